"""Contract checks, reconciliations and coverage reports. A check is an aggregate that returns violations as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions import count_if, finite, month_index, quantiles, ratio
from panelmill.sources.contracts import CONTRACTS, KINDS, Contract

VIOLATION = "rule string, column string, n long"


def schema_violations(df: DataFrame, contract: Contract) -> list[tuple[str, str, int]]:
    """Missing columns and wrong kinds, from the schema alone."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = [("missing_column", c.name, 1) for c in contract.columns if c.required and c.name not in types]
    out += [("missing_column", k, 1) for k in contract.keys if k not in types and k not in {c.name for c in contract.columns}]
    out += [("kind", c.name, 1) for c in contract.columns if c.name in types and not isinstance(types[c.name], KINDS[c.kind])]
    for prefix, (kind, least) in contract.prefixes.items():
        found = [n for n in types if n.startswith(prefix)]
        if len(found) < least:
            out.append(("prefix_count", prefix, len(found)))
        out += [("kind", n, 1) for n in found if not isinstance(types[n], KINDS[kind])]
    return out


def value_rules(df: DataFrame, contract: Contract) -> dict[tuple[str, str], Column]:
    """(rule, column) -> counting expression; all of them fit one aggregate."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rules: dict[tuple[str, str], Column] = {("empty", "*"): F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)}
    for c in contract.columns:
        if c.name not in types or not isinstance(types[c.name], KINDS[c.kind]):
            continue
        v = F.col(c.name)
        missing = v.isNull() | F.isnan(v) if isinstance(types[c.name], (T.DoubleType, T.FloatType)) else v.isNull()
        if not c.nullable:
            rules["null", c.name] = count_if(missing)
        if c.lo is not None:
            rules["below_minimum", c.name] = count_if(~missing & (v < c.lo - 1e-9))
        if c.hi is not None:
            rules["above_maximum", c.name] = count_if(~missing & (v > c.hi + 1e-9))
        if c.allowed is not None:
            rules["not_allowed", c.name] = count_if(~missing & ~v.isin(*c.allowed))
        if c.kind == "date":
            rules["not_month_end", c.name] = count_if(v.isNotNull() & (v.cast("date") != F.last_day(v)))
    if contract.complete_when and contract.complete_when[0] in types:
        flag, cols = contract.complete_when
        for name in cols:
            if name in types:
                rules["incomplete", name] = count_if(F.col(flag) & F.col(name).isNull())
    for prefix, bound in contract.prefix_bound.items():
        for name in (n for n in types if n.startswith(prefix)):
            rules["out_of_bound", name] = count_if(F.abs(F.col(name)) > bound + 1e-6)
    return rules


def violations(df: DataFrame, contract: str | Contract) -> DataFrame:
    """Broken rules as (rule, column, n): one aggregate for values, one for key uniqueness."""
    c = CONTRACTS[contract] if isinstance(contract, str) else contract
    spark = df.sparkSession
    static = spark.createDataFrame(schema_violations(df, c), VIOLATION)
    rules = value_rules(df, c)
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(n).alias("column"), e.cast("long").alias("n")) for (r, n), e in rules.items()])
    found = df.agg(cells.alias("v")).select(F.inline("v"))
    out = static.unionByName(found)
    if c.keys and all(k in df.columns for k in c.keys):
        dup = duplicate_keys(df, c.keys).select(F.lit("duplicate_key").alias("rule"), F.lit(",".join(c.keys)).alias("column"), "n")
        out = out.unionByName(dup)
    return out.filter("n > 0 OR rule = 'prefix_count'")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("n"))


def reconcile_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys missing from ``b``, unexpected in ``b`` and repeated rows of each side. One grouped pass over both sides."""
    k = list(keys)
    both = a.select(*k, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*k, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    per_key = both.groupBy(*k).agg(F.sum("__a").alias("na"), F.sum("__b").alias("nb"))
    return per_key.agg(
        count_if((F.col("na") > 0) & (F.col("nb") > 0)).alias("matched"), count_if(F.col("nb") == 0).alias("missing"),
        count_if(F.col("na") == 0).alias("unexpected"),
        F.sum(F.greatest(F.col("na") - 1, F.lit(0))).cast("long").alias("duplicate_left"),
        F.sum(F.greatest(F.col("nb") - 1, F.lit(0))).cast("long").alias("duplicate_right"),
    )


def compare_columns(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], atol: float = 1e-12, rtol: float = 0.0) -> DataFrame:
    """Per column over matched keys: null mismatches, values out of tolerance, largest absolute difference."""
    right = b.select(*keys, *[F.col(c).alias(f"{c}__b") for c in cols])
    joined = a.select(*keys, *cols).join(right, list(keys))
    cells = []
    for c in cols:
        x, y = F.col(c), F.col(f"{c}__b")
        diff = F.abs(x - y)
        cells.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).cast("long").alias("rows"),
            count_if(x.isNull() != y.isNull()).alias("null_mismatch"),
            count_if(F.coalesce(diff > atol + rtol * F.abs(y), F.lit(False))).alias("out_of_tolerance"), F.max(diff).alias("max_abs_diff"),
        ))
    return joined.agg(F.array(*cells).alias("v")).select(F.inline("v"))


def disjoint_ids(df: DataFrame, *, id: str, group: str) -> DataFrame:
    """Ids that occur in more than one group."""
    return df.groupBy(id).agg(F.count_distinct(group).cast("long").alias("n_groups"), F.min(group).alias("first_group")).filter("n_groups > 1")


def crosswalk_conflicts(df: DataFrame, left: str, right: str) -> DataFrame:
    """Ids of either side that map to several ids of the other."""
    pairs = df.select(left, right).distinct()

    def side(a: str, b: str) -> DataFrame:
        return pairs.groupBy(F.col(a).cast("string").alias("id")).agg(F.count(F.lit(1)).cast("long").alias("partners")).filter("partners > 1").select(
            F.lit(a).alias("side"), "id", "partners"
        )

    return side(left, right).unionByName(side(right, left))


def spans(df: DataFrame, *, id: str, date: str, flag: str) -> DataFrame:
    """First, last and number of months of each id, over all rows and over flagged rows."""
    f = F.col(flag)
    return df.groupBy(id).agg(
        F.min(date).alias("first_month"), F.max(date).alias("last_month"), F.count(F.lit(1)).cast("long").alias("months"),
        F.min(F.when(f, F.col(date))).alias("first_flagged"), F.max(F.when(f, F.col(date))).alias("last_flagged"), count_if(f).alias("flagged_months"),
    )


def revisions(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float = 1e-8) -> DataFrame:
    """Rows added, removed or changed between two vintages."""
    k = list(keys)
    left = a.select(*k, *[F.col(c).alias(f"{c}_old") for c in cols], F.lit(True).alias("__a"))
    right = b.select(*k, *[F.col(c).alias(f"{c}_new") for c in cols], F.lit(True).alias("__b"))
    changed = F.lit(False)
    for c in cols:
        x, y = F.col(f"{c}_old"), F.col(f"{c}_new")
        changed = changed | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol, F.lit(False))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(changed, "changed")
    return left.join(right, k, "full_outer").withColumn("status", status).filter("status IS NOT NULL").drop("__a", "__b")


def identities(df: DataFrame, exprs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Per identity: comparable rows and relative error of left against right."""
    cells = []
    for name, (lhs, rhs) in exprs.items():
        err = F.abs(ratio(lhs - rhs, rhs))
        cells.append(F.struct(
            F.lit(name).alias("identity"), F.count(err).cast("long").alias("n"), F.max(err).alias("max_rel_error"),
            count_if(F.coalesce(err > 1e-9, F.lit(False))).alias("broken"),
        ))
    return df.agg(F.array(*cells).alias("v")).select(F.inline("v"))


def coverage(df: DataFrame, by: Sequence[str], flags: Sequence[str], *, rollup: bool = True) -> DataFrame:
    """Counts and rates of boolean flags by group, with subtotals when ``rollup``."""
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    aggs = [F.count(F.lit(1)).cast("long").alias("rows")]
    for f in flags:
        aggs += [count_if(F.col(f)).alias(f"n_{f}"), (count_if(F.col(f)) / F.count(F.lit(1))).alias(f"rate_{f}")]
    return grouped.agg(*aggs)


def security_profile(
    daily: DataFrame, windows: DataFrame, *, id: str, date: str, start: str, end: str, close: str, volume: str, ohlc: Sequence[str],
    status: str, currency: str,
) -> DataFrame:
    """Per requested security: row counts by kind over its own date window, first and last day, distinct codes."""
    inside = windows.join(daily, id, "left").withColumn("__in", F.coalesce(F.col(date).between(F.col(start), F.col(end)), F.lit(False)))
    yes = F.col("__in")
    full = yes
    for c in ohlc:
        full = full & F.col(c).isNotNull()
    codes = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(yes, F.col(c).cast("string")))), "|")  # noqa: E731 (few codes)
    return inside.groupBy(id, start, end).agg(
        count_if(yes).alias("daily_rows"), count_if(yes & F.col(close).isNotNull()).alias("close_rows"),
        count_if(yes & F.col(volume).isNotNull()).alias("volume_rows"), count_if(full).alias("ohlc_rows"),
        count_if(yes & F.col(status).isin(3, 4, 10)).alias("actual_rows"), count_if(yes & (F.col(status) == 5)).alias("carried_rows"),
        F.min(F.when(yes, F.col(date))).alias("first_daily"), F.max(F.when(yes, F.col(date))).alias("last_daily"),
        codes(currency).alias("currencies"), codes(status).alias("statuses"),
    )


def hierarchy_check(df: DataFrame, *, value: str, label: str, sources: Mapping[str, str], tol: float = 1e-12) -> DataFrame:
    """Rows whose label names another source than the one whose value was used."""
    agrees = F.when(F.col(label) == "MISSING", F.col(value).isNull() & F.lit(True))
    for column, name in sources.items():
        agrees = agrees.when(F.col(label) == name, F.col(column).isNotNull() & (F.abs(F.col(column) - F.col(value)) <= tol))
    bad = ~F.coalesce(agrees, F.lit(False))
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("rows"), count_if(bad).alias("mismatched"))


def outliers(monthly: DataFrame, daily: DataFrame, *, id: str, month: str, value: str, date: str, ret: str, limit: float, n: int = 21) -> DataFrame:
    """Flagged months rebuilt from raw rows: statistic over the last ``n`` rows up to month end, and the largest shock day."""
    flagged = monthly.filter(F.col(value) >= limit).select(id, month, value)
    raw = daily.select(id, F.col(date), F.col(ret))
    # each flagged month needs at most the rows of its own and the preceding months; equal ids only, then the date range
    near = flagged.join(raw, id).filter(F.col(date) <= F.col(month))
    w = Window.partitionBy(id, month).orderBy(F.col(date).desc())
    last = near.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return last.groupBy(id, month, value).agg(
        F.stddev_samp(ret).alias("rebuilt"), F.count(ret).cast("long").alias("n"),
        F.max_by(date, F.struct(F.abs(ret), F.col(date))).alias("shock_day"), F.max(F.abs(ret)).alias("shock"),
    )


def quantile_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, min, p01, p50, p99 and max with linear interpolation."""
    return quantiles(df, list(by), value, {"q_min": 0.0, "p01": 0.01, "p50": 0.5, "p99": 0.99, "q_max": 1.0})


def unbalanced(df: DataFrame, *, date: str, unit: str) -> DataFrame:
    """Dates on which some unit of the whole table is absent, and which ones. Units are design cells: few."""
    units = df.select(unit).distinct().agg(F.sort_array(F.collect_set(unit)).alias("__all"))
    seen = df.groupBy(date).agg(F.collect_set(unit).alias("__seen"))
    out = seen.join(F.broadcast(units), F.lit(True)).withColumn("absent", F.array_except("__all", "__seen"))  # one-row side
    return out.filter(F.size("absent") > 0).select(date, F.size("absent").cast("long").alias("n_absent"), F.array_join("absent", "|").alias("absent"))


def dense_months(df: DataFrame, month: str, out: str = "mi") -> DataFrame:
    """Attach the position of each month among the months that exist."""
    order = df.select(month).distinct().withColumn(out, F.row_number().over(Window.orderBy(month)).cast("long"))
    return df.join(order, month)


def membership_flows(df: DataFrame, *, id: str, month: str) -> DataFrame:
    """Per month: members, entries, exits, exits for good and exits with a later return."""
    rows = dense_months(df.select(id, month).distinct(), month)
    last = rows.agg(F.max("mi").alias("__last"))
    w = Window.partitionBy(id).orderBy("mi")
    marked = rows.select(
        month, "mi",
        (~F.col("mi").eqNullSafe(F.lag("mi").over(w) + 1)).alias("enters"),
        (~F.col("mi").eqNullSafe(F.lead("mi").over(w) - 1)).alias("leaves"), F.lead("mi").over(w).isNull().alias("final"),
    )
    g = marked.groupBy(month, "mi").agg(
        F.count(F.lit(1)).cast("long").alias("n"), count_if(F.col("enters")).alias("entries"), count_if(F.col("leaves")).alias("exits"),
        count_if(F.col("leaves") & F.col("final")).alias("exits_permanent"),
    )
    g = g.join(F.broadcast(last), F.lit(True))  # one-row side
    inner = F.col("mi") < F.col("__last")
    return g.select(
        month, "n", F.when(F.col("mi") > 1, F.col("entries")).alias("entries"), F.when(inner, F.col("exits")).alias("exits"),
        F.when(inner, F.col("exits_permanent")).alias("exits_permanent"),
        F.when(inner, F.col("exits") - F.col("exits_permanent")).alias("exits_with_return"),
    )


def panel_coverage(base: DataFrame, others: Mapping[str, DataFrame], *, keys: Sequence[str], month: str) -> DataFrame:
    """Per month: rows of the base panel, and how many of them each other panel has."""
    out = base
    for name, other in others.items():
        out = out.join(other.select(*keys).distinct().withColumn(f"__{name}", F.lit(True)), list(keys), "left")
    return out.groupBy(month).agg(
        F.count(F.lit(1)).cast("long").alias("rows"), *[count_if(F.col(f"__{n}").isNotNull()).alias(f"in_{n}") for n in others]
    )


def held_losses(book: DataFrame, panel: DataFrame, others: Mapping[str, DataFrame], *, by: Sequence[str], id: str, month: str) -> DataFrame:
    """Per book month: names held, names absent from the panel's next month (for good or not), names other panels lack."""
    rows = dense_months(panel.select(id, month).distinct(), month)
    w = Window.partitionBy(id).orderBy("mi")
    life = rows.select(
        id, month, "mi", (F.lead("mi").over(w) == F.col("mi") + 1).alias("__stays"), F.lead("mi").over(w).isNull().alias("__final")
    )
    last = rows.agg(F.max("mi").alias("__last"))
    held = book.filter(F.col("w") != 0).select(*by, id, month).join(life, [id, month], "left")
    for name, other in others.items():
        held = held.join(other.select(id, F.col(month)).distinct().withColumn(f"__{name}", F.lit(True)), [id, month], "left")
    held = held.join(F.broadcast(last), F.lit(True))  # one-row side
    inner = F.col("mi") < F.col("__last")
    gone = inner & ~F.coalesce("__stays", F.lit(False))
    return held.groupBy(*by, month).agg(
        F.count(F.lit(1)).cast("long").alias("n_held"), count_if(F.col("mi").isNull()).alias("n_not_in_panel"),
        count_if(F.coalesce(gone, F.lit(False))).alias("n_not_next"), count_if(F.coalesce(gone & F.col("__final"), F.lit(False))).alias("n_not_next_permanent"),
        *[count_if(F.col(f"__{n}").isNull()).alias(f"n_not_in_{n}") for n in others],
    )


def first_loss(losses: DataFrame, *, by: Sequence[str], month: str) -> DataFrame:
    return losses.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("months"), F.min(F.when(F.col("n_not_next") > 0, F.col(month))).alias("first_month")
    )


def gap_runs(df: DataFrame, *, id: str, month: str, ok: str, carry: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of consecutive unusable months of each id, how each ends, and whether ``carry`` flags hold throughout."""
    w = Window.partitionBy(id).orderBy("mi")
    rows = df.withColumn("mi", month_index(month)).withColumn("__ok", F.coalesce(F.col(ok), F.lit(False)))
    rows = rows.select(
        "*", F.lead("mi").over(w).alias("__nm"), F.lead("__ok").over(w).alias("__nok"), F.lag("mi").over(w).alias("__pm"), F.lag("__ok").over(w).alias("__pok")
    )
    bad = rows.filter(~F.col("__ok"))
    runs = bad.withColumn("__run", F.col("mi") - F.row_number().over(w))
    at_end = lambda c: F.max_by(c, "mi")
    at_start = lambda c: F.min_by(c, "mi")
    g = runs.groupBy(id, "__run").agg(
        F.count(F.lit(1)).cast("long").alias("run_len"), F.min(month).alias("first_month"), F.max(month).alias("last_month"),
        at_end(F.struct("mi", "__nm", "__nok")).alias("e"), at_start(F.struct("mi", "__pm", "__pok")).alias("s"),
        *[F.min(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(f"__all_{c}") for c in carry],
    )
    adjacent = F.coalesce(F.col("e.__nm") == F.col("e.mi") + 1, F.lit(False))
    ends = F.when(adjacent & F.col("e.__nok"), "recovers").when(adjacent, "next_unusable").otherwise("no_next_row")
    before = F.coalesce((F.col("s.__pm") == F.col("s.mi") - 1) & F.col("s.__pok"), F.lit(False))
    return g.select(
        id, "first_month", "last_month", "run_len", ends.alias("ends"), before.alias("usable_before"),
        *[(F.col(f"__all_{c}") == 1).alias(f"all_{c}") for c in carry],
    )


def gap_buckets(runs: DataFrame, flags: Sequence[str]) -> DataFrame:
    n = F.col("run_len")
    bucket = F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 12, "4-12").otherwise(">12")
    return runs.groupBy(bucket.alias("bucket"), *flags).agg(F.count(F.lit(1)).cast("long").alias("n_runs"))


def gap_span_join(runs: DataFrame, spans: DataFrame, *, id: str, first: str, last: str) -> DataFrame:
    """Gap runs against the vendor's first and last day of the security."""
    j = runs.join(spans, id, "left")
    place = (
        F.when(F.col(first).isNull(), "no_vendor_rows").when(F.col("last_month") < F.col(first), "before_vendor_start")
        .when(F.col("first_month") > F.col(last), "after_vendor_end").otherwise("inside_vendor_span")
    )
    return j.groupBy(place.alias("place"), "ends").agg(
        F.count(F.lit(1)).cast("long").alias("n_runs"), F.count_distinct(id).cast("long").alias("n_ids"),
        F.count_distinct(F.when(F.col("run_len") > 1, F.col(id))).cast("long").alias("n_ids_long"),
    )


def flag_crosstab(df: DataFrame, flags: Sequence[str], *, cube: bool = False) -> DataFrame:
    grouped = df.cube(*flags) if cube else df.groupBy(*flags)
    return grouped.agg(F.count(F.lit(1)).cast("long").alias("n"))


def row_position(df: DataFrame, *, id: str, month: str, ok: str) -> DataFrame:
    """Where unusable rows sit in a name's life."""
    life = df.groupBy(id).agg(F.max(month).alias("__last"), F.max(F.when(F.col(ok), F.col(month))).alias("__last_ok"))
    bad = df.filter(~F.coalesce(F.col(ok), F.lit(False))).join(life, id)
    place = (
        F.when(F.col(month) == F.col("__last"), "last_row").when(F.col("__last_ok") > F.col(month), "later_usable").otherwise("no_later_usable")
    )
    return bad.groupBy(place.alias("position")).agg(F.count(F.lit(1)).cast("long").alias("rows"), F.count_distinct(id).cast("long").alias("ids"))


SUPPORT_FLAGS = ("target", "priced", "usable", "dividend", "member", "costed", "certified")
_SUPPORT_OUT = (
    "book string, m date, n_target long, n_carried long, n_frozen_uncosted long, n_frozen_uncertified long, n_new_absent long, "
    "n_new_unusable long, n_unresolved long, n_cost_gap long, n_dividend_gap long"
)


def _support_names(pdf: pd.DataFrame) -> pd.DataFrame:
    """State machine of many names at once: rows are months, columns names."""
    months = np.sort(pdf["m"].unique())
    wide = {f: pdf.pivot(index="m", columns="id", values=f).reindex(months).to_numpy() == True for f in SUPPORT_FLAGS}  # noqa: E712
    n = wide["target"].shape[1]
    carried, lost = np.zeros(n, bool), np.zeros(n, bool)
    rows = []
    for i, m in enumerate(months):
        f = {k: v[i] for k, v in wide.items()}
        gone, silent = carried & ~f["priced"], carried & f["priced"] & ~f["usable"]
        sound = carried & f["usable"] & f["priced"]
        uncosted = sound & ~(f["costed"] & f["member"])
        uncertified = sound & ~uncosted & ~f["certified"]
        lost = lost | gone | silent
        fresh = f["target"] & ~lost & ~carried
        gone2, silent2 = fresh & ~f["priced"], fresh & f["priced"] & ~f["usable"]
        lost = lost | gone2 | silent2
        frozen = uncosted | uncertified
        live = f["target"] & ~lost
        held = live | frozen
        entry = live & ~carried & ~frozen
        counts = (
            f["target"], carried, uncosted, uncertified, gone | gone2, silent | silent2, lost, entry & ~f["certified"],
            held & f["priced"] & ~f["dividend"],
        )
        rows.append((pdf["book"].iat[0], m, *(int(c.sum()) for c in counts)))
        carried = held & ~lost
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _SUPPORT_OUT.split(", ")])


def support_simulation(rows: DataFrame, *, names_per_task: int = 256) -> DataFrame:
    """Month by month: names carried, frozen and unresolved (for good) in each book.

    ``rows`` holds (book, id, m) on every month of the book with the boolean flags. A name's state never depends on
    another name, so a book is cut into bundles of names that run in parallel, and the counts are added up.
    """
    counts = [c.split()[0] for c in _SUPPORT_OUT.split(", ")][2:]
    size = rows.groupBy("book").agg(F.approx_count_distinct("id").alias("__n"))
    cut = rows.join(size, "book").withColumn(
        "__part", F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.col("__n") / names_per_task), F.lit(1)))
    )
    parts = cut.groupBy("book", "__part").applyInPandas(_support_names, _SUPPORT_OUT)
    return (
        parts.groupBy("book", "m").agg(*[F.sum(c).cast("long").alias(c) for c in counts])
        .withColumn("valuation_unresolved", F.col("n_unresolved") > 0)
        .withColumn("cost_unsupported", F.col("n_cost_gap") > 0)
        .withColumn("dividend_unsupported", F.col("n_dividend_gap") > 0)
    )


def support_shares(sim: DataFrame, *, by: Sequence[str] = ("book",)) -> DataFrame:
    """Share of months unsupported for each metric, counted once, with a tier label."""
    v, c, d = (F.col(x) for x in ("valuation_unresolved", "cost_unsupported", "dividend_unsupported"))
    share = lambda e: F.avg(F.coalesce(e, F.lit(False)).cast("double"))
    wide = sim.groupBy(*by).agg(share(v).alias("gross"), share(v | c).alias("net"), share(v | c | d).alias("after_tax"))
    long = wide.unpivot([F.col(b) for b in by], ["gross", "net", "after_tax"], "metric", "share")
    x = F.col("share")
    tier = F.when(x == 0, "0%").when(x <= 0.05, "(0,5%]").when(x <= 0.25, "(5%,25%]").otherwise(">25%")
    return long.withColumn("tier", tier)


def attach_quality(results: DataFrame, manifest: DataFrame, *, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """Results with the latest recorded construction quality of each strategy."""
    from panelmill.sources.io import latest_per_key

    complete = manifest.select(key, order, *cols).dropna(subset=list(cols))
    return results.join(latest_per_key(complete, [key], [order]).drop(order), key, "left")


def usable(*cols: str) -> Column:
    out = finite(cols[0])
    for c in cols[1:]:
        out = out & finite(c)
    return out

