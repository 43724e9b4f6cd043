"""Ranks, order statistics and group moments that keep working when one group is huge.

A window partitioned by month puts a whole cross-section in one task. So groups of more than ``CELL`` rows are cut into cells of about that
many consecutive rows, at keys from a sample that a hash picks; a smaller group is one cell. Rows are ranked inside their cell, and the number
of rows in lower cells is added. Where cuts fall only decides the sizes of cells, never a rank. The cuts are one array for each large group,
so there is one entry for every ``CELL`` rows, and they are broadcast; where no group is large their plan is empty. An input that is more than a scan is written once, as it is read for the counts, the cuts
and the ranks; rows are carried through.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 50_000
#: Sampled keys for each cut.
PER_CUT = 16


def _once(df: DataFrame) -> DataFrame:
    """``df`` if reading it again is a scan; otherwise what it gives, written to the shared folder."""
    from panelmill.sources.io import written

    plan = df._jdf.queryExecution().analyzed().toString()
    return written(df, "rows") if re.search(r"\b(Join|Aggregate|Window|Sort|Generate|Union|MapIn\w+|FlatMap\w+|Repartition\w*)\b", plan) else df


def _null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's key copies are dropped."""
    renamed = right
    for i, k in enumerate(by):
        renamed = renamed.withColumnRenamed(k, f"__k{i}")
    cond = F.lit(True)
    for i, k in enumerate(by):
        cond = cond & left[k].eqNullSafe(renamed[f"__k{i}"])
    return left.join(renamed, cond, how).drop(*[f"__k{i}" for i in range(len(by))])


def every(a: Column, n: int) -> Column:
    """Each n-th entry of an array."""
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(n), F.size(a), F.lit(n)), lambda i: F.element_at(a, i))).otherwise(F.slice(a, 1, 0))


def _cells(rows: DataFrame, by: Sequence[str], keys: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Add for each output of ``keys`` the cell of its key columns; where the first of them is missing it is null. Small groups have cell 0."""
    key = {out: F.struct(*cols) for out, cols in keys.items()}
    hot = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__all")).where(F.col("__all") > CELL).select(*by, F.lit(True).alias("__hot"))
    picked = {out: (F.pmod(F.xxhash64(*cols), F.lit(max(CELL // PER_CUT, 1))) == 0) & cols[0].isNotNull() for out, cols in keys.items()}
    sample = rows.where(_any(picked.values()))
    lists = [F.sort_array(F.collect_list(F.when(picked[out], key[out]))).alias(out) for out in keys]
    cuts = _null_safe_join(sample, F.broadcast(hot), by).groupBy(*by).agg(*lists)
    cuts = cuts.select(*by, *[every(F.col(out), PER_CUT).alias(f"__q_{out}") for out in keys])
    # the steps of a binary search: powers of two, down from the largest that the number of cuts has
    halves = lambda q: F.transform(F.sequence(F.length(F.bin(F.size(q))) - 1, F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    cuts = cuts.select("*", *[halves(F.col(f"__q_{out}")).alias(f"__s_{out}") for out in keys])
    # a cut stands for CELL rows, so cuts are sent to the rows: a join by group would put a whole group in one task
    found = _null_safe_join(rows, F.broadcast(cuts), by, "left")
    for out, cols in keys.items():
        cell = _below(F.col(f"__q_{out}"), F.col(f"__s_{out}"), key[out])
        found = found.withColumn(out, F.when(cols[0].isNotNull(), F.when(F.col(f"__q_{out}").isNull(), 0).otherwise(cell)))
    return found.drop(*[f"__{x}_{out}" for x in "qs" for out in keys])


def _below(cuts: Column, steps: Column, key: Column) -> Column:
    """Number of the sorted ``cuts`` that are below ``key``, by binary search in ``steps``; ``key`` is built once a row."""
    near = lambda k: lambda pos, step: F.when((pos + step <= F.size(cuts)) & (F.get(cuts, pos + step - 1) < k), pos + step).otherwise(pos)
    place = lambda k: F.aggregate(steps, F.lit(0), near(k))
    return F.get(F.transform(F.array(key), place), 0)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def row_ranks(df: DataFrame, by: Sequence[str], columns: Mapping[str, str], tie: str, *, desc: bool = False, counts: str = "") -> DataFrame:
    """1-based position of each column's value by (value, tie) inside its group, for several columns at once (column -> output).

    Missing values have no rank. With ``counts``, the number of present values is added as output + counts.
    """
    by, names = list(by), list(columns)
    rows = _cells(_once(df), by, {f"__b{i}": [-F.col(c) if desc else F.col(c), F.col(tie)] for i, c in enumerate(names)})
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__b{i}").alias("b")) for i in range(len(names))])
    sized = rows.select(*by, F.explode(entries).alias("c")).where("c.b is not null").groupBy(*by, "c.i", "c.b").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*by, "i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.select(*by, "i", "b", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("v"), F.sum("__n").over(Window.partitionBy(*by, "i")).alias("n"))
    each = [F.map_from_entries(F.collect_list(F.when(F.col("i") == i, F.struct("b", "v")))).alias(f"__m{i}") for i in range(len(names))]
    maps = sized.groupBy(*by).agg(*each, *[F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"__n{i}") for i in range(len(names))])
    rows = _null_safe_join(rows, maps, by, "left")
    # the sorts below take one number a column along, not the maps of all cells
    rows = rows.withColumns({f"__o{i}": F.element_at(f"__m{i}", F.col(f"__b{i}")) for i in range(len(names))}).drop(*(f"__m{i}" for i in range(len(names))))
    for i, c in enumerate(names):
        key = F.col(c).desc() if desc else F.col(c).asc()
        local = F.row_number().over(Window.partitionBy(*by, f"__b{i}").orderBy(key, F.col(tie)))
        rows = rows.withColumn(f"__r{i}", F.when(F.col(c).isNotNull(), (local + F.col(f"__o{i}")).cast("long"))).drop(f"__o{i}", f"__b{i}")
        if counts:
            rows = rows.withColumn(columns[c] + counts, F.coalesce(f"__n{i}", F.lit(0)).cast("long")).drop(f"__n{i}")
    for i, c in enumerate(names):
        rows = rows.withColumn(columns[c], F.col(f"__r{i}"))
    return rows.drop(*(f"__{x}{i}" for i in range(len(names)) for x in "nr"))


def row_rank(df: DataFrame, by: Sequence[str], order: str, tie: str, out: str = "rank", *, desc: bool = False, counts: str = "") -> DataFrame:
    """``row_ranks`` of one column."""
    return row_ranks(df, by, {order: out}, tie, desc=desc, counts=counts)


def _distinct_values(df: DataFrame, by: Sequence[str], order: str, weight: Column) -> DataFrame:
    """Distinct values of each group with ``__n`` (their summed weight), ``__first`` (weight of smaller values) and ``__sum`` (of all)."""
    cells = _cells(_once(df.groupBy(*by, order).agg(weight.alias("__n"))), by, {"__b": [F.col(order)]})
    totals = cells.groupBy(*by, "__b").agg(F.sum("__n").alias("__w"))
    run = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("__off", F.sum("__w").over(run) - F.col("__w")).withColumn("__sum", F.sum("__w").over(Window.partitionBy(*by))).drop("__w")
    inside = Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = _null_safe_join(cells, totals, [*by, "__b"])
    return placed.withColumn("__first", F.col("__off") + F.sum("__n").over(inside) - F.col("__n")).drop("__off", "__b")


def _mean_rank() -> Column:
    return F.col("__first") + (F.col("__n") + 1) / 2.0


def avg_rank(df: DataFrame, by: Sequence[str], order: str, out: str = "rank") -> DataFrame:
    """Rank with ties sharing the mean position (the Spearman rank). ``order`` must not be null."""
    by, rows = list(by), _once(df)
    ranks = _distinct_values(rows, by, order, F.count(F.lit(1))).select(*by, order, _mean_rank().alias(out))
    return _null_safe_join(rows, ranks, [*by, order])


def group_stats(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row. They are summed within tasks and written, so that Spark knows their size: few are broadcast and no row is shuffled."""
    from panelmill.sources.io import written

    by = list(by)
    return _null_safe_join(df, written(df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]), "stats"), by)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, plus the count ``n``; from ranks of the distinct values."""
    by = list(by)
    values = _distinct_values(df.filter(F.col(value).isNotNull()), by, value, F.count(F.lit(1)))
    first, last = F.col("__first") + 1, F.col("__first") + F.col("__n")
    exprs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__sum") - 1)
        at = lambda k: F.max(F.when((first <= k) & (k <= last), F.col(value)))
        low, high = at(F.floor(pos) + 1), at(F.ceil(pos) + 1)
        exprs.append((low + F.max(pos - F.floor(pos)) * (high - low)).alias(name))
    return values.groupBy(*by).agg(F.max("__sum").cast("long").alias("n"), *exprs)


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str, out: str = "wmedian") -> DataFrame:
    """Smallest value at which the running weight share reaches one half."""
    by = list(by)
    values = _distinct_values(df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)), by, value, F.sum(weight))
    reached = values.filter(F.col("__first") + F.col("__n") >= F.col("__sum") / 2 * (1 - 1e-12))
    return reached.groupBy(*by).agg(F.min(value).alias(out))
