"""Cross-sectional transforms of one month, and the joins that assemble a design panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import clip, finite, group_stats, month_index, positive, ratio, row_rank, spearman
from panelmill.functions.ranking import _null_safe_join, row_ranks


def xs_rank(df: DataFrame, value: str, *, by: Sequence[str], id: str, out: str) -> DataFrame:
    """Rank to [-0.5, 0.5] with missing values kept missing; ties in id order. A lone value maps to -0.5."""
    ranked = row_ranks(df, by, {value: "__x"}, id, counts="_n")
    return ranked.withColumn(out, (F.col("__x") - 1) / F.greatest(F.col("__x_n") - 1, F.lit(1)) - 0.5).drop("__x", "__x_n")


def xs_rank_many(df: DataFrame, values: Sequence[str], *, by: Sequence[str], id: str) -> DataFrame:
    """``xs_rank`` of several columns in place, from one pass of cuts and one of counts for all of them."""
    ranked = row_ranks(df, by, {v: f"__x{v}" for v in values}, id, counts="_n")
    shares = {v: ((F.col(f"__x{v}") - 1) / F.greatest(F.col(f"__x{v}_n") - 1, F.lit(1)) - 0.5) for v in values}
    return ranked.select(*[shares[c].alias(c) if c in shares else F.col(c) for c in df.columns])


def xs_z(
    df: DataFrame, value: str, *, by: Sequence[str], out: str, ddof: int, bound: float | None = None, missing_zero: bool = False,
) -> DataFrame:
    """Standardise inside each month; a spread below 1e-12 gives zero."""
    sd = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    st = group_stats(df, by, __mu=F.avg(value), __sd=sd)
    # a month whose values are all equal carries no information
    z = F.when(F.col("__sd") > 1e-12, (F.col(value) - F.col("__mu")) / F.col("__sd")).when(F.col(value).isNotNull(), 0.0)
    if bound is not None:
        z = clip(z, -bound, bound)
    if missing_zero:
        z = F.coalesce(z, F.lit(0.0))
    return st.withColumn(out, z).drop("__mu", "__sd")


def demean(df: DataFrame, value: str, *, by: Sequence[str], out: str) -> DataFrame:
    st = group_stats(df, by, __mu=F.avg(value))
    return st.withColumn(out, F.col(value) - F.col("__mu")).drop("__mu")


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the columns that are present; null when none is."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0)))
    n = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    return ratio(total, n)


def theme_composites(df: DataFrame, themes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean of the available signals of each theme, as ``theme_*`` columns; no reshape, so no shuffle."""
    return df.select("*", *[row_mean(list(s)).alias(f"theme_{t}") for t, s in themes.items()])


def interactions(df: DataFrame, states: DataFrame, *, on: Sequence[str], themes: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Join the monthly states and multiply every theme by every state."""
    joined = df.join(states, list(on), "left")
    return joined.select("*", *[(F.col(t) * F.col(s)).alias(f"{t}_x_{s}") for t in themes for s in names])


def build_design(members: DataFrame, signals: DataFrame, targets: DataFrame, costs: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Members with signals (inner), targets and cost inputs (left), all on the same keys."""
    k = list(keys)
    return members.join(signals, k).join(targets, k, "left").join(costs, k, "left")


def forward_returns(df: DataFrame, *, id: str, month: str, ret: str, horizons: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """Next month's return, and sums over the next months when every one of them exists."""
    w = Window.partitionBy(id).orderBy(month)
    idx = month_index(month)
    out = [F.when(F.lead(idx).over(w) - idx == 1, F.lead(ret).over(w)).alias("r_1m")]
    for h in horizons:
        ahead = Window.partitionBy(id).orderBy("__i").rangeBetween(1, h)
        out.append(F.when(F.count(ret).over(ahead) == h, F.sum(ret).over(ahead)).alias(f"r_{h}m"))
    return df.withColumn("__i", idx).select(*df.columns, *out)


def breadth_cap(df: DataFrame, n: int, *, month: str, id: str, size: str, flag: str = "in_universe") -> DataFrame:
    """Keep the flag only on the ``n`` largest priced members of each month; rows stay."""
    priced = df.filter(F.col(flag) & F.col(size).isNotNull()).select(month, id, size)
    top = row_rank(priced, [month], size, id, "__r", desc=True).filter(F.col("__r") <= n).select(month, id, F.lit(True).alias("__keep"))
    return df.join(top, [month, id], "left").withColumn(flag, F.coalesce("__keep", F.lit(False))).drop("__keep")


def tradeable(spread="spread", sigma="sigma_d", adv="adv_usd") -> Column:
    """Missing market inputs mean the name cannot trade; nothing is imputed."""
    return (
        finite(spread) & finite(sigma) & finite(adv)
        & F.coalesce(F.col(spread) >= 0, F.lit(False)) & F.coalesce(F.col(sigma) >= 0, F.lit(False)) & F.coalesce(F.col(adv) > 0, F.lit(False))
    )


def split_book(prev: DataFrame, alive: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Last month's positions as tradeable, frozen (alive without usable inputs) or exited."""
    state = alive.select(*keys, tradeable().alias("__ok"))
    return (
        prev.join(state, list(keys), "left")
        .withColumn("status", F.when(F.col("__ok").isNull(), "exited").when(F.col("__ok"), "tradeable").otherwise("frozen"))
        .drop("__ok")
    )


def book_costs(book: DataFrame, inputs: DataFrame, *, keys: Sequence[str], proxy: float) -> DataFrame:
    """Cost inputs of a book with a labelled borrow proxy; missing market inputs are flagged, never filled."""
    joined = book.join(inputs, list(keys), "left")
    return joined.select(
        *book.columns, "spread", "sigma_d", "adv_usd",
        F.coalesce("borrow_fee", F.lit(proxy)).alias("borrow_fee"),
        F.when(F.col("borrow_fee").isNull(), "proxy").otherwise("observed").alias("borrow_source"),
        F.coalesce(~tradeable(), F.lit(True)).alias("violation"),
    )


def rank_bins(
    df: DataFrame, value: str, *, by: Sequence[str], id: str, k: int = 3, min_n: int = 1, out: str = "bin"
) -> DataFrame:
    """1..k bins at the quantile edges of the first-come rank. Quantile cuts are not equal-count tiles."""
    rows = df.filter(F.col(value).isNotNull())
    ranked = row_rank(rows, by, value, id, "__r")
    ranked = group_stats(ranked, by, __n=F.count(F.lit(1)))
    # smallest b with k*(r-1) <= b*(n-1), in integers
    exact = sum(((F.col("__r") - 1) * k > (F.col("__n") - 1) * F.lit(j)).cast("int") for j in range(1, k)) + F.lit(1)
    return ranked.filter(F.col("__n") >= min_n).withColumn(out, exact.cast("int")).drop("__r", "__n")


def xs_residual(df: DataFrame, *, y: str, x: str, by: Sequence[str], out: str) -> DataFrame:
    """Residual of y on x inside each month; slope and intercept are grouped aggregates."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    coef = rows.groupBy(*by).agg(F.regr_slope(y, x).alias("__s"), F.regr_intercept(y, x).alias("__i"))
    return _null_safe_join(rows, coef, list(by)).withColumn(out, F.col(y) - F.col("__i") - F.col("__s") * F.col(x)).drop("__s", "__i")


def melt(df: DataFrame, keep: Sequence[str], values: Sequence[str], name: str = "signal", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(c) for c in keep], [F.col(c) for c in values], name, value)


def orient(
    df: DataFrame, signals: Sequence[str], *, by: str, target: str, cutoff: str, min_n: int = 30
) -> DataFrame:
    """Sign of each signal's mean information coefficient over months before the cutoff (+1 when there is none)."""
    early = df.filter(F.col(by) < F.lit(cutoff).cast("date"))
    ics = spearman(melt(early, [by, target], signals), [by, "signal"], "value", target, min_n=min_n)
    return ics.groupBy("signal").agg(F.avg("ic").alias("mean_ic")).withColumn("sign", F.when(F.col("mean_ic") < 0, -1).otherwise(1))


def signal_coverage(df: DataFrame, signals: Sequence[str], *, month: str) -> DataFrame:
    """Share of present signal values per year, averaged over signals."""
    shares = df.groupBy(F.year(month).alias("year")).agg(*[F.avg(F.col(s).isNotNull().cast("double")).alias(s) for s in signals])
    mean = sum((F.col(s) for s in signals[1:]), F.col(signals[0])) / len(signals)
    return shares.select("year", mean.alias("coverage"))


def log_positive(c: str) -> Column:
    return F.ln(positive(c))
