"""Studies composed from the panel, book and inference operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions import avg_rank, ratio, spearmans
from panelmill.operators import book as bk
from panelmill.operators import bootstrap
from panelmill.operators import inference as inf
from panelmill.operators import linear
from panelmill.operators import xsection as xs
from panelmill.sources.io import written


def signal_quality(
    df: DataFrame, signals: Sequence[str], *, id: str, month: str, target: str, horizons: Mapping[str, int], min_n: int = 6, periods: int = 12,
) -> DataFrame:
    """Per signal: mean IC, spread, ICIR, HAC t, month-to-month rank persistence, horizon ICs and decay half-life."""
    cols = list(dict.fromkeys([target, *horizons]))
    df = df.filter(reduce(or_, [F.col(s).isNotNull() for s in signals]))
    order = df.select(month).distinct().withColumn("__i", F.row_number().over(Window.orderBy(month)))  # months only
    w = Window.partitionBy(id).orderBy(month)
    before = [F.when(F.lag("__i").over(w) == F.col("__i") - 1, F.lag(s).over(w)).alias(f"__prev_{s}") for s in signals]
    # every signal meets all targets, its own last value being one more; each column is ranked once
    pairs = [(s, c) for s in signals for c in (*cols, f"__prev_{s}")]
    ranked = spearmans(df.join(F.broadcast(order), month).select(month, *signals, *cols, *before), [month], pairs, min_n=2)
    last = F.col("second") == F.concat(F.lit("__prev_"), "first")
    all_ics = written(ranked.select(F.col("first").alias("signal"), F.when(last, "__prev").otherwise(F.col("second")).alias("h"), month, "n", "ic"), "ics")
    ics = all_ics.filter((F.col("h") == target) & (F.col("n") >= min_n) & F.col("ic").isNotNull()).drop("n")
    h = inf.hac(ics, ["signal"], month, {"ic": "ic"})
    at = lambda c, n: F.avg(F.when((F.col("h") == c) & (F.col("n") >= n), F.col("ic")))
    means = all_ics.groupBy("signal").agg(
        F.stddev_samp(F.when((F.col("h") == target) & (F.col("n") >= min_n), F.col("ic"))).alias("ic_sd"), at("__prev", 2).alias("autocorr_1m"),
        *[at(c, min_n).alias(f"ic_{c}") for c in horizons],
    )
    out = h.join(means, "signal").select(
        "signal", h["n"], "mean_ic", "ic_sd", (ratio("mean_ic", "ic_sd") * float(periods) ** 0.5).alias("icir"), ratio("mean_ic", "se_ic").alias("nw_t"),
        "autocorr_1m", (1.0 - F.col("autocorr_1m")).alias("implied_turnover"), *[f"ic_{c}" for c in horizons],
    )
    # first positive horizon, then the first later one at half its value or less (non-positive points are skipped)
    points = F.filter(
        F.array(*[F.struct(F.lit(n).alias("h"), F.col(f"ic_{c}").alias("v")) for c, n in sorted(horizons.items(), key=lambda kv: kv[1])]), lambda p: p["v"] > 0
    )
    rest = F.filter(F.slice(points, 2, len(horizons)), lambda p: p["v"] <= F.element_at(points, 1)["v"] / 2)
    half = F.when(F.size(points) >= 2, F.try_element_at(rest, F.lit(1))["h"]).cast("double")
    return out.withColumn("half_life", half)


def redundancy(df: DataFrame, signals: Sequence[str], themes: Mapping[str, Sequence[str]], *, key: Sequence[str]) -> DataFrame:
    """Spearman matrix over complete rows, reduced to mean absolute correlation within and across themes and effective N.

    For a correlation matrix the participation ratio of its eigenvalues equals N^2 / sum(c^2), so no decomposition is needed.
    """
    long = xs.melt(df.select(*key, *signals).dropna(), key, signals)
    # whole-panel ranks: the signal is the only key, so always use the bucketed plan
    long = avg_rank(long, ["signal"], "value", "rank")
    cols = list(signals)
    ranked = long.groupBy(*key).pivot("signal", cols).agg(F.first("rank"))
    mean = ranked.agg(*[F.avg(c).alias(f"m_{c}") for c in cols])
    centred = ranked.join(F.broadcast(mean), F.lit(True)).select(*[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in cols])  # one-row side
    cells = linear.gram_blocks(centred, by=[], cols=cols).select("i", F.posexplode("row").alias("j", "s"))
    diag = cells.filter("i = j")
    corr = (
        cells.join(diag.select("i", F.col("s").alias("si")), "i").join(diag.select("j", F.col("s").alias("sj")), "j")
        .withColumn("c", F.coalesce(ratio("s", F.sqrt(F.col("si") * F.col("sj"))), F.lit(0.0)))
    )
    theme = {s: t for t, names in themes.items() for s in names}
    names = F.array(*[F.lit(s) for s in signals])
    labels = F.array(*[F.lit(theme.get(s, "other")) for s in signals])
    corr = corr.select(
        F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), "c",
        (F.element_at(labels, F.col("i") + 1) == F.element_at(labels, F.col("j") + 1)).alias("same"), F.element_at(labels, F.col("i") + 1).alias("theme"),
    )
    upper = F.col("a") < F.col("b")
    total = corr.agg(
        F.lit("ALL").alias("theme"), F.count_distinct("a").cast("long").alias("n_signals"), (F.count_distinct("a") ** 2 / F.sum(F.col("c") ** 2)).alias("effective_n"),
        F.avg(F.when(upper & F.col("same"), F.abs("c"))).alias("within"), F.avg(F.when(upper & ~F.col("same"), F.abs("c"))).alias("across"),
    )
    per = corr.filter("same").groupBy("theme").agg(
        F.count_distinct("a").cast("long").alias("n_signals"), (F.count_distinct("a") ** 2 / F.sum(F.col("c") ** 2)).alias("effective_n"),
        F.avg(F.when(upper, F.abs("c"))).alias("within"), F.lit(None).cast("double").alias("across"),
    ).filter("n_signals > 1")
    return total.unionByName(per)


def growth(x: str) -> Column:
    """Product of (1 + x): sign and log apart, zero when some month loses everything exactly."""
    one = 1.0 + F.col(x)
    dead = F.max((one == 0).cast("int")) == 1
    sign = F.when(F.sum((one < 0).cast("int")) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(dead, 0.0).otherwise(sign * F.exp(F.sum(F.ln(F.abs(F.when(one != 0, one))))))


def capacity_effect(cells: DataFrame, *, by: Sequence[str], month: str, cell: str, B: int = 4000, periods: int = 12, salt: str = "0") -> DataFrame:
    """Return difference of capped and uncapped composites at each mandate size, split into gross forgone and cost saved.

    A size is valid only while no single cell loses everything in a month; the step-down correction runs over valid sizes.
    """
    by = list(by)
    values = ["gross_ret", "net_ret_uncapped", "gross_ret_capped", "net_ret_capped"]
    rung = [*by, "aum"]
    solv = cells.groupBy(*rung).agg(
        F.min("net_ret_uncapped").alias("min_uncapped"), F.min("net_ret_capped").alias("min_capped"),
        F.count_distinct(F.when(F.col("net_ret_uncapped") <= -1, F.col(cell))).cast("long").alias("cells_wiped"),
        F.min(F.when(F.col("net_ret_uncapped") <= -1, F.col(month))).alias("first_wipeout"),
    ).withColumn("solvent", (F.col("min_uncapped") > -1) & (F.col("min_capped") > -1))
    comp = inf.composite(cells, by=rung, order=month, unit=cell, values=values)
    ann = lambda e: F.avg(e) * periods
    c = F.col
    parts = comp.groupBy(*rung).agg(
        F.count(F.lit(1)).cast("long").alias("months"), ann(c("gross_ret_capped") - c("gross_ret")).alias("gross_forgone"),
        ann((c("gross_ret") - c("net_ret_uncapped")) - (c("gross_ret_capped") - c("net_ret_capped"))).alias("cost_saved"),
        growth("net_ret_uncapped").alias("wealth_uncapped"), growth("net_ret_capped").alias("wealth_capped"),
    )
    tests = inf.mean_diff(comp, rung, month, "net_ret_capped", "net_ret_uncapped", B, salt=salt).select(
        *rung, c("stat").alias("B"), "se", "t", "p", c("ci_low").alias("B_low"), c("ci_high").alias("B_high")
    )
    out = solv.join(parts, rung).join(tests, rung, "left")
    for name in ("B", "se", "t", "p", "B_low", "B_high"):
        out = out.withColumn(name, F.when(c("solvent"), c(name)))
    out = inf.holm(out, "p", by=by, tie="aum", valid=c("solvent"))
    return out.withColumn("residual", c("B") - (c("gross_forgone") + c("cost_saved")))


def tier_reconcile(a: DataFrame, b: DataFrame, *, on: Sequence[str], value: str) -> DataFrame:
    """The same quantity under two accounting tiers."""
    j = a.select(*on, F.col(value).alias("tier_a")).join(b.select(*on, F.col(value).alias("tier_b")), list(on), "full_outer")
    return j.withColumn("difference", F.col("tier_b") - F.col("tier_a")).withColumn("same_sign", F.signum("tier_a") == F.signum("tier_b"))


def _sharpe_pair(df: DataFrame, keys: Sequence[str], periods: int) -> DataFrame:
    sr = lambda x: ratio(F.avg(x), F.stddev_samp(x)) * float(periods) ** 0.5
    return df.groupBy(*keys).agg((sr("net_ret_capped") - sr("net_ret_uncapped")).alias("channel"))


def _first_zero(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """log10 size of the first sign change of the channel along the ladder, interpolated linearly."""
    w = Window.partitionBy(*keys).orderBy("aum")
    x, nx = F.col("channel"), F.lead("channel").over(w)
    la, nla = F.log10("aum"), F.log10(F.lead("aum").over(w))
    crosses = (F.signum(x) != F.signum(nx)) & (F.signum(x) != 0)
    at = F.when(crosses, la - ratio(x, nx - x) * (nla - la))
    return df.select(*keys, "aum", at.alias("__at")).groupBy(*keys).agg(F.min_by("__at", F.when(F.col("__at").isNotNull(), F.col("aum"))).alias("log10_aum"))


def crossover(comp: DataFrame, *, by: Sequence[str], month: str, B: int = 4000, block: int = inf.BLOCK, salt: str = "0", periods: int = 12) -> DataFrame:
    """Mandate size where the Sharpe channel changes sign, with a bootstrap interval; one index serves every rung."""
    by = list(by)
    rungs = comp.groupBy(*by).agg(F.count_distinct("aum").alias("__r"))
    full = comp.groupBy(*by, month).agg(F.count_distinct("aum").alias("__c")).join(rungs, by).filter("__c = __r").select(*by, month)
    rows = comp.join(full, [*by, month], "left_semi")
    point = _first_zero(_sharpe_pair(rows, [*by, "aum"], periods), by).withColumnRenamed("log10_aum", "point_log10")
    draws = bootstrap.replicate(rows, [*by, "aum"], month, ["net_ret_capped", "net_ret_uncapped"], B, bootstrap.sharpe_gap, ["channel", "error"], block=block, salt=salt, periods=periods)
    zeros = _first_zero(draws, [*by, "b"])
    tails = zeros.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("n_boot"), (1.0 - F.count("log10_aum") / F.count(F.lit(1))).alias("no_crossover"),
        F.percentile("log10_aum", F.lit(0.025)).alias("ci_low_log10"), F.percentile("log10_aum", F.lit(0.975)).alias("ci_high_log10"),
        F.count("log10_aum").alias("__fin"),
    )
    ok = F.col("__fin") >= 50
    return point.join(tails, by).select(
        *by, "point_log10", "n_boot", "no_crossover", F.when(ok, F.col("ci_low_log10")).alias("ci_low_log10"), F.when(ok, F.col("ci_high_log10")).alias("ci_high_log10")
    )


def capacity_channel(cells: DataFrame, *, by: Sequence[str], month: str, cell: str, B: int = 4000, salt: str = "0") -> DataFrame:
    """Sharpe difference capped minus uncapped per cell and for the composite, corrected within each."""
    rung = [*by, "aum"]
    comp = inf.composite(cells, by=rung, order=month, unit=cell, values=["net_ret_capped", "net_ret_uncapped"]).withColumn(cell, F.lit("COMPOSITE"))
    cols = [*rung, cell, month, "net_ret_capped", "net_ret_uncapped"]
    rows = cells.select(*cols).unionByName(comp.select(*cols))
    out = inf.sharpe_diff(rows, [*rung, cell], month, "net_ret_capped", "net_ret_uncapped", B, salt=salt)
    out = out.withColumn("level", F.when(F.col(cell) == "COMPOSITE", "composite").otherwise("cell"))
    out = out.withColumn("__key", F.concat_ws("|", *[F.col(k).cast("string") for k in [*rung, cell]]))
    return inf.holm(out, "p", by=["level"], tie="__key").drop("__key")


def friction_table(cells: DataFrame, *, by: Sequence[str], month: str, cell: str, periods: int = 12) -> DataFrame:
    """Cost and capacity drags in basis points a year, and the Sharpe each friction takes, per mandate size."""
    rung = [*by, "aum"]
    comp = inf.composite(cells, by=rung, order=month, unit=cell, values=["gross_ret", "net_ret_uncapped", "gross_ret_capped", "net_ret_capped"])
    bps = lambda e: F.avg(e) * periods * 10000.0
    sr = lambda x: ratio(F.avg(x), F.stddev_samp(x)) * float(periods) ** 0.5
    c = F.col
    return comp.groupBy(*rung).agg(
        F.count(F.lit(1)).cast("long").alias("months"), bps(c("gross_ret")).alias("gross_bps"), bps(c("gross_ret") - c("net_ret_uncapped")).alias("cost_drag_bps"),
        bps(c("gross_ret") - c("gross_ret_capped")).alias("capacity_drag_bps"), (sr("net_ret_uncapped") - sr("gross_ret")).alias("cost_channel"),
        (sr("net_ret_capped") - sr("net_ret_uncapped")).alias("capacity_channel"),
    )


def tax_friction(summary: DataFrame, *, by: Sequence[str], arm: str) -> DataFrame:
    """Mean cost and tax drag per arm, and over all arms."""
    cols = ["cost_drag_bps", "tax_drag_bps", "gross_sharpe", "net_sharpe", "after_tax_sharpe", "lt_share", "turnover_mean"]
    rows = summary.withColumn("arm", F.explode(F.array(F.col(arm), F.lit("ALL"))))
    return rows.groupBy(*by, "arm").agg(
        F.count(F.lit(1)).cast("long").alias("cells"), *[F.avg(c).alias(c) for c in cols],
        F.avg(F.col("after_tax_sharpe") - F.col("net_sharpe")).alias("tax_channel"),
    )


def axis_tests(cells: DataFrame, *, by: Sequence[str], month: str, cell: str, value: str, B: int = 4000, salt: str = "0") -> DataFrame:
    """Sharpe difference of the on and off composites of each design axis, corrected over axes within ``by``."""
    rows = inf.parse_cells(cells, cell)
    long = rows.withColumn("__a", F.explode(F.array(*[F.struct(F.lit(f).alias("axis"), F.col(f).alias("level")) for f in inf.FACTORS])))
    pair = long.groupBy(*by, "__a.axis", month).agg(
        F.avg(F.when(F.col("__a.level") == 1, F.col(value))).alias("__on"), F.avg(F.when(F.col("__a.level") == -1, F.col(value))).alias("__off")
    )
    tests = inf.sharpe_diff(pair, [*by, "axis"], month, "__on", "__off", B, salt=salt)
    return inf.holm(tests, "p", by=by, tie="axis")


def power_table(tests: DataFrame, effects: Sequence[float]) -> DataFrame:
    """Power of a two-sided 5% test of each size of true effect, from the estimated standard error."""
    from panelmill.functions import normal_cdf

    rows = tests.withColumn("effect", F.explode(F.array(*[F.lit(float(e)) for e in effects])))
    z = F.col("effect") / F.col("se")
    return rows.select(*[c for c in tests.columns if c in ("axis", "n", "se")], "effect", (normal_cdf(z - 1.959964) + normal_cdf(-z - 1.959964)).alias("power"))


def theme_liquidity(
    df: DataFrame, themes: Mapping[str, Sequence[str]], signs: DataFrame, *, id: str, month: str, ret: str, liquidity: str, B: int = 4000,
    periods: int = 12, salt: str = "0",
) -> DataFrame:
    """Spread of each theme inside the least and the most liquid tercile, and the test of their Sharpe difference."""
    signals = [s for names in themes.values() for s in names]
    flip = signs.groupBy().pivot("signal", signals).agg(F.first("sign"))
    oriented = df.join(F.broadcast(flip.select(*[F.col(s).alias(f"__s_{s}") for s in signals])), F.lit(True))  # one-row side
    oriented = oriented.select(id, month, ret, liquidity, *[(F.col(s) * F.coalesce(F.col(f"__s_{s}"), F.lit(1))).alias(s) for s in signals])
    binned = xs.rank_bins(oriented, liquidity, by=[month], id=id, k=3, min_n=30)
    th = xs.theme_composites(binned, themes)
    long = xs.melt(th, [id, month, ret, "bin"], [f"theme_{t}" for t in themes], "theme", "score")
    spread = bk.spread_return(long, by=["theme", "bin", month], id=id, score="score", ret=ret)
    wide = spread.groupBy("theme", month).agg(
        F.max(F.when(F.col("bin") == 1, F.col("spread_ret"))).alias("illiquid"), F.max(F.when(F.col("bin") == 3, F.col("spread_ret"))).alias("liquid")
    )
    tests = inf.sharpe_diff(wide, ["theme"], month, "illiquid", "liquid", B, salt=salt, periods=periods)
    return inf.holm(tests, "p", tie="theme")


def hc1_slope(df: DataFrame, *, by: Sequence[str], y: str, x: str, extra: str | None = None, min_n: int = 5) -> DataFrame:
    """Slope of y on x (with one optional control) and its heteroskedasticity-robust error.

    The control is partialled out of both sides first, which leaves slope and residuals unchanged.
    """
    by = list(by)
    keep = [c for c in (y, x, extra) if c]
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(keep)]).dropna(subset=[f"__{i}" for i in range(len(keep))])

    def residual(frame: DataFrame, target: str, on: str) -> DataFrame:
        coef = frame.groupBy(*by).agg(F.regr_slope(target, on).alias("__s"), F.regr_intercept(target, on).alias("__c"))
        return frame.join(coef, by).withColumn(target, F.col(target) - F.col("__c") - F.col("__s") * F.col(on)).drop("__s", "__c")

    k = 2
    if extra:
        rows = residual(residual(rows, "__0", "__2"), "__1", "__2")
        k = 3
    fit = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.regr_slope("__0", "__1").alias("slope"), F.regr_intercept("__0", "__1").alias("__c"),
        F.regr_sxx("__0", "__1").alias("__sxx"), F.avg("__1").alias("__mx"),
    )
    e = F.col("__0") - F.col("__c") - F.col("slope") * F.col("__1")
    meat = rows.join(fit, by).groupBy(*by, "n", "slope", "__sxx").agg(F.sum(((F.col("__1") - F.col("__mx")) * e) ** 2).alias("__m"))
    se = F.sqrt(F.col("__m") / F.col("__sxx") ** 2 * F.col("n") / F.greatest(F.col("n") - k, F.lit(1)))
    return meat.filter(F.col("n") >= min_n).select(*by, "n", "slope", se.alias("se"), ratio("slope", se).alias("t"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _on_times(gram: pd.Series) -> pd.Series:
    """Coefficients of the last three columns on all before them; columns without weight of their own get none."""
    out = []
    for g in gram:
        a = np.array([np.asarray(r, float) for r in g])
        out.append([*(np.linalg.pinv(a[:-3, :-3], rcond=1e-10, hermitian=True) @ a[:-3, -3:]).T])
    return pd.Series(out)


def did_twfe(df: DataFrame, *, by: Sequence[str], unit: str, time: str, y: str, x: str, post: str) -> DataFrame:
    """Effect of post x (x - mean x) with unit and time effects, errors clustered by time and by unit; rows with a missing number are left out.

    Units may lack times. Unit effects go by means over the unit, and time effects by a regression on time dummies of which the unit means are
    taken too: that is exact on any panel, in one window and one matrix per group, as there are only as many dummies as the calendar has times.
    """
    by, names = list(by), ["__y", "__x1", "__x2"]
    full = df.select(*by, unit, time, F.col(y).cast("double").alias("__y"), F.col(x).cast("double").alias("__x"), F.col(post).cast("double").alias("__p")).dropna(subset=["__y", "__x", "__p", time])
    mean = full.groupBy(*by).agg(F.avg("__x").alias("__mx"))
    rows = full.join(mean, by).withColumn("__x2", F.col("__x") - F.col("__mx")).withColumn("__x1", F.col("__p") * F.col("__x2"))
    times = [r[0] for r in full.select(time).distinct().orderBy(time).collect()]  # times of the calendar
    within = Window.partitionBy(*by, unit)
    inner = lambda v: v - F.avg(v).over(within)
    dummies = F.array(*[inner((F.col(time) == F.lit(t)).cast("double")) for t in times[1:]]).cast("array<double>")
    d = rows.select(*by, unit, time, *[inner(F.col(c)).alias(c) for c in names], dummies.alias("__d"))
    if len(times) > 1:
        gram = linear.matrices(linear.gram_blocks(d, by=by, cols=names, vector=("__d", len(times) - 1)), by)
        d = d.join(gram.select(*by, _on_times("gram").alias("__c")), by)
        fitted = lambda i: F.aggregate(F.zip_with("__d", F.element_at("__c", i), lambda u, c: u * c), F.lit(0.0), lambda s, v: s + v)
        d = d.select(*by, unit, time, *[(F.col(c) - fitted(i)).alias(c) for i, c in enumerate(names, 1)])
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    m = d.groupBy(*by).agg(
        s("__x1", "__x1").alias("a11"), s("__x1", "__x2").alias("a12"), s("__x2", "__x2").alias("a22"), s("__x1", "__y").alias("b1"), s("__x2", "__y").alias("b2"),
        F.count(F.lit(1)).cast("long").alias("n"), F.count_distinct(unit).cast("long").alias("units"), F.count_distinct(time).cast("long").alias("times"),
    )
    det = F.col("a11") * F.col("a22") - F.col("a12") ** 2
    m = m.withColumn("det", det).withColumn("beta", ratio(F.col("a22") * F.col("b1") - F.col("a12") * F.col("b2"), "det")).withColumn(
        "gamma", ratio(F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1"), "det")
    )
    e = d.join(m, by).withColumn("__e", F.col("__y") - F.col("beta") * F.col("__x1") - F.col("gamma") * F.col("__x2"))
    out = m
    k = 2 + F.col("units") + F.col("times") - 1
    for name, cluster, groups in (("time", time, "times"), ("unit", unit, "units")):
        scores = e.groupBy(*by, cluster, "a22", "a12", "det").agg(F.sum(F.col("__x1") * F.col("__e")).alias("s1"), F.sum(F.col("__x2") * F.col("__e")).alias("s2"))
        # first row of the inverse times the score
        v = scores.groupBy(*by).agg(F.sum(ratio(F.col("a22") * F.col("s1") - F.col("a12") * F.col("s2"), "det") ** 2).alias("v"))
        scale = (F.col(groups) / F.greatest(F.col(groups) - 1, F.lit(1))) * ((F.col("n") - 1) / F.greatest(F.col("n") - k, F.lit(1)))
        out = out.join(v, by).withColumn(f"se_{name}", F.sqrt(F.col("v") * scale)).drop("v")
    return out.select(
        *by, "n", "units", "times", "beta", "se_time", ratio("beta", "se_time").alias("t_time"), "se_unit", ratio("beta", "se_unit").alias("t_unit")
    )
