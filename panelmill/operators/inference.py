"""Tests on monthly return series: HAC errors, stationary bootstrap, multiple testing.

A series is (keys, order, value). Series are short (months), many, and independent of each other, so everything is a
window or a grouping partitioned by series; bootstrap replications are arrays (``bootstrap``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import normal_cdf, normal_quantile, ratio, two_sided_p
from panelmill.operators import bootstrap

BLOCK = 6
PERIODS = 12


def _lags(n: Column) -> Column:
    rule = F.floor(4.0 * F.pow(n / 100.0, F.lit(2.0 / 9.0)))
    return F.greatest(F.least(rule, n - 2), F.lit(0))


def hac(df: DataFrame, by: Sequence[str], order: str, values: Mapping[str, str | Column]) -> DataFrame:
    """Mean and Newey-West standard error of each value per series: n, mean_*, se_* (null below three rows).

    The Bartlett sum of autocovariances up to lag L is the mean over windows of L + 1 rows, zeros beyond both ends, of the squared window sum.
    Window sums are differences of cumulative sums, which end at zero, so any number of lags costs one array per series.
    """
    by = list(by)
    p = Window.partitionBy(*by)
    o = p.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cols = {k: (F.col(v) if isinstance(v, str) else v) for k, v in values.items()}
    base = df.select(*by, order, *[c.alias(f"__x_{k}") for k, c in cols.items()])
    d = base.select("*", F.row_number().over(p.orderBy(order)).alias("__i"), *[(F.col(f"__x_{k}") - F.avg(f"__x_{k}").over(p)).alias(f"__d_{k}") for k in cols])
    run = d.select("*", *[F.coalesce(F.sum(f"__d_{k}").over(o), F.lit(0.0)).alias(f"__c_{k}") for k in cols])
    g = run.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("n"), *[F.avg(f"__x_{k}").alias(f"mean_{k}") for k in cols],
        F.array_sort(F.collect_list(F.struct("__i", *[f"__c_{k}" for k in cols]))).alias("__s"),
    )
    g = g.withColumn("__L", _lags(F.col("n")).cast("int"))
    out = []
    for k in cols:
        c = F.transform("__s", lambda s: s[f"__c_{k}"])  # noqa: B023
        before = lambda i: F.when(i > F.col("__L"), F.get(F.col(f"__a_{k}"), i - F.col("__L") - 1)).otherwise(0.0)  # noqa: B023, E731
        g = g.withColumn(f"__a_{k}", c)
        square = lambda acc, x: acc + x * x
        inside = F.aggregate(F.transform(f"__a_{k}", lambda x, i: x - before(i)), F.lit(0.0), square)
        beyond = F.aggregate(F.slice(f"__a_{k}", F.greatest(F.col("n").cast("int") - F.col("__L"), F.lit(1)), F.col("__L")), F.lit(0.0), square)
        out.append(F.when(F.col("n") >= 3, F.sqrt((inside + beyond) / (F.col("__L") + 1.0)) / F.col("n")).alias(f"se_{k}"))
    means = [x for k, se in zip(cols, out) for x in (F.col(f"mean_{k}"), se)]
    return g.select(*by, "n", *means)


def newey_west(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    out = hac(df.filter(F.col(value).isNotNull()), by, order, {"x": value})
    return out.select(*by, "n", F.col("mean_x").alias("mean"), F.col("se_x").alias("se"), ratio("mean_x", "se_x").alias("t"))


def influence(df: DataFrame, by: Sequence[str], value: str, out: str, periods: int = PERIODS) -> DataFrame:
    """Attach the Sharpe ratio (annual, ``sr_<out>``) and each month's influence on it (``psi_<out>``)."""
    p = Window.partitionBy(*by)
    sd = F.stddev_samp(value).over(p)
    mu = F.avg(value).over(p)
    st = df.select("*", F.when(sd > 0, mu / sd).alias("__s"), F.when(sd > 0, (F.col(value) - mu) / sd).alias("__z"))
    root = float(periods) ** 0.5
    return st.select(
        *df.columns, (F.col("__s") * root).alias(f"sr_{out}"),
        (root * (F.col("__z") - 0.5 * F.col("__s") * (F.col("__z") ** 2 - 1.0))).alias(f"psi_{out}"),
    )


def sharpe_test(df: DataFrame, by: Sequence[str], order: str, value: str, *, periods: int = PERIODS, benchmark: float = 0.0) -> DataFrame:
    """Annual Sharpe ratio with HAC and moment-based standard errors, t and two-sided p."""
    rows = df.filter(F.col(value).isNotNull())
    inf = influence(rows, by, value, "x", periods)
    h = hac(inf, by, order, {"psi": "psi_x"})
    n = F.col("n")
    moments = inf.groupBy(*by).agg(
        F.max("sr_x").alias("sharpe"), F.skewness(value).alias("__g1"), F.kurtosis(value).alias("__g2"), F.count(F.lit(1)).alias("__n"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
    )
    j = h.join(moments, list(by))
    # unbiased skewness and excess kurtosis from the population moments
    skew = F.col("__g1") * F.sqrt(n * (n - 1.0)) / (n - 2.0)
    kurt = ((n + 1.0) * F.col("__g2") + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0))
    s = F.col("sharpe") / float(periods) ** 0.5
    iid = F.sqrt(F.greatest(1.0 - F.col("skew") * s + 0.25 * (F.col("kurt") + 2.0) * s ** 2, F.lit(1e-12)) / n) * float(periods) ** 0.5
    j = j.select("*", skew.alias("skew"), kurt.alias("kurt"))
    out = j.select(
        *by, "n", "mean", "sd", "sharpe", F.when(n >= 8, F.col("se_psi")).alias("se"), F.when(n >= 8, iid).alias("se_iid"), "skew", "kurt"
    )
    out = out.withColumn("t", ratio(F.col("sharpe") - benchmark, "se"))
    return out.withColumn("p", two_sided_p("t")).withColumn("over_hurdle", F.coalesce(F.abs("t") > 3.0, F.lit(False)))


def expected_max(n_trials: Column, sd: Column) -> Column:
    """Expected largest of N independent estimates under no skill (Bailey and Lopez de Prado)."""
    n = F.greatest(n_trials.cast("double"), F.lit(1.0))
    euler = 0.5772156649015329
    first = normal_quantile(1.0 - 1.0 / n)
    second = normal_quantile(1.0 - 1.0 / (n * 2.718281828459045))
    return F.when(n <= 1, 0.0).otherwise(sd * ((1.0 - euler) * first + euler * second))


def deflated_sharpe(tests: DataFrame, n_trials: int | Column, *, periods: int = PERIODS) -> DataFrame:
    """Probability that a Sharpe ratio beats the best of ``n_trials`` skill-less attempts. Input: rows of ``sharpe_test``."""
    n = F.col("n").cast("double")
    sd = 1.0 / F.sqrt(F.greatest(n - 1.0, F.lit(1.0)))
    rows = tests.withColumn("expected_max", expected_max(n_trials if isinstance(n_trials, Column) else F.lit(n_trials), sd))
    s = F.col("sharpe") / float(periods) ** 0.5
    # kurt holds excess kurtosis
    denom = F.sqrt(F.greatest(1.0 - F.col("skew") * s + 0.25 * (F.col("kurt") + 2.0) * s ** 2, F.lit(1e-12)))
    z = (s - F.col("expected_max")) * F.sqrt(F.greatest(n - 1.0, F.lit(1.0))) / denom
    rows = rows.withColumn("deflated_p", normal_cdf(z))
    return rows.withColumn("expected_max", F.col("expected_max") * float(periods) ** 0.5).withColumn("survives", F.col("deflated_p") > 0.95)


def pbo(df: DataFrame, *, order: str, unit: str, value: str, n_splits: int = 16) -> DataFrame:
    """Probability of backtest overfitting by symmetric cross-validation over all balanced block splits.

    A strategy becomes one array of block sums and counts. The sums of all subsets of the lower half of its blocks and of the upper half
    (2 x 2^(n/2) of them) give those of every balanced split by one addition; only (split, strategy) pairs are rows.
    """
    n_splits -= n_splits % 2
    half = n_splits // 2
    balanced = balanced_rows(df, order=order, unit=unit, value=value)
    pos = balanced.select(order).distinct().withColumn("__t", F.row_number().over(Window.orderBy(order)) - 1)  # one row per date
    size = pos.agg(F.count(F.lit(1)).alias("__len"))
    pos = pos.join(F.broadcast(size), F.lit(True))  # one-row side
    base, extra = F.floor(F.col("__len") / n_splits), F.col("__len") % n_splits
    cut = extra * (base + 1)
    block = F.when(F.col("__t") < cut, F.floor(F.col("__t") / (base + 1))).otherwise(extra + F.floor((F.col("__t") - cut) / F.greatest(base, F.lit(1))))
    blocks = balanced.join(pos.select(order, block.cast("int").alias("__blk")), order).groupBy(unit, "__blk").agg(
        F.sum(value).alias("__s"), F.count(F.lit(1)).cast("double").alias("__c")
    )
    at = lambda i, c: F.coalesce(F.max(F.when(F.col("__blk") == i, F.col(c))), F.lit(0.0))
    table = blocks.groupBy(unit).agg(*[F.array(*[at(i, c) for i in range(n_splits)]).alias(c) for c in ("__s", "__c")])
    subsets = F.sequence(F.lit(0), F.lit(2**half - 1))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def partial(c: str, shift: int) -> Column:
        inside = lambda m: F.filter(F.slice(c, shift + 1, half), lambda _, i: F.call_function("getbit", m, i) == 1)
        return F.transform(subsets, lambda m: total(inside(m)))

    halves = table.select(unit, *[partial(c, h).alias(f"{c}{h}") for c in ("__s", "__c") for h in (0, half)], total("__s").alias("__st"), total("__c").alias("__ct"))
    masks = F.flatten(F.transform(subsets, lambda lo: F.transform(F.filter(subsets, lambda hi: F.bit_count(lo) + F.bit_count(hi) == half), lambda hi: F.struct(lo.alias("lo"), hi.alias("hi")))))
    rows = halves.withColumn("__m", F.explode(masks))
    pick = lambda c: F.get(F.col(f"{c}0"), F.col("__m.lo")) + F.get(F.col(f"{c}{half}"), F.col("__m.hi"))
    rows = rows.select(unit, (F.col("__m.lo") + F.col("__m.hi") * 2**half).alias("mask"), pick("__s").alias("__in"), pick("__c").alias("__n"), "__st", "__ct")
    perf = rows.select("mask", unit, ratio("__in", "__n").alias("__is"), ((F.col("__st") - F.col("__in")) / (F.col("__ct") - F.col("__n"))).alias("__oos"))
    w = Window.partitionBy("mask")
    rank = F.rank().over(w.orderBy("__oos")) + (F.count(F.lit(1)).over(Window.partitionBy("mask", "__oos")) - 1) / 2.0
    ranked = perf.select("*", rank.alias("__r"), F.count(F.lit(1)).over(w).alias("__k"))
    best = ranked.groupBy("mask").agg(F.min_by(F.struct("__r", "__k"), F.struct(-F.col("__is"), F.col(unit))).alias("b"))  # ties: first name
    pct = F.least(F.greatest(F.col("b.__r") / F.col("b.__k"), F.lit(1e-6)), F.lit(1 - 1e-6))
    logits = best.select(F.ln(pct / (1 - pct)).alias("logit"), F.col("b.__k").alias("k"))
    return logits.agg(
        F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).cast("long").alias("n_combinations"),
        F.max("k").cast("long").alias("n_strategies"), F.percentile("logit", F.lit(0.5)).alias("median_logit"),
    )


def balanced_rows(df: DataFrame, *, order: str, unit: str, value: str) -> DataFrame:
    """Rows of the dates on which every unit has a value."""
    rows = df.filter(F.col(value).isNotNull())
    units = rows.agg(F.count_distinct(unit).alias("__u"))
    full = rows.groupBy(order).agg(F.count_distinct(unit).alias("__c")).join(F.broadcast(units), F.col("__c") == F.col("__u")).select(order)
    return rows.join(full, order, "left_semi")


def bootstrap_index(lengths: DataFrame, B: int, *, block: int = BLOCK, salt: str = "0") -> DataFrame:
    """Stationary-bootstrap positions (len, b, t, idx) for each distinct series length ``len``, all zero-based."""
    return bootstrap.positions(lengths, B, block=block, salt=salt)


def _tails(boot: DataFrame, by: Sequence[str], plain: str, stud: str) -> list[Column]:
    ok = F.col(stud).isNotNull()
    return [
        F.count(F.lit(1)).cast("long").alias("n_boot"), F.sum(ok.cast("long")).alias("__fin"),
        F.percentile(plain, F.lit(0.025)).alias("ci_low"), F.percentile(plain, F.lit(0.975)).alias("ci_high"),
        F.percentile(stud, F.lit(0.025)).alias("__q_lo"), F.percentile(stud, F.lit(0.975)).alias("__q_hi"),
        F.avg((F.col(plain) <= 0).cast("double")).alias("__le"), F.avg((F.col(plain) >= 0).cast("double")).alias("__ge"),
    ]


def _decide(joined: DataFrame, by: Sequence[str], extra: Sequence[str], plus_one: bool) -> DataFrame:
    enough = (F.col("__fin") >= 100) & F.col("t").isNotNull()
    count = F.col("__hits")
    p_t = (count + 1.0) / (F.col("__fin") + 1.0) if plus_one else count / F.col("__fin")
    p_pct = 2.0 * F.least("__le", "__ge")
    return joined.select(
        *by, "n", "n_boot", *extra, "stat", "se", "t", F.least(F.when(enough, p_t).otherwise(p_pct), F.lit(1.0)).alias("p"),
        "ci_low", "ci_high", F.when(enough, F.col("stat") - F.col("__q_hi") * F.col("se")).alias("ci_stud_low"),
        F.when(enough, F.col("stat") - F.col("__q_lo") * F.col("se")).alias("ci_stud_high"),
    )


def sharpe_diff(
    df: DataFrame, by: Sequence[str], order: str, a: str, b: str, B: int = 4000, *, block: int = BLOCK, salt: str = "0", periods: int = PERIODS,
    plus_one: bool = False,
) -> DataFrame:
    """Studentised bootstrap test of the difference of two Sharpe ratios on paired months (at least twelve)."""
    by = list(by)
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, order, F.col(a).alias("__a"), F.col(b).alias("__b"))

    def stat(frame: DataFrame, keys: list[str], o: str) -> DataFrame:
        inf = influence(influence(frame, keys, "__a", "a", periods), keys, "__b", "b", periods)
        h = hac(inf, keys, o, {"psi": F.col("psi_a") - F.col("psi_b"), "sa": "sr_a", "sb": "sr_b"})
        return h.select(*keys, "n", F.col("mean_sa").alias("sharpe_a"), F.col("mean_sb").alias("sharpe_b"),
                        (F.col("mean_sa") - F.col("mean_sb")).alias("stat"), F.col("se_psi").alias("se"))

    point = stat(rows, by, order).filter("n >= 12").withColumn("t", ratio("stat", "se"))
    both = bootstrap.replicate(rows, by, order, ["__a", "__b"], B, bootstrap.sharpe_gap, ["__draw", "__dse"], block=block, salt=salt, periods=periods).join(point, by)
    both = both.withColumn("__stud", F.when(F.col("__dse") > 0, (F.col("__draw") - F.col("stat")) / F.col("__dse")))
    tails = both.groupBy(*by).agg(*_tails(both, by, "__draw", "__stud"), F.sum((F.abs("__stud") >= F.abs("t")).cast("long")).alias("__hits"))
    return _decide(point.join(tails, by), by, ["sharpe_a", "sharpe_b"], plus_one)


def mean_diff(
    df: DataFrame, by: Sequence[str], order: str, a: str, b: str, B: int = 4000, *, block: int = BLOCK, salt: str = "0", periods: int = PERIODS,
    plus_one: bool = False,
) -> DataFrame:
    """Studentised bootstrap test of the annualised difference of paired means."""
    by = list(by)
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, order, (F.col(a) - F.col(b)).alias("__d"))

    def stat(frame: DataFrame, keys: list[str], o: str) -> DataFrame:
        h = hac(frame, keys, o, {"d": "__d"})
        return h.select(*keys, "n", (F.col("mean_d") * periods).alias("stat"), (F.col("se_d") * periods).alias("se"))

    point = stat(rows, by, order).filter("n >= 12").withColumn("t", ratio("stat", "se"))
    both = bootstrap.replicate(rows, by, order, [F.col("__d") * periods], B, bootstrap.mean_and_error, ["__draw", "__dse"], block=block, salt=salt).join(point, by)
    both = both.withColumn("__stud", F.when(F.col("__dse") > 0, (F.col("__draw") - F.col("stat")) / F.col("__dse")))
    tails = both.groupBy(*by).agg(*_tails(both, by, "__draw", "__stud"), F.sum((F.abs("__stud") >= F.abs("t")).cast("long")).alias("__hits"))
    return _decide(point.join(tails, by), by, [], plus_one)


def romano_wolf(df: DataFrame, *, order: str, unit: str, value: str, B: int = 2000, block: int = BLOCK, salt: str = "0", alpha: float = 0.05) -> DataFrame:
    """Step-down p-values controlling the familywise error: each unit meets the bootstrap maximum over the units not above it."""
    rows = balanced_rows(df, order=order, unit=unit, value=value)
    obs = hac(rows, [unit], order, {"x": value}).filter("n >= 20").select(unit, F.col("mean_x").alias("mean"), ratio("mean_x", "se_x").alias("t_stat"))
    # a unit without variance has an infinite error, hence a statistic of zero
    obs = obs.withColumn("t_stat", F.coalesce("t_stat", F.lit(0.0)))
    centred = rows.join(obs.select(unit, "mean"), unit).select(unit, order, (F.col(value) - F.col("mean")).alias("__x"))
    draws = bootstrap.replicate(centred, [unit], order, ["__x"], B, bootstrap.mean_and_error, ["mean_x", "se_x"], block=block, salt=salt)
    draws = draws.select(unit, "b", F.coalesce(ratio("mean_x", "se_x"), F.lit(0.0)).alias("__t"))
    ranked = obs.withColumn("__k", F.row_number().over(Window.orderBy(F.col("t_stat").desc(), unit)))  # one row per unit
    w = Window.partitionBy("b").orderBy(F.col("__k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    maxes = draws.join(ranked, unit).select(unit, "__k", "t_stat", F.max("__t").over(w).alias("__m"))
    p = maxes.groupBy(unit, "__k").agg(F.avg((F.col("__m") >= F.col("t_stat")).cast("double")).alias("__p"))
    mono = p.withColumn("p_adjusted", F.max("__p").over(Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)))
    return obs.join(mono.select(unit, "p_adjusted"), unit).withColumn("reject", F.col("p_adjusted") < alpha)


def spa(df: DataFrame, *, order: str, unit: str, value: str, benchmark: str, B: int = 2000, block: int = BLOCK, salt: str = "0") -> DataFrame:
    """Superior predictive ability: is the best candidate better than the benchmark, with clearly inferior ones recentred.

    Statistics are plain t ratios; the standard error is already that of the mean.
    """
    rows = balanced_rows(df, order=order, unit=unit, value=value)
    base = rows.filter(F.col(unit) == benchmark).select(order, F.col(value).alias("__base"))
    d = rows.filter(F.col(unit) != benchmark).join(base, order).select(unit, order, (F.col(value) - F.col("__base")).alias("__d"))
    obs = hac(d, [unit], order, {"d": "__d"}).filter("n >= 20").withColumn("t", F.coalesce(ratio("mean_d", "se_d"), F.lit(0.0)))
    threshold = -F.sqrt(2.0 * F.ln(F.ln(F.greatest(F.col("n"), F.lit(3)).cast("double")))) * F.col("se_d")
    centre = obs.select(unit, F.when(F.col("mean_d") > threshold, F.col("mean_d")).otherwise(0.0).alias("__g"))
    shifted = d.join(centre, unit).select(unit, order, (F.col("__d") - F.col("__g")).alias("__x"))
    draws = bootstrap.replicate(shifted, [unit], order, ["__x"], B, bootstrap.mean_and_error, ["mean_x", "se_x"], block=block, salt=salt)
    best = draws.groupBy("b").agg(F.max(F.coalesce(ratio("mean_x", "se_x"), F.lit(0.0))).alias("__m"))
    top = obs.agg(
        F.max("t").alias("t_stat"), F.max_by(unit, F.struct("t", unit)).alias("best"), F.count(F.lit(1)).cast("long").alias("n_candidates"),
        F.max("n").alias("months"),
    )
    hits = best.join(F.broadcast(top), F.lit(True))  # one-row side
    return hits.groupBy("t_stat", "best", "n_candidates", "months").agg(F.avg((F.col("__m") >= F.col("t_stat")).cast("double")).alias("p"))


def diebold_mariano(df: DataFrame, by: Sequence[str], order: str, error_a: str, error_b: str) -> DataFrame:
    """Equal accuracy of two forecasts by the HAC t of the squared-error difference."""
    d = df.withColumn("__d", F.col(error_a) ** 2 - F.col(error_b) ** 2).filter(F.col("__d").isNotNull())
    h = hac(d, by, order, {"d": "__d"}).withColumn("t", ratio("mean_d", "se_d"))
    return h.select(
        *by, "n", F.col("mean_d").alias("mean_loss_diff"), "t", two_sided_p("t").alias("p"), F.when(F.col("mean_d") < 0, "a").otherwise("b").alias("better")
    )


def benjamini_hochberg(df: DataFrame, p: str, *, by: Sequence[str] = (), tie: str, alpha: float = 0.05) -> DataFrame:
    """False-discovery-rate adjusted p-values. One row per hypothesis."""
    rows = df.filter(F.col(p).isNotNull())
    part = Window.partitionBy(*by)
    up = part.orderBy(p, tie)
    raw = rows.withColumn("__a", F.col(p) * F.count(F.lit(1)).over(part) / F.row_number().over(up))
    low = F.min("__a").over(part.orderBy(F.col(p).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("p_adjusted", F.least(F.greatest(low, F.lit(0.0)), F.lit(1.0))).withColumn("reject", F.col("p_adjusted") < alpha).drop("__a")


def holm(df: DataFrame, p: str, *, by: Sequence[str] = (), tie: str, out: str = "p_holm", valid: Column | None = None) -> DataFrame:
    """Step-down adjusted p-values over the valid, non-null hypotheses; the others stay null."""
    ok = F.col(p).isNotNull() & (F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True))
    rows = df.withColumn("__ok", ok)
    part = Window.partitionBy(*by, "__ok")
    up = part.orderBy(p, tie)
    step = F.least((F.count(F.lit(1)).over(part) - F.row_number().over(up) + 1) * F.col(p), F.lit(1.0))
    raw = rows.withColumn("__a", step)
    run = F.max("__a").over(up.rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn(out, F.when(F.col("__ok"), run)).drop("__a", "__ok")


def report(df: DataFrame, *, order: str, unit: str, value: str, n_trials: int, B: int = 2000) -> DataFrame:
    """Per strategy: Sharpe test, deflation and step-down p-value."""
    tests = deflated_sharpe(sharpe_test(df, [unit], order, value), n_trials)
    rw = romano_wolf(df, order=order, unit=unit, value=value, B=B).select(unit, "p_adjusted", "reject")
    return tests.join(rw, unit, "left")


FACTORS = ("f1", "f2", "f3", "f4")


def parse_cells(df: DataFrame, cell: str, on: Sequence[str] = ("N", "C", "E", "U"), off: Sequence[str] = ("L", "S", "P", "0")) -> DataFrame:
    """Levels +1/-1 of the four factors of a cell code; an unknown code is an error."""
    parts = F.split(cell, "-")
    levels = []
    for i in range(4):
        p = F.element_at(parts, i + 1)
        bad = F.raise_error(F.concat(F.lit("unknown cell code "), F.col(cell)))
        levels.append(F.when(p == on[i], 1).when(p == off[i], -1).otherwise(bad.cast("int")).alias(FACTORS[i]))
    return df.select("*", *levels)


def factorial_effects(df: DataFrame, *, order: str, cell: str, value: str, max_order: int = 4, periods: int = PERIODS) -> DataFrame:
    """Every main effect and interaction: the HAC mean of its contrast series over balanced months."""
    from itertools import combinations

    rows = parse_cells(balanced_rows(df, order=order, unit=cell, value=value), cell)
    n_cells = rows.agg(F.count_distinct(cell).alias("__c"))
    terms = []
    for k in range(1, max_order + 1):
        for combo in combinations(FACTORS, k):
            code = F.lit(1)
            for f in combo:
                code = code * F.col(f)
            terms.append(F.struct(F.lit(" x ".join(combo)).alias("term"), F.lit(k).alias("order_"), code.alias("code")))
    long = rows.withColumn("__t", F.explode(F.array(*terms))).join(F.broadcast(n_cells), F.lit(True))  # one-row side
    series = long.groupBy("__t.term", "__t.order_", order).agg(F.sum(F.col("__t.code") * F.col(value) / (F.col("__c") / 2.0)).alias("__x"))
    h = hac(series, ["term", "order_"], order, {"x": "__x"})
    return h.select(
        "term", F.col("order_").alias("order"), F.col("mean_x").alias("estimate"), F.col("se_x").alias("se"), ratio("mean_x", "se_x").alias("t"),
        (F.col("mean_x") * periods).alias("annualised"), F.col("n").alias("months"),
    )


def shapley_attribution(df: DataFrame, *, order: str, cell: str, value: str, periods: int = PERIODS) -> DataFrame:
    """Shapley value of each factor over cell means; the four add up to all-on minus all-off.

    A cell with s factors on enters factor f with weight (s-1)!(4-s)!/4! when f is on and -s!(3-s)!/4! when it is off.
    """
    means = parse_cells(balanced_rows(df, order=order, unit=cell, value=value), cell).groupBy(cell, *FACTORS).agg(F.avg(value).alias("__m"))
    s = sum(((F.col(f) == 1).cast("int") for f in FACTORS[1:]), (F.col(FACTORS[0]) == 1).cast("int"))
    on = F.element_at(F.array(*[F.lit(factorial(k - 1) * factorial(4 - k) / 24.0) for k in range(1, 5)]), F.greatest(s, F.lit(1)))
    off = F.element_at(F.array(*[F.lit(-factorial(k) * factorial(3 - k) / 24.0) for k in range(0, 4)]), F.least(s + 1, F.lit(4)))
    long = means.select("__m", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.when(F.col(f) == 1, on).otherwise(off).alias("w")) for f in FACTORS])).alias("c"))
    g = long.groupBy("c.factor").agg(F.sum(F.col("c.w") * F.col("__m")).alias("shapley"))
    total = g.agg(F.sum("shapley").alias("__t"))
    return g.join(F.broadcast(total), F.lit(True)).select(  # one-row side
        "factor", "shapley", (F.col("shapley") * periods).alias("annualised"), ratio("shapley", "__t").alias("share")
    )


def attribution_report(df: DataFrame, *, order: str, cell: str, value: str, periods: int = PERIODS) -> DataFrame:
    """Cell table, effects, Shapley values and balance in one long table (section, name, value, t)."""
    kept = balanced_rows(df, order=order, unit=cell, value=value)
    cells = kept.groupBy(cell).agg((F.avg(value) * periods).alias("v"), (ratio(F.avg(value), F.stddev_samp(value)) * float(periods) ** 0.5).alias("t"))
    eff = factorial_effects(df, order=order, cell=cell, value=value, periods=periods)
    shap = shapley_attribution(df, order=order, cell=cell, value=value, periods=periods)
    months = df.select(order).distinct().agg(F.count(F.lit(1)).alias("a"))
    used = kept.select(order).distinct().agg(F.count(F.lit(1)).alias("u"))
    none = F.lit(None).cast("double")
    balance = months.join(F.broadcast(used), F.lit(True)).select(  # one-row sides
        F.lit("balance").alias("section"), F.lit("months_dropped").alias("name"), (F.col("a") - F.col("u")).cast("double").alias("value"), none.alias("t")
    )
    return (
        cells.select(F.lit("cell").alias("section"), F.col(cell).alias("name"), F.col("v").alias("value"), "t")
        .unionByName(eff.select(F.lit("effect").alias("section"), F.col("term").alias("name"), F.col("annualised").alias("value"), "t"))
        .unionByName(shap.select(F.lit("shapley").alias("section"), F.col("factor").alias("name"), F.col("annualised").alias("value"), none.alias("t")))
        .unionByName(balance)
    )


def composite(df: DataFrame, *, by: Sequence[str], order: str, unit: str, values: Sequence[str]) -> DataFrame:
    """Equal-weight mean over units on the dates where every unit of the group reports every value."""
    rows = df
    for v in values:
        rows = rows.filter(F.col(v).isNotNull())
    units = df.groupBy(*by).agg(F.count_distinct(unit).alias("__u"))
    g = rows.groupBy(*by, order).agg(F.count_distinct(unit).alias("__c"), *[F.avg(v).alias(v) for v in values])
    return g.join(units, list(by)).filter("__c = __u").drop("__c", "__u")
