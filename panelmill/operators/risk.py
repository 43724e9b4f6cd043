"""Structural risk: market, betas, factor returns, exponentially weighted covariances, book risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import clip, quantiles, ratio
from panelmill.operators import linear
from panelmill.operators.xsection import rank_bins


def market_return(df: DataFrame, *, month: str, ret: str, cap: str) -> DataFrame:
    w = F.greatest(F.col(cap), F.lit(1e-6))
    rows = df.filter(F.col(ret).isNotNull() & F.col(cap).isNotNull())
    return rows.groupBy(month).agg((F.sum(F.col(ret) * w) / F.sum(w)).alias("mkt"))


def rolling_beta(df: DataFrame, market: DataFrame, *, id: str, month: str, ret: str, n: int = 36, m: int = 24) -> DataFrame:
    """Beta over the last ``n`` market months with at least ``m`` pairs, known at the start of the month, clipped, 1 by default.

    The market's variance runs over the market's own months; pairs are found by month position, so absent months cost nothing.
    """
    order = market.select(month, "mkt", F.row_number().over(Window.orderBy(month)).alias("__i"))  # one row per month
    recent = Window.orderBy("__i").rowsBetween(-(n - 1), 0)
    var = order.select(month, F.when(F.count("mkt").over(recent) >= m, F.var_samp("mkt").over(recent)).alias("__var"))
    rows = df.select(id, month, F.col(ret).alias("__r")).join(order, month).join(var, month)
    w = Window.partitionBy(id).orderBy("__i").rangeBetween(-n, -1)
    pair = F.col("__r").isNotNull() & F.col("mkt").isNotNull()
    cov = F.when(F.sum(pair.cast("int")).over(w) >= m, F.covar_samp("__r", "mkt").over(w))
    # the variance known at the end of the previous market month
    prev = var.join(order.select(month, "__i"), month).select((F.col("__i") + 1).alias("__i"), F.col("__var").alias("__pv"))
    out = rows.withColumn("__cov", cov).join(prev, "__i", "left")
    return out.select(id, month, F.coalesce(clip(ratio("__cov", "__pv"), -1.5, 3.5), F.lit(1.0)).alias("beta"))


def xs_wls(df: DataFrame, *, month: str, id: str, y: str, xs: Sequence[str], cap: str, min_extra: int = 10) -> tuple[DataFrame, DataFrame]:
    """Cap-weighted monthly regression: (factor returns per month, residual per name).

    Months with fewer than ``min_extra`` names beyond the regressors are skipped. Only k*k sums per month are shuffled.
    """
    rows = df.filter(F.col(y).isNotNull() & F.col(cap).isNotNull()).withColumn("__w", F.greatest(F.col(cap), F.lit(1e-6)))
    fit = linear.ols(rows, by=[month], y=y, xs=xs, weight="__w", intercept=False, min_extra=min_extra)
    factors = fit.select(month, "n", *[F.element_at("coef", i + 1).alias(x) for i, x in enumerate(xs)])
    residual = rows.join(fit.select(month, "coef"), month).select(id, month, (F.col(y) - linear.predict(xs, intercept=False)).alias("resid"))
    return factors, residual


def ewma_cov(factors: DataFrame, *, month: str, names: Sequence[str], halflife: float, ridge: float = 0.0) -> DataFrame:
    """Factor covariance as of every month from all months up to it, as (month, i, j, cov).

    Factor returns are one row per month, so each month may be copied to the later ones.
    """
    pos = factors.select(month, *names, F.row_number().over(Window.orderBy(month)).alias("__i"))
    last = pos.agg(F.max("__i").alias("__z"))
    copies = pos.join(F.broadcast(last), F.lit(True)).withColumn("__asof", F.explode(F.sequence("__i", "__z")))  # one-row side
    w = F.pow(F.lit(0.5), (F.col("__asof") - F.col("__i")) / halflife)
    means = copies.groupBy("__asof").agg(F.sum(w).alias("__sw"), *[(F.sum(w * F.col(n)) / F.sum(w)).alias(f"__m_{n}") for n in names])
    c = copies.join(means, "__asof")
    d = lambda n: F.col(n) - F.col(f"__m_{n}")
    cells = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            value = F.sum(w * d(a) * d(b)) / F.max("__sw") + (ridge if i == j else 0.0)
            cells.append(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), value.alias("cov")))
    out = c.groupBy("__asof").agg(F.array(*cells).alias("v")).select("__asof", F.inline("v"))
    return out.join(pos.select(F.col("__i").alias("__asof"), month), "__asof").select(month, "i", "j", "cov")


def specific_var(
    resid: DataFrame, sizes: DataFrame, *, id: str, month: str, halflife: float, cap: str, shrink: float = 0.3, history: int = 120,
) -> DataFrame:
    """Exponentially weighted residual variance of every name as of every month, shrunk to its size decile's median.

    Weights are powers of the month position, so the trailing sums are plain range windows scaled back; nothing is copied.
    """
    order = sizes.select(month).distinct().withColumn("__i", F.row_number().over(Window.orderBy(month)))
    rows = sizes.select(id, month, cap).join(order, month).join(resid, [id, month], "left")
    up = F.pow(F.lit(2.0), F.col("__i") / halflife)
    w = Window.partitionBy(id).orderBy("__i").rangeBetween(-(history - 1), 0)
    s = lambda e: F.sum(F.when(F.col("resid").isNotNull(), e)).over(w)
    x = F.col("resid")
    n = F.least(F.col("__i"), F.lit(history))
    lam = 0.5 ** (1.0 / halflife)
    total = (1.0 - F.pow(F.lit(lam), n)) / (1.0 - lam)  # all months of the history, present or not
    sums = rows.select(id, month, cap, (s(up) / up).alias("__w0"), (s(up * x) / up).alias("__w1"), (s(up * x * x) / up).alias("__w2"), total.alias("__tot"))
    mean = F.col("__w1") / F.col("__tot")
    raw = F.when(F.col("__w0") > 0, (F.col("__w2") - 2 * mean * F.col("__w1") + mean ** 2 * F.col("__w0")) / F.greatest("__w0", F.lit(1e-6)))
    var = sums.select(id, month, cap, F.when(raw > 0, raw).alias("raw"))
    binned = rank_bins(var, cap, by=[month], id=id, k=10, out="__dec")
    med = quantiles(binned, [month, "__dec"], "raw", {"__gm": 0.5}).drop("n")
    overall = quantiles(var, [month], "raw", {"__am": 0.5}).drop("n")
    j = binned.join(med, [month, "__dec"], "left").join(overall, month, "left")
    base = (1 - shrink) * F.coalesce("raw", "__gm") + shrink * F.coalesce("__gm", "__am")
    return j.select(id, month, "raw", F.greatest(F.coalesce(base, "__am", F.lit(0.01)), F.lit(1e-6)).alias("spec_var"))


def wide_cov(cov: DataFrame, *, month: str, names: Sequence[str]) -> DataFrame:
    """One row per month with a column per covariance cell."""
    return cov.groupBy(month).agg(
        *[F.max(F.when((F.col("i") == a) & (F.col("j") == b), F.col("cov"))).alias(f"__f_{i}_{k}") for i, a in enumerate(names) for k, b in enumerate(names)]
    )


def quadratic(cols: Sequence[Column], k: int) -> Column:
    total = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            total = total + cols[i] * cols[j] * F.col(f"__f_{i}_{j}")
    return total


def total_vol(exposures: DataFrame, cov: DataFrame, spec: DataFrame, *, id: str, month: str, names: Sequence[str]) -> DataFrame:
    j = exposures.join(wide_cov(cov, month=month, names=names), month).join(spec.select(id, month, "spec_var"), [id, month])
    return j.select(id, month, F.sqrt(quadratic([F.col(n) for n in names], len(names)) + F.col("spec_var")).alias("vol"))


def book_risk(book: DataFrame, exposures: DataFrame, cov: DataFrame, spec: DataFrame, *, by: Sequence[str], id: str, month: str, names: Sequence[str]) -> DataFrame:
    """Factor exposures of a book, its variance from factors and names, and volatility."""
    rows = book.select(*by, id, month, "w").join(exposures, [id, month]).join(spec.select(id, month, "spec_var"), [id, month])
    x = rows.groupBy(*by, month).agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names], F.sum(F.col("w") ** 2 * F.col("spec_var")).alias("specific"))
    j = x.join(wide_cov(cov, month=month, names=names), month)
    factor = quadratic([F.col(n) for n in names], len(names))
    return j.select(*by, month, *names, factor.alias("factor_var"), "specific", F.sqrt(factor + F.col("specific")).alias("vol"))


def bias_stat(df: DataFrame, *, by: Sequence[str], ret: str, vol: str) -> DataFrame:
    z = F.col(ret) / F.greatest(F.col(vol), F.lit(1e-12))
    return df.groupBy(*by).agg(F.sqrt(F.avg(z * z)).alias("bias"))
