"""Walk-forward scoring models whose heavy step is an aggregate.

Per-month statistics (rank ICs, cross-product matrices) are computed once over the panel. A training window is then a sum
of months, so expanding windows never copy panel rows; only the small statistics meet the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions import clip, group_stats, month_end, month_index, quantiles, ratio, row_rank, spearman, uniform
from panelmill.operators import book as bk
from panelmill.operators import linear
from panelmill.operators import xsection as xs
from panelmill.sources.io import written


def walk_forward(
    panel: DataFrame, *, month: str, first_year: int, val_months: int = 12, horizon: int = 1, embargo: int | None = None, rolling: int | None = None
) -> DataFrame:
    """One row per test year of the panel: train, validation and test windows separated by the embargo."""
    gap = horizon if embargo is None else embargo
    span = panel.agg(F.min(month).alias("a"), F.max(month).alias("z"))
    years = span.select("a", F.explode(F.sequence(F.lit(first_year), F.year("z"))).alias("test_year"))
    test_start = F.make_date("test_year", F.lit(1), F.lit(31))
    val_end = month_end(test_start, -(gap + 1))
    val_start = month_end(val_end, -(val_months - 1))
    train_end = month_end(val_start, -(gap + 1))
    cal = years.select(
        "test_year", "a", test_start.alias("test_start"), F.make_date("test_year", F.lit(12), F.lit(31)).alias("test_end"),
        val_end.alias("val_end"), val_start.alias("val_start"), train_end.alias("train_end"),
    )
    train_start = F.col("a") if rolling is None else month_end(F.col("train_end"), -(rolling - 1))
    return cal.select("test_year", train_start.alias("train_start"), "train_end", "val_start", "val_end", "test_start", "test_end")


def leakage(cal: DataFrame, horizon: int) -> DataFrame:
    """Splits whose windows overlap or whose labels reach into the next window."""
    gap = lambda a, b: month_index(b) - month_index(a)
    bad = (gap(F.col("train_end"), F.col("val_start")) <= horizon) | (gap(F.col("val_end"), F.col("test_start")) <= horizon)
    return cal.filter(bad)


def assign_split(df: DataFrame, cal: DataFrame, *, month: str) -> DataFrame:
    """Rows with their split and part. The calendar is one row per test year, joined on the month only through a small table."""
    m = F.col("__m")
    months = df.select(F.col(month).alias("__m")).distinct().join(F.broadcast(cal), m.between(F.col("train_start"), F.col("test_end")))  # a few rows
    part = (
        F.when(m.between(F.col("train_start"), F.col("train_end")), "train").when(m.between(F.col("val_start"), F.col("val_end")), "val")
        .when(m.between(F.col("test_start"), F.col("test_end")), "test")
    )
    parts = months.select(F.col("__m").alias(month), "test_year", part.alias("part")).filter("part IS NOT NULL")
    return df.join(parts, month)


def lockbox_violations(df: DataFrame, *, month: str, start: str) -> DataFrame:
    late = F.col(month) >= F.lit(start).cast("date")
    return df.agg(F.sum(late.cast("long")).alias("n"), F.min(F.when(late, F.col(month))).alias("first_month"))


def rank_ic(df: DataFrame, *, by: Sequence[str], month: str, score: str, target: str, bounds: tuple[float, float] | None = None, floor: float = 0.0) -> DataFrame:
    """Mean monthly rank IC; optionally clipped to a band and kept away from zero with its sign."""
    ics = spearman(df, [*by, month], score, target)
    out = ics.groupBy(*by).agg(F.avg("ic").alias("ic"), F.count("ic").cast("long").alias("months"))
    if bounds:
        v = clip("ic", *bounds)
        sign = F.when(v < 0, -1.0).otherwise(1.0)
        out = out.withColumn("ic_used", F.when(F.abs(v) < floor, sign * floor).otherwise(v))
    return out


def standardised(df: DataFrame, signals: Sequence[str], *, month: str) -> DataFrame:
    """``z_*`` columns of all signals from one set of monthly moments, missing as zero."""
    moments = {f"mu_{s}": F.avg(s) for s in signals} | {f"sd_{s}": F.stddev_samp(s) for s in signals}
    st = group_stats(df, [month], **moments)
    z = lambda s: F.when(F.col(f"sd_{s}") > 1e-12, (F.col(s) - F.col(f"mu_{s}")) / F.col(f"sd_{s}"))
    return st.select(*df.columns, *[F.coalesce(z(s), F.lit(0.0)).alias(f"z_{s}") for s in signals])


def score_equal(df: DataFrame, signals: Sequence[str], *, month: str) -> DataFrame:
    """Mean of the standardised signals, missing as zero."""
    z = standardised(df, signals, month=month)
    return z.withColumn("score", xs.row_mean([f"z_{s}" for s in signals]))


def score_theme(df: DataFrame, themes: Mapping[str, Sequence[str]], *, month: str) -> DataFrame:
    """Mean over themes of the mean standardised signal of the theme."""
    names = [s for t in themes.values() for s in t]
    z = score_equal(df, names, month=month)
    return xs.theme_composites(z, {t: [f"z_{s}" for s in ss] for t, ss in themes.items()}).withColumn("score", xs.row_mean([f"theme_{t}" for t in themes]))


def ic_weights(df: DataFrame, signals: Sequence[str], cal: DataFrame, *, id: str, month: str, target: str) -> DataFrame:
    """(test_year, signal, weight) from the mean training IC, negatives dropped, equal when none is positive."""
    ics = spearman(xs.melt(df, [id, month, target], signals), ["signal", month], "value", target)
    train = assign_split(ics, cal, month=month).filter("part = 'train'").groupBy("test_year", "signal").agg(F.avg("ic").alias("ic"))
    kept = train.withColumn("ic", F.greatest(F.coalesce("ic", F.lit(0.0)), F.lit(0.0)))
    w = Window.partitionBy("test_year")
    total = F.sum("ic").over(w)
    return kept.select("test_year", "signal", F.when(total > 0, F.col("ic") / total).otherwise(1.0 / F.count(F.lit(1)).over(w)).alias("weight"))


def score_ic(df: DataFrame, signals: Sequence[str], cal: DataFrame, *, id: str, month: str, target: str) -> DataFrame:
    """Test-year scores of IC-weighted standardised signals."""
    weights = ic_weights(df, signals, cal, id=id, month=month, target=target)
    wide = weights.groupBy("test_year").pivot("signal", list(signals)).agg(F.first("weight"))
    z = standardised(df, signals, month=month)
    test = z.withColumn("test_year", F.year(month)).join(wide.select("test_year", *[F.col(s).alias(f"w_{s}") for s in signals]), "test_year")
    score = sum((F.col(f"z_{s}") * F.coalesce(f"w_{s}", F.lit(0.0)) for s in signals[1:]), F.col(f"z_{signals[0]}") * F.coalesce(f"w_{signals[0]}", F.lit(0.0)))
    return test.select(id, month, "test_year", score.alias("score"))


COEFS = T.ArrayType(T.DoubleType())


def window_grams(
    df: DataFrame, cal: DataFrame, cols: Sequence[str], *, month: str, part: str = "train", vector: tuple[str, int] | None = None
) -> DataFrame:
    """(test_year, gram) of complete rows: monthly cross-products once, then summed over each window's months."""
    rows = df.select(month, *cols, *([vector[0]] if vector else [])).dropna()
    monthly = linear.gram_blocks(rows, by=[month], cols=cols, vector=vector)
    joined = assign_split(monthly, cal, month=month).filter(F.col("part") == part)
    k = len(cols) + (vector[1] if vector else 0)
    sums = joined.groupBy("test_year", "i").agg(F.array(*[F.sum(F.element_at("row", j + 1)) for j in range(k)]).alias("row"))
    return linear.matrices(sums, ["test_year"])


@F.pandas_udf(COEFS)
def _ridge(gram: pd.Series, lam: pd.Series) -> pd.Series:
    """Coefficients from the cross-products of (x..., y); a zero penalty uses the pseudo-inverse."""
    out = []
    for g, l in zip(gram, lam):
        a = np.array([np.asarray(r, float) for r in g])
        x, b = a[:-1, :-1], a[:-1, -1]
        out.append(np.linalg.pinv(x, rcond=1e-10, hermitian=True) @ b if l == 0 else np.linalg.solve(x + l * np.eye(len(b)), b))
    return pd.Series(out)


def ridge_paths(df: DataFrame, signals: Sequence[str], cal: DataFrame, *, month: str, target: str, penalties: Sequence[float]) -> DataFrame:
    """(test_year, penalty, coef) for every penalty from one pass over the panel."""
    grams = window_grams(df, cal, [*signals, target], month=month)
    return grams.withColumn("penalty", F.explode(F.array(*[F.lit(float(p)) for p in penalties]))).withColumn("coef", _ridge("gram", "penalty")).drop("gram")


def score_ols(df: DataFrame, signals: Sequence[str], cal: DataFrame, *, id: str, month: str, target: str) -> DataFrame:
    """Pooled least squares without intercept; collinear signals share through the pseudo-inverse."""
    coef = ridge_paths(df, signals, cal, month=month, target=target, penalties=[0.0])
    test = df.select(id, month, *signals).withColumn("test_year", F.year(month)).join(coef, "test_year")
    return test.select(id, month, "test_year", linear.predict(signals, intercept=False).alias("score"))


def score_ridge(df: DataFrame, signals: Sequence[str], cal: DataFrame, *, id: str, month: str, target: str, penalties: Sequence[float]) -> DataFrame:
    """Ridge whose penalty maximises the validation rank IC (smallest penalty on ties)."""
    paths = ridge_paths(df, signals, cal, month=month, target=target, penalties=penalties)
    val = assign_split(df.select(id, month, target, *signals), cal, month=month).filter("part = 'val'").join(paths, "test_year")
    val = val.withColumn("score", linear.predict(signals, intercept=False))
    ics = rank_ic(val, by=["test_year", "penalty"], month=month, score="score", target=target)
    best = ics.groupBy("test_year").agg(F.min_by("penalty", F.struct(-F.col("ic"), F.col("penalty"))).alias("penalty"))
    coef = paths.join(best, ["test_year", "penalty"])
    test = df.select(id, month, *signals).withColumn("test_year", F.year(month)).join(coef, "test_year")
    return test.select(id, month, "test_year", "penalty", linear.predict(signals, intercept=False).alias("score"))


def poisson_one(u: Column) -> Column:
    """Poisson(1) count from a uniform, by its distribution function."""
    p, total, edges = 0.36787944117144233, 0.0, []
    for k in range(9):
        total += p
        edges.append(total)
        p /= k + 1
    out = F.lit(9)
    for k in range(8, -1, -1):
        out = F.when(u < edges[k], k).otherwise(out)
    return out.cast("double")


def score_ridge_ensemble(
    df: DataFrame, signals: Sequence[str], cal: DataFrame, *, id: str, month: str, target: str, alpha: float = 1.0, members: int = 5, salt: str = "0"
) -> DataFrame:
    """Ridge on standardised signals fitted on bootstrap copies: mean prediction and its spread over members.

    A bootstrap copy is a Poisson(1) weight per row and member, so it is drawn where the row lives.
    """
    train = assign_split(df.select(id, month, target, *signals), cal, month=month).filter("part = 'train'").filter(F.col(target).isNotNull())
    stats = train.groupBy("test_year").agg(
        *[F.avg(s).alias(f"mu_{s}") for s in signals], *[F.greatest(F.stddev_pop(s), F.lit(1e-8)).alias(f"sd_{s}") for s in signals]
    )
    z = lambda s: clip((F.coalesce(F.col(s), F.lit(0.0)) - F.col(f"mu_{s}")) / F.col(f"sd_{s}"), -8, 8)
    ready = train.join(stats, "test_year").select("test_year", id, month, F.lit(1.0).alias("__one"), *[z(s).alias(f"z_{s}") for s in signals], target)
    copies = ready.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    copies = copies.withColumn("__w", poisson_one(uniform(salt, F.col("member"), F.col(id), F.col(month)))).filter("__w > 0")
    cols = ["__one", *[f"z_{s}" for s in signals], target]
    blocks = linear.gram_blocks(copies, by=["test_year", "member"], cols=cols, weight="__w")
    grams = linear.matrices(blocks, ["test_year", "member"])

    @F.pandas_udf(COEFS)
    def fit(gram: pd.Series) -> pd.Series:
        out = []
        for g in gram:
            a = np.array([np.asarray(r, float) for r in g])
            x, b = a[:-1, :-1], a[:-1, -1]
            pen = alpha * np.eye(len(b))
            pen[0, 0] = 0.0  # the intercept is free
            out.append(np.linalg.solve(x + pen, b))
        return pd.Series(out)

    coef = grams.withColumn("coef", fit("gram")).groupBy("test_year").agg(F.collect_list("coef").alias("coefs"))  # one per member
    test = df.select(id, month, *signals).withColumn("test_year", F.year(month)).join(coef, "test_year").join(stats, "test_year")
    features = F.array(F.lit(1.0), *[z(s) for s in signals])
    test = test.withColumn("__x", features).withColumn(
        "__p", F.transform("coefs", lambda c: F.aggregate(F.zip_with(c, F.col("__x"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    )
    n = float(members)
    mean = F.aggregate("__p", F.lit(0.0), lambda a, b: a + b) / n
    test = test.withColumn("score", mean)
    spread = F.aggregate(F.transform("__p", lambda p: (p - F.col("score")) ** 2), F.lit(0.0), lambda a, b: a + b)
    return test.select(id, month, "test_year", "score", (F.sqrt(spread / (n - 1)) if members > 1 else F.lit(None).cast("double")).alias("unc_sd"))


def _assembled(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.select("*", *[F.coalesce(s, F.lit(0.0)).alias(f"__f_{s}") for s in signals])
    return VectorAssembler(inputCols=[f"__f_{s}" for s in signals], outputCol="features").transform(filled).drop(*[f"__f_{s}" for s in signals])


def score_gbt(df: DataFrame, signals: Sequence[str], cal: DataFrame, *, id: str, month: str, target: str, trees: int = 10, depth: int = 3, seed: int = 0) -> DataFrame:
    """Gradient-boosted trees with early stopping on the validation window; one distributed fit per test year."""
    from pyspark.ml.regression import GBTRegressor

    rows = _assembled(assign_split(df.select(id, month, target, *signals), cal, month=month), signals)
    out = None
    for r in cal.select("test_year").orderBy("test_year").collect():  # a few years
        y = rows.filter(F.col("test_year") == r["test_year"])
        train = y.filter("part <> 'test'").filter(F.col(target).isNotNull()).withColumn("is_val", F.col("part") == "val")
        model = GBTRegressor(
            featuresCol="features", labelCol=target, predictionCol="score", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, validationIndicatorCol="is_val"
        ).fit(train)
        part = model.transform(y.filter("part = 'test'")).select(id, month, "test_year", "score")
        out = part if out is None else out.unionByName(part)
    return out


def rff_features(df: DataFrame, signals: Sequence[str], n_features: int, *, gamma: float | None = None, seed: int = 0) -> DataFrame:
    """Random Fourier features sqrt(2/P) cos(xW + b) of standardised inputs as an array column ``rff``; the map depends on the seed only."""
    d = len(signals)
    g = 1.0 / (2.0 * d) if gamma is None else gamma
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0.0, np.sqrt(2.0 * g), size=(d, n_features)), rng.uniform(0, 2 * np.pi, size=n_features)

    @F.pandas_udf(COEFS)
    def project(x: pd.Series) -> pd.Series:
        z = np.stack(x.to_numpy())
        return pd.Series(list(np.sqrt(2.0 / n_features) * np.cos(z @ w + b)))

    return df.withColumn("rff", project(F.array(*[F.coalesce(s, F.lit(0.0)) for s in signals])))


def score_rff(
    df: DataFrame, signals: Sequence[str], cal: DataFrame, *, id: str, month: str, target: str, n_features: int, penalty: str = "ridge", alpha: float = 1.0, seed: int = 0
) -> DataFrame:
    """Dense (ridge) or sparse (L1) regression on random features; ``complexity`` is features per training row."""
    stats = df.agg(*[F.avg(s).alias(f"mu_{s}") for s in signals], *[F.greatest(F.stddev_pop(s), F.lit(1e-8)).alias(f"sd_{s}") for s in signals])
    z = df.join(F.broadcast(stats), F.lit(True)).select(  # one-row side
        id, month, target, *[clip((F.coalesce(F.col(s), F.lit(0.0)) - F.col(f"mu_{s}")) / F.col(f"sd_{s}"), -8, 8).alias(s) for s in signals]
    )
    rff = rff_features(z, signals, n_features, seed=seed)
    size = assign_split(df.filter(F.col(target).isNotNull()).groupBy(month).agg(F.count(F.lit(1)).alias("n")), cal, month=month)
    size = size.filter("part = 'train'").groupBy("test_year").agg((F.lit(float(n_features)) / F.sum("n")).alias("complexity"))
    if penalty == "ridge":
        grams = window_grams(rff, cal, [target], month=month, vector=("rff", n_features))
        coef = grams.select("test_year", _ridge("gram", F.lit(float(alpha))).alias("coef"))
        dot = F.aggregate(F.zip_with("coef", "rff", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        test = rff.withColumn("test_year", F.year(month)).join(coef, "test_year").withColumn("score", dot)
        return test.join(size, "test_year").select(id, month, "test_year", "complexity", "score")
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rows = assign_split(rff.withColumn("features", array_to_vector("rff")), cal, month=month)
    out = None
    for r in cal.select("test_year").orderBy("test_year").collect():  # a few years
        y = rows.filter(F.col("test_year") == r["test_year"])
        model = LinearRegression(featuresCol="features", labelCol=target, predictionCol="score", regParam=alpha, elasticNetParam=1.0).fit(
            y.filter("part = 'train'").filter(F.col(target).isNotNull())
        )
        part = model.transform(y.filter("part = 'test'")).select(id, month, "test_year", "score")
        out = part if out is None else out.unionByName(part)
    return out.join(size, "test_year").select(id, month, "test_year", "complexity", "score")


SPECTRUM = T.StructType([T.StructField(n, T.DoubleType()) for n in ("top1_share", "top5_share", "top10_share", "effective_rank")])


@F.pandas_udf(SPECTRUM)
def _spectrum(gram: pd.Series) -> pd.DataFrame:
    rows = []
    for g in gram:
        a = np.array([np.asarray(r, float) for r in g])
        n, s = a[0, 0], a[0, 1:]
        cov = (a[1:, 1:] - np.outer(s, s) / n) / (n - 1)
        v = np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None)
        share = v / v.sum()
        live = share[share > 0]
        rows.append((share[0], share[:5].sum(), share[:10].sum(), float(np.exp(-(live * np.log(live)).sum()))))
    return pd.DataFrame(rows, columns=[f.name for f in SPECTRUM.fields])


def spectrum(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Eigenvalue shares and effective rank of the feature covariance."""
    rows = df.select(F.lit(1.0).alias("__one"), *cols).dropna()
    g = linear.matrices(linear.gram_blocks(rows.withColumn("g", F.lit(1)), by=["g"], cols=["__one", *cols]), ["g"])
    return g.select(_spectrum("gram").alias("s"), F.element_at(F.element_at("gram", 1), 1).cast("long").alias("n_obs")).select("n_obs", "s.*")


def select_trials(trials: DataFrame, *, by: Sequence[str], params: str, metric: str) -> DataFrame:
    """Best trial of each split by validation metric; the first parameter string on ties."""
    ok = trials.filter(F.col(metric).isNotNull())
    return ok.groupBy(*by).agg(
        F.min_by(params, F.struct(-F.col(metric), F.col(params))).alias(params), F.max(metric).alias(metric), F.count(F.lit(1)).cast("long").alias("n_trials")
    )


def scale_alpha(df: DataFrame, *, by: Sequence[str], score: str, vol: str, ic: float | Column) -> DataFrame:
    """Forecast alpha = IC x volatility x standardised score."""
    z = xs.xs_z(df, score, by=list(by), out="__z", ddof=0, bound=4.0)
    return z.withColumn("alpha", (ic if isinstance(ic, Column) else F.lit(float(ic))) * F.col(vol) * F.col("__z")).drop("__z")


def _shrunk(alpha: str, unc: str, kappa: float | Column) -> Column:
    """Alpha where the uncertainty's mean over the cross-section is ``__mu``."""
    k = kappa if isinstance(kappa, Column) else F.lit(float(kappa))
    return F.col(alpha) / (1.0 + k * F.coalesce(ratio(unc, "__mu"), F.lit(1.0)) ** 2)


def shrink(df: DataFrame, *, by: Sequence[str], alpha: str, unc: str, kappa: float | Column) -> DataFrame:
    """Alpha shrunk where its uncertainty exceeds the mean of its cross-section."""
    st = group_stats(df, list(by), __mu=F.avg(unc))
    return st.withColumn("alpha_shrunk", _shrunk(alpha, unc, kappa)).drop("__mu")


def proxy_books(df: DataFrame, alphas: Mapping[str, Column], *, by: Sequence[str], vol: str, gross: float = 2.0, cap: float = 0.01) -> DataFrame:
    """Diagonal mean-variance books, one weight column for each alpha: alpha over variance, neutral, capped, legs equalised, gross at most ``gross``.

    Cross-sections give a few numbers each to all books at once; rows are neither repeated nor shuffled.
    """
    by, outs = list(by), list(alphas)
    col = lambda name, o: F.col(f"__{name}_{o}")
    var = F.greatest(F.col(vol) ** 2, F.lit(1e-8))
    s = df.select("*", *[(F.coalesce(a, F.lit(0.0)) / var).alias(f"__a_{o}") for o, a in alphas.items()])
    s = group_stats(s, by, **{f"__mu_{o}": F.avg(f"__a_{o}") for o in outs})
    s = s.withColumns({f"__a_{o}": col("a", o) - col("mu", o) for o in outs})
    s = group_stats(s, by, **{f"__den_{o}": F.sum(F.abs(f"__a_{o}")) for o in outs})
    s = s.withColumns({f"__w_{o}": F.when(col("den", o) >= 1e-12, clip(gross * col("a", o) / col("den", o), -cap, cap)).otherwise(0.0) for o in outs})
    legs = {f"__long_{o}": F.sum(F.greatest(f"__w_{o}", F.lit(0.0))) for o in outs} | {f"__short_{o}": F.sum(F.greatest(-col("w", o), F.lit(0.0))) for o in outs}
    s = group_stats(s, by, **legs)

    def weight(o: str) -> Column:
        target = F.least(col("long", o), col("short", o))
        side = F.when(col("w", o) > 0, col("long", o)).otherwise(col("short", o))
        w = F.when(target > 0, col("w", o) * target / F.when(side > 0, side))
        scale = F.when(2 * target > gross, gross / (2 * target)).otherwise(1.0)
        return F.coalesce(w * scale, F.lit(0.0))

    return s.withColumns({o: weight(o) for o in outs}).drop(*[f"__{x}_{o}" for o in outs for x in ("a", "mu", "den", "w", "long", "short")])


def proxy_book(df: DataFrame, *, by: Sequence[str], alpha: str, vol: str, gross: float = 2.0, cap: float = 0.01) -> DataFrame:
    """``proxy_books`` of one alpha, its weight as ``w``."""
    return proxy_books(df, {"w": F.col(alpha)}, by=by, vol=vol, gross=gross, cap=cap)


def proxy_nets(book: DataFrame, weights: Mapping[str, str], *, by: Sequence[str], id: str, month: str, aum: float, borrow: float) -> DataFrame:
    """Monthly net return of books (weight -> output) against their previous weights (names that left are not charged), from one shuffle of their rows."""
    by = list(by)
    dates = written(bk.book_dates(book, by, month).select(*by, month, "__i"), "dates")
    rows = book.join(dates, [*by, month]).select(*by, id, month, "__i", "ret_next", "spread", "sigma_d", "adv_usd", *weights)
    over = Window.partitionBy(*by, id).orderBy(month)
    follows = F.lag("__i").over(over) == F.col("__i") - 1
    rows = rows.withColumns({f"__p_{w}": F.when(follows, F.lag(w).over(over)) for w in weights})

    def net(w: str) -> Column:
        lin, imp = bk.trade_cost(F.col(w) - F.coalesce(f"__p_{w}", F.lit(0.0)), F.col("spread"), F.col("sigma_d"), F.col("adv_usd"), F.lit(float(aum)))
        return F.col(w) * F.coalesce("ret_next", F.lit(0.0)) - lin - imp - bk.borrow_cost(F.col(w), borrow)

    return rows.groupBy(*by, month).agg(*[F.sum(net(w)).alias(out) for w, out in weights.items()])


def proxy_net(book: DataFrame, *, by: Sequence[str], id: str, month: str, aum: float, borrow: float) -> DataFrame:
    """``proxy_nets`` of the weight ``w``."""
    return proxy_nets(book, {"w": "net_ret"}, by=by, id=id, month=month, aum=aum, borrow=borrow)


def select_kappa(
    df: DataFrame, grid: Sequence[float], *, by: Sequence[str], id: str, month: str, alpha: str, unc: str, vol: str, aum: float, borrow: float, cap: float = 0.01,
) -> DataFrame:
    """Total validation net return of each model's proxy book at every shrinkage strength, and which is best (the smallest on ties).

    The books of all strengths are columns beside each other, so a row is shuffled once for all of them.
    """
    by = list(by)
    strengths = {f"__w{i}": k for i, k in enumerate(dict.fromkeys(float(k) for k in grid))}
    rows = group_stats(df, [*by, month], __mu=F.avg(unc))
    book = proxy_books(rows, {w: _shrunk(alpha, unc, k) for w, k in strengths.items()}, by=[*by, month], vol=vol, cap=cap)
    nets = proxy_nets(book, {w: f"__net{w}" for w in strengths}, by=by, id=id, month=month, aum=aum, borrow=borrow)
    sums = nets.groupBy(*by).agg(*[F.sum(f"__net{w}").alias(w) for w in strengths])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kappa"), F.col(w).alias("total")) for w, k in strengths.items()]))
    total = sums.select(*by, each.alias("__k")).select(*by, "__k.*")
    best = F.first("kappa").over(Window.partitionBy(*by).orderBy(F.col("total").desc(), "kappa"))  # one row per strength
    return total.select(*by, "kappa", "total", (F.col("kappa") == best).alias("best"))


#: Buckets of absolute residuals, and bins of relative ones, to an octave.
OCTAVE = BINS = 16


def conformal(
    df: DataFrame, *, by: Sequence[str], id: str, month: str, score: str, truth: str, months: int = 24, alpha: float = 0.1, min_n: int = 100,
) -> DataFrame:
    """Half-width of each month's interval: the k-th smallest absolute residual of the trailing existing months.

    Output (by, month, n, half_width, unc_sd). A month keeps counts of its residuals by bucket, which add up over trailing months; they tell the
    bucket that holds the k-th residual, and only that bucket's values are met again.
    """
    by = list(by)
    order = df.select(month).distinct().withColumn("__i", F.row_number().over(Window.orderBy(month)))  # months only
    resid = df.select(*by, month, F.abs(F.col(truth) - F.col(score)).alias("__e")).filter("__e IS NOT NULL").join(F.broadcast(order), month)
    bucket = F.when(F.col("__e") > 0, F.floor(F.log2("__e") * OCTAVE)).otherwise(-(1 << 20)).cast("int")
    values = written(resid.groupBy(*by, "__i", "__e").agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", bucket), "residuals")
    later = lambda rows: rows.withColumn("__to", F.explode(F.sequence(F.col("__i") + 1, F.col("__i") + months)))
    counts = later(values.groupBy(*by, "__i", "__b").agg(F.sum("__n").alias("__n"))).groupBy(*by, "__to", "__b").agg(F.sum("__n").alias("__n"))
    run = Window.partitionBy(*by, "__to").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("__upto", F.sum("__n").over(run)).withColumn("n", F.sum("__n").over(Window.partitionBy(*by, "__to")))
    k = F.least(F.ceil((F.col("n") + 1) * (1.0 - alpha)), F.col("n"))
    aim = placed.filter((F.col("n") >= min_n) & (F.col("__upto") >= k) & (F.col("__upto") - F.col("__n") < k))
    aim = aim.select(*by, "__to", "__b", "n", (k - (F.col("__upto") - F.col("__n"))).alias("__k"))
    source = aim.withColumn("__i", F.explode(F.sequence(F.col("__to") - months, F.col("__to") - 1)))
    inside = values.join(source, [*by, "__i", "__b"]).groupBy(*by, "__to", "n", "__k", "__e").agg(F.sum("__n").alias("__n"))
    within = Window.partitionBy(*by, "__to").orderBy("__e").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("__upto", F.sum("__n").over(within)).filter(F.col("__upto") >= F.col("__k"))
    hit = reached.groupBy(*by, "__to", "n").agg(F.min("__e").alias("half_width"))
    out = hit.join(F.broadcast(order.withColumnRenamed("__i", "__to")), "__to")
    return out.select(*by, month, "n", "half_width", (F.col("half_width") / 1.645 if abs(alpha - 0.1) < 1e-12 else F.col("half_width")).alias("unc_sd"))


def conformal_bounds(df: DataFrame, widths: DataFrame, *, by: Sequence[str], month: str, score: str, truth: str) -> DataFrame:
    """``df`` with each security's bounds, and whether its truth (null: not known) lies within them; months without a width are left out."""
    rows = df.join(widths.select(*by, month, "half_width"), [*by, month])
    low, high = F.col(score) - F.col("half_width"), F.col(score) + F.col("half_width")
    return rows.select(*df.columns, low.alias("lower"), high.alias("upper"), ((F.col(truth) >= low) & (F.col(truth) <= high)).alias("inside"))


def scale_path(x: np.ndarray, start: float, alpha: float, rate: float) -> tuple[float, float, float]:
    """(scale used, coverage, next scale) of one month of relative residuals."""
    covered = float((x <= start).mean())
    return start, covered, float(np.clip(start * np.exp(rate * ((1 - alpha) - covered)), 0.25, 4.0))


def conformal_adaptive(df: DataFrame, widths: DataFrame, *, by: Sequence[str], month: str, score: str, truth: str, alpha: float = 0.1, rate: float = 0.05) -> DataFrame:
    """Interval scale fed back from each month's realised coverage: (by, month, scale, coverage, n).

    All that a scale needs of a month is how many relative residuals it covers. A scale stays within [1/4, 4], so a month is first counted in BINS
    bins to an octave, in one aggregation; the recursion over months runs on the bins, and its scales are made exact by passes in which every month counts the residuals up to its present scale. Months depend on earlier ones only: a pass settles at least one more
    month, and all at once as soon as no scale moves any count.
    """
    by = list(by)
    x = F.abs(F.col(truth) - F.col(score)) / F.col("half_width")
    rows = df.join(widths.select(*by, month, "half_width"), [*by, month]).select(*by, month, x.alias("x")).filter("x IS NOT NULL")
    values = written(rows.groupBy(*by, month, "x").agg(F.count(F.lit(1)).alias("k")), "relative-residuals")
    bin_of = F.when(F.col("x") > 0, F.ceil(F.greatest(F.least(F.log2("x"), F.lit(2.5)), F.lit(-2.5)) * BINS)).otherwise(-3 * BINS)
    bins = values.groupBy(*by, month, bin_of.alias("bin")).agg(F.max("x").alias("x"), F.sum("k").alias("k"))
    first = bins.groupBy(*by, month).agg(F.sum("k").alias("n"), F.sort_array(F.collect_list(F.struct("x", "k"))).alias("steps"))
    path = written(_scales(first, by, month, alpha, rate), "scales")
    while True:
        met = values.join(path.select(*by, month, "scale"), [*by, month]).groupBy(*by, month).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("x") <= F.col("scale"), F.col("k")).otherwise(0)).alias("__c"))
        steps = F.array(F.struct(F.lit(0.0).alias("x"), F.col("__c").alias("k")))
        exact = written(_scales(met.select(*by, month, "n", steps.alias("steps")), by, month, alpha, rate), "scales")
        moved = exact.join(path.select(*by, month, F.col("scale").alias("__s")), [*by, month]).agg(F.max(F.abs(F.col("scale") - F.col("__s")))).first()[0]
        if not moved:
            return exact
        path = exact


def _scales(months: DataFrame, by: Sequence[str], month: str, alpha: float, rate: float) -> DataFrame:
    """(by, month, scale, coverage, n): the recursion over the months of each key; ``steps`` counts its residuals up to some sizes."""
    by = list(by)
    schema = T.StructType([*(months.schema[b] for b in by), T.StructField(month, T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("scale", "coverage")), T.StructField("n", T.LongType())])

    def fold(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                scale = 1.0
                for s in row["__m"]:
                    covered = sum(p["k"] for p in s["steps"] if p["x"] <= scale) / s["n"]
                    found.append((*(row[b] for b in by), s["m"], scale, covered, s["n"]))
                    scale = min(max(scale * math.exp(rate * ((1 - alpha) - covered)), 0.25), 4.0)
            if found:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=[*by, month, "scale", "coverage", "n"]), preserve_index=False)

    rows = months.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(month).alias("m"), "n", "steps"))).alias("__m"))
    return rows.mapInArrow(fold, schema)


def blend_width(df: DataFrame, *, by: Sequence[str], width: str, dispersion: str) -> DataFrame:
    """Calibrated width times the name's dispersion relative to its cross-section."""
    st = group_stats(df, list(by), __mu=F.avg(dispersion))
    rel = F.when(F.col("__mu") > 0, F.col(dispersion) / F.col("__mu")).otherwise(1.0)
    return st.withColumn("unc_sd", F.col(width) * F.coalesce(rel, F.lit(1.0))).drop("__mu")


def dispersion(df: DataFrame, *, by: Sequence[str], metric: str, reference: str) -> DataFrame:
    """Spread of a metric over seeds, and the gap to a reference in units of that spread."""
    g = df.groupBy(*by).agg(
        F.count(metric).cast("long").alias("seeds"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.min(metric).alias("lo"),
        F.max(metric).alias("hi"), F.avg(reference).alias("ref"),
    )
    return g.withColumn("gap_over_sd", ratio(F.col("mean") - F.col("ref"), "sd"))


def plan_audit(trials: DataFrame, plan: DataFrame, *, by: Sequence[str], params: str, keys: Sequence[str]) -> DataFrame:
    """Trials inside and outside the registered grid, and the N to deflate by (the larger of registered and distinct fitted)."""
    parsed = trials.select(*by, F.from_json(params, "map<string,string>").alias("__p"), params)
    parsed = parsed.select(*by, params, *[F.col("__p")[k].alias(k) for k in keys])
    grid = plan.select(*by, *keys).distinct().withColumn("__in", F.lit(True))
    registered = plan.select(*by, *keys).distinct().groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("registered"))
    j = parsed.join(grid, [*by, *keys], "left")
    inside = F.col("__in").isNotNull()
    g = j.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("trials"), F.sum(inside.cast("long")).alias("inside"), F.sum((~inside).cast("long")).alias("outside"),
        F.count_distinct(params).cast("long").alias("distinct_configs"),
    )
    out = g.join(registered, list(by), "left")
    return out.withColumn("n_deflate", F.greatest(F.coalesce("registered", F.lit(0)), F.col("distinct_configs")))


def trial_counts(exhibit: DataFrame, trials: DataFrame, *, exhibit_key: str, run: str, params: str) -> DataFrame:
    """Distinct configurations behind each exhibit, from the runs it was built from."""
    return exhibit.join(trials, run).groupBy(exhibit_key).agg(
        F.count_distinct(run).cast("long").alias("runs"), F.count(F.lit(1)).cast("long").alias("trials"), F.count_distinct(params).cast("long").alias("configs")
    )


def persistence(df: DataFrame, signals: Sequence[str], *, id: str, month: str, bounds: tuple[float, float] = (0.0, 0.99), min_n: int = 12) -> DataFrame:
    """Mean over names of each signal's lag-one autocorrelation, clipped."""
    long = xs.melt(df, [id, month], signals).filter("value IS NOT NULL")
    lagged = long.withColumn("__p", F.lag("value").over(Window.partitionBy("signal", id).orderBy(month))).filter("__p IS NOT NULL")
    flat = (F.stddev_pop("value") < 1e-12) | (F.stddev_pop("__p") < 1e-12)
    per = lagged.groupBy("signal", id).agg(F.count(F.lit(1)).alias("n"), F.when(~flat, F.corr("value", "__p")).alias("ac")).filter(F.col("n") >= min_n)
    return per.groupBy("signal").agg(clip(F.avg("ac"), *bounds).alias("persistence"), F.count("ac").cast("long").alias("names"))


def inflation_gap(trials: DataFrame, *, by: Sequence[str], sharpe: str, months: int) -> DataFrame:
    """Best observed Sharpe against the best expected of as many skill-less trials."""
    from panelmill.operators.inference import expected_max

    g = trials.groupBy(*by).agg(F.count(sharpe).alias("n"), F.max(sharpe).alias("best"), F.avg(sharpe).alias("mean"))
    sd = F.lit(1.0 / float(max(months - 1, 1)) ** 0.5)
    out = g.select(*by, F.col("n").cast("long").alias("n_trials"), "best", "mean", expected_max(F.col("n"), sd).alias("__e"))
    return out.withColumn("expected_best", F.col("__e") * 12.0 ** 0.5).withColumn("gap", F.col("best") - F.col("expected_best")).drop("__e")


def implied_theme_weights(book: DataFrame, exposures: DataFrame, themes: Sequence[str], *, by: Sequence[str], id: str, month: str) -> DataFrame:
    """Monthly regression of weights on theme scores: how much of each theme the book holds."""
    rows = book.select(*by, id, month, "w").join(exposures.select(id, month, *themes), [id, month])
    fit = linear.ols(rows, by=[*by, month], y="w", xs=themes)
    return fit.select(*by, month, *[F.element_at("coef", i + 2).alias(t) for i, t in enumerate(themes)])


def state_dependence(implied: DataFrame, states: DataFrame, themes: Sequence[str], names: Sequence[str], *, by: Sequence[str], month: str) -> DataFrame:
    """Regression of implied theme weights on market states, with t-statistics."""
    rows = xs.melt(implied, [*by, month], themes, "theme", "weight").join(states.select(month, *names), month)
    fit = linear.ols(rows, by=[*by, "theme"], y="weight", xs=names)
    cells = F.array(*[
        F.struct(F.lit(s).alias("state"), F.element_at("coef", i + 2).alias("coefficient"), ratio(F.element_at("coef", i + 2), F.element_at("se", i + 2)).alias("t_stat"))
        for i, s in enumerate(names)
    ])
    return fit.select(*by, "theme", F.explode(cells).alias("c")).select(*by, "theme", "c.*")


def economic_importance(
    df: DataFrame, coefs: Mapping[str, float], themes: Mapping[str, Sequence[str]], *, id: str, month: str, vol: str, aum: float, borrow: float,
    cap: float = 0.01,
) -> DataFrame:
    """Net return lost when a theme is set to its monthly median in a linear score."""
    names = list(coefs)
    med = df.select(month).distinct()
    for s in names:
        med = med.join(quantiles(df, [month], s, {f"__m_{s}": 0.5}).drop("n"), month, "left")
    rows = df.join(med, month)

    def score(muted: Sequence[str]) -> Column:
        pick = lambda s: F.col(f"__m_{s}") if s in muted else F.col(s)
        return sum((F.coalesce(pick(s), F.lit(0.0)) * float(coefs[s]) for s in names[1:]), F.coalesce(pick(names[0]), F.lit(0.0)) * float(coefs[names[0]]))

    variants = F.array(F.struct(F.lit("").alias("theme"), score([]).alias("alpha")), *[F.struct(F.lit(t).alias("theme"), score(ss).alias("alpha")) for t, ss in themes.items()])
    long = rows.withColumn("__v", F.explode(variants)).select(id, month, "__v.theme", "__v.alpha", vol, "ret_next", "spread", *([] if vol == "sigma_d" else ["sigma_d"]), "adv_usd")
    book = proxy_book(long, by=["theme", month], alpha="alpha", vol=vol, cap=cap)
    total = proxy_net(book, by=["theme"], id=id, month=month, aum=aum, borrow=borrow).groupBy("theme").agg(F.sum("net_ret").alias("total"))
    full = total.filter("theme = ''").select(F.col("total").alias("net_return_full"))
    return total.filter("theme <> ''").join(F.broadcast(full), F.lit(True)).select(  # one-row side
        "theme", F.col("total").alias("net_return_without"), "net_return_full", (F.col("net_return_full") - F.col("total")).alias("importance")
    )


def statistical_importance(coefs: DataFrame, meta: DataFrame, *, feature: str, value: str, theme: str) -> DataFrame:
    """Sum of absolute coefficients by theme; unknown features count as other."""
    j = coefs.join(meta.select(feature, theme), feature, "left")
    return j.groupBy(F.coalesce(theme, F.lit("other")).alias("theme")).agg(F.sum(F.abs(value)).alias("importance"))
