"""Least squares by sufficient statistics: Spark sums the cross-products, a small system is solved per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIT = T.StructType([
    T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("se", T.ArrayType(T.DoubleType())), T.StructField("rss", T.DoubleType())
])


@F.pandas_udf(FIT)
def _solve(n: pd.Series, gram: pd.Series, xy: pd.Series, yy: pd.Series, ridge: pd.Series) -> pd.DataFrame:
    coefs, ses, rss = [], [], []
    for m, g, b, s, lam in zip(n, gram, xy, yy, ridge):
        k = len(b)
        a = np.zeros((k, k))
        a[np.triu_indices(k)] = np.asarray(g, float)
        a = a + np.triu(a, 1).T + lam * np.eye(k)
        b = np.asarray(b, float)
        inv = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
        c = inv @ b
        left = max(float(s - 2 * c @ b + c @ a @ c), 0.0)
        coefs.append(c)
        ses.append(np.sqrt(np.clip(np.diag(inv) * left / max(m - k, 1), 0, None)))
        rss.append(left)
    return pd.DataFrame({"coef": coefs, "se": ses, "rss": rss})


def ols(
    df: DataFrame, *, by: Sequence[str], y: str, xs: Sequence[str], weight: str | None = None, ridge: float = 0.0, intercept: bool = True,
    min_extra: int = 0,
) -> DataFrame:
    """(Weighted) least squares per group over complete rows: n, coef, se, rss; the intercept comes first.

    Cross-products are ordinary partial aggregates, so a group of any size reduces map-side to k*k numbers.
    """
    terms: list[Column] = ([F.lit(1.0)] if intercept else []) + [F.col(x).cast("double") for x in xs]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ok = F.col(y).isNotNull()
    for x in xs:
        ok = ok & F.col(x).isNotNull()
    if weight:
        ok = ok & (w > 0)
    k = len(terms)
    target = F.col(y).cast("double")
    sums = df.filter(ok).groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.array(*[F.sum(w * terms[i] * terms[j]) for i in range(k) for j in range(i, k)]).alias("__g"),
        F.array(*[F.sum(w * t * target) for t in terms]).alias("__b"),
        F.sum(w * target * target).alias("__s"),
    )
    fit = sums.filter(F.col("n") >= k + min_extra).withColumn("__f", _solve("n", "__g", "__b", "__s", F.lit(float(ridge))))
    return fit.select(*by, "n", "__f.coef", "__f.se", "__f.rss")


def predict(terms: Sequence[str], coef: str = "coef", intercept: bool = True) -> Column:
    first = 1 if intercept else 0
    total = F.element_at(coef, 1) if intercept else F.lit(0.0)
    for i, x in enumerate(terms):
        total = total + F.element_at(coef, i + 1 + first) * F.col(x)
    return total


def gram_blocks(df: DataFrame, *, by: Sequence[str], cols: Sequence[str], weight: str | None = None, vector: tuple[str, int] | None = None) -> DataFrame:
    """Cross-product matrix of many columns per group, as (by, i, row) where ``row`` is the i-th matrix row.

    Each task sums the outer products of its Arrow batches, so k*k numbers per task and group reach the shuffle.
    Rows with a missing column must be filled or dropped before. ``vector`` names an array column and its length, whose
    elements come before ``cols``.
    """
    by, cols = list(by), list(cols)
    fields = [df.schema[b] for b in by]
    schema = T.StructType([*fields, T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))])
    sent = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols], *([F.col(weight).alias("__w")] if weight else []), *([F.col(vector[0]).alias("__v")] if vector else []))
    size = len(cols) + (vector[1] if vector else 0)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, g in pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]:
                x = g[cols].to_numpy(float)
                if vector:
                    x = np.hstack([np.stack(g["__v"].to_numpy()), x])
                xw = x * g["__w"].to_numpy(float)[:, None] if weight else x
                key = key if isinstance(key, tuple) else (key,)
                total[key] = total.get(key, 0.0) + xw.T @ x
        for key, m in total.items():
            out = pd.DataFrame({"i": np.arange(size, dtype="int32"), "row": list(m)})
            for name, v in zip(by, key):
                out[name] = v
            yield out[[*by, "i", "row"]]

    parts = sent.mapInPandas(partial, schema)
    k = size
    sums = parts.groupBy(*by, "i").agg(*[F.sum(F.element_at("row", j + 1)).alias(f"s{j}") for j in range(k)])
    return sums.select(*by, "i", F.array(*[f"s{j}" for j in range(k)]).alias("row"))


def matrices(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group with the matrix rows in order."""
    return blocks.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "row"))), lambda r: r["row"]).alias("gram"))
