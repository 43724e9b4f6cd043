"""Stationary-bootstrap replications in bundles: one task row is a series and some hundred replications, worked as one array.

A series (months, so a few hundred numbers) travels once per bundle, whatever the number of replications; its copies never become rows.
Draws come from a digest of (salt, replication, position), so every run and engine draws the same positions, and series of equal length
share them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Replications of a bundle.
BUNDLE = 250


@lru_cache(maxsize=64)
def _uniforms(salt: str, first: int, count: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws (restart, start) of replications [first, first + count) at positions below ``upto``."""
    draw = lambda b, t, tag: int.from_bytes(hashlib.md5(f"{salt}|{b}|{t}|{tag}".encode()).digest()[:4], "big") / 4294967296.0
    pairs = [[(draw(b, t, "r"), draw(b, t, "s")) for t in range(upto)] for b in range(first, first + count)]
    both = np.array(pairs, float).reshape(count, upto, 2)
    return both[..., 0], both[..., 1]


def draws(n: int, first: int, count: int, block: int, salt: str) -> np.ndarray:
    """Positions (count x n) of replications in a series of length ``n``: runs that restart with probability 1 / block and wrap around."""
    restart, start = (u[:, :n] for u in _uniforms(salt, first, count, -(-n // 64) * 64))
    t = np.arange(n)
    begins = (restart < 1.0 / block) | (t == 0)
    since = np.maximum.accumulate(np.where(begins, t, 0), axis=1)
    return (np.floor(np.take_along_axis(start, since, 1) * n).astype(np.int64) + t - since) % n


def hac(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and Newey-West error of each row of ``x``; the error is NaN below three columns."""
    n = x.shape[1]
    mean = x.mean(1)
    if n < 3:
        return mean, np.full(len(x), np.nan)
    lags = max(min(int(np.floor(4.0 * (n / 100.0) ** (2.0 / 9.0))), n - 2), 0)
    run = np.cumsum(x - mean[:, None], axis=1)
    padded = np.concatenate([np.zeros((len(x), lags + 1)), run], axis=1)
    inside = ((run - padded[:, :n]) ** 2).sum(1)
    beyond = (run[:, n - lags - 1 : n - 1] ** 2).sum(1)
    return mean, np.sqrt((inside + beyond) / (lags + 1.0)) / n


def sharpe(x: np.ndarray, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Annual Sharpe ratio of each row and every column's influence on it; NaN where a row does not vary."""
    mean, sd = x.mean(1, keepdims=True), x.std(1, ddof=1, keepdims=True) if x.shape[1] > 1 else np.full((len(x), 1), np.nan)
    sd = np.where(sd > 0, sd, np.nan)
    s, z = mean / sd, (x - mean) / sd
    return s[:, 0] * periods**0.5, periods**0.5 * (z - 0.5 * s * (z**2 - 1.0))


def mean_and_error(values: list[np.ndarray], periods: int) -> list[np.ndarray]:
    return [*hac(values[0])]


def sharpe_gap(values: list[np.ndarray], periods: int) -> list[np.ndarray]:
    """Difference of two Sharpe ratios and its error."""
    (a, psi_a), (b, psi_b) = (sharpe(v, periods) for v in values)
    return [a - b, hac(psi_a - psi_b)[1]]


def in_bundles(rows: DataFrame, B: int) -> DataFrame:
    """``rows`` times bundles: ``first`` and ``count`` of its replications, dealt evenly."""
    n = -(-B // BUNDLE)
    bundle = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    bundle = bundle.select(*rows.columns, (F.col("__k") * BUNDLE).alias("__first"), F.least(F.lit(BUNDLE), F.lit(B) - F.col("__k") * BUNDLE).alias("__count"))
    return bundle.repartition(*[F.col(c) for c in rows.columns if not c.startswith("__x")], "__first")


def replicate(
    df: DataFrame, by: Sequence[str], order: str, values: Sequence[str | Column], B: int, statistic: Callable[[list[np.ndarray], int], list[np.ndarray]],
    out: Sequence[str], *, block: int, salt: str, periods: int = 12,
) -> DataFrame:
    """(by, b, out): ``statistic`` of every replication of every series, whose rows have no nulls; NaN becomes null."""
    by, out = list(by), list(out)
    cols = [(v if isinstance(v, Column) else F.col(v)).cast("double").alias(f"__v{i}") for i, v in enumerate(values)]
    series = df.select(*by, F.col(order).alias("__o"), *cols).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__o", *[f"__v{i}" for i in range(len(cols))]))).alias("__s"))
    series = series.select(*by, *[F.col(f"__s.__v{i}").alias(f"__x{i}") for i in range(len(cols))])
    fields = [f"{k} {df.schema[k].dataType.simpleString()}" for k in by]
    names = [f"__x{i}" for i in range(len(cols))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, count = (batch.column(c).to_pylist() for c in ("__first", "__count"))
            for k in range(batch.num_rows):
                x = [np.asarray(batch.column(c)[k].values, float) for c in names]
                at = draws(len(x[0]), first[k], count[k], block, salt)
                found = statistic([v[at] for v in x], periods)
                keys = [batch.column(c).take(pa.array([k] * count[k])) for c in by]
                numbers = pa.array(np.arange(first[k], first[k] + count[k], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*keys, numbers, *[pa.array(f, from_pandas=True) for f in found]], names=[*by, "b", *out])

    return in_bundles(series, B).mapInArrow(work, ", ".join([*fields, "b int", *(f"{c} double" for c in out)]))


def positions(lengths: DataFrame, B: int, *, block: int, salt: str) -> DataFrame:
    """(len, b, t, idx) of every replication for each distinct series length ``len``, all zero-based."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, first, count in zip(*(batch.column(c).to_pylist() for c in ("len", "__first", "__count"))):
                b, t = (a.ravel().astype(np.int32) for a in np.meshgrid(np.arange(first, first + count), np.arange(n), indexing="ij"))
                idx = draws(n, first, count, block, salt).ravel().astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), n, np.int32)), *map(pa.array, (b, t, idx))], names=["len", "b", "t", "idx"])

    return in_bundles(lengths.select(F.col("len").cast("int").alias("len")).distinct(), B).mapInArrow(work, "len int, b int, t int, idx int")
