"""Stateful streams with batch twins. Rows of a key are taken in event order whatever order they arrive in; state per key is bounded: a few numbers,
or open lots, and the rows that the watermark has not passed yet."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelmill.operators.adaptive import UNSEEN, _typed, page_hinkley
from panelmill.operators.models import scale_path
from panelmill.operators.tax import Position
from panelmill.sources.io import scratch_dir


def in_event_order(
    df: DataFrame, fold: Callable[[Any, list[tuple]], tuple[Any, list[tuple]]], start: Callable[[], Any], *, by: Sequence[str], at: str, values: Sequence[str], late: str, out: str,
    bundles: int | None = None,
) -> DataFrame:
    """Give the rows of each key to ``fold`` in the order of ``at``: fold(state, [(at, *values), …]) -> (state, output rows without the key).

    A row waits in the key's state until the watermark, ``late`` behind the latest event of any key, has passed it; an event-time timer gives out
    the rows of keys to which nothing more comes. Rows behind the watermark are late: Spark leaves them out and counts them (``Replay.late_rows``).
    Rows with a null among ``values`` only move the watermark. Rows of one key and time keep their order of arrival. Events are after 1970.

    Spark calls Python once for every group. Where keys are many and short, ``bundles`` makes a group of all keys of one hash remainder, with a
    state and waiting rows for each of its keys; the number belongs to the checkpoint.
    """
    by, values = list(by), list(values)
    keys = ["__bundle"] if bundles else by

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pickle.loads(state.get[0]) if state.exists else {}  # by key: its state and the rows that wait
        for rows in batches:
            for full, *row in zip(*(rows[c] for c in ("__full", *by, "__ms", at, *values))):
                if full:
                    key = tuple([None if k != k else k for k in row[: len(by)]])  # pandas has nan for a null
                    if key not in known:
                        known[key] = [start(), []]
                    known[key][1].append(tuple(row[len(by) :]))
        passed = state.getCurrentWatermarkMs()
        found, timer = [], None
        for key, held in known.items():
            waiting = held[1]
            if not waiting:
                continue
            waiting.sort(key=lambda r: r[0])
            ready = sum(r[0] <= passed for r in waiting)
            if ready:
                held[0], made = fold(held[0], [r[1:] for r in waiting[:ready]])
                found += [(*key, *r) for r in made]
                held[1] = waiting = waiting[ready:]
            if waiting:
                timer = waiting[0][0] if timer is None else min(timer, waiting[0][0])
        state.update((pickle.dumps(known),))
        if timer is not None:
            state.setTimeoutTimestamp(int(timer))
        for i in range(0, len(found), 10000):
            yield pd.DataFrame(found[i : i + 10000], columns=[*by, *(c.split()[0] for c in out.split(", "))])

    rows = df.filter(F.col(at).isNotNull()).select(*by, at, *values, F.col(at).cast("timestamp").alias("__at")).withWatermark("__at", late)
    full = reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in values])
    rows = rows.withColumn("__ms", F.unix_millis("__at")).withColumn("__full", full)
    if bundles:
        # rows without a key or a value stand apart, as they make floats of a batch's whole numbers
        bare, at_hash = reduce(lambda a, b: a | b, [F.col(b).isNull() for b in by]), F.pmod(F.xxhash64(*by), F.lit(bundles))
        rows = rows.withColumn("__bundle", F.when(~F.col("__full"), -1).when(bare, -2 - at_hash).otherwise(at_hash))
    return rows.groupBy(*keys).applyInPandasWithState(step, f"{_typed(df, by)}, {out}", "s binary", "append", GroupStateTimeout.EventTimeTimeout)


def drift_stream(
    df: DataFrame, *, by: Sequence[str], order: str, value: str, delta: float = 0.002, threshold: float = 0.05, burn_in: int = 24, late: str = "1 day",
) -> DataFrame:
    """Change points of every series as its rows pass the watermark."""

    def fold(past: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        alarms, past = page_hinkley(pd.Series([x for _, x in rows], dtype=float).to_numpy(), delta, threshold, burn_in, past)
        return past, [(rows[k][0], *what) for k, *what in alarms]

    return in_event_order(df, fold, lambda: UNSEEN, by=by, at=order, values=[value], late=late, out=f"{_typed(df, [order])}, direction string, statistic double")


def interval_scale_stream(df: DataFrame, *, by: Sequence[str], order: str, ratios: str, alpha: float = 0.1, rate: float = 0.05, late: str = "1 day") -> DataFrame:
    """Interval scale fed back by coverage. One row per key and month carries that month's relative residuals."""

    def fold(scale: float, rows: list[tuple]) -> tuple[float, list[tuple]]:
        done = []
        for when, xs in rows:
            used, cov, scale = scale_path(pd.Series(xs, dtype=float).to_numpy(), scale, alpha, rate)
            done.append((when, used, cov))
        return scale, done

    return in_event_order(df, fold, lambda: 1.0, by=by, at=order, values=[ratios], late=late, out=f"{_typed(df, [order])}, scale double, coverage double")


def lots_stream(df: DataFrame, *, by: Sequence[str], date: str, target: str, growth: str, method: str, late: str = "1 day", bundles: int | None = None) -> DataFrame:
    """Realised gains of positions moving to dollar targets, as their trades pass the watermark."""

    def fold(book: Position, rows: list[tuple]) -> tuple[Position, list[tuple]]:
        sold = []
        for d, to, r in rows:
            book.grow(float(r))
            sold += [(d, opened, gain, long_term) for opened, gain, long_term, _ in book.move(d, float(to))]
        return book, sold

    out = "sold date, opened date, gain double, long_term boolean"
    return in_event_order(df, fold, lambda: Position(method, 12), by=by, at=date, values=[target, growth], late=late, out=out, bundles=bundles)


def window_features(df: DataFrame, *, by: Sequence[str], ts: str, value: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count, mean, spread and extremes per time window; the same plan serves batch and stream (``late`` sets the watermark)."""
    rows = df.withWatermark(ts, late) if late else df
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = rows.groupBy(win.alias("w"), *by).agg(
        F.count(value).cast("long").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.max(value).alias("hi"), F.min(value).alias("lo")
    )
    return g.select(*by, F.col("w.start").alias("window_start"), "n", "mean", "sd", "hi", "lo")


def sessions(df: DataFrame, *, by: Sequence[str], ts: str, value: str, gap: str) -> DataFrame:
    g = df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(value).alias("total"))
    return g.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


class Replay(NamedTuple):
    rows: DataFrame
    late_rows: int


def replay(df: DataFrame, build: Callable[[DataFrame], DataFrame], *, at: str, arrives: str | None = None, parts: int = 3, late: str = "1 day") -> Replay:
    """What the stream that ``build`` makes of ``df`` puts out when the rows arrive in ``parts`` slices of ``arrives`` (default: of event time ``at``).

    A slice is written by as many tasks as Spark likes; then the query takes up from its checkpoint what is new, and stops. With the last slice
    comes a row of nulls far beyond the last event, so that the watermark passes all others. Also returned: how many rows came too late.
    """
    spark, arrives = df.sparkSession, arrives or at
    base = f"{scratch_dir(spark)}/replay-{uuid.uuid4().hex}"
    number = lambda c: F.unix_micros(c.cast("timestamp"))
    lo, hi, last = df.agg(F.min(number(F.col(arrives))), F.max(number(F.col(arrives))), F.max(F.col(at).cast("timestamp"))).first()  # one row
    if last is None:
        return Replay(build(df).limit(0), 0)
    share = (number(F.col(arrives)) - lo) / float(max(hi - lo, 1)) * parts
    part: Column = F.coalesce(F.least(F.floor(share), F.lit(parts - 1)), F.lit(parts - 1))
    beyond = (F.lit(last) + F.expr(f"INTERVAL '{late}'") + F.expr("INTERVAL 2 DAYS")).cast(df.schema[at].dataType)
    beat = spark.range(1).select(*[(beyond if c.name == at else F.lit(None).cast(c.dataType)).alias(c.name) for c in df.schema])
    dropped = 0
    for i in range(parts):
        rows = df.filter(part == i)
        (rows if i < parts - 1 else rows.unionByName(beat)).write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(df.schema).parquet(f"{base}/in"))
        run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
        run.awaitTermination()
        dropped += sum(op.numRowsDroppedByWatermark for p in run.recentProgress for op in p.stateOperators)
    return Replay(spark.read.schema(stream.schema).parquet(f"{base}/out"), dropped)
