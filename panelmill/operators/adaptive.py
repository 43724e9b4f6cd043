"""Sequential learners over monthly series: drift detection and expert aggregation, in batch.

A series is one row per month, so a group is bounded by the calendar. Everything is written over whole arrays: the Page-Hinkley statistics
are reflected random walks, which a running minimum gives without a step-by-step state, and the aggregator's weights are a softmax of summed
gains as long as nothing is shared or floored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Observations and their sum, then sum and lowest sum of the falling and of the rising walk since the last alarm, of a series not yet begun.
UNSEEN = (0.0,) * 6


def _walk(steps: np.ndarray, at: float, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Running sums that go on from ``at``, and the lowest of them, of ``low`` and of all before."""
    sums = np.cumsum(np.append(at, steps))[1:]
    return sums, np.minimum.accumulate(np.append(low, sums))[1:]


def page_hinkley(x: np.ndarray, delta: float, threshold: float, burn_in: int, past: tuple = UNSEEN) -> tuple[list[tuple[int, str, float]], tuple]:
    """Alarms (position, direction, statistic) of the two-sided test, and what the next rows of the series have to know.

    Deviations are taken from the mean of all observations so far; the first ``burn_in`` only feed the mean. A statistic is the height of its
    walk above the walk's lowest point. After an alarm both walks start anew, the mean goes on. Sums run on across calls, so a series gives
    the same numbers however it is cut.
    """
    count, total, *walks = past
    n, sums = count + np.arange(1, len(x) + 1), np.cumsum(np.append(total, x))[1:]
    off = x - sums / n
    down, up = np.where(n > burn_in, -off - delta, 0.0), np.where(n > burn_in, off - delta, 0.0)
    alarms, at = [], 0
    while at < len(x):
        fall, fall_low = _walk(down[at:], *walks[:2])
        rise, rise_low = _walk(up[at:], *walks[2:])
        falls, rises = fall - fall_low, rise - rise_low
        over = np.flatnonzero((falls > threshold) | (rises > threshold))
        if not len(over):
            walks = [float(v[-1]) for v in (fall, fall_low, rise, rise_low)]
            break
        k = int(over[0])
        alarms.append((at + k, "decline", float(falls[k])) if falls[k] > threshold else (at + k, "improvement", float(rises[k])))
        walks = [0.0] * 4
        at += k + 1
    return alarms, (count + len(x), float(sums[-1]) if len(x) else total, *walks)


def _typed(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def drift(df: DataFrame, *, by: Sequence[str], order: str, value: str, delta: float = 0.002, threshold: float = 0.05, burn_in: int = 24) -> DataFrame:
    """Change points of every series: (by, order, direction, statistic)."""
    by = list(by)

    def find(key, series: pd.DataFrame) -> pd.DataFrame:
        series = series.dropna(subset=[value]).sort_values(order)
        alarms, _ = page_hinkley(series[value].to_numpy(float), delta, threshold, burn_in)
        return pd.DataFrame([(*key, series[order].iloc[k], *what) for k, *what in alarms], columns=[*by, order, "direction", "statistic"])

    return df.select(*by, order, value).groupBy(*by).applyInPandas(find, f"{_typed(df, [*by, order])}, direction string, statistic double")


def calibrate_drift(df: DataFrame, *, by: Sequence[str], order: str, value: str, grid: Sequence[float], target: float = 1.0, delta: float = 0.002) -> DataFrame:
    """Threshold whose false-alarm rate per decade is nearest the target; the smallest on ties.

    The burn-in is two years, or a third of a shorter series.
    """
    by = list(by)

    def rates(key, series: pd.DataFrame) -> pd.DataFrame:
        x = series.dropna(subset=[value]).sort_values(order)[value].to_numpy(float)
        found = [len(page_hinkley(x, delta, level, min(24, len(x) // 3))[0]) for level in grid]
        per_decade = 120.0 * np.array(found) / max(len(x), 1e-9)
        return pd.DataFrame({**dict(zip(by, key)), "threshold": list(grid), "rate": per_decade, "gap": np.abs(per_decade - target)})

    each = df.select(*by, order, value).groupBy(*by).applyInPandas(rates, f"{_typed(df, by)}, threshold double, rate double, gap double")
    return each.groupBy(*by).agg(F.min_by(F.struct("threshold", "rate"), F.struct("gap", "threshold")).alias("b")).select(*by, "b.threshold", "b.rate")


def refit_schedule(months: DataFrame, events: DataFrame, *, by: Sequence[str], month: str, calendar: Sequence[int] = (12,)) -> DataFrame:
    """Months on which a calendar rule (months of the year) and a drift rule refit, with the alarm's direction and statistic."""
    rows = months.join(events.select(*by, month, "direction", "statistic"), [*by, month], "left")
    return rows.select(*by, month, F.month(month).isin(list(calendar)).alias("calendar_refit"), F.col("direction").isNotNull().alias("drift_refit"), "direction", "statistic")


def hedge(
    df: DataFrame, *, by: Sequence[str], month: str, expert: str, reward: str, warmup: int = 12, share: float = 0.0, floor: float = 0.0,
    eta: float | None = None, scale: float | None = None,
) -> DataFrame:
    """Weights in force each month from exponential weighting of all earlier rewards: (by, month, expert, weight, reward).

    A month's gain is the clipped reward over ``scale`` times the rate ``eta``; by default the scale is four robust deviations of all
    rewards so far and the rate sqrt(8 log experts / months). Missing rewards are 0. The first ``warmup`` months are not learnt from.
    A panel's experts and months form one group.
    """
    by = list(by)

    def gain(r: np.ndarray, t: int) -> np.ndarray:
        past = r[: t + 1]
        width = scale if scale is not None else max(5.9304 * float(np.median(np.abs(past - np.median(past)))), 1e-6)
        rate = eta if eta is not None else np.sqrt(8.0 * np.log(r.shape[1]) / (t + 1))
        return rate * np.clip(r[t] / width, -1.0, 1.0)

    def softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def mixed(weight: np.ndarray, g: np.ndarray) -> np.ndarray:
        """One month of fixed share: move a part of the mass evenly to all experts, and keep each above the floor."""
        out = np.maximum((1.0 - share) * softmax(np.log(np.maximum(weight, 1e-300)) + g) + share / len(g), floor)
        return out / out.sum()

    def weigh(key, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index=month, columns=expert, values=reward).sort_index()
        r = np.nan_to_num(wide.to_numpy(float))
        months, n = r.shape
        gains = np.array([gain(r, t) if t >= warmup else np.zeros(n) for t in range(months - 1)]).reshape(-1, n)
        if share == 0.0 and floor == 0.0:
            weight = softmax(np.concatenate([np.zeros((1, n)), np.cumsum(gains, axis=0)]))
        else:
            even = np.full((min(warmup, months - 1) + 1, n), 1.0 / n)
            weight = np.concatenate([even, np.array(list(accumulate(gains[warmup:], mixed, initial=even[-1]))[1:]).reshape(-1, n)])
        cells = {month: np.repeat(wide.index.to_numpy(), n), expert: np.tile(wide.columns.to_numpy(), months), "weight": weight.ravel(), "reward": r.ravel()}
        return pd.DataFrame({**dict(zip(by, key)), **cells})[[*by, month, expert, "weight", "reward"]]

    schema = f"{_typed(df, [*by, month, expert])}, weight double, reward double"
    return df.select(*by, month, expert, reward).groupBy(*by).applyInPandas(weigh, schema)


def combine(weights: DataFrame, scores: DataFrame, *, on: Sequence[str], id: str, weight: str, score: str) -> DataFrame:
    """Weighted sum of the members' scores, a missing member adding nothing, and the plain mean of the present ones."""
    keys = [k for k in on if k != "member"]
    j = scores.join(weights, list(on))
    return j.groupBy(*keys, id).agg(
        F.sum(F.col(weight) * F.col(score)).alias("combined"), F.avg(score).alias("equal"), F.count(F.lit(1)).cast("long").alias("members")
    )


def causality(weights: DataFrame, *, active: str, known: str) -> DataFrame:
    """Weights that use a reward not yet known when they become active."""
    return weights.filter(F.col(known) >= F.col(active))


def adaptation_report(h: DataFrame, *, by: Sequence[str], month: str, expert: str) -> DataFrame:
    """Weight turnover, effective members, and the aggregate against equal weights and the best expert in hindsight."""
    by = list(by)
    w = Window.partitionBy(*by, expert).orderBy(month)
    rows = h.withColumn("__dw", F.abs(F.col("weight") - F.lag("weight").over(w)))
    monthly = rows.groupBy(*by, month).agg(
        F.sum(F.col("weight") * F.col("reward")).alias("agg"), F.avg("reward").alias("eq"), (F.sum("__dw") / 2).alias("turn"), (1.0 / F.sum(F.col("weight") ** 2)).alias("eff")
    )
    best = h.groupBy(*by, expert).agg(F.sum("reward").alias("__s")).groupBy(*by).agg(F.max("__s").alias("best_total"))
    return monthly.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("months"), F.sum("agg").alias("aggregate_total"), F.sum("eq").alias("equal_total"), F.avg("turn").alias("weight_turnover"),
        F.avg("eff").alias("effective_members"),
    ).join(best, by).withColumn("regret", F.col("best_total") - F.col("aggregate_total"))
