"""Values in force at a date, looked up in place.

A dated table (rules, rates) becomes one sorted array for each key. An event meets the array of its key, one row for each key, and finds its entry
by binary search in a column expression: events are not shuffled, sorted or grouped, and equal events stay apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.sources.io import written

#: Most entries of a table that is broadcast; a larger one is joined by its key.
BROADCAST = 1_000_000
_STEPS = [2**k for k in range(30, -1, -1)]


def intervals(schedule: DataFrame, *, by: str, start: str, end: str, values: Sequence[str]) -> DataFrame:
    """(by, cuts): ascending dates from which ``n`` rows of the schedule are in force, and the row's ``values`` where it is one."""
    rows = schedule.select(by, F.col(start).cast("date").alias("__s"), F.col(end).cast("date").alias("__e"), F.struct(*values).alias("v"))
    dates = rows.select(by, F.explode(F.array("__s", F.date_add("__e", 1))).alias("d")).distinct()
    inside = dates.join(rows, by).where(F.col("d").between(F.col("__s"), F.col("__e"))).groupBy(by, "d").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    full = dates.join(inside, [by, "d"], "left").select(by, F.struct("d", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("v")).alias("v")).alias("c"))
    return full.groupBy(by).agg(F.sort_array(F.collect_list("c")).alias("cuts"))


def steps(rates: DataFrame, *, by: str, date: str, values: Sequence[str]) -> DataFrame:
    """(by, cuts): ascending dates from which a value holds until the next one; one row for each key and date."""
    return rates.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.struct(*values).alias("v")))).alias("cuts"))


def in_force(cuts: Column, at: Column) -> Column:
    """The last entry of ``cuts`` whose date is not after ``at``; null if there is none."""
    jump = lambda pos, step: F.when((pos + step <= F.size(cuts)) & (F.get(cuts, pos + step - 1)["d"] <= at), pos + step).otherwise(pos)
    place = F.aggregate(F.array(*[F.lit(s) for s in _STEPS]), F.lit(0), jump)
    return F.get(cuts, F.when(at.isNotNull(), place).otherwise(0) - 1)


def lookup(events: DataFrame, table: DataFrame, *, key: Column, at: Column, out: str) -> DataFrame:
    """``events`` with ``out``, the entry of ``table`` (by, cuts) for ``key`` that is in force at ``at``."""
    by = table.columns[0]
    held = written(table, "dated")
    size = held.agg(F.sum(F.size("cuts"))).first()[0] or 0
    held = held.select(F.col(by).alias("__by"), F.col("cuts").alias("__cuts"))
    keyed = events.withColumn("__key", key).withColumn("__at", at)
    found = keyed.join(F.broadcast(held) if size <= BROADCAST else held, F.col("__key") == F.col("__by"), "left")
    return found.select(*events.columns, in_force(F.col("__cuts"), F.col("__at")).alias(out))
