"""Point-in-time operators: values known by a date, reconciled vintages, dated slices.

As-of joins merge both sides into one ordered stream per key and carry the last known value forward, so their cost is a
sort; a range join would pair every event with its whole history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import count_if


def asof_join(
    left: DataFrame, right: DataFrame, *, by: Sequence[str], left_on: str, right_on: str, values: Sequence[str], right_date: str | None = None
) -> DataFrame:
    """Each left row with the latest right row at or before it. ``right_date`` keeps the matched right key."""
    payload = F.struct(F.col(right_on).alias("__at"), *[F.col(v) for v in values])
    l = left.select(*left.columns, F.col(left_on).alias("__t"), F.lit(1).alias("__side"))  # noqa: E741
    r = right.select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), payload.alias("__p"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__p", F.last("__p", ignorenulls=True).over(w)).filter("__side = 1")
    out = [F.col(f"__p.{v}").alias(v) for v in values]
    if right_date:
        out.append(F.col("__p.__at").alias(right_date))
    return filled.select(*left.columns, *out)


def latest_known(events: DataFrame, calendar: DataFrame, *, known_at: str, event: str, value: str, ok: str, month: str = "m") -> DataFrame:
    """Per calendar month: the successful event with the latest known-at date, its age, and how many later events failed.

    Events are first rolled up to one row per known-at day, then merged with the calendar; a month reads the running
    state of all days up to it.
    """
    good = F.col(ok)
    days = events.groupBy(F.col(known_at).alias("__t")).agg(
        F.max(F.when(good, F.struct(F.col(known_at).alias("at"), F.col(event).alias("ev"), F.col(value).alias("v")))).alias("__best"),
        count_if(~good).alias("__fail"),
    )
    stream = days.withColumn("__side", F.lit(0)).unionByName(
        calendar.select(F.col(month).alias("__t"), F.lit(1).alias("__side")), allowMissingColumns=True
    )
    w = Window.orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    run = stream.select(
        "__t", "__side",
        F.last("__best", ignorenulls=True).over(w).alias("__b"),
        F.sum(F.coalesce("__fail", F.lit(0))).over(w).alias("__f"),
        # failures known by the end of the day of the best event
        F.last(F.when(F.col("__best").isNotNull(), F.struct(F.col("__t").alias("t"))), ignorenulls=True).over(w).alias("__bt"),
    )
    at_best = run.filter("__side = 0").groupBy(F.col("__t").alias("__k")).agg(F.max("__f").alias("__f0"))
    months = run.filter("__side = 1").join(at_best, F.col("__bt.t") == F.col("__k"), "left")
    return months.select(
        F.col("__t").alias(month), F.col("__b.v").alias(value), F.col("__b.ev").alias("source_event"), F.col("__b.at").alias("source_known_at"),
        F.datediff("__t", F.col("__b.at")).cast("long").alias("staleness_days"),
        F.when(F.col("__b").isNotNull(), F.col("__f") - F.coalesce("__f0", F.lit(0))).cast("long").alias("later_failed"),
    )


def reconcile_vintages(
    df: DataFrame, *, key: str, known_at: str, value: str, source: str, tol: float
) -> DataFrame:
    """One row per event over all source vintages: conflict status, or the first source's successful value."""
    g = df.groupBy(key).agg(
        F.count_distinct(known_at).cast("long").alias("n_dates"),
        F.min(known_at).alias(known_at),
        (F.max(value) - F.min(value)).alias("__spread"),
        F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(source), F.col(value)))).alias("__pick"),
        F.count_distinct(source).cast("long").alias("source_vintages"),
        F.concat_ws("|", F.sort_array(F.collect_set(source))).alias("sources"),  # few source files per event
    )
    status = (
        F.when(F.col("n_dates") != 1, "conflicting_dates")
        .when(F.col("__spread") > tol, "conflicting_values")
        .otherwise("ok")
    )
    return g.select(
        key, status.alias("status"), F.when(status == "ok", F.col(known_at)).alias(known_at),
        F.when(status == "ok", F.col(f"__pick.{value}")).alias(value), F.col("__pick").isNotNull().alias("successful"),
        "source_vintages", "sources",
    )


def monthly_mean(df: DataFrame, *, date: str, value: str, error: str) -> DataFrame:
    return df.groupBy(F.last_day(date).alias("m")).agg(
        F.avg(value).alias("mean_value"), F.count(value).cast("long").alias("n"), F.max(F.abs(error)).alias("max_error")
    )


def price_implied_yield(price: str | Column, days: float = 91.0, year: float = 365.0) -> Column:
    """Simple annual yield in percent of a discount bill priced per 100."""
    p = F.col(price) if isinstance(price, str) else price
    return (100.0 / p - 1.0) * (year / days) * 100.0


def reference_slice(
    df: DataFrame, *, date: str, on: str, id: str, endpoint: str, close: str, high: str, currency: str, expected_currency: Column
) -> DataFrame:
    """The rows of one statutory date, each with the first rule it breaks (null when valid)."""
    cut = df.filter(F.col(date) == F.lit(on).cast("date"))
    broken = (
        F.when(F.col(close).isNull() | F.col(high).isNull() | F.col(endpoint).isNull(), "incomplete")
        .when(F.col(endpoint) > F.lit(on).cast("date"), "forward_looking")
        .when(F.col(currency) != expected_currency, "currency")
        .when((F.col(high) < F.col(close)) | (F.col(high) <= 0) | (F.col(close) <= 0), "price_order")
    )
    return cut.select(
        id, F.col(date).alias("reference_date"), F.col(high).alias("fmv_price_local"), F.col(close).alias("close_price_local"),
        F.col(currency).alias("currency"), endpoint, broken.alias("violation"),
    )

