"""Column expressions shared by the operators. Everything here stays on the JVM except the two normal-law UDFs."""

from __future__ import annotations

from collections.abc import Iterable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """True only for a present, finite number (never null)."""
    c = col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def positive(c: str | Column) -> Column:
    """The value when it is a finite positive number, else null."""
    c = col(c)
    return F.when(finite(c) & (c > 0), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in panel data; Spark aggregates would propagate it."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def clip(c: str | Column, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is zero or missing (ANSI division would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


def month_end(c: str | Column, months: int = 0) -> Column:
    c = col(c)
    return F.last_day(F.add_months(c, months)) if months else F.last_day(c)


def month_index(c: str | Column) -> Column:
    """Months since year 0, so that consecutive months differ by one."""
    c = col(c)
    return F.year(c) * 12 + F.month(c)


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Round for reports. The nudge of 1% of the last place keeps exact decimal ties from depending on summation order."""
    return F.round(col(c) + F.lit(10.0 ** -(digits + 2)), digits)


def uniform(*parts: str | int | Column) -> Column:
    """Reproducible uniform in [0, 1) from an md5 digest of the key parts."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)



_NORMAL = NormalDist()


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(_NORMAL.cdf, na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda v: _NORMAL.inv_cdf(v) if 0.0 < v < 1.0 else None, na_action="ignore").astype("float64")


def two_sided_p(t: str | Column) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(col(t))))
