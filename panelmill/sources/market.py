"""Panel views over the star-schema tables.

A security is a supplier, its country the supplier's region, its trading currency changes every calendar year. Line items
are its trades: one day of trades makes a bar, one month of bars a panel row. Every view is lazy, and reads only the
columns it needs.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.functions import month_index
from panelmill.operators import daily


def _currency(sec: str, d: str) -> Column:
    k = (F.col(sec) + F.year(d)) % 3
    return F.when(k == 0, "AAA").when(k == 1, "BBB").otherwise("CCC")


def _month_totals() -> list[Column]:
    return [
        F.count(F.lit(1)).cast("long").alias("n_days"),
        F.sum("notional").alias("me"),
        F.round(F.avg("disc"), 10).alias("sig_disc"),
        F.round(F.avg("tax"), 10).alias("sig_tax"),
        F.avg(F.col("hi") - F.col("lo")).alias("sig_range"),
        F.sum("vol").alias("sig_vol"),
    ]


def _certified(at) -> list[Column]:
    return [
        F.when(at("range_obs_21") == 21, at("range_21") + 0.001).alias("spread"),
        F.when(at("ret_obs_21") == 21, at("sigma_21")).alias("sigma_d"),
        F.when(at("obs_21") == 21, at("adv_21")).alias("adv_usd"),
        F.lit(None).cast("double").alias("borrow_fee"),
    ]


#: Trades that one task takes between shuffles; their bars fit its memory as a table and as a sort.
TRADES = 300_000


class Market:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.plans: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Write a stage's output as a table in the shared folder and continue from it.

        Books, scores and panels feed several branches of one plan; without a stage each branch would scan the trades again.
        """
        if name not in self.plans:
            from panelmill.sources.io import scratch_dir

            path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            self.plans[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.plans[name]

    @cached_property
    def securities(self) -> DataFrame:
        """sec_id -> country, and the book account."""
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("sec_id"), F.col("r_name").alias("country"))
        )

    @cached_property
    def tasks(self) -> int:
        """Tasks that share the trades: their number grows with the table, whose rows its footers tell."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(least, -(-self.table("lineitem").count() // TRADES))

    @cached_property
    def daily_px(self) -> DataFrame:
        """One bar per security and day. A bar has hardly more than a trade, so trades are dealt by security and day as they are: a table of
        bars beside the scan would be as large as its split and spill. The days of a hot security go to all tasks."""
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        bars = (
            self.table("lineitem")
            .select("l_suppkey", F.to_date("l_shipdate").alias("d"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
            .repartition(self.tasks, "l_suppkey", "d")
            .groupBy(F.col("l_suppkey").alias("sec_id"), "d")
            .agg(
                ((F.min(unit) + F.max(unit)) / 2).alias("op"),
                F.max(unit).alias("hi"),
                F.min(unit).alias("lo"),
                (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("cl"),
                F.sum("l_quantity").alias("vol"),
                F.sum("l_extendedprice").alias("notional"),
                F.avg("l_discount").alias("disc"),
                F.avg("l_tax").alias("tax"),
            )
        )
        return bars.join(self.securities, "sec_id").select(
            "country", "sec_id", "d", _currency("sec_id", "d").alias("cur"),
            "op", "hi", "lo", "cl", "vol", "notional", "disc", "tax",
        )

    @cached_property
    def vendor_daily(self) -> DataFrame:
        """The bars in vendor layout: raw close, adjustment and return factors, quote unit and price status."""
        k = (F.col("sec_id") + F.dayofmonth("d")) % 9
        return self.daily_px.select(
            "country", "sec_id", "d", F.col("cur").alias("curcdd"),
            F.col("cl").alias("prccd"), F.col("op").alias("prcod"), F.col("hi").alias("prchd"), F.col("lo").alias("prcld"),
            F.col("vol").alias("cshtrd"), (F.col("vol") * 1000.0).alias("cshoc"),
            F.when(F.col("d") < "1998-07-01", 2.0).otherwise(1.0).alias("ajexdi"),
            (1.0 + (F.year("d") - 1995) * 0.01).alias("trfd"),
            F.when(F.col("sec_id") % 7 == 0, 100.0).otherwise(1.0).alias("qunit"),
            F.when(k == 0, 10).when(k == 1, 4).when(k == 8, 5).otherwise(3).alias("prcstd"),
        )

    @cached_property
    def fx_quotes(self) -> DataFrame:
        """Quotes of one base currency by day and status (AR actual, CF carried forward)."""
        cur = F.element_at(F.array(*[F.lit(c) for c in ("USD", "AAA", "BBB", "CCC")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
        return (
            self.table("lineitem")
            .groupBy(
                F.to_date("l_shipdate").alias("d"), cur.alias("tocurd"),
                F.when(F.col("l_linestatus") == "O", "AR").otherwise("CF").alias("exrattpd"),
            )
            .agg((1 + F.avg("l_discount")).alias("exratd"))
        )

    @cached_property
    def fx_rates(self) -> DataFrame:
        """Sparse rates, every third calendar day."""
        cur = F.when(F.col("l_returnflag") == "A", "AAA").when(F.col("l_returnflag") == "N", "BBB").otherwise("CCC")
        return (
            self.table("lineitem")
            .filter(F.dayofmonth("l_shipdate") % 3 == 0)
            .groupBy(F.to_date("l_shipdate").alias("d"), cur.alias("cur"))
            .agg((1 + F.avg("l_discount")).alias("usd_per_local"))
        )

    @cached_property
    def months(self) -> DataFrame:
        """Months of the panel: those in which a security trades."""
        traded = self.table("lineitem").join(self.securities, F.col("l_suppkey") == F.col("sec_id"))
        return traded.select(F.last_day("l_shipdate").alias("m")).distinct()

    @cached_property
    def monthly_px(self) -> DataFrame:
        return self.daily_px.groupBy("country", "sec_id", F.last_day("d").alias("m")).agg(*_month_totals(), F.max_by("cl", "d").alias("cl"))

    @cached_property
    def rolled(self) -> DataFrame:
        """Daily returns with their 21-row statistics."""
        px = self.daily_px.select("country", "sec_id", "d", "cur", "cl", "hi", "lo", "vol", "notional", "disc", "tax").repartition(self.tasks, "sec_id")
        returns = daily.daily_returns(px, keys=["sec_id"], date="d", currency="cur", price="cl", high="hi", low="lo")
        return daily.rolling_features(
            returns, keys=["sec_id"], date="d",
            counts={"obs_21": None, "ret_obs_21": "ret", "range_obs_21": "hl_range"},
            sds={"sigma_21": "ret"},
            means={"adv_21": "notional", "range_21": "hl_range"},
            maxes={"max_gap_21": "gap_days"},
        )

    @cached_property
    def features(self) -> DataFrame:
        """Month-end endpoint of the 21-row daily statistics."""
        return daily.month_endpoint(self.rolled, keys=["sec_id"], date="d", out="m")

    @cached_property
    def cost_inputs(self) -> DataFrame:
        """Certified month-end cost inputs: a value is kept only when its whole 21-row window was observed."""
        return self.features.select("country", "sec_id", "m", *_certified(F.col))

    @cached_property
    def panel(self) -> DataFrame:
        """Security-month panel with returns and cost inputs; a return needs both calendar months.

        Month totals and month-end statistics come from one grouping of the daily windows, which keeps their
        partitioning by security: one scan, no join. Each statistic is kept by itself, as a struct of them would have
        the daily rows sorted a second time.
        """
        last = [F.max_by(c, "d").alias(c) for c in ("cl", "range_obs_21", "range_21", "ret_obs_21", "sigma_21", "obs_21", "adv_21")]
        months = self.rolled.groupBy("country", "sec_id", F.last_day("d").alias("m")).agg(*_month_totals(), *last)
        w = Window.partitionBy("sec_id").orderBy("m")
        consecutive = lambda a, b: month_index(b) - month_index(a) == 1
        priced = months.select(
            "*", F.lag("m").over(w).alias("__pm"), F.lag("cl").over(w).alias("__pc"), F.lead("m").over(w).alias("__nm"),
            F.lead("cl").over(w).alias("__nc"),
        )
        close = F.col("cl")
        return priced.select(
            "sec_id", "m", "country", "n_days", (F.col("n_days") >= 5).alias("in_universe"), "me", close.alias("price"),
            "sig_disc", "sig_tax", "sig_range", "sig_vol",
            F.when(consecutive(F.col("__pm"), F.col("m")), close / F.col("__pc") - 1).alias("ret"),
            F.when(consecutive(F.col("m"), F.col("__nm")), F.col("__nc") / close - 1).alias("ret_next"),
            *_certified(F.col),
        )

    @cached_property
    def signals(self) -> DataFrame:
        """Wide rank-normalised signals in [-0.5, 0.5] beside the panel columns the operators need."""
        base = self.panel.select(
            "country", "sec_id", "m", "me", "price", "ret", "ret_next", "spread", "sigma_d", "adv_usd", "borrow_fee",
            "in_universe", "sig_disc", "sig_tax", "sig_vol", F.col("ret").alias("sig_mom"), F.col("me").alias("sig_size"),
        )
        from panelmill.operators.xsection import xs_rank_many

        names = ["sig_disc", "sig_tax", "sig_vol", "sig_mom", "sig_size"]
        return self.stage("signals", xs_rank_many(base, names, by=["m"], id="sec_id"))

    @cached_property
    def trades(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("account"))
        return (
            self.table("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(
                "account", (F.col("l_suppkey") % 10).alias("security"), F.to_date("l_shipdate").alias("d"),
                F.when(F.col("l_returnflag") == "R", "S").otherwise("B").alias("side"),
            )
            .agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("amount"))
        )

    @cached_property
    def covered_trades(self) -> DataFrame:
        """Trades preceded by one opening buy per position, large enough that no sale is short."""
        w = Window.partitionBy("account", "security").orderBy("d", "side").rowsBetween(Window.unboundedPreceding, 0)
        run = self.trades.withColumn("net", F.sum(F.when(F.col("side") == "S", F.col("qty")).otherwise(-F.col("qty"))).over(w))
        opening = (
            run.groupBy("account", "security")
            .agg(F.greatest(F.max("net"), F.lit(0.0)).alias("qty"))
            .filter("qty > 0")
            .select(
                "account", "security", F.lit("1994-12-31").cast("date").alias("d"), F.lit("B").alias("side"),
                "qty", (F.col("qty") * 1000.0).alias("amount"),
            )
        )
        return self.trades.unionByName(opening)

    @cached_property
    def cell_returns(self) -> DataFrame:
        """Months x 16 design cells, coded by four two-level letters."""
        bit = lambda b, on, off: F.when(F.col("p_partkey").bitwiseAND(b) == b, on).otherwise(off)
        cell = F.concat_ws("-", bit(1, "N", "L"), bit(2, "C", "S"), bit(4, "E", "P"), bit(8, "U", "0"))
        return self.stage(
            "cells",
            self.table("lineitem")
            .join(self.table("part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.last_day("l_shipdate").alias("m"), cell.alias("cell"))
            .agg((F.avg("l_discount") - F.avg("l_tax") - 0.01).alias("r")),
        )
