"""Sources and sinks: every query writes or reads real tables and returns rows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from panelmill.functions import rnd
from panelmill.operators import daily
from panelmill.plans.registry import R, query, shared, view
from panelmill.sources import io


def fresh(t, name: str) -> str:
    return os.path.join(io.scratch_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


@shared
def universe(t):
    """Universe contract columns from the monthly panel."""
    return t.monthly_px.select(
        "country", F.col("m").alias("date"), F.col("sec_id").alias("permno"), (F.col("n_days") >= 5).alias("in_universe"), "me",
        F.col("cl").alias("price"), F.lit(1).alias("exchcd"), (F.col("sec_id") % 50).cast("int").alias("ff49"),
        (F.col("n_days") * 1.0).alias("nyse_size_pct"),
    )


view("universe", """
  SELECT country, m AS date, sec_id AS permno, n_days >= 5 AS in_universe, me, cl AS price, 1 AS exchcd, CAST(sec_id % 50 AS INTEGER) AS ff49,
         CAST(n_days AS DOUBLE) AS nyse_size_pct FROM monthly_px""")


@query("s1_contract_round_trip", f"SELECT date, permno, in_universe, {R('me', 3)} AS me, ff49 FROM universe WHERE in_universe")
def s1(t):
    path = fresh(t, "universe")
    io.write_contract(universe(t), path, "universe")
    back = io.read_contract(t.spark, path).filter("in_universe")
    return back.select("date", "permno", "in_universe", rnd("me", 3).alias("me"), "ff49")


@query("s2_typed_gzip_csv", "SELECT l_suppkey AS sec_id, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2")
def s2(t):
    path = fresh(t, "csv")
    li = t.table("lineitem").select(
        F.col("l_suppkey").alias("sec_id"), F.to_date("l_shipdate").alias("d"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")
    )
    li.write.option("header", True).option("compression", "gzip").csv(path)
    rows = io.read_csv_typed(t.spark, path, "sec_id BIGINT, d DATE, qty DOUBLE, flag STRING", ["sec_id", "d", "qty"])
    return rows.groupBy("sec_id", "d").agg(F.sum("qty").alias("qty"))


@query("s3_restrict_to_keys", f"""
SELECT sec_id, m, {R('me', 3)} AS me FROM monthly_px p
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.sec_id AND last_day(CAST(o.o_orderdate AS DATE)) = p.m)""")
def s3(t):
    keys = t.table("orders").select(F.col("o_custkey").alias("sec_id"), F.last_day("o_orderdate").alias("m"))
    return io.restrict_to_keys(t.monthly_px, keys, ["sec_id", "m"]).select("sec_id", "m", rnd("me", 3).alias("me"))


def bundle(t, country: str | None = None):
    """Write the six tables once and load them lazily."""
    root = fresh(t, "bundle")
    s = t.signals
    key = [F.col("m").alias("date"), F.col("sec_id").alias("permno")]
    universe(t).write.parquet(f"{root}/universe", partitionBy="country")
    s.select("country", *key, "sig_disc", "sig_size").write.parquet(f"{root}/signals", partitionBy="country")
    s.select("country", *key, "ret_next").write.parquet(f"{root}/targets", partitionBy="country")
    t.cost_inputs.select("country", *key, "spread", "sigma_d", "adv_usd", "borrow_fee").write.parquet(f"{root}/cost_inputs", partitionBy="country")
    s.groupBy(F.col("m").alias("date")).agg(F.avg("ret").alias("MKT")).write.parquet(f"{root}/states")
    t.table("part").select(F.col("p_name").alias("signal"), F.col("p_brand").alias("theme")).distinct().write.parquet(f"{root}/signal_meta")
    return io.load_bundle(t.spark, root, country=country)


@query("s4_load_bundle", """
SELECT 'universe' AS name, count(*) AS n FROM universe WHERE country = 'ASIA'
UNION ALL SELECT 'signals', count(*) FROM signals WHERE country = 'ASIA'
UNION ALL SELECT 'targets', count(ret_next) FROM signals WHERE country = 'ASIA'
UNION ALL SELECT 'cost_inputs', count(sigma_d) FROM cost_inputs WHERE country = 'ASIA'
UNION ALL SELECT 'states', count(DISTINCT m) FROM signals
UNION ALL SELECT 'signal_meta', count(*) FROM (SELECT DISTINCT p_name, p_brand FROM part)""")
def s4(t):
    b = bundle(t, "ASIA")
    count = lambda df, name, c=None: df.agg(F.count(c or F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    out = count(b.universe, "universe")
    for part in (
        count(b.signals, "signals"), count(b.targets, "targets", "ret_next"), count(b.cost_inputs, "cost_inputs", "sigma_d"),
        count(b.states, "states"), count(b.signal_meta, "signal_meta"),
    ):
        out = out.unionByName(part)
    return out


COUNTRIES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("s5_pool_countries", f"SELECT country, country || ':' || sec_id AS gid, m, {R('me', 3)} AS me FROM monthly_px")
def s5(t):
    frames = {c: t.monthly_px.filter(F.col("country") == c).select("sec_id", "m", "me") for c in COUNTRIES}
    return io.pool(frames, id="sec_id").select("country", "gid", "m", rnd("me", 3).alias("me"))


@query("s6_panel_join", f"""
SELECT p.m AS date, p.sec_id AS permno, {R('s.sig_disc')} AS sig_disc, {R('s.ret_next')} AS ret_next, {R('c.sigma_d')} AS sigma_d
FROM monthly_px p LEFT JOIN signals s ON p.sec_id = s.sec_id AND p.m = s.m LEFT JOIN cost_inputs c ON p.sec_id = c.sec_id AND p.m = c.m""")
def s6(t):
    key = [F.col("m").alias("date"), F.col("sec_id").alias("permno")]
    s = t.signals
    none = t.spark.range(0)
    b = io.Bundle(
        universe=universe(t), signals=s.select(*key, "sig_disc"), signal_meta=none, targets=s.select(*key, "ret_next"), states=none,
        cost_inputs=t.cost_inputs.select("country", *key, "spread", "sigma_d", "adv_usd", "borrow_fee"),
    )
    out = io.panel(b, ["sig_disc", "ret_next", "sigma_d"])
    return out.select("date", "permno", *[rnd(c).alias(c) for c in ("sig_disc", "ret_next", "sigma_d")])


@query("s7_append_with_column_union", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
UNION ALL SELECT o_orderkey, o_orderstatus, NULL FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def s7(t):
    o = t.table("orders")
    old = o.filter("o_orderdate < '1998-01-01'").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return io.append_rows(old, o.filter("o_orderdate >= '1998-01-01'").select("o_orderkey", "o_orderstatus"))


@query("s9_latest_run", f"""
SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey, {R('o_totalprice', 2)} AS o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def s9(t):
    o = t.table("orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderkey", rnd("o_totalprice", 2).alias("o_totalprice"))
    return io.latest_per_key(o, ["o_custkey"], ["d", "o_orderkey"])


@query("s10_evaluation_gate", """
SELECT last_day(CAST(o_orderdate AS DATE)) AS m, count(*) AS n FROM orders
WHERE o_orderdate BETWEEN DATE '1996-03-31' AND DATE '1998-09-30' GROUP BY 1""")
def s10(t):
    return io.gate(t.table("orders"), "o_orderdate", "1996-03-31", "1998-09-30").groupBy(F.last_day("o_orderdate").alias("m")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("s11_extract_missing_partitions", f"""
SELECT year(m) AS y, count(*) AS n, {R('sum(me)', 1)} AS me FROM monthly_px GROUP BY 1""")
def s11(t):
    """Cache some years, extract only the others, then read the whole cache back."""
    path = fresh(t, "years")
    rows = t.monthly_px.select("sec_id", "m", "me", F.year("m").alias("y"))
    io.write_partitions(rows.filter("y % 2 = 0"), path, "y")
    years = rows.select("y").distinct()
    todo = io.missing_partitions(t.spark, years, path, column="y", schema=rows.schema)
    io.write_partitions(rows.join(todo, "y", "left_semi"), path, "y")
    return t.spark.read.parquet(path).groupBy("y").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("me"), 1).alias("me"))


@query("s11_incremental_features", f"""
SELECT sec_id, d, year(d)::INTEGER AS y, obs_21, ret_obs_21, {R('sigma_21')} AS sigma_21, {R('adv_21', 3)} AS adv_21, max_gap_21 FROM rolled""")
def s11_features(t):
    """21-row features of some years, then of the years still missing: together those of all rows in one go.

    A security trades every fourth day here, so 21 rows before a year need more than the usual 62 days.
    """
    def features(px):
        kept = daily.daily_returns(px, keys=["sec_id", "y"], date="d", currency="cur", price="cl", high="hi", low="lo")
        return daily.rolling_features(
            kept, keys=["sec_id", "y"], date="d", counts={"obs_21": None, "ret_obs_21": "ret"}, sds={"sigma_21": "ret"}, means={"adv_21": "notional"}, maxes={"max_gap_21": "gap_days"}
        ).select("sec_id", "d", "y", "obs_21", "ret_obs_21", "sigma_21", "adv_21", "max_gap_21")

    path = fresh(t, "feature-years")
    px = t.daily_px.select("sec_id", "d", "cur", "cl", "hi", "lo", "notional")
    years = t.stage("years", t.table("lineitem").select(F.year("l_shipdate").alias("y")).distinct())
    for asked in (years.filter("y % 2 = 0"), years):
        io.extract_years(px, features, asked, path, date="d", year="y", look_back=240)
    out = t.spark.read.parquet(path)
    return out.select("sec_id", "d", "y", "obs_21", "ret_obs_21", rnd("sigma_21").alias("sigma_21"), rnd("adv_21", 3).alias("adv_21"), "max_gap_21")


@query("s6_checked_join", f"""
SELECT p.sec_id, p.m, p.n_days, {R('p.me', 1)} AS me, {R('c.sigma_d')} AS sigma_d, {R('c.adv_usd', 2)} AS adv_usd
FROM monthly_px p LEFT JOIN cost_inputs c ON p.sec_id = c.sec_id AND p.m = c.m""")
def s6_checked(t):
    """Month totals with their cost inputs, where a security-month that repeats on either side ends the query."""
    out = io.checked_join(t.monthly_px.select("sec_id", "m", "n_days", "me"), t.cost_inputs.select("sec_id", "m", "sigma_d", "adv_usd"), ["sec_id", "m"])
    return out.select("sec_id", "m", "n_days", rnd("me", 1).alias("me"), rnd("sigma_d").alias("sigma_d"), rnd("adv_usd", 2).alias("adv_usd"))


@query("s12_manifest_verify")
def s12(t):
    """Digests of the table files against a manifest that lacks one file and holds one stale digest."""
    found = io.file_digests(t.spark, t.root, "*.parquet")
    stale = F.when(F.col("file").startswith("nation"), F.sha2(F.lit("stale"), 256)).otherwise(F.col("sha256"))
    manifest = found.filter(~F.col("file").startswith("region")).select("file", stale.alias("sha256"))
    return io.manifest_verify(found, manifest)
