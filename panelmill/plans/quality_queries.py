"""Data quality, coverage and census queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import month_end, rnd
from panelmill.operators import daily, quality
from panelmill.operators.xsection import melt, tradeable
from panelmill.plans.daily_queries import ar_daily, vendor_monthly, vendor_returns, vendor_rolled
from panelmill.plans.registry import R, query, shared, view
from panelmill.plans.source_queries import universe
from panelmill.sources.contracts import CONTRACTS, Col, Contract


@shared
def broken_universe(t):
    """The universe with faults on known rows: null sizes, a wrong industry code, mid-month dates, repeated keys."""
    u = universe(t)
    p = F.col("permno")
    bad = u.select(
        F.when((p % 11 == 0) & (F.month("date") == 5), F.date_sub("date", 3)).otherwise(F.col("date")).alias("date"), "permno", "in_universe",
        F.when(p % 7 == 0, None).when(p % 19 == 0, -F.col("me")).otherwise(F.col("me")).alias("me"), "price", "exchcd",
        F.when(p % 23 == 0, 99).otherwise(F.col("ff49")).alias("ff49"), (F.col("nyse_size_pct") * 10).alias("nyse_size_pct"),
    )
    return bad.unionByName(bad.filter((p % 5 == 0) & (F.month("date") == 1)))


view("broken_once", """
  SELECT CAST(CASE WHEN permno % 11 = 0 AND month(date) = 5 THEN date - 3 ELSE date END AS DATE) AS date, permno, in_universe,
         CASE WHEN permno % 7 = 0 THEN NULL WHEN permno % 19 = 0 THEN -me ELSE me END AS me, price, exchcd,
         CASE WHEN permno % 23 = 0 THEN 99 ELSE ff49 END AS ff49, nyse_size_pct * 10 AS nyse_size_pct
  FROM universe""")
view("broken", "SELECT * FROM broken_once UNION ALL SELECT * FROM broken_once WHERE permno % 5 = 0 AND month(date) = 1")


@query("q1_schema_kinds")
def q1(t):
    frame = universe(t).drop("price").withColumn("ff49", F.col("ff49").cast("string"))
    return quality.violations(frame, "universe")


@query("q2_value_rules", """
SELECT * FROM (
  SELECT 'below_minimum' AS rule, 'me' AS "column", count(*) FILTER (me < -1e-9) AS n FROM broken
  UNION ALL SELECT 'above_maximum', 'nyse_size_pct', count(*) FILTER (nyse_size_pct > 100 + 1e-9) FROM broken
  UNION ALL SELECT 'not_allowed', 'ff49', count(*) FILTER (ff49 NOT BETWEEN 0 AND 49) FROM broken
  UNION ALL SELECT 'not_month_end', 'date', count(*) FILTER (date <> last_day(date)) FROM broken
  UNION ALL SELECT 'incomplete', 'me', count(*) FILTER (in_universe AND me IS NULL) FROM broken
  UNION ALL SELECT 'duplicate_key', 'date,permno', CAST(count(*) - count(DISTINCT (date, permno)) AS BIGINT) FROM broken) WHERE n > 0""")
def q2(t):
    return quality.violations(broken_universe(t), "universe")


@query("q3_duplicate_keys", "SELECT CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def q3(t):
    return quality.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("q4_conditional_completeness", """
SELECT country, count(*) FILTER (in_universe AND spread IS NULL) AS spread, count(*) FILTER (in_universe AND sigma_d IS NULL) AS sigma_d,
       count(*) FILTER (in_universe AND adv_usd IS NULL) AS adv_usd FROM panel GROUP BY 1""")
def q4(t):
    flag = F.col("in_universe")
    return t.panel.groupBy("country").agg(*[F.sum((flag & F.col(c).isNull()).cast("long")).alias(c) for c in ("spread", "sigma_d", "adv_usd")])


@query("q5_signal_family_bounds", """
SELECT signal, min(v) >= -0.5 - 1e-6 AND max(v) <= 0.5 + 1e-6 AS ok, count(v) AS n, round(min(v), 8) AS lo, round(max(v), 8) AS hi
FROM (UNPIVOT signals ON sig_disc, sig_tax, sig_vol, sig_mom, sig_size INTO NAME signal VALUE v) GROUP BY 1""")
def q5(t):
    names = [c for c in t.signals.columns if c.startswith("sig_")]
    long = melt(t.signals, ["m", "sec_id"], names)
    return long.groupBy("signal").agg(
        ((F.min("value") >= -0.5 - 1e-6) & (F.max("value") <= 0.5 + 1e-6)).alias("ok"), F.count("value").alias("n"),
        F.round(F.min("value"), 8).alias("lo"), F.round(F.max("value"), 8).alias("hi"),
    )


@shared
def vintage(t):
    """The bars without some securities, with small price changes on others and some repeated rows."""
    px = t.daily_px.select("sec_id", "d", "cl", "notional").filter("sec_id % 17 <> 0")
    px = px.withColumn("cl", F.when(F.col("sec_id") % 13 == 0, F.col("cl") + 1e-6).otherwise(F.col("cl")))
    return px.withColumn("notional", F.when(F.col("sec_id") % 29 == 0, None).otherwise(F.col("notional")))


view("vintage", """
  SELECT sec_id, d, CASE WHEN sec_id % 13 = 0 THEN cl + 1e-6 ELSE cl END AS cl, CASE WHEN sec_id % 29 = 0 THEN NULL ELSE notional END AS notional
  FROM daily_px WHERE sec_id % 17 <> 0""")


@query("q6_key_reconciliation", """
SELECT count(*) FILTER (na > 0 AND nb > 0) AS matched, count(*) FILTER (nb = 0) AS missing, count(*) FILTER (na = 0) AS unexpected,
       CAST(sum(greatest(na - 1, 0)) AS BIGINT) AS duplicate_left, CAST(sum(greatest(nb - 1, 0)) AS BIGINT) AS duplicate_right
FROM (SELECT sec_id, d, sum(a) AS na, sum(b) AS nb FROM (
        SELECT sec_id, d, 1 AS a, 0 AS b FROM daily_px UNION ALL SELECT sec_id, d, 0, 1 FROM vintage UNION ALL SELECT sec_id, d + 4000, 0, 1 FROM vintage
        UNION ALL SELECT sec_id, d, 0, 1 FROM vintage WHERE sec_id % 5 = 0) GROUP BY 1, 2)""")
def q6(t):
    v = vintage(t).select("sec_id", "d")
    other = v.unionByName(v.withColumn("d", F.date_add("d", 4000))).unionByName(v.filter("sec_id % 5 = 0"))
    return quality.reconcile_keys(t.daily_px, other, ["sec_id", "d"])


@query("q7_column_identity", f"""
SELECT 'cl' AS "column", count(*) AS "rows", count(*) FILTER ((a.cl IS NULL) <> (b.cl IS NULL)) AS null_mismatch,
       count(*) FILTER (abs(a.cl - b.cl) > 1e-9) AS out_of_tolerance, {R('max(abs(a.cl - b.cl))')} AS max_abs_diff
FROM daily_px a JOIN vintage b ON a.sec_id = b.sec_id AND a.d = b.d
UNION ALL SELECT 'notional', count(*), count(*) FILTER ((a.notional IS NULL) <> (b.notional IS NULL)), count(*) FILTER (abs(a.notional - b.notional) > 1e-9),
       {R('max(abs(a.notional - b.notional))')} FROM daily_px a JOIN vintage b ON a.sec_id = b.sec_id AND a.d = b.d""")
def q7(t):
    out = quality.compare_columns(t.daily_px, vintage(t), ["sec_id", "d"], ["cl", "notional"], atol=1e-9)
    return out.withColumn("max_abs_diff", rnd("max_abs_diff"))


@query("q8_disjoint_ids", """
SELECT l_partkey AS id, count(DISTINCT l_returnflag) AS n_groups, min(l_returnflag) AS first_group FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def q8(t):
    li = t.table("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("grp"))
    return quality.disjoint_ids(li, id="id", group="grp")


@query("q9_crosswalk_conflicts", """
WITH x AS (SELECT DISTINCT l_partkey AS a, l_suppkey * 1000 + l_linenumber AS b FROM lineitem)
SELECT 'a' AS side, CAST(a AS VARCHAR) AS id, count(*) AS partners FROM x GROUP BY a HAVING count(*) > 1
UNION ALL SELECT 'b', CAST(b AS VARCHAR), count(*) FROM x GROUP BY b HAVING count(*) > 1""")
def q9(t):
    li = t.table("lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("b"))
    return quality.crosswalk_conflicts(li, "a", "b")


@query("q10_security_spans", """
SELECT sec_id, min(m) AS first_month, max(m) AS last_month, count(*) AS months, min(m) FILTER (in_universe) AS first_flagged,
       max(m) FILTER (in_universe) AS last_flagged, count(*) FILTER (in_universe) AS flagged_months FROM panel GROUP BY 1""")
def q10(t):
    return quality.spans(t.monthly_px.withColumn("f", F.col("n_days") >= 5), id="sec_id", date="m", flag="f")


@query("q11_investible_ledger", "SELECT p.sec_id, p.m, s_name AS vendor_id FROM panel p JOIN supplier ON p.sec_id = s_suppkey WHERE in_universe")
def q11(t):
    cross = t.table("supplier").select(F.col("s_suppkey").alias("sec_id"), F.col("s_name").alias("vendor_id"))
    return t.monthly_px.filter("n_days >= 5").select("sec_id", "m").join(cross, "sec_id")


@query("q12_vendor_revisions", """
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed'
         WHEN (a.cl IS NULL) <> (b.cl IS NULL) OR (a.notional IS NULL) <> (b.notional IS NULL) OR abs(a.cl - b.cl) > 1e-8 OR abs(a.notional - b.notional) > 1e-8 THEN 'changed' END AS status
  FROM daily_px a FULL JOIN vintage b ON a.sec_id = b.sec_id AND a.d = b.d) WHERE status IS NOT NULL GROUP BY 1""")
def q12(t):
    out = quality.revisions(t.daily_px, vintage(t), ["sec_id", "d"], ["cl", "notional"])
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("q13_formula_identities", """
SELECT 'price' AS identity, count(adjusted_price) AS n, round(max(abs((adjusted_price * ajexdi - prccd) / prccd)), 9) AS max_rel_error,
       count(*) FILTER (abs((adjusted_price * ajexdi - prccd) / prccd) > 1e-9) AS broken FROM vendor_adj
UNION ALL SELECT 'return_index', count(return_index), round(max(abs((return_index - adjusted_price * trfd) / (adjusted_price * trfd))), 9),
       count(*) FILTER (abs((return_index - adjusted_price * trfd) / (adjusted_price * trfd)) > 1e-9) FROM vendor_adj
UNION ALL SELECT 'share_unit', count(cshoc), round(max(abs((cshoc / cshtrd - 1000) / 1000)), 9), count(*) FILTER (abs((cshoc / cshtrd - 1000) / 1000) > 1e-9) FROM vendor_adj""")
def q13(t):
    from panelmill.plans.daily_queries import vendor_adjusted

    out = quality.identities(vendor_adjusted(t), {
        "price": (F.col("adjusted_price") * F.col("ajexdi"), F.col("prccd")),
        "return_index": (F.col("return_index"), F.col("adjusted_price") * F.col("trfd")),
        "share_unit": (F.col("cshoc") / F.col("cshtrd"), F.lit(1000.0)),
    })
    return out.withColumn("max_rel_error", F.round("max_rel_error", 9))


@query("q14_coverage_rollup", f"""
SELECT country, y, count(*) AS "rows", count(*) FILTER (ret_ok) AS n_ret_ok, {R('count(*) FILTER (ret_ok) / count(*)')} AS rate_ret_ok,
       count(*) FILTER (ohlc_ok) AS n_ohlc_ok, {R('count(*) FILTER (ohlc_ok) / count(*)')} AS rate_ohlc_ok
FROM (SELECT country, year(m) AS y, return_obs_21 = 21 AS ret_ok, ohlc_obs_21 = 21 AS ohlc_ok FROM vendor_month) GROUP BY ROLLUP (country, y)""")
def q14(t):
    ends = vendor_monthly(t).select(
        "country", F.year("m").alias("y"), (F.col("return_obs_21") == 21).alias("ret_ok"), (F.col("ohlc_obs_21") == 21).alias("ohlc_ok")
    )
    out = quality.coverage(ends, ["country", "y"], ["ret_ok", "ohlc_ok"])
    return out.withColumn("rate_ret_ok", rnd("rate_ret_ok")).withColumn("rate_ohlc_ok", rnd("rate_ohlc_ok"))


@query("q15_projected_coverage", f"""
SELECT country, y, count(*) AS "rows", count(*) FILTER (edge) AS n_edge, {R('count(*) FILTER (edge) / count(*)')} AS rate_edge,
       count(*) FILTER (ar AND NOT edge) AS n_increment, {R('count(*) FILTER (ar AND NOT edge) / count(*)')} AS rate_increment,
       count(*) FILTER (ar OR edge) AS n_spread, {R('count(*) FILTER (ar OR edge) / count(*)')} AS rate_spread,
       count(*) FILTER ((ar OR edge) AND sig AND adv) AS n_complete, {R('count(*) FILTER ((ar OR edge) AND sig AND adv) / count(*)')} AS rate_complete
FROM (SELECT country, year(m) AS y, raw_obs_21 = 21 AND return_obs_21 = 21 AND ohlc_obs_21 = 21 AS ar, ohlc_obs_21 = 21 AND sec_id % 2 = 0 AS edge,
             return_obs_21 = 21 AS sig, volume_obs_21 = 21 AS adv FROM vendor_month) GROUP BY 1, 2""")
def q15(t):
    ar = (F.col("raw_obs_21") == 21) & (F.col("return_obs_21") == 21) & (F.col("ohlc_obs_21") == 21)
    edge = (F.col("ohlc_obs_21") == 21) & (F.col("sec_id") % 2 == 0)
    spread = ar | edge
    ends = vendor_monthly(t).select(
        "country", F.year("m").alias("y"), edge.alias("edge"), (ar & ~edge).alias("increment"), spread.alias("spread"),
        (spread & (F.col("return_obs_21") == 21) & (F.col("volume_obs_21") == 21)).alias("complete"),
    )
    flags = ["edge", "increment", "spread", "complete"]
    out = quality.coverage(ends, ["country", "y"], flags, rollup=False)
    return out.withColumns({f"rate_{f}": rnd(f"rate_{f}") for f in flags})


@query("q16_security_profile", """
SELECT s.sec_id, s.a AS query_start, s.z AS query_end, count(v.d) AS daily_rows, count(prccd) AS close_rows, count(cshtrd) AS volume_rows,
       count(*) FILTER (prcod IS NOT NULL AND prchd IS NOT NULL AND prcld IS NOT NULL AND prccd IS NOT NULL) AS ohlc_rows,
       count(*) FILTER (prcstd IN (3, 4, 10)) AS actual_rows, count(*) FILTER (prcstd = 5) AS carried_rows, min(v.d) AS first_daily, max(v.d) AS last_daily,
       coalesce(string_agg(DISTINCT curcdd, '|' ORDER BY curcdd), '') AS currencies,
       coalesce(string_agg(DISTINCT CAST(prcstd AS VARCHAR), '|' ORDER BY CAST(prcstd AS VARCHAR)), '') AS statuses
FROM (SELECT s_suppkey AS sec_id, DATE '1996-01-01' + CAST(s_suppkey % 400 AS INTEGER) AS a, DATE '1999-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS z FROM supplier) s
LEFT JOIN vendor_daily v ON v.sec_id = s.sec_id AND v.d BETWEEN s.a AND s.z GROUP BY 1, 2, 3""")
def q16(t):
    base = lambda day, k: F.date_add(F.lit(day).cast("date"), (F.col("s_suppkey") % k).cast("int"))
    windows = t.table("supplier").select(
        F.col("s_suppkey").alias("sec_id"), base("1996-01-01", 400).alias("query_start"), base("1999-01-01", 300).alias("query_end")
    )
    return quality.security_profile(
        t.vendor_daily, windows, id="sec_id", date="d", start="query_start", end="query_end", close="prccd", volume="cshtrd",
        ohlc=["prcod", "prchd", "prcld", "prccd"], status="prcstd", currency="curcdd",
    )


@query("q17_extraction_audit", f"""
SELECT v.country, count(*) AS "rows", max(datediff('day', v.d, v.m)) AS max_staleness, {R("avg(datediff('day', v.d, v.m))")} AS mean_staleness,
       count(*) FILTER (lo = hi) AS stable_currency, count(sigma_total_21) AS sigma_rows
FROM vendor_month v JOIN (SELECT sec_id, last_day(d) AS m, min(curcdd) AS lo, max(curcdd) AS hi FROM vendor_ret GROUP BY 1, 2) s ON v.sec_id = s.sec_id AND v.m = s.m
GROUP BY 1""")
def q17(t):
    rolled = vendor_rolled(t)
    month = daily.month_stats(rolled, keys=["sec_id"], date="d", close="prccd", volume="cshtrd", ret="total_ret", currency="curcdd")
    ends = daily.month_endpoint(rolled, keys=["sec_id"], date="d").join(month, ["sec_id", "m"])
    stale = F.datediff("m", "d")
    return ends.groupBy("country").agg(
        F.count(F.lit(1)).alias("rows"), F.max(stale).cast("long").alias("max_staleness"), rnd(F.avg(stale)).alias("mean_staleness"),
        F.sum((F.col("month_min_currency") == F.col("month_max_currency")).cast("long")).alias("stable_currency"),
        F.count("sigma_total_21").alias("sigma_rows"),
    )


@query("q18_source_hierarchy", """
SELECT label, count(*) AS "rows", count(*) FILTER (sec_id % 31 = 0 AND label <> 'MISSING') AS mismatched FROM (
  SELECT a.sec_id, CASE WHEN v.return_obs_21 = 21 THEN 'RANGE' WHEN a.ar_strict IS NOT NULL THEN 'AR' ELSE 'MISSING' END AS label
  FROM ar_daily a JOIN vendor_roll v ON a.sec_id = v.sec_id AND a.d = v.d) GROUP BY 1""")
def q18(t):
    rng = vendor_rolled(t).select("sec_id", "d", F.when(F.col("return_obs_21") == 21, F.col("hl_range_21")).alias("rng"))
    both = ar_daily(t).select("sec_id", "d", "ar_strict").join(rng, ["sec_id", "d"])
    out = daily.coalesce_sources(both, {"rng": "RANGE", "ar_strict": "AR"}, out="spread", label="label")
    out = out.withColumn("spread", F.when(F.col("sec_id") % 31 == 0, F.col("spread") + 1.0).otherwise(F.col("spread")))
    return quality.hierarchy_check(out, value="spread", label="label", sources={"rng": "RANGE", "ar_strict": "AR"})


@query("q19_outlier_rebuild", f"""
SELECT f.sec_id, f.m, {R('f.sigma_21')} AS sigma_21, {R('stddev_samp(r.ret)')} AS rebuilt, count(r.ret) AS n, max_by(r.d, abs(r.ret)) AS shock_day, {R('max(abs(r.ret))')} AS shock
FROM features f JOIN (SELECT sec_id, d, ret FROM daily_ret) r ON r.sec_id = f.sec_id AND r.d <= f.m
WHERE f.sigma_21 >= 25 AND (SELECT count(*) FROM daily_ret x WHERE x.sec_id = r.sec_id AND x.d > r.d AND x.d <= f.m) < 21 GROUP BY f.sec_id, f.m, f.sigma_21""")
def q19(t):
    px = t.daily_px.select("sec_id", "d", "cur", "cl", "hi", "lo")
    raw = daily.daily_returns(px, keys=["sec_id"], date="d", currency="cur", price="cl", high="hi", low="lo")
    out = quality.outliers(t.features, raw, id="sec_id", month="m", value="sigma_21", date="d", ret="ret", limit=25.0)
    return out.select("sec_id", "m", rnd("sigma_21").alias("sigma_21"), rnd("rebuilt").alias("rebuilt"), "n", "shock_day", rnd("shock").alias("shock"))


@query("q20_quantile_summary", f"""
SELECT country, count(ret) AS n, {R('min(ret)')} AS q_min, {R('quantile_cont(ret, 0.01)')} AS p01, {R('quantile_cont(ret, 0.5)')} AS p50,
       {R('quantile_cont(ret, 0.99)')} AS p99, {R('max(ret)')} AS q_max FROM daily_ret WHERE ret IS NOT NULL GROUP BY 1""")
def q20(t):
    px = t.daily_px.select("country", "sec_id", "d", "cur", "cl", "hi", "lo")
    raw = daily.daily_returns(px, keys=["sec_id"], date="d", currency="cur", price="cl", high="hi", low="lo")
    out = quality.quantile_summary(raw, "ret", ["country"])
    return out.select("country", "n", *[rnd(c).alias(c) for c in ("q_min", "p01", "p50", "p99", "q_max")])


@query("q21_unbalanced_months", """
WITH c AS (SELECT DISTINCT m, cell FROM cell_returns WHERE NOT (month(m) = 3 AND cell LIKE 'N-C%')), u AS (SELECT DISTINCT cell FROM c)
SELECT m, count(*) AS n_absent, string_agg(cell, '|' ORDER BY cell) AS absent
FROM (SELECT d.m, u.cell FROM (SELECT DISTINCT m FROM c) d, u EXCEPT SELECT m, cell FROM c) GROUP BY 1""")
def q21(t):
    cells = t.cell_returns.filter(~((F.month("m") == 3) & F.col("cell").startswith("N-C")))
    return quality.unbalanced(cells, date="m", unit="cell")


view("mem", "SELECT sec_id, m FROM monthly_px WHERE n_days >= 6")
view("mem_life", """
  SELECT *, mi = max(mi) OVER (PARTITION BY sec_id) AS final, NOT coalesce(lead(mi) OVER w = mi + 1, FALSE) AS leaves, NOT coalesce(lag(mi) OVER w = mi - 1, FALSE) AS enters,
         max(mi) OVER () AS last_mi
  FROM (SELECT sec_id, m, dense_rank() OVER (ORDER BY m) AS mi FROM mem) WINDOW w AS (PARTITION BY sec_id ORDER BY mi)""")


@shared
def members(t):
    return t.monthly_px.filter("n_days >= 6").select("sec_id", "m")


@query("q22_membership_flows", """
SELECT m, count(*) AS n, CASE WHEN mi > 1 THEN count(*) FILTER (enters) END AS entries, CASE WHEN mi < last_mi THEN count(*) FILTER (leaves) END AS exits,
       CASE WHEN mi < last_mi THEN count(*) FILTER (leaves AND final) END AS exits_permanent,
       CASE WHEN mi < last_mi THEN count(*) FILTER (leaves AND NOT final) END AS exits_with_return
FROM mem_life GROUP BY m, mi, last_mi""")
def q22(t):
    return quality.membership_flows(members(t), id="sec_id", month="m")


@query("q23_panel_coverage", """
SELECT p.m, count(*) AS "rows", count(a.m) AS in_members, count(c.m) AS in_costs FROM monthly_px p
LEFT JOIN mem a ON p.sec_id = a.sec_id AND p.m = a.m
LEFT JOIN (SELECT sec_id, m FROM cost_inputs WHERE sigma_d IS NOT NULL) c ON p.sec_id = c.sec_id AND p.m = c.m GROUP BY 1""")
def q23(t):
    costs = t.cost_inputs.filter("sigma_d IS NOT NULL")
    return quality.panel_coverage(t.monthly_px.select("sec_id", "m"), {"members": members(t), "costs": costs}, keys=["sec_id", "m"], month="m")


view("census_book", """
  SELECT CASE WHEN sec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS book, sec_id, m, CASE WHEN month(m) % 4 = 0 THEN 0.0 ELSE 0.01 END AS w FROM monthly_px WHERE n_days >= 5""")
view("losses", """
  SELECT b.book, b.m, count(*) AS n_held, count(*) FILTER (l.mi IS NULL) AS n_not_in_panel, count(*) FILTER (l.mi < last_mi AND leaves) AS n_not_next,
         count(*) FILTER (l.mi < last_mi AND leaves AND final) AS n_not_next_permanent, count(*) FILTER (c.m IS NULL) AS n_not_in_costs
  FROM census_book b LEFT JOIN mem_life l ON b.sec_id = l.sec_id AND b.m = l.m
  LEFT JOIN (SELECT sec_id, m FROM cost_inputs WHERE sigma_d IS NOT NULL) c ON b.sec_id = c.sec_id AND b.m = c.m WHERE w <> 0 GROUP BY 1, 2""")


@shared
def losses(t):
    book = t.monthly_px.filter("n_days >= 5").select(
        F.when(F.col("sec_id") % 2 == 0, "even").otherwise("odd").alias("book"), "sec_id", "m", F.when(F.month("m") % 4 == 0, 0.0).otherwise(0.01).alias("w")
    )
    costs = t.cost_inputs.filter("sigma_d IS NOT NULL")
    return quality.held_losses(book, members(t), {"costs": costs}, by=["book"], id="sec_id", month="m")


@query("q24_held_names_lost", "SELECT * FROM losses")
def q24(t):
    return losses(t)


@query("q24_first_loss", "SELECT book, count(*) AS months, min(m) FILTER (n_not_next > 0) AS first_month FROM losses GROUP BY 1")
def q24_first(t):
    return quality.first_loss(losses(t), by=["book"], month="m")


view("runs", """
  SELECT sec_id, min(m) AS first_month, max(m) AS last_month, count(*) AS run_len,
         CASE WHEN max_by(nm, mi) = max(mi) + 1 AND max_by(nok, mi) THEN 'recovers' WHEN max_by(nm, mi) = max(mi) + 1 THEN 'next_unusable' ELSE 'no_next_row' END AS ends,
         coalesce(min_by(pm, mi) = min(mi) - 1 AND min_by(pok, mi), FALSE) AS usable_before, bool_and(in_universe) AS all_in_universe
  FROM (SELECT *, mi - row_number() OVER (PARTITION BY sec_id ORDER BY mi) AS run FROM (
          SELECT *, coalesce(lead(mi) OVER w, -1) AS nm, coalesce(lead(ok) OVER w, FALSE) AS nok, coalesce(lag(mi) OVER w, -1) AS pm, coalesce(lag(ok) OVER w, FALSE) AS pok
          FROM (SELECT sec_id, m, in_universe, year(m) * 12 + month(m) AS mi, sigma_d IS NOT NULL AND ret_next IS NOT NULL AS ok FROM panel)
          WINDOW w AS (PARTITION BY sec_id ORDER BY mi)) WHERE NOT ok) GROUP BY sec_id, run""")


@shared
def gap_panel(t):
    return t.panel.withColumn("ok", F.col("sigma_d").isNotNull() & F.col("ret_next").isNotNull())


@shared
def runs(t):
    return quality.gap_runs(gap_panel(t), id="sec_id", month="m", ok="ok", carry=["in_universe"])


@query("q25_gap_runs", "SELECT * FROM runs")
def q25(t):
    return runs(t)


@query("q26_gap_buckets", """
SELECT CASE WHEN run_len <= 1 THEN '1' WHEN run_len <= 3 THEN '2-3' WHEN run_len <= 12 THEN '4-12' ELSE '>12' END AS bucket, ends, all_in_universe, count(*) AS n_runs
FROM runs GROUP BY 1, 2, 3""")
def q26(t):
    return quality.gap_buckets(runs(t), ["ends", "all_in_universe"])


@query("q27_gap_vendor_spans", """
SELECT CASE WHEN s.first_d IS NULL THEN 'no_vendor_rows' WHEN last_month < first_d THEN 'before_vendor_start' WHEN first_month > last_d THEN 'after_vendor_end'
            ELSE 'inside_vendor_span' END AS place, ends, count(*) AS n_runs, count(DISTINCT r.sec_id) AS n_ids, count(DISTINCT CASE WHEN run_len > 1 THEN r.sec_id END) AS n_ids_long
FROM runs r LEFT JOIN (SELECT sec_id, min(d) AS first_d, max(d) AS last_d FROM daily_px WHERE d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND sec_id % 9 <> 0 GROUP BY 1) s ON r.sec_id = s.sec_id
GROUP BY 1, 2""")
def q27(t):
    spans = t.daily_px.filter("d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND sec_id % 9 <> 0").groupBy("sec_id").agg(
        F.min("d").alias("first_d"), F.max("d").alias("last_d")
    )
    return quality.gap_span_join(runs(t), spans, id="sec_id", first="first_d", last="last_d")


@query("q28_flag_crosstab", """
SELECT in_universe, priced, certified, count(*) AS n FROM (
  SELECT in_universe, ret_next IS NOT NULL AS priced, coalesce(spread >= 0 AND sigma_d >= 0 AND adv_usd > 0, FALSE) AS certified FROM panel) GROUP BY CUBE (in_universe, priced, certified)""")
def q28(t):
    flags = t.panel.select("in_universe", quality.usable("ret_next").alias("priced"), tradeable().alias("certified"))
    return quality.flag_crosstab(flags, ["in_universe", "priced", "certified"], cube=True)


@query("q29_bad_row_position", """
SELECT CASE WHEN m = last_m THEN 'last_row' WHEN last_ok > m THEN 'later_usable' ELSE 'no_later_usable' END AS position, count(*) AS "rows", count(DISTINCT sec_id) AS ids
FROM (SELECT sec_id, m, sigma_d IS NOT NULL AND ret_next IS NOT NULL AS ok, max(m) OVER (PARTITION BY sec_id) AS last_m,
             max(CASE WHEN sigma_d IS NOT NULL AND ret_next IS NOT NULL THEN m END) OVER (PARTITION BY sec_id) AS last_ok FROM panel) WHERE NOT ok GROUP BY 1""")
def q29(t):
    return quality.row_position(gap_panel(t), id="sec_id", month="m", ok="ok")


@shared
def support(t):
    """Two books over the panel, each name on every month from the first to the last of the panel."""
    p = daily.densify(t.panel.drop("country"), keys=["sec_id"], month="m")
    p = p.withColumn("book", F.explode(F.array(F.lit("A"), F.lit("B"))))
    k = F.when(F.col("book") == "A", 0).otherwise(1)
    has = lambda c: F.coalesce(c, F.lit(False))
    rows = p.select(
        "book", F.col("sec_id").alias("id"), "m", has((F.col("sec_id") + F.month("m") + k) % 5 == 0).alias("target"),
        F.col("price").isNotNull().alias("priced"), F.col("ret_next").isNotNull().alias("usable"), (F.col("sec_id") % 6 != 0).alias("dividend"),
        has(F.col("in_universe")).alias("member"), F.col("spread").isNotNull().alias("costed"), tradeable().alias("certified"),
    )
    return quality.support_simulation(rows)


@query("q30_support_simulation")
def q30(t):
    return support(t)


@query("q31_support_shares")
def q31(t):
    return quality.support_shares(support(t)).withColumn("share", rnd("share"))


@query("q31_unsupported_shares_by_country", f"""
SELECT country, metric, {R('share')} AS share, CASE WHEN share = 0 THEN '0%' WHEN share <= 0.05 THEN '(0,5%]' WHEN share <= 0.25 THEN '(5%,25%]' ELSE '>25%' END AS tier
FROM (UNPIVOT (SELECT country, avg(CAST(v AS DOUBLE)) AS gross, avg(CAST(v OR c AS DOUBLE)) AS net, avg(CAST(v OR c OR d AS DOUBLE)) AS after_tax FROM (
  SELECT country, bool_or(n_days < 2) AS v, bool_or(n_days = 2) AS c, bool_or(n_days = 3) AS d FROM monthly_px GROUP BY country, m) GROUP BY 1) ON gross, net, after_tax INTO NAME metric VALUE share)""")
def q31_country(t):
    any_ = lambda e: F.max(e)
    sim = t.monthly_px.groupBy("country", "m").agg(
        any_(F.col("n_days") < 2).alias("valuation_unresolved"), any_(F.col("n_days") == 2).alias("cost_unsupported"),
        any_(F.col("n_days") == 3).alias("dividend_unsupported"),
    )
    return quality.support_shares(sim, by=["country"]).withColumn("share", rnd("share"))


@query("q32_attach_quality", f"""
SELECT r.cell, {R('avg(r.r)')} AS mean_ret, max(q.held_share) AS held_share FROM cell_returns r
LEFT JOIN (SELECT cell, max_by(h, m) AS held_share FROM (SELECT cell, m, month(m) / 12.0::DOUBLE AS h FROM cell_returns WHERE cell LIKE '%U') GROUP BY 1) q ON r.cell = q.cell GROUP BY 1""")
def q32(t):
    results = t.cell_returns.groupBy("cell").agg(rnd(F.avg("r")).alias("mean_ret"))
    manifest = t.cell_returns.select("cell", "m", F.when(F.col("cell").endswith("U"), F.month("m") / 12.0).alias("held_share"))
    return quality.attach_quality(results, manifest, key="cell", order="m", cols=["held_share"])
