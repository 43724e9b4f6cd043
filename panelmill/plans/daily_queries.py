"""Daily bars to monthly features and market states."""

from pyspark.sql import functions as F

from panelmill.functions import finite, rnd
from panelmill.operators import asof, daily
from panelmill.plans.registry import R, query, shared, view


@query("flagship_month_end_features", f"""
SELECT country, sec_id, m, d AS endpoint_date, cur, obs_21, ret_obs_21, range_obs_21, max_gap_21,
       {R('sigma_21')} AS sigma_21, {R('adv_21', 3)} AS adv_21, {R('range_21')} AS range_21,
       {R('CASE WHEN ret_obs_21 = 21 THEN sigma_21 END')} AS sigma_strict
FROM features""")
def flagship(t):
    return t.features.select(
        "country", "sec_id", "m", F.col("d").alias("endpoint_date"), "cur", "obs_21", "ret_obs_21", "range_obs_21", "max_gap_21",
        rnd("sigma_21").alias("sigma_21"), rnd("adv_21", 3).alias("adv_21"), rnd("range_21").alias("range_21"),
        rnd(F.when(F.col("ret_obs_21") == 21, F.col("sigma_21"))).alias("sigma_strict"),
    )


view("fx_ranked", """
  SELECT * FROM fx_quotes
  QUALIFY row_number() OVER (PARTITION BY d, tocurd ORDER BY CASE WHEN exrattpd = 'AR' THEN 0 ELSE 1 END, exrattpd) = 1""")
view("fx_usd", """
  SELECT f.d, f.tocurd AS cur, CASE WHEN f.tocurd = 'USD' THEN 1.0
         WHEN f.exratd > 0 AND u.exratd > 0 THEN u.exratd / f.exratd END::DOUBLE AS usd_per_local
  FROM fx_ranked f JOIN fx_ranked u ON f.d = u.d AND u.tocurd = 'USD'""")
view("vendor_adj", """
  SELECT v.*, x.usd_per_local,
         CASE WHEN prccd > 0 AND ajexdi > 0 THEN prccd / ajexdi END AS adjusted_price,
         CASE WHEN prccd > 0 AND ajexdi > 0 AND trfd > 0 THEN prccd / ajexdi * trfd END AS return_index,
         CASE WHEN prccd > 0 AND cshtrd >= 0 THEN prccd * cshtrd END AS notional_reported,
         CASE WHEN prccd > 0 AND cshtrd >= 0 AND qunit > 0 THEN prccd * cshtrd / qunit END AS notional_qunit,
         CASE WHEN prccd > 0 AND cshtrd >= 0 AND qunit > 0 AND usd_per_local > 0 THEN prccd * cshtrd / qunit * usd_per_local END AS notional_usd
  FROM vendor_daily v LEFT JOIN fx_usd x ON v.d = x.d AND v.curcdd = x.cur
  WHERE prcstd IN (3, 4, 10)""")
view("vendor_ret", """
  SELECT *, CASE WHEN curcdd = lag(curcdd) OVER w AND return_index > 0 AND lag(return_index) OVER w > 0
                 THEN return_index / lag(return_index) OVER w - 1 END AS total_ret,
         CASE WHEN curcdd = lag(curcdd) OVER w AND adjusted_price > 0 AND lag(adjusted_price) OVER w > 0
                 THEN adjusted_price / lag(adjusted_price) OVER w - 1 END AS ret,
         CASE WHEN prchd > 0 AND prcld > 0 AND prchd >= prcld THEN (prchd - prcld) / ((prchd + prcld) / 2) END AS hl_range,
         d - lag(d) OVER w AS gap_days
  FROM vendor_adj WINDOW w AS (PARTITION BY sec_id ORDER BY d)""")
view("vendor_roll", """
  SELECT *, count(*) OVER w AS raw_obs_21, count(total_ret) OVER w AS return_obs_21, count(cshtrd) OVER w AS volume_obs_21,
         count(hl_range) OVER w AS ohlc_obs_21, stddev_samp(total_ret) OVER w AS sigma_total_21, stddev_samp(ret) OVER w AS sigma_price_21,
         avg(notional_reported) OVER w AS adv_reported_21, avg(notional_qunit) OVER w AS adv_qunit_21, avg(notional_usd) OVER w AS adv_usd_21,
         avg(hl_range) OVER w AS hl_range_21, avg(CASE WHEN notional_qunit > 0 THEN abs(total_ret) / notional_qunit END) OVER w AS amihud_qunit_21,
         avg(CASE WHEN notional_usd > 0 THEN abs(total_ret) / notional_usd END) OVER w AS amihud_usd_21, max(gap_days) OVER w AS max_gap_days_21
  FROM vendor_ret WINDOW w AS (PARTITION BY sec_id ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
view("vendor_month", """
  SELECT *, last_day(d) AS m FROM vendor_roll
  QUALIFY row_number() OVER (PARTITION BY sec_id, last_day(d) ORDER BY d DESC) = 1""")


@shared
def vendor_rates(t):
    return daily.cross_rate(daily.prefer_rate(t.fx_quotes))


@shared
def vendor_adjusted(t):
    px = daily.trading_days(t.vendor_daily)
    fx = vendor_rates(t).withColumnRenamed("cur", "curcdd")
    return daily.adjust_prices(px.join(fx, ["d", "curcdd"], "left"))


@shared
def vendor_returns(t):
    return daily.daily_returns(
        vendor_adjusted(t), keys=["sec_id"], date="d", currency="curcdd", price="adjusted_price", index="return_index",
        high="prchd", low="prcld",
    )


@shared
def vendor_rolled(t):
    return daily.rolling_features(
        vendor_returns(t), keys=["sec_id"], date="d",
        counts={"raw_obs_21": None, "return_obs_21": "total_ret", "volume_obs_21": "cshtrd", "ohlc_obs_21": "hl_range"},
        sds={"sigma_total_21": "total_ret", "sigma_price_21": "ret"},
        means={
            "adv_reported_21": "notional_reported", "adv_qunit_21": "notional_qunit", "adv_usd_21": "notional_usd", "hl_range_21": "hl_range",
            "amihud_qunit_21": daily.amihud("total_ret", "notional_qunit"), "amihud_usd_21": daily.amihud("total_ret", "notional_usd"),
        },
        maxes={"max_gap_days_21": "gap_days"},
    )


@shared
def vendor_monthly(t):
    return daily.month_endpoint(vendor_rolled(t), keys=["sec_id"], date="d")


@query("f1_adjusted_prices", f"""
SELECT sec_id, d, {R('adjusted_price', 6)} AS adjusted_price, {R('return_index', 6)} AS return_index,
       {R('notional_reported', 3)} AS notional_reported, {R('notional_qunit', 3)} AS notional_qunit, {R('notional_usd', 3)} AS notional_usd
FROM vendor_adj""")
def f1(t):
    return vendor_adjusted(t).select(
        "sec_id", "d", rnd("adjusted_price", 6).alias("adjusted_price"), rnd("return_index", 6).alias("return_index"),
        *[rnd(c, 3).alias(c) for c in ("notional_reported", "notional_qunit", "notional_usd")],
    )


@query("f2_fx_preference", f"SELECT d, tocurd, exrattpd, {R('exratd')} AS exratd FROM fx_ranked")
def f2(t):
    return daily.prefer_rate(t.fx_quotes).select("d", "tocurd", "exrattpd", rnd("exratd").alias("exratd"))


@query("f3_fx_cross_rate", f"SELECT d, cur, {R('usd_per_local')} AS usd_per_local FROM fx_usd")
def f3(t):
    return vendor_rates(t).select("d", "cur", rnd("usd_per_local").alias("usd_per_local"))


@query("f4_trading_day_filter", """
SELECT prcstd, count(*) AS n, count(DISTINCT sec_id) AS securities FROM vendor_daily WHERE prcstd IN (3, 4, 10) GROUP BY 1""")
def f4(t):
    return daily.trading_days(t.vendor_daily).groupBy("prcstd").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("sec_id").alias("securities")
    )


@query("f5_daily_returns", f"""
SELECT sec_id, d, {R('total_ret')} AS total_ret, {R('ret')} AS ret, {R('hl_range')} AS hl_range, gap_days FROM vendor_ret""")
def f5(t):
    return vendor_returns(t).select(
        "sec_id", "d", rnd("total_ret").alias("total_ret"), rnd("ret").alias("ret"), rnd("hl_range").alias("hl_range"), "gap_days"
    )


@query("f6_rolling_features", f"""
SELECT sec_id, d, raw_obs_21, return_obs_21, volume_obs_21, ohlc_obs_21, {R('sigma_total_21')} AS sigma_total_21,
       {R('sigma_price_21')} AS sigma_price_21, {R('adv_reported_21', 3)} AS adv_reported_21, {R('adv_qunit_21', 3)} AS adv_qunit_21,
       {R('adv_usd_21', 3)} AS adv_usd_21, {R('hl_range_21')} AS hl_range_21, {R('amihud_qunit_21', 12)} AS amihud_qunit_21,
       {R('amihud_usd_21', 12)} AS amihud_usd_21, max_gap_days_21
FROM vendor_roll""")
def f6(t):
    return vendor_rolled(t).select(
        "sec_id", "d", "raw_obs_21", "return_obs_21", "volume_obs_21", "ohlc_obs_21",
        *[rnd(c).alias(c) for c in ("sigma_total_21", "sigma_price_21", "hl_range_21")],
        *[rnd(c, 3).alias(c) for c in ("adv_reported_21", "adv_qunit_21", "adv_usd_21")],
        *[rnd(c, 12).alias(c) for c in ("amihud_qunit_21", "amihud_usd_21")], "max_gap_days_21",
    )


@query("f7_month_stats", """
SELECT sec_id, last_day(d) AS m, count(*) AS month_rows, count(prccd) AS month_close_rows, count(cshtrd) AS month_volume_rows,
       count(total_ret) AS month_return_rows, min(d) AS month_first_date, sum(cshtrd) AS month_volume,
       min(curcdd) AS month_min_currency, max(curcdd) AS month_max_currency
FROM vendor_ret GROUP BY 1, 2""")
def f7(t):
    return daily.month_stats(
        vendor_returns(t), keys=["sec_id"], date="d", close="prccd", volume="cshtrd", ret="total_ret", currency="curcdd"
    )


@query("f8_month_endpoint", f"SELECT sec_id, m, d AS endpoint_date, prcstd, curcdd, {R('prccd', 6)} AS prccd FROM vendor_month")
def f8(t):
    px = daily.trading_days(t.vendor_daily)
    return daily.month_endpoint(px, keys=["sec_id"], date="d").select(
        "sec_id", "m", F.col("d").alias("endpoint_date"), "prcstd", "curcdd", rnd("prccd", 6).alias("prccd")
    )


@query("f9_requested_months", """
SELECT q.sec_id, q.m, v.d AS endpoint_date, v.d IS NOT NULL AS endpoint_present
FROM (SELECT DISTINCT sec_id, last_day(d + INTERVAL 31 DAY) AS m FROM daily_px) q
LEFT JOIN vendor_month v ON q.sec_id = v.sec_id AND q.m = v.m""")
def f9(t):
    requested = t.daily_px.select("sec_id", F.last_day(F.date_add("d", 31)).alias("m")).distinct()
    ends = daily.month_endpoint(daily.trading_days(t.vendor_daily), keys=["sec_id"], date="d").select("sec_id", "m", F.col("d").alias("endpoint_date"))
    return daily.attach_requested(requested, ends, keys=["sec_id", "m"], present="endpoint_date")


view("segments", """
  SELECT *, sum(brk) OVER (PARTITION BY sec_id ORDER BY d ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (
    SELECT *, CASE WHEN curcdd IS DISTINCT FROM lag(curcdd) OVER w THEN 1 ELSE 0 END AS brk
    FROM vendor_daily WHERE prcstd IN (3, 4, 10) WINDOW w AS (PARTITION BY sec_id ORDER BY d))""")


@query("f10_currency_segments", """
SELECT sec_id, segment, min(curcdd) AS curcdd, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM segments GROUP BY 1, 2""")
def f10(t):
    seg = daily.currency_segments(daily.trading_days(t.vendor_daily), keys=["sec_id"], date="d", currency="curcdd")
    return seg.groupBy("sec_id", "segment").agg(
        F.min("curcdd").alias("curcdd"), F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d")
    )


view("ar_daily", """
  SELECT *, CASE WHEN pair_obs >= 2 THEN 2 * sqrt(greatest(mean_gamma, 0.0)) END AS ar_any,
         CASE WHEN pair_obs = 20 THEN 2 * sqrt(greatest(mean_gamma, 0.0)) END AS ar_strict
  FROM (SELECT *, count(g) OVER w AS pair_obs, avg(g) OVER w AS mean_gamma FROM (
          SELECT *, (lag(c) OVER w - lag(eta) OVER w) * (lag(c) OVER w - eta) AS g
          FROM (SELECT *, ln(prccd) AS c, (ln(prchd) + ln(prcld)) / 2 AS eta FROM segments WHERE prccd > 0 AND prchd > 0 AND prcld > 0)
          WINDOW w AS (PARTITION BY sec_id, segment ORDER BY d))
        WINDOW w AS (PARTITION BY sec_id, segment ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")


@shared
def ar_daily(t):
    return daily.abdi_ranaldo(
        daily.trading_days(t.vendor_daily), keys=["sec_id"], date="d", currency="curcdd", close="prccd", high="prchd", low="prcld"
    )


@query("f11_abdi_ranaldo_spread", f"""
SELECT sec_id, d, segment, pair_obs, CASE WHEN ar_any < 1e-6 THEN 0.0 ELSE {R('ar_any', 7)} END AS ar_any,
       CASE WHEN ar_strict < 1e-6 THEN 0.0 ELSE {R('ar_strict', 7)} END AS ar_strict
FROM ar_daily""")
def f11(t):
    # a mean of exact zeros may sum to a rounding residue whose square root is visible
    flat = lambda c: F.when(F.col(c) < 1e-6, 0.0).otherwise(rnd(c, 7))
    return ar_daily(t).select("sec_id", "d", "segment", "pair_obs", flat("ar_any").alias("ar_any"), flat("ar_strict").alias("ar_strict"))


@shared
def edge_daily(t):
    return daily.edge_spread(
        daily.trading_days(t.vendor_daily), keys=["sec_id"], date="d", currency="curcdd",
        open="prcod", high="prchd", low="prcld", close="prccd",
    )


@query("f12_edge_spread")
def f12(t):
    return daily.month_endpoint(edge_daily(t), keys=["sec_id"], date="d").select(
        "country", "sec_id", "m", F.col("rows_n").alias("trading_rows"), F.col("complete_n").alias("complete_rows"),
        rnd("edge_any", 7).alias("edge_any"), rnd("edge_strict", 7).alias("edge_strict"),
    )


@query("f13_strict_gate", f"""
SELECT sec_id, m, {R('CASE WHEN return_obs_21 = 21 THEN sigma_total_21 END')} AS sigma_total_21,
       {R('CASE WHEN volume_obs_21 = 21 THEN adv_qunit_21 END', 3)} AS adv_qunit_21
FROM vendor_month""")
def f13(t):
    gated = daily.strict_gate(vendor_monthly(t), {"sigma_total_21": "return_obs_21", "adv_qunit_21": "volume_obs_21"})
    return gated.select("sec_id", "m", rnd("sigma_total_21").alias("sigma_total_21"), rnd("adv_qunit_21", 3).alias("adv_qunit_21"))


@query("f14_exact_date_fx", f"""
SELECT v.sec_id, v.m, {R('x.usd_per_local')} AS usd_per_local, {R('adv_qunit_21 * x.usd_per_local', 3)} AS adv_qunit_21_usd,
       {R('amihud_qunit_21 / x.usd_per_local', 12)} AS amihud_qunit_21_usd
FROM vendor_month v LEFT JOIN fx_rates x ON v.d = x.d AND v.curcdd = x.cur""")
def f14(t):
    ends = vendor_monthly(t).drop("usd_per_local")
    out = daily.attach_fx_exact(ends, t.fx_rates, date="d", currency="curcdd", multiply=["adv_qunit_21"], divide=["amihud_qunit_21"])
    return out.select(
        "sec_id", "m", rnd("usd_per_local").alias("usd_per_local"), rnd("adv_qunit_21_usd", 3).alias("adv_qunit_21_usd"),
        rnd("amihud_qunit_21_usd", 12).alias("amihud_qunit_21_usd"),
    )


@query("f15_spread_hierarchy", f"""
SELECT sec_id, d, CASE WHEN coalesce(hl21, ar_strict) < 1e-6 THEN 0.0 ELSE {R('coalesce(hl21, ar_strict)', 7)} END AS spread,
       CASE WHEN hl21 IS NOT NULL THEN 'RANGE_21' WHEN ar_strict IS NOT NULL THEN 'ABDI_RANALDO_21_STRICT' ELSE 'MISSING' END AS spread_source,
       CAST(NULL AS DOUBLE) AS borrow_fee
FROM (SELECT a.sec_id, a.d, a.ar_strict, CASE WHEN v.return_obs_21 = 21 THEN v.hl_range_21 END AS hl21
      FROM ar_daily a JOIN vendor_roll v ON a.sec_id = v.sec_id AND a.d = v.d)""")
def f15(t):
    # the better estimate is present only on complete windows, so both sources and the missing label occur
    better = vendor_rolled(t).select("sec_id", "d", F.when(F.col("return_obs_21") == 21, F.col("hl_range_21")).alias("hl21"))
    both = ar_daily(t).select("sec_id", "d", "ar_strict").join(better, ["sec_id", "d"])
    out = daily.coalesce_sources(both, {"hl21": "RANGE_21", "ar_strict": "ABDI_RANALDO_21_STRICT"}, out="spread", label="spread_source")
    return out.select(
        "sec_id", "d", F.when(F.col("spread") < 1e-6, 0.0).otherwise(rnd("spread", 7)).alias("spread"), "spread_source",
        F.lit(None).cast("double").alias("borrow_fee"),
    )


@query("f16_prior_month_members", """
SELECT sec_id, m, last_day(m + INTERVAL 1 MONTH) AS active_month FROM panel WHERE in_universe""")
def f16(t):
    return daily.prior_month_members(t.monthly_px.filter("n_days >= 5").select("sec_id", "m"))


view("members", "SELECT country, sec_id, last_day(m + INTERVAL 1 MONTH) AS active_month FROM monthly_px WHERE n_days >= 5")
view("mkt_daily", """
  SELECT s.country, d, rw / w AS mkt_ret, w AS prior_cap, s.n AS constituents, e.n AS expected, s.n / e.n AS participation
  FROM (SELECT r.country, r.active_month, d, sum(r * w) AS rw, sum(w) AS w, count(*) AS n FROM (
          SELECT country, sec_id, d, last_day(d) AS active_month,
                 CASE WHEN cur = lag(cur) OVER x THEN cl / lag(cl) OVER x - 1 END AS r,
                 CASE WHEN cur = lag(cur) OVER x THEN lag(notional) OVER x END AS w
          FROM daily_px WINDOW x AS (PARTITION BY sec_id ORDER BY d)) r
        JOIN members m ON r.sec_id = m.sec_id AND r.active_month = m.active_month
        WHERE r IS NOT NULL AND w > 0 GROUP BY 1, 2, 3) s
  JOIN (SELECT country, active_month, count(*) AS n FROM members GROUP BY 1, 2) e
    ON s.country = e.country AND s.active_month = e.active_month
  WHERE s.n / e.n >= 0.1""")


@shared
def market_daily(t):
    members = daily.prior_month_members(t.monthly_px.filter("n_days >= 5").select("country", "sec_id", "m"))
    return daily.cap_weighted_return(
        t.daily_px, members, id="sec_id", country="country", date="d", currency="cur", index="cl", cap="notional", min_share=0.1
    )


@query("f17_cap_weighted_market", f"""
SELECT country, d, {R('mkt_ret')} AS mkt_ret, {R('prior_cap', 2)} AS prior_cap, constituents, expected, {R('participation')} AS participation
FROM mkt_daily""")
def f17(t):
    return market_daily(t).select(
        "country", "d", rnd("mkt_ret").alias("mkt_ret"), rnd("prior_cap", 2).alias("prior_cap"), "constituents", "expected",
        rnd("participation").alias("participation"),
    )


view("vol_month", """
  SELECT country, last_day(d) AS m, obs, CASE WHEN obs = 21 AND sd > 0 THEN ln(sd) END AS vol_raw
  FROM (SELECT *, count(mkt_ret) OVER w AS obs, stddev_samp(mkt_ret) OVER w AS sd FROM mkt_daily
        WINDOW w AS (PARTITION BY country ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
  QUALIFY row_number() OVER (PARTITION BY country, last_day(d) ORDER BY d DESC) = 1""")
view("illiq_month", """
  SELECT country, m, count(*) AS names, count(v) AS valid_names, sum(CASE WHEN v IS NOT NULL THEN cap END) / sum(cap) AS cover,
         CASE WHEN sum(CASE WHEN v IS NOT NULL THEN cap END) / sum(cap) >= 0.5
              THEN sum(CASE WHEN v IS NOT NULL THEN v * cap END) / sum(CASE WHEN v IS NOT NULL THEN cap END) END AS illiq_vw
  FROM (SELECT country, m, CASE WHEN return_obs_21 >= 15 AND volume_obs_21 >= 15 THEN amihud_qunit_21 * 1e6 END AS v,
               CASE WHEN notional_qunit > 0 THEN notional_qunit END AS cap FROM vendor_month)
  GROUP BY 1, 2""")


@shared
def vol_month(t):
    return daily.vol_state(market_daily(t), country="country", date="d", ret="mkt_ret")


@shared
def illiq_month(t):
    ends = vendor_monthly(t).withColumn("illiq", F.col("amihud_qunit_21") * 1e6)
    return daily.illiq_state(
        ends, country="country", month="m", value="illiq", cap="notional_qunit", obs=["return_obs_21", "volume_obs_21"]
    )


@query("f18_market_volatility_state", f"SELECT country, m, obs, {R('vol_raw')} AS vol_raw FROM vol_month")
def f18(t):
    return vol_month(t).select("country", "m", "obs", rnd("vol_raw").alias("vol_raw"))


@query("f19_cap_weighted_illiquidity", f"SELECT country, m, names, valid_names, {R('cover')} AS cover, {R('illiq_vw')} AS illiq_vw FROM illiq_month")
def f19(t):
    return illiq_month(t).select("country", "m", "names", "valid_names", rnd("cover").alias("cover"), rnd("illiq_vw").alias("illiq_vw"))


view("illiq_dev", """
  SELECT country, m, ln(CASE WHEN illiq_vw > 0 THEN illiq_vw END) - ln(CASE WHEN count(illiq_vw) OVER w >= 9 AND avg(illiq_vw) OVER w > 0
         THEN avg(illiq_vw) OVER w END) AS log_dev
  FROM illiq_month WINDOW w AS (PARTITION BY country ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")


@query("f20_log_deviation", f"SELECT country, m, {R('log_dev')} AS log_dev FROM illiq_dev")
def f20(t):
    return daily.log_deviation(illiq_month(t), keys=["country"], date="m", value="illiq_vw").select("country", "m", rnd("log_dev").alias("log_dev"))


view("month_grid", """
  SELECT c.country, last_day(s.s) AS m FROM (SELECT DISTINCT country FROM vol_month) c,
  (SELECT unnest(generate_series(date_trunc('month', min(m))::TIMESTAMP, date_trunc('month', max(m))::TIMESTAMP, INTERVAL 1 MONTH)) AS s FROM vol_month) s""")


@query("f21_densify", f"""
SELECT g.country, g.m, v.obs, {R('v.vol_raw')} AS vol_raw FROM month_grid g LEFT JOIN vol_month v ON g.country = v.country AND g.m = v.m""")
def f21(t):
    return daily.densify(vol_month(t), keys=["country"], month="m").select("country", "m", "obs", rnd("vol_raw").alias("vol_raw"))


view("vol_z", """
  SELECT *, coalesce(max(CASE WHEN active THEN 1 ELSE 0 END) OVER (PARTITION BY country ORDER BY m) = 1 AND NOT active, FALSE) AS gap,
         least(greatest(coalesce(CASE WHEN active THEN (lagged - mu) / sd END, 0.0), -5.0), 5.0) AS z
  FROM (SELECT *, coalesce(mu IS NOT NULL AND sd > 0 AND lagged IS NOT NULL, FALSE) AS active FROM (
    SELECT *, CASE WHEN count(lagged) OVER w >= 24 THEN avg(lagged) OVER w END AS mu,
              CASE WHEN count(lagged) OVER w >= 24 THEN stddev_samp(lagged) OVER w END AS sd
    FROM (SELECT *, lag(vol_raw) OVER (PARTITION BY country ORDER BY m) AS lagged FROM vol_month)
    WINDOW w AS (PARTITION BY country ORDER BY m ROWS UNBOUNDED PRECEDING)))""")


@query("f22_lagged_expanding_z", f"SELECT country, m, {R('lagged')} AS lagged, active, gap, {R('z')} AS z FROM vol_z")
def f22(t):
    return daily.lagged_expanding_z(vol_month(t), keys=["country"], date="m", value="vol_raw").select(
        "country", "m", rnd("lagged").alias("lagged"), "active", "gap", rnd("z").alias("z")
    )


@query("f23_assemble_states", """
WITH s AS (SELECT coalesce(v.country, i.country) AS country, coalesce(v.m, i.m) AS m, v.z, i.log_dev,
                  CASE WHEN i.log_dev IS NULL THEN NULL WHEN i.log_dev < 0 THEN 1 ELSE 0 END AS bear
           FROM vol_z v FULL JOIN illiq_dev i ON v.country = i.country AND v.m = i.m)
SELECT 'z' AS "column", 'finite' AS rule, count(*) FILTER (z IS NULL) AS n FROM s
UNION ALL SELECT 'log_dev', 'finite', count(*) FILTER (log_dev IS NULL) FROM s
UNION ALL SELECT 'bear', 'binary', count(*) FILTER (bear IS NULL) FROM s""")
def f23(t):
    z = daily.lagged_expanding_z(vol_month(t), keys=["country"], date="m", value="vol_raw").select("country", "m", "z")
    dev = daily.log_deviation(illiq_month(t), keys=["country"], date="m", value="illiq_vw").select("country", "m", "log_dev")
    states = daily.assemble_states([z, dev], keys=["country", "m"]).withColumn("bear", (F.col("log_dev") < 0).cast("int"))
    return daily.state_violations(states, numeric=["z", "log_dev"], binary=["bear"])


view("events_dated", """
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ev, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS known_at,
         o_totalprice AS v, o_orderstatus <> 'F' AS ok FROM orders""")


@shared
def dated_events(t):
    return t.table("orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("ev"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5).cast("int")).alias("known_at"),
        F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") != "F").alias("ok"),
    )


@query("f24_latest_known_at_month_end", f"""
WITH cal AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS m FROM orders),
best AS (SELECT c.m, max(struct_pack(ka := e.known_at, kb := e.ev, kc := e.v)) AS bst FROM cal c JOIN events_dated e ON e.ok AND e.known_at <= c.m GROUP BY 1)
SELECT c.m, {R('b.bst.kc', 2)} AS v, b.bst.kb AS source_event, b.bst.ka AS source_known_at, datediff('day', b.bst.ka, c.m) AS staleness_days,
       CASE WHEN b.bst IS NOT NULL THEN (SELECT count(*) FROM events_dated e WHERE NOT e.ok AND e.known_at <= c.m AND e.known_at > b.bst.ka) END AS later_failed
FROM cal c LEFT JOIN best b ON c.m = b.m""")
def f24(t):
    calendar = t.table("orders").select(F.last_day("o_orderdate").alias("m")).distinct()
    out = asof.latest_known(dated_events(t), calendar, known_at="known_at", event="ev", value="v", ok="ok")
    return out.withColumn("v", rnd("v", 2))


@query("f25_reconcile_vintages", f"""
SELECT ev, CASE WHEN nd <> 1 THEN 'conflicting_dates' WHEN spread > 100000 THEN 'conflicting_values' ELSE 'ok' END AS status,
       CASE WHEN nd = 1 AND coalesce(spread, 0) <= 100000 THEN k END AS known_at,
       CASE WHEN nd = 1 AND coalesce(spread, 0) <= 100000 THEN {R('p.b', 2)} END AS value, p IS NOT NULL AS successful, nsrc AS source_vintages, sources
FROM (SELECT account || '|' || ev AS ev, count(DISTINCT known_at) AS nd, min(known_at) AS k, max(v) - min(v) AS spread,
             min(CASE WHEN v IS NOT NULL THEN struct_pack(a := src, b := v) END) AS p, count(DISTINCT src) AS nsrc,
             array_to_string(list_sort(list_distinct(list(src))), '|') AS sources
      FROM (SELECT o_custkey % 50 AS account, CAST(o_orderdate AS DATE) AS ev, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INTEGER) AS known_at,
                   CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS v, o_orderpriority AS src FROM orders)
      GROUP BY 1)""")
def f25(t):
    o = t.table("orders").select(
        F.concat_ws("|", (F.col("o_custkey") % 50).cast("string"), F.to_date("o_orderdate").cast("string")).alias("ev"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 2).cast("int")).alias("known_at"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("value"), F.col("o_orderpriority").alias("src"),
    )
    return asof.reconcile_vintages(o, key="ev", known_at="known_at", value="value", source="src", tol=100000.0).withColumn("value", rnd("value", 2))


@query("f26_monthly_event_mean", f"""
SELECT last_day(CAST(o_orderdate AS DATE)) AS m, {R('avg(y)', 6)} AS mean_value, count(y) AS n, {R('max(abs(e))', 6)} AS max_error
FROM (SELECT *, (100.0 / p - 1.0) * (365.0::DOUBLE / 91.0) * 100.0 AS y, p - 98.0 AS e
      FROM (SELECT o_orderdate, 96.0 + (o_orderkey % 400) / 100.0::DOUBLE AS p FROM orders)) GROUP BY 1""")
def f26(t):
    o = t.table("orders").select(F.to_date("o_orderdate").alias("d"), (F.lit(96.0) + (F.col("o_orderkey") % 400) / 100.0).alias("p"))
    o = o.select("d", asof.price_implied_yield("p").alias("y"), (F.col("p") - 98.0).alias("e"))
    out = asof.monthly_mean(o, date="d", value="y", error="e")
    return out.select("m", rnd("mean_value", 6).alias("mean_value"), "n", rnd("max_error", 6).alias("max_error"))


@query("f27_statutory_reference_slice", f"""
SELECT sec_id, m AS reference_date, {R('prchd', 6)} AS fmv_price_local, {R('prccd', 6)} AS close_price_local, curcdd AS currency, d AS endpoint_date,
       CASE WHEN prccd IS NULL OR prchd IS NULL THEN 'incomplete' WHEN d > DATE '1998-01-31' THEN 'forward_looking'
            WHEN curcdd <> 'BBB' THEN 'currency' WHEN prchd < prccd THEN 'price_order' END AS violation
FROM vendor_month WHERE m = DATE '1998-01-31'""")
def f27(t):
    ends = daily.month_endpoint(daily.trading_days(t.vendor_daily), keys=["sec_id"], date="d").withColumnRenamed("d", "endpoint_date")
    out = asof.reference_slice(
        ends, date="m", on="1998-01-31", id="sec_id", endpoint="endpoint_date", close="prccd", high="prchd", currency="curcdd",
        expected_currency=F.lit("BBB"),
    )
    return out.withColumn("fmv_price_local", rnd("fmv_price_local", 6)).withColumn("close_price_local", rnd("close_price_local", 6))


view("factor_months", """
  SELECT m, avg(ret) AS mkt, avg(ret * sig_disc) AS disc, avg(ret * sig_size) AS size FROM signals GROUP BY 1""")
view("states", """
  SELECT m, lag(b) OVER w AS BEAR, lag(f1) OVER w AS FMOM_disc, lag(f2) OVER w AS FMOM_size FROM (
    SELECT m, CASE WHEN coalesce(CASE WHEN count(mkt) OVER a >= 6 THEN sum(mkt) OVER a END, 0.0) < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS b,
           coalesce(CASE WHEN count(disc) OVER c >= 6 THEN sum(disc) OVER c END, 0.0) AS f1,
           coalesce(CASE WHEN count(size) OVER c >= 6 THEN sum(size) OVER c END, 0.0) AS f2
    FROM factor_months WINDOW a AS (ORDER BY m ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), c AS (ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
  WINDOW w AS (ORDER BY m)""")


@shared
def factor_months(t):
    return t.signals.groupBy("m").agg(
        F.avg("ret").alias("mkt"), F.avg(F.col("ret") * F.col("sig_disc")).alias("disc"), F.avg(F.col("ret") * F.col("sig_size")).alias("size")
    )


@shared
def states(t):
    return daily.derived_states(factor_months(t), month="m", ret="mkt", factors=["disc", "size"])


@query("f28_state_families", f"SELECT m, BEAR, {R('FMOM_disc')} AS FMOM_disc, {R('FMOM_size')} AS FMOM_size FROM states")
def f28(t):
    return states(t).select("m", "BEAR", rnd("FMOM_disc").alias("FMOM_disc"), rnd("FMOM_size").alias("FMOM_size"))


@query("f28_placebo_states", f"""
WITH r AS (SELECT m, FMOM_disc, row_number() OVER (ORDER BY m) - 1 AS i FROM states),
b AS (SELECT blk, row_number() OVER (ORDER BY ('0x' || substr(md5('1|' || blk), 1, 8))::BIGINT / 4294967296.0, blk) AS t
      FROM (SELECT DISTINCT i // 24 AS blk FROM r)),
p AS (SELECT FMOM_disc, row_number() OVER (ORDER BY t, i) - 1 AS j FROM r JOIN b ON r.i // 24 = b.blk)
SELECT m, {R('p.FMOM_disc')} AS FMOM_disc FROM r JOIN p ON r.i = p.j""")
def f28_placebo(t):
    out = daily.block_permute(states(t), month="m", values=["FMOM_disc"])
    return out.select("m", rnd("FMOM_disc").alias("FMOM_disc"))
