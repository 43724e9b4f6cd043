"""Cross-section and panel transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import month_end, rnd
from panelmill.operators import xsection as xs
from panelmill.plans.daily_queries import states
from panelmill.plans.registry import R, query, shared, view
from panelmill.plans.views import xs_rank_sql

SIGNALS = ["sig_disc", "sig_tax", "sig_vol", "sig_mom", "sig_size"]
THEMES = {"fee": ["sig_disc", "sig_tax"], "size": ["sig_vol", "sig_size"], "trend": ["sig_mom"]}


def row_mean_sql(cols):
    total = " + ".join(f"coalesce({c}, 0.0)" for c in cols)
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols)
    return f"({total}) / nullif({n}, 0)"


view("themes", f"SELECT *, {', '.join(f'{row_mean_sql(s)} AS theme_{k}' for k, s in THEMES.items())} FROM signals")


@shared
def themed(t):
    return xs.theme_composites(t.signals, THEMES)


@query("p1_cross_sectional_rank", f"SELECT sec_id, m, {R(xs_rank_sql('sig_range'))} AS rank_range, {R(xs_rank_sql('ret'))} AS rank_ret FROM panel")
def p1(t):
    src = t.panel.select("sec_id", "m", F.col("sig_range").alias("rank_range"), F.col("ret").alias("rank_ret"))
    out = xs.xs_rank_many(src, ["rank_range", "rank_ret"], by=["m"], id="sec_id")
    return out.select("sec_id", "m", rnd("rank_range").alias("rank_range"), rnd("rank_ret").alias("rank_ret"))


@query("p2_z_population_clipped", f"""
SELECT sec_id, m, {R('CASE WHEN me IS NULL THEN NULL WHEN sd > 1e-12 THEN least(greatest((me - mu) / sd, -1.5), 1.5) ELSE 0 END')} AS z FROM (
  SELECT *, avg(me) OVER (PARTITION BY m) AS mu, stddev_pop(me) OVER (PARTITION BY m) AS sd FROM panel)""")
def p2(t):
    out = xs.xs_z(t.panel.select("sec_id", "m", "me"), "me", by=["m"], out="z", ddof=0, bound=1.5)
    return out.select("sec_id", "m", rnd("z").alias("z"))


@query("p3_z_sample_missing_zero", f"""
SELECT sec_id, m, {R('coalesce(CASE WHEN sd > 1e-12 THEN (ret - mu) / sd ELSE 0 END, 0.0)')} AS z FROM (
  SELECT *, avg(ret) OVER (PARTITION BY m) AS mu, stddev_samp(ret) OVER (PARTITION BY m) AS sd FROM panel)""")
def p3(t):
    out = xs.xs_z(t.panel.select("sec_id", "m", "ret"), "ret", by=["m"], out="z", ddof=1, missing_zero=True)
    return out.select("sec_id", "m", rnd("z").alias("z"))


@query("p4_demeaned_target", f"SELECT sec_id, m, {R('ret_next - avg(ret_next) OVER (PARTITION BY m)')} AS y FROM panel")
def p4(t):
    return xs.demean(t.panel, "ret_next", by=["m"], out="y").select("sec_id", "m", rnd("y").alias("y"))


@query("p5_theme_composites", f"SELECT sec_id, m, {R('theme_fee')} AS theme_fee, {R('theme_size')} AS theme_size, {R('theme_trend')} AS theme_trend FROM themes")
def p5(t):
    return themed(t).select("sec_id", "m", *[rnd(f"theme_{k}").alias(f"theme_{k}") for k in THEMES])


@query("p6_state_interactions", f"""
SELECT t.sec_id, t.m, {R('theme_fee * BEAR')} AS theme_fee_x_BEAR, {R('theme_fee * FMOM_disc')} AS theme_fee_x_FMOM_disc,
       {R('theme_size * BEAR')} AS theme_size_x_BEAR, {R('theme_size * FMOM_disc')} AS theme_size_x_FMOM_disc
FROM themes t LEFT JOIN states s ON t.m = s.m""")
def p6(t):
    out = xs.interactions(themed(t), states(t), on=["m"], themes=["theme_fee", "theme_size"], names=["BEAR", "FMOM_disc"])
    return out.select("sec_id", "m", *[rnd(c).alias(c) for c in out.columns if "_x_" in c])


@query("p7_design_frame", f"""
SELECT t.sec_id, t.m, {R('theme_fee')} AS theme_fee, {R('ret_next - avg(ret_next) OVER (PARTITION BY t.m)')} AS y, {R('c.sigma_d')} AS sigma_d
FROM (SELECT * FROM themes WHERE in_universe) t LEFT JOIN cost_inputs c ON t.sec_id = c.sec_id AND t.m = c.m""")
def p7(t):
    s = themed(t)
    k = ["sec_id", "m"]
    design = xs.build_design(
        s.filter("in_universe").select(*k), s.select(*k, "theme_fee"), s.select(*k, "ret_next"), t.cost_inputs.select(*k, "sigma_d"), keys=k
    )
    out = xs.demean(design, "ret_next", by=["m"], out="y")
    return out.select(*k, rnd("theme_fee").alias("theme_fee"), rnd("y").alias("y"), rnd("sigma_d").alias("sigma_d"))


@query("p8_forward_returns", f"""
SELECT sec_id, m, {R('CASE WHEN lead(mi) OVER w = mi + 1 THEN lead(ret) OVER w END')} AS r_1m,
       {R('CASE WHEN count(ret) OVER a = 3 THEN sum(ret) OVER a END')} AS r_3m, {R('CASE WHEN count(ret) OVER b = 6 THEN sum(ret) OVER b END')} AS r_6m,
       {R('CASE WHEN count(ret) OVER c = 12 THEN sum(ret) OVER c END')} AS r_12m
FROM (SELECT *, year(m) * 12 + month(m) AS mi FROM panel)
WINDOW w AS (PARTITION BY sec_id ORDER BY m), a AS (PARTITION BY sec_id ORDER BY mi RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING),
       b AS (PARTITION BY sec_id ORDER BY mi RANGE BETWEEN 1 FOLLOWING AND 6 FOLLOWING), c AS (PARTITION BY sec_id ORDER BY mi RANGE BETWEEN 1 FOLLOWING AND 12 FOLLOWING)""")
def p8(t):
    out = xs.forward_returns(t.panel.select("sec_id", "m", "ret"), id="sec_id", month="m", ret="ret")
    return out.select("sec_id", "m", *[rnd(c).alias(c) for c in ("r_1m", "r_3m", "r_6m", "r_12m")])


view("capped", """
  SELECT * REPLACE (coalesce(in_universe AND me IS NOT NULL AND rk <= 40, FALSE) AS in_universe) FROM (
    SELECT *, row_number() OVER (PARTITION BY m, in_universe AND me IS NOT NULL ORDER BY me DESC, sec_id) AS rk
    FROM (SELECT * REPLACE (CASE WHEN sec_id % 10 = 3 THEN NULL ELSE me END AS me) FROM panel))""")


@query("p9_breadth_cap", "SELECT sec_id, m, in_universe FROM capped")
def p9(t):
    p = t.panel.withColumn("me", F.when(F.col("sec_id") % 10 == 3, None).otherwise(F.col("me")))
    return xs.breadth_cap(p, 40, month="m", id="sec_id", size="me").select("sec_id", "m", "in_universe")


view("tradeable_rows", "SELECT *, coalesce(spread >= 0 AND sigma_d >= 0 AND adv_usd > 0, FALSE) AS ok FROM panel")


@query("p10_tradeable_mask", "SELECT sec_id, m, ok FROM tradeable_rows")
def p10(t):
    return t.panel.select("sec_id", "m", xs.tradeable().alias("ok"))


view("held", "SELECT sec_id, m, 0.01 AS w FROM monthly_px WHERE n_days >= 6")


@query("p11_split_prior_book", """
SELECT h.sec_id, last_day(h.m + INTERVAL 1 MONTH) AS m, CASE WHEN r.ok IS NULL THEN 'exited' WHEN r.ok THEN 'tradeable' ELSE 'frozen' END AS status
FROM held h LEFT JOIN tradeable_rows r ON r.in_universe AND r.sec_id = h.sec_id AND r.m = last_day(h.m + INTERVAL 1 MONTH)""")
def p11(t):
    prev = t.monthly_px.filter("n_days >= 6").select("sec_id", month_end("m", 1).alias("m"))
    return xs.split_book(prev, t.panel.filter("in_universe"), keys=["sec_id", "m"])


@query("p12_book_cost_inputs", f"""
SELECT h.sec_id, h.m, {R('r.spread')} AS spread, 0.005::DOUBLE AS borrow_fee, 'proxy' AS borrow_source, NOT coalesce(r.ok, FALSE) AS violation
FROM held h LEFT JOIN tradeable_rows r ON r.sec_id = h.sec_id AND r.m = h.m""")
def p12(t):
    book = t.monthly_px.filter("n_days >= 6").select("sec_id", "m")
    out = xs.book_costs(book, t.cost_inputs, keys=["sec_id", "m"], proxy=0.005)
    return out.select("sec_id", "m", rnd("spread").alias("spread"), "borrow_fee", "borrow_source", "violation")


@query("p13_rank_terciles", """
SELECT sec_id, m, CAST(1 + CASE WHEN (r - 1) * 3 > (n - 1) THEN 1 ELSE 0 END + CASE WHEN (r - 1) * 3 > (n - 1) * 2 THEN 1 ELSE 0 END AS INTEGER) AS bin
FROM (SELECT sec_id, m, row_number() OVER (PARTITION BY m ORDER BY adv_usd, sec_id) AS r, count(*) OVER (PARTITION BY m) AS n
      FROM panel WHERE adv_usd IS NOT NULL) WHERE n >= 30""")
def p13(t):
    return xs.rank_bins(t.panel.select("sec_id", "m", "adv_usd"), "adv_usd", by=["m"], id="sec_id", k=3, min_n=30).drop("adv_usd")


@query("p14_size_neutral_residual", f"""
WITH x AS (SELECT sec_id, m, ln(adv_usd) AS y, ln(me) AS x FROM panel WHERE adv_usd > 0 AND me > 0),
c AS (SELECT m, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM x GROUP BY 1)
SELECT sec_id, x.m, {R('y - i - s * x', 7)} AS resid FROM x JOIN c ON x.m = c.m""")
def p14(t):
    p = t.panel.select("sec_id", "m", xs.log_positive("adv_usd").alias("y"), xs.log_positive("me").alias("x"))
    return xs.xs_residual(p, y="y", x="x", by=["m"], out="resid").select("sec_id", "m", rnd("resid", 7).alias("resid"))


def spearman_view(name, source, by, a, b, min_n):
    keys = ", ".join(by)
    view(name, f"""
  SELECT {keys}, count(*) AS n, CASE WHEN min(a) = max(a) OR min(b) = max(b) THEN NULL ELSE corr(ra, rb) END AS ic FROM (
    SELECT {keys}, a, b, rank() OVER (PARTITION BY {keys} ORDER BY a) + (count(*) OVER (PARTITION BY {keys}, a) - 1) / 2.0::DOUBLE AS ra,
           rank() OVER (PARTITION BY {keys} ORDER BY b) + (count(*) OVER (PARTITION BY {keys}, b) - 1) / 2.0::DOUBLE AS rb
    FROM (SELECT {keys}, {a} AS a, {b} AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) GROUP BY {keys} HAVING count(*) >= {min_n}""")


view("long_signals", """
  SELECT m, sec_id, ret_next, signal, value FROM (UNPIVOT (SELECT m, sec_id, ret_next, sig_disc, sig_tax, sig_vol, sig_mom, sig_size FROM signals)
  ON sig_disc, sig_tax, sig_vol, sig_mom, sig_size INTO NAME signal VALUE value)""")
view("long_early", "SELECT * FROM long_signals WHERE m < DATE '1998-01-31'")
spearman_view("ic_early", "long_early", ["m", "signal"], "value", "ret_next", 30)


@query("p15_orient_signals", f"SELECT signal, {R('avg(ic)')} AS mean_ic, CAST(CASE WHEN avg(ic) < 0 THEN -1 ELSE 1 END AS INTEGER) AS sign FROM ic_early GROUP BY 1")
def p15(t):
    out = xs.orient(t.signals, SIGNALS, by="m", target="ret_next", cutoff="1998-01-31")
    return out.select("signal", rnd("mean_ic").alias("mean_ic"), "sign")


@query("p16_signal_coverage", f"""
SELECT year(m) AS year, {R('(' + ' + '.join(f'count({s}) / count(*)' for s in SIGNALS) + ') / 5')} AS coverage FROM signals GROUP BY 1""")
def p16(t):
    return xs.signal_coverage(t.signals, SIGNALS, month="m").select("year", rnd("coverage").alias("coverage"))
