"""Walk-forward models, alpha scaling, uncertainty, risk and interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import rnd
from panelmill.operators import models as md
from panelmill.operators import risk as rk
from panelmill.operators import xsection as xs
from panelmill.operators.xsection import tradeable
from panelmill.plans.book_queries import cost_sql, decile_book, rounded, rsql, scored
from panelmill.plans.daily_queries import states
from panelmill.plans.registry import R, query, shared, view
from panelmill.plans.xsection_queries import SIGNALS, THEMES, spearman_view, themed

ID = {"id": "sec_id", "month": "m"}

view("calendar", """
  SELECT y AS test_year, a AS train_start, last_day(val_start - INTERVAL 2 MONTH) AS train_end, val_start, val_end, make_date(y, 1, 31) AS test_start, make_date(y, 12, 31) AS test_end
  FROM (SELECT *, last_day(val_end - INTERVAL 11 MONTH) AS val_start FROM (SELECT *, last_day(make_date(y, 1, 31) - INTERVAL 2 MONTH) AS val_end FROM (
    SELECT a, CAST(unnest(range(1998, CAST(year(z) AS BIGINT) + 1)) AS INTEGER) AS y FROM (SELECT min(m) AS a, max(m) AS z FROM panel))))""")
view("split_rows", """
  SELECT p.*, test_year, CASE WHEN p.m BETWEEN train_start AND train_end THEN 'train' WHEN p.m BETWEEN val_start AND val_end THEN 'val' WHEN p.m BETWEEN test_start AND test_end THEN 'test' END AS part
  FROM panel p JOIN calendar c ON p.m BETWEEN c.train_start AND c.test_end""")


@shared
def calendar(t):
    return md.walk_forward(t.signals, month="m", first_year=1998)


@shared
def design(t):
    """Signals with a demeaned target; missing signals are filled with the neutral rank."""
    d = xs.demean(t.signals, "ret_next", by=["m"], out="y")
    fill = [F.coalesce(s, F.lit(0.0)).alias(s) for s in SIGNALS]
    return t.stage("design", d.select("sec_id", "m", *fill, (F.col("y") * 0.002).alias("y"), (F.col("ret_next") * 0.002).alias("ret_next")))


@query("m1_walk_forward_calendar", "SELECT * FROM calendar")
def m1(t):
    return md.walk_forward(t.months, month="m", first_year=1998)  # the calendar by itself needs no signals


@query("m2_assign_split", "SELECT test_year, part, count(*) AS n, min(m) AS first_m, max(m) AS last_m FROM split_rows WHERE part IS NOT NULL GROUP BY 1, 2")
def m2(t):
    return md.assign_split(t.signals.select("sec_id", "m"), calendar(t), month="m").groupBy("test_year", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("m").alias("first_m"), F.max("m").alias("last_m")
    )


@query("m3_lockbox_guard", "SELECT count(*) FILTER (m >= DATE '2001-01-31') AS n, min(m) FILTER (m >= DATE '2001-01-31') AS first_month FROM panel")
def m3(t):
    return md.lockbox_violations(t.monthly_px, month="m", start="2001-01-31")


spearman_view("ic_all", "scored", ["cell", "m"], "score", "ret_next", 1)


@query("m4_mean_rank_ic", f"""
SELECT cell, {R('avg(ic)')} AS ic, count(ic) AS months, {R('CASE WHEN abs(least(greatest(avg(ic), -0.1), 0.1)) < 0.005 THEN CASE WHEN avg(ic) < 0 THEN -0.005 ELSE 0.005 END ELSE least(greatest(avg(ic), -0.1), 0.1) END')} AS ic_used
FROM ic_all GROUP BY 1""")
def m4(t):
    out = md.rank_ic(scored(t), by=["cell"], month="m", score="score", target="ret_next", bounds=(-0.1, 0.1), floor=0.005)
    return rounded(out, ["cell", "months"], ["ic", "ic_used"])


def z_sql(s):
    return f"coalesce(CASE WHEN stddev_samp({s}) OVER p > 1e-12 THEN ({s} - avg({s}) OVER p) / stddev_samp({s}) OVER p WHEN {s} IS NOT NULL THEN 0 END, 0.0) AS z_{s}"


view("z_signals", f"SELECT sec_id, m, ret_next, {', '.join(z_sql(s) for s in SIGNALS)} FROM signals WINDOW p AS (PARTITION BY m)")


@query("m5_equal_and_theme_scores", f"""
SELECT sec_id, m, {R('(' + ' + '.join(f'z_{s}' for s in SIGNALS) + ') / 5')} AS score_equal, {R('((z_sig_disc + z_sig_tax) / 2 + (z_sig_vol + z_sig_size) / 2 + z_sig_mom) / 3')} AS score_theme FROM z_signals""")
def m5(t):
    s = t.signals.select("sec_id", "m", *SIGNALS)
    eq = md.score_equal(s, SIGNALS, month="m").select("sec_id", "m", rnd("score").alias("score_equal"))
    th = md.score_theme(s, THEMES, month="m").select("sec_id", "m", rnd("score").alias("score_theme"))
    return eq.join(th, ["sec_id", "m"])


spearman_view("ic_sig", "long_signals", ["signal", "m"], "value", "ret_next", 1)


@query("m6_ic_weighted_score", f"""
WITH w0 AS (SELECT test_year, signal, greatest(coalesce(avg(ic), 0.0), 0.0) AS ic FROM ic_sig i JOIN calendar c ON i.m BETWEEN c.train_start AND c.train_end GROUP BY 1, 2),
w AS (SELECT test_year, signal, CASE WHEN sum(ic) OVER q > 0 THEN ic / sum(ic) OVER q ELSE 1.0 / count(*) OVER q END AS w FROM w0 WINDOW q AS (PARTITION BY test_year)),
z AS (UNPIVOT (SELECT sec_id, m, {', '.join(f'z_{s} AS {s}' for s in SIGNALS)} FROM z_signals) ON {', '.join(SIGNALS)} INTO NAME signal VALUE z)
SELECT sec_id, m, test_year, {R('sum(z * w)')} AS score FROM z JOIN w ON z.signal = w.signal AND year(z.m) = w.test_year GROUP BY 1, 2, 3""")
def m6(t):
    out = md.score_ic(t.signals.select("sec_id", "m", "ret_next", *SIGNALS), SIGNALS, calendar(t), **ID, target="ret_next")
    return rounded(out, ["sec_id", "m", "test_year"], ["score"])


@query("m7_pooled_least_squares")
def m7(t):
    return rounded(md.score_ols(design(t), SIGNALS, calendar(t), **ID, target="y"), ["sec_id", "m", "test_year"], ["score"])


@query("m8_ridge_by_validation_ic")
def m8(t):
    out = md.score_ridge(design(t), SIGNALS, calendar(t), **ID, target="y", penalties=[0.1, 1.0, 10.0, 100.0])
    return rounded(out, ["sec_id", "m", "test_year", "penalty"], ["score"])


@query("m9_ridge_bootstrap_members")
def m9(t):
    return rounded(md.score_ridge_ensemble(design(t), SIGNALS, calendar(t), **ID, target="y"), ["sec_id", "m", "test_year"], ["score", "unc_sd"])


@query("m10_boosted_trees")
def m10(t):
    return rounded(md.score_gbt(design(t), SIGNALS, calendar(t), **ID, target="y"), ["sec_id", "m", "test_year"], ["score"])


@query("m11_random_features_ridge")
def m11(t):
    out = md.score_rff(design(t), SIGNALS, calendar(t), **ID, target="y", n_features=24)
    return rounded(out, ["sec_id", "m", "test_year"], ["complexity", "score"])


@query("m11_random_features_sparse")
def m11_l1(t):
    out = md.score_rff(design(t), SIGNALS, calendar(t), **ID, target="y", n_features=24, penalty="l1", alpha=1e-5)
    return rounded(out, ["sec_id", "m", "test_year"], ["complexity", "score"])


@query("m12_spectrum_diagnostic")
def m12(t):
    return rounded(md.spectrum(design(t), SIGNALS), ["n_obs"], ["top1_share", "top5_share", "top10_share", "effective_rank"])


@query("m13_select_trials", f"""
SELECT split, min_by(params, struct_pack(a := -metric, b := params)) AS params, {R('max(metric)')} AS metric, count(*) AS n_trials
FROM (SELECT event_type AS split, props AS params, round(avg(value), 8) AS metric FROM events GROUP BY 1, 2) GROUP BY 1""")
def m13(t):
    trials = t.table("events").groupBy(F.col("event_type").alias("split"), F.col("props").alias("params")).agg(F.round(F.avg("value"), 8).alias("metric"))
    out = md.select_trials(trials, by=["split"], params="params", metric="metric")
    return out.select("split", "params", rnd("metric").alias("metric"), "n_trials")


view("cell_ic", "SELECT cell, CASE WHEN abs(least(greatest(avg(ic), -0.1), 0.1)) < 0.005 THEN CASE WHEN avg(ic) < 0 THEN -0.005 ELSE 0.005 END ELSE least(greatest(avg(ic), -0.1), 0.1) END AS ic_used FROM ic_all GROUP BY 1")
view("alphas", """
  SELECT cell, sec_id, m, score, sigma_d, spread, adv_usd, ret_next, alpha, alpha / (1 + 2 * pow(coalesce(spread / avg(spread) OVER (PARTITION BY cell, m), 1.0), 2)) AS alpha_shrunk FROM (
    SELECT s.*, ic_used * sigma_d * least(greatest(CASE WHEN stddev_pop(score) OVER p > 1e-12 THEN (score - avg(score) OVER p) / stddev_pop(score) OVER p ELSE 0 END, -4.0), 4.0) AS alpha
    FROM scored s JOIN cell_ic c ON s.cell = c.cell WINDOW p AS (PARTITION BY s.cell, m))""")


@shared
def alphas(t):
    ics = md.rank_ic(scored(t), by=["cell"], month="m", score="score", target="ret_next", bounds=(-0.1, 0.1), floor=0.005)
    s = scored(t).join(t.stage("cell_ics", ics.select("cell", "ic_used")), "cell")
    a = md.scale_alpha(s, by=["cell", "m"], score="score", vol="sigma_d", ic=F.col("ic_used")).drop("ic_used")
    a = md.shrink(a, by=["cell", "m"], alpha="alpha", unc="spread", kappa=2.0)
    return t.stage("alphas", a.select("cell", "sec_id", "m", "ret_next", "spread", "sigma_d", "adv_usd", "alpha", "alpha_shrunk"))


@query("m14_volatility_scaled_alpha", f"SELECT cell, sec_id, m, {R('alpha', 8)} AS alpha FROM alphas")
def m14(t):
    return rounded(alphas(t), ["cell", "sec_id", "m"], ["alpha"], 8)


@query("m15_uncertainty_shrinkage", f"SELECT cell, sec_id, m, {R('alpha_shrunk', 8)} AS alpha_shrunk FROM alphas")
def m15(t):
    return rounded(alphas(t), ["cell", "sec_id", "m"], ["alpha_shrunk"], 8)


def proxy_sql(source: str, keys: str, alpha: str) -> str:
    return f"""SELECT * EXCLUDE (w0, ls, ss), coalesce(CASE WHEN least(ls, ss) > 0 THEN w0 * least(ls, ss) / CASE WHEN w0 > 0 THEN ls ELSE ss END * CASE WHEN 2 * least(ls, ss) > 2 THEN 1 / least(ls, ss) ELSE 1 END END, 0.0) AS w FROM (
      SELECT *, sum(greatest(w0, 0.0)) OVER (PARTITION BY {keys}) AS ls, sum(greatest(-w0, 0.0)) OVER (PARTITION BY {keys}) AS ss FROM (
      SELECT * EXCLUDE (a1), CASE WHEN sum(abs(a1)) OVER (PARTITION BY {keys}) >= 1e-12 THEN least(greatest(2 * a1 / sum(abs(a1)) OVER (PARTITION BY {keys}), -0.05::DOUBLE), 0.05::DOUBLE) ELSE 0.0 END AS w0 FROM (
      SELECT * EXCLUDE (a0), a0 - avg(a0) OVER (PARTITION BY {keys}) AS a1 FROM (SELECT *, coalesce({alpha}, 0.0) / greatest(sigma_d * sigma_d, 1e-8) AS a0 FROM {source}))))"""


@query("m16_proxy_book", f"SELECT cell, sec_id, m, {R('w')} AS w FROM ({proxy_sql('alphas', 'cell, m', 'alpha_shrunk')})")
def m16(t):
    return rounded(md.proxy_book(alphas(t), by=["cell", "m"], alpha="alpha_shrunk", vol="sigma_d", cap=0.05), ["cell", "sec_id", "m"], ["w"])


_KAPPA = "(SELECT cell, sec_id, m, sigma_d, spread, adv_usd, ret_next, kappa, alpha / (1 + kappa * pow(coalesce(spread / avg(spread) OVER (PARTITION BY cell, m, kappa), 1.0), 2)) AS s FROM alphas, (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (4.0::DOUBLE)) k(kappa))"


@query("m17_kappa_selection", f"""
WITH b AS ({proxy_sql(_KAPPA, 'cell, m, kappa', 's')}), i AS (SELECT cell, m, row_number() OVER (PARTITION BY cell ORDER BY m) AS i FROM (SELECT DISTINCT cell, m FROM b)), x AS (SELECT b.*, i FROM b JOIN i ON b.m = i.m AND b.cell = i.cell),
n AS (SELECT c.cell, c.kappa, sum(c.w * coalesce(c.ret_next, 0.0) - ({cost_sql('c.w - coalesce(p.w, 0.0)', 'c.', '1e5::DOUBLE')}) - greatest(-c.w, 0.0) * 0.03::DOUBLE / 12) AS total
      FROM x c LEFT JOIN x p ON c.cell = p.cell AND c.kappa = p.kappa AND c.sec_id = p.sec_id AND c.i = p.i + 1 GROUP BY 1, 2)
SELECT cell, kappa, {R('total', 5)} AS total, kappa = first_value(kappa) OVER (PARTITION BY cell ORDER BY total DESC, kappa) AS best FROM n""")
def m17(t):
    out = md.select_kappa(alphas(t), [0.0, 1.0, 4.0], by=["cell"], **ID, alpha="alpha", unc="spread", vol="sigma_d", aum=1e5, borrow=0.03, cap=0.05)
    return out.select("cell", "kappa", rnd("total", 5).alias("total"), "best")


view("predictions", "SELECT cell AS model, sec_id, m, score * 0.01::DOUBLE AS score, ret_next AS y, spread FROM scored")
view("widths", """
  WITH o AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM (SELECT DISTINCT m FROM predictions)),
  r AS (SELECT p.*, o.i, abs(y - score) AS e FROM predictions p JOIN o ON p.m = o.m WHERE y IS NOT NULL),
  k AS (SELECT r.model, t.m, r.e, row_number() OVER (PARTITION BY r.model, t.m ORDER BY r.e) AS rn, count(*) OVER (PARTITION BY r.model, t.m) AS n FROM o t JOIN r ON r.i BETWEEN t.i - 24 AND t.i - 1)
  SELECT model, m, n, e AS half_width FROM k WHERE n >= 100 AND rn = least(ceil((n + 1) * (1.0 - 0.1)), n)""")


@shared
def predictions(t):
    return t.stage("predictions", scored(t).select(F.col("cell").alias("model"), "sec_id", "m", (F.col("score") * 0.01).alias("score"), F.col("ret_next").alias("y"), "spread"))


@shared
def widths(t):
    return t.stage("widths", md.conformal(predictions(t), by=["model"], id="sec_id", month="m", score="score", truth="y"))


@query("m18_split_conformal", f"SELECT model, m, n, {R('half_width')} AS half_width, {R('half_width / 1.645')} AS unc_sd FROM widths")
def m18(t):
    return rounded(widths(t), ["model", "m", "n"], ["half_width", "unc_sd"])


@query("m18_security_bounds", f"""
SELECT p.model, p.sec_id, p.m, {R('score - half_width')} AS lower, {R('score + half_width')} AS upper, y >= score - half_width AND y <= score + half_width AS inside
FROM predictions p JOIN widths w ON p.model = w.model AND p.m = w.m""")
def m18_bounds(t):
    out = md.conformal_bounds(predictions(t), widths(t), by=["model"], month="m", score="score", truth="y")
    return rounded(out, ["model", "sec_id", "m", "inside"], ["lower", "upper"])


@query("m19_adaptive_conformal", f"""
WITH RECURSIVE x AS (SELECT p.model, p.m, abs(y - score) / half_width AS x FROM predictions p JOIN widths w ON p.model = w.model AND p.m = w.m WHERE y IS NOT NULL),
o AS (SELECT model, m, row_number() OVER (PARTITION BY model ORDER BY m) AS i, list(x) AS xs FROM x GROUP BY 1, 2),
s AS (SELECT model, 1::BIGINT AS i, 1.0::DOUBLE AS scale FROM (SELECT DISTINCT model FROM o)
  UNION ALL SELECT s.model, s.i + 1, least(greatest(s.scale * exp(0.05::DOUBLE * (0.9::DOUBLE - len(list_filter(o.xs, lambda v: v <= s.scale)) / len(o.xs))), 0.25), 4.0)::DOUBLE FROM s JOIN o ON o.model = s.model AND o.i = s.i)
SELECT o.model, o.m, len(o.xs)::BIGINT AS n, {R('scale')} AS scale, {R('len(list_filter(o.xs, lambda v: v <= scale)) / len(o.xs)')} AS coverage FROM s JOIN o ON o.model = s.model AND o.i = s.i""")
def m19(t):
    out = md.conformal_adaptive(predictions(t), widths(t), by=["model"], month="m", score="score", truth="y")
    return rounded(out, ["model", "m", "n"], ["scale", "coverage"])


@query("m20_blended_width", f"""
SELECT p.model, p.sec_id, p.m, {R('half_width / 1.645 * coalesce(CASE WHEN mu > 0 THEN spread / mu ELSE 1.0 END, 1.0)')} AS unc_sd
FROM (SELECT p.*, w.half_width, avg(spread) OVER (PARTITION BY p.model, p.m) AS mu FROM predictions p JOIN widths w ON p.model = w.model AND p.m = w.m) p""")
def m20(t):
    j = predictions(t).join(widths(t).select("model", "m", F.col("unc_sd").alias("width")), ["model", "m"])
    return rounded(md.blend_width(j, by=["model", "m"], width="width", dispersion="spread"), ["model", "sec_id", "m"], ["unc_sd"])


@query("m21_seed_dispersion", f"""
SELECT substr(cell, 1, 3) AS grp, count(*) AS seeds, {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS sd, {R('min(v)')} AS lo, {R('max(v)')} AS hi, {R('avg(0.01)')} AS ref, {R('(avg(v) - 0.01) / stddev_samp(v)', 5)} AS gap_over_sd
FROM (SELECT cell, avg(r) * 12 AS v FROM cell_returns GROUP BY 1) GROUP BY 1""")
def m21(t):
    v = t.cell_returns.groupBy("cell").agg((F.avg("r") * 12).alias("v")).withColumn("ref_", F.lit(0.01)).withColumn("grp", F.substring("cell", 1, 3))
    out = md.dispersion(v, by=["grp"], metric="v", reference="ref_")
    return out.select("grp", "seeds", *[rnd(c).alias(c) for c in ("mean", "sd", "lo", "hi", "ref")], rnd("gap_over_sd", 5).alias("gap_over_sd"))


@query("m22_plan_audit", """
WITH tr AS (SELECT event_type AS strategy, props AS params, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL),
pl AS (SELECT DISTINCT event_type AS strategy, CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR) AS k FROM events)
SELECT t.strategy, count(*) AS trials, count(p.k) AS inside, count(*) - count(p.k) AS outside, count(DISTINCT params) AS distinct_configs, max(r.n) AS registered, greatest(max(r.n), count(DISTINCT params)) AS n_deflate
FROM tr t LEFT JOIN pl p ON t.strategy = p.strategy AND t.k = p.k JOIN (SELECT strategy, count(*) AS n FROM pl GROUP BY 1) r ON t.strategy = r.strategy GROUP BY 1""")
def m22(t):
    e = t.table("events")
    trials = e.filter("props IS NOT NULL").select(F.col("event_type").alias("strategy"), F.col("props").alias("params"))
    plan = e.select(F.col("event_type").alias("strategy"), (F.floor("value") % 60).cast("string").alias("k"))
    return md.plan_audit(trials, plan, by=["strategy"], params="params", keys=["k"])


@query("m23_trial_counts", """
SELECT o_orderpriority AS exhibit, count(DISTINCT l_orderkey) AS runs, count(*) AS trials, count(DISTINCT l_partkey) AS configs FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def m23(t):
    exhibit = t.table("orders").select(F.col("o_orderpriority").alias("exhibit"), F.col("o_orderkey").alias("run"))
    trials = t.table("lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("params"))
    return md.trial_counts(exhibit, trials, exhibit_key="exhibit", run="run", params="params")


@query("m24_signal_persistence", f"""
SELECT signal, {R('least(greatest(avg(ac), 0.0), 0.99)')} AS persistence, count(ac) AS names FROM (
  SELECT signal, sec_id, CASE WHEN stddev_pop(value) < 1e-12 OR stddev_pop(p) < 1e-12 THEN NULL ELSE corr(value, p) END AS ac FROM (
    SELECT *, lag(value) OVER (PARTITION BY signal, sec_id ORDER BY m) AS p FROM long_signals) WHERE p IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 12) GROUP BY 1""")
def m24(t):
    out = md.persistence(t.signals, SIGNALS, **ID)
    return rounded(out, ["signal", "names"], ["persistence"])


@query("m25_inflation_gap")
def m25(t):
    trials = t.cell_returns.groupBy("cell").agg((F.avg("r") / F.stddev_samp("r") * 12**0.5).alias("sharpe")).withColumn("arm", F.substring("cell", 5, 1))
    return rounded(md.inflation_gap(trials, by=["arm"], sharpe="sharpe", months=83), ["arm", "n_trials"], ["best", "mean", "expected_best", "gap"])


view("mkt_month", "SELECT m, sum(ret * greatest(me, 1e-6)) / sum(greatest(me, 1e-6)) AS mkt FROM panel WHERE ret IS NOT NULL GROUP BY 1")


@shared
def returns_panel(t):
    return t.stage("returns_panel", t.panel.select("country", "sec_id", "m", "me", "ret", "ret_next"))


@shared
def market(t):
    return rk.market_return(returns_panel(t), month="m", ret="ret", cap="me")


@query("r1_market_return", f"SELECT m, {R('mkt')} AS mkt FROM mkt_month")
def r1(t):
    return rounded(market(t), ["m"], ["mkt"])


view("betas", """
  WITH o AS (SELECT m, mkt, row_number() OVER (ORDER BY m) AS i, CASE WHEN count(mkt) OVER w >= 24 THEN var_samp(mkt) OVER w END AS v FROM mkt_month WINDOW w AS (ORDER BY m ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)),
  x AS (SELECT p.sec_id, p.m, p.ret, o.mkt, o.i FROM panel p JOIN o ON p.m = o.m),
  c AS (SELECT sec_id, m, i, CASE WHEN count(ret) OVER w >= 24 THEN covar_samp(ret, mkt) OVER w END AS c FROM x WINDOW w AS (PARTITION BY sec_id ORDER BY i RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING))
  SELECT c.sec_id, c.m, CASE WHEN c.c IS NULL OR o.v IS NULL THEN 1.0 ELSE least(greatest(c.c / o.v, -1.5), 3.5) END AS beta FROM c LEFT JOIN o ON c.i = o.i + 1""")


@shared
def betas(t):
    return t.stage("betas", rk.rolling_beta(returns_panel(t), market(t), id="sec_id", month="m", ret="ret"))


@query("r2_rolling_beta", f"SELECT sec_id, m, {R('beta', 5)} AS beta FROM betas")
def r2(t):
    return rounded(betas(t), ["sec_id", "m"], ["beta"], 5)


FACTORS = ["beta", "theme_fee", "theme_size", "theme_trend"]


@shared
def exposures(t):
    fill = [F.coalesce(c, F.lit(0.0)).alias(c) for c in FACTORS[1:]]
    return t.stage("exposures", themed(t).select("sec_id", "m", "me", (F.col("ret_next") * 0.002).alias("r"), *fill).join(betas(t), ["sec_id", "m"]))


@shared
def regression(t):
    f, e = rk.xs_wls(exposures(t), month="m", id="sec_id", y="r", xs=FACTORS, cap="me")
    return t.stage("factor_returns", f), t.stage("residuals", e)


@query("r3_factor_returns")
def r3(t):
    return rounded(regression(t)[0], ["m", "n"], FACTORS)


@query("r3_residuals")
def r3_residuals(t):
    return rounded(regression(t)[1], ["sec_id", "m"], ["resid"])


view("two_factors", "SELECT m, avg(ret * sig_disc) AS f1, avg(ret * sig_size) AS f2 FROM signals WHERE ret IS NOT NULL GROUP BY 1")
view("fcov", """
  WITH p AS (SELECT *, row_number() OVER (ORDER BY m) AS i FROM two_factors), c AS (SELECT a.m AS as_of, pow(0.5, (a.i - p.i) / 36.0::DOUBLE) AS w, p.f1, p.f2 FROM p JOIN p a ON p.i <= a.i),
  mu AS (SELECT as_of, sum(w) AS sw, sum(w * f1) / sum(w) AS m1, sum(w * f2) / sum(w) AS m2 FROM c GROUP BY 1)
  SELECT c.as_of AS m, sum(w * (f1 - m1) * (f1 - m1)) / max(sw) + 1e-6 AS c11, sum(w * (f1 - m1) * (f2 - m2)) / max(sw) AS c12, sum(w * (f2 - m2) * (f2 - m2)) / max(sw) + 1e-6 AS c22 FROM c JOIN mu ON c.as_of = mu.as_of GROUP BY 1""")


@shared
def two_factor_cov(t):
    f = t.signals.filter("ret IS NOT NULL").groupBy("m").agg(F.avg(F.col("ret") * F.col("sig_disc")).alias("f1"), F.avg(F.col("ret") * F.col("sig_size")).alias("f2"))
    return rk.ewma_cov(f, month="m", names=["f1", "f2"], halflife=36.0, ridge=1e-6)


@query("r4_ewma_factor_covariance", f"""
SELECT m, 'f1' AS i, 'f1' AS j, {R('c11')} AS cov FROM fcov UNION ALL SELECT m, 'f1', 'f2', {R('c12')} FROM fcov UNION ALL SELECT m, 'f2', 'f1', {R('c12')} FROM fcov UNION ALL SELECT m, 'f2', 'f2', {R('c22')} FROM fcov""")
def r4(t):
    return rounded(two_factor_cov(t), ["m", "i", "j"], ["cov"])


@shared
def specific(t):
    return t.stage("specific", rk.specific_var(regression(t)[1], exposures(t), id="sec_id", month="m", halflife=24.0, cap="me"))


@shared
def factor_cov(t):
    return t.stage("factor_cov", rk.ewma_cov(regression(t)[0], month="m", names=FACTORS, halflife=36.0))


@query("r5_specific_variance")
def r5(t):
    return rounded(specific(t), ["sec_id", "m"], ["raw", "spec_var"], 8)


@query("r5_total_volatility")
def r5_vol(t):
    return rounded(rk.total_vol(exposures(t), factor_cov(t), specific(t), id="sec_id", month="m", names=FACTORS), ["sec_id", "m"], ["vol"])


@query("r6_book_risk", f"""
SELECT b.cell, b.m, {R('x1')} AS sig_disc, {R('x2')} AS sig_size, {R('x1 * x1 * c11 + 2 * x1 * x2 * c12 + x2 * x2 * c22')} AS factor_var, {R('s', 5)} AS specific, {R('sqrt(x1 * x1 * c11 + 2 * x1 * x2 * c12 + x2 * x2 * c22 + s)', 5)} AS vol
FROM (SELECT b.cell, b.m, sum(w * sig_disc) AS x1, sum(w * sig_size) AS x2, sum(w * w * b.sigma_d * b.sigma_d * 21) AS s FROM book b JOIN signals g ON b.sec_id = g.sec_id AND b.m = g.m GROUP BY 1, 2) b JOIN fcov f ON b.m = f.m""")
def r6(t):
    names = ["sig_disc", "sig_size"]
    cov = two_factor_cov(t).replace({"f1": "sig_disc", "f2": "sig_size"}, subset=["i", "j"])
    b = decile_book(t)
    spec = b.select("sec_id", "m", (F.col("sigma_d") ** 2 * 21).alias("spec_var")).distinct()
    out = rk.book_risk(b, t.signals.select("sec_id", "m", *names), cov, spec, by=["cell"], id="sec_id", month="m", names=names)
    return out.select("cell", "m", *[rnd(c).alias(c) for c in (*names, "factor_var")], rnd("specific", 5).alias("specific"), rnd("vol", 5).alias("vol"))


@query("r7_bias_statistic", f"SELECT cell, {R('sqrt(avg(pow(ret_next / greatest(sigma_d * sqrt(21), 1e-12), 2)))', 5)} AS bias FROM scored WHERE ret_next IS NOT NULL GROUP BY 1")
def r7(t):
    s = scored(t).filter("ret_next IS NOT NULL").withColumn("vol", F.col("sigma_d") * F.sqrt(F.lit(21.0)))
    return rounded(rk.bias_stat(s, by=["cell"], ret="ret_next", vol="vol"), ["cell"], ["bias"], 5)


@shared
def implied(t):
    ex = themed(t).select("sec_id", "m", *[F.coalesce(f"theme_{k}", F.lit(0.0)).alias(f"theme_{k}") for k in THEMES])
    return md.implied_theme_weights(decile_book(t), ex, [f"theme_{k}" for k in THEMES], by=["cell"], id="sec_id", month="m")


@query("b20_implied_theme_weights")
def b20(t):
    return rounded(implied(t), ["cell", "m"], [f"theme_{k}" for k in THEMES])


@query("b21_state_dependence")
def b21(t):
    out = md.state_dependence(implied(t), states(t).dropna(), [f"theme_{k}" for k in THEMES], ["BEAR", "FMOM_disc"], by=["cell"], month="m")
    return rounded(out, ["cell", "theme", "state"], ["coefficient", "t_stat"], 5)


@query("b22_economic_importance")
def b22(t):
    s = t.signals.filter(tradeable()).select(
        "sec_id", "m", *SIGNALS, (F.col("ret_next") * 0.002).alias("ret_next"), "spread", (F.col("sigma_d") * 0.002).alias("sigma_d"), "adv_usd"
    )
    coefs = dict(zip(SIGNALS, (0.01, -0.005, 0.004, 0.02, 0.003)))
    return rounded(md.economic_importance(s, coefs, THEMES, **ID, vol="sigma_d", aum=1e5, borrow=0.03, cap=0.05), ["theme"], ["net_return_without", "net_return_full", "importance"], 5)


@query("b23_statistical_importance", f"""
SELECT CASE signal WHEN 'sig_disc' THEN 'fee' WHEN 'sig_tax' THEN 'fee' WHEN 'sig_vol' THEN 'size' WHEN 'sig_size' THEN 'size' ELSE 'other' END AS theme, {R('sum(abs(c))')} AS importance
FROM (SELECT signal, regr_slope(ret_next, value) AS c FROM long_signals WHERE ret_next IS NOT NULL GROUP BY 1) GROUP BY 1""")
def b23(t):
    long = xs.melt(t.signals, ["sec_id", "m", "ret_next"], SIGNALS).filter("ret_next IS NOT NULL AND value IS NOT NULL")
    coefs = long.groupBy("signal").agg(F.regr_slope("ret_next", "value").alias("c"))
    rows = [(s, k) for k, names in THEMES.items() for s in names if k != "trend"]
    meta = t.spark.createDataFrame(rows, "signal string, theme string")
    return rounded(md.statistical_importance(coefs, meta, feature="signal", value="c", theme="theme"), ["theme"], ["importance"])
