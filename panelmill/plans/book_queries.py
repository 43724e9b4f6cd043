"""Books, costs and capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import rnd
from panelmill.operators import book as bk
from panelmill.operators.xsection import row_mean, tradeable
from panelmill.plans.registry import R, query, shared, view
from panelmill.plans.xsection_queries import SIGNALS, row_mean_sql, spearman_view

AUMS = [1e4, 1e5, 1e6, 1e7]
AUM_ROWS = "(VALUES (1e4::DOUBLE), (1e5::DOUBLE), (1e6::DOUBLE), (1e7::DOUBLE)) AS a(aum)"
KEYS = {"by": ["cell"], "id": "sec_id", "month": "m"}


def cost_sql(dw: str, pre: str, aum: str) -> str:
    ok = f"({pre}adv_usd > 0 AND {pre}spread IS NOT NULL AND {pre}sigma_d IS NOT NULL)"
    return (f"CASE WHEN {ok} THEN 0.5 * {pre}spread * abs({dw}) + 0.0005::DOUBLE * abs({dw}) + {pre}sigma_d * sqrt({aum} / greatest({pre}adv_usd, 1.0)) * pow(abs({dw}), 1.5) ELSE 0.0 END")


def cap_sql(w: str, adv: str, aum: str) -> str:
    return f"sign({w}) * least(abs({w}), coalesce(0.12::DOUBLE * {adv} / {aum}, 0.0))"


view("scored", f"""
  SELECT cell, sec_id, m, score, ret_next * 0.002::DOUBLE AS ret_next, spread, sigma_d * 0.002::DOUBLE AS sigma_d, adv_usd, me FROM (
    SELECT 'EQ' AS cell, sec_id, m, round({row_mean_sql(SIGNALS)}, 10) AS score, ret_next, spread, sigma_d, adv_usd, me FROM signals
    UNION ALL SELECT 'MOM', sec_id, m, sig_mom, ret_next, spread, sigma_d, adv_usd, me FROM signals)
  WHERE score IS NOT NULL AND spread >= 0 AND sigma_d >= 0 AND adv_usd > 0""")
view("ranked_scores", """
  SELECT *, row_number() OVER (PARTITION BY cell, m ORDER BY score, sec_id) AS r, count(*) OVER (PARTITION BY cell, m) AS n FROM scored""")
view("book", """
  SELECT cell, sec_id, m, score, ret_next, spread, sigma_d, adv_usd, me,
         CASE WHEN r <= greatest(n // 10, 1) THEN -1.0 WHEN r > n - greatest(n // 10, 1) THEN 1.0 ELSE 0.0 END::DOUBLE / greatest(n // 10, 1) AS w
  FROM ranked_scores WHERE n >= 20""")
view("vw_book", """
  SELECT * EXCLUDE (w, leg, cap), leg * cap / sum(cap) OVER (PARTITION BY cell, m, leg) AS w FROM (SELECT *, sign(w) AS leg, CASE WHEN me > 0 THEN me ELSE 0.0 END AS cap FROM book)""")
view("book_months", """
  SELECT *, row_number() OVER (PARTITION BY cell ORDER BY m) AS i, lead(m) OVER (PARTITION BY cell ORDER BY m) AS next_m FROM (SELECT DISTINCT cell, m FROM book)""")
view("book_trades", """
  SELECT coalesce(c.cell, p.cell) AS cell, coalesce(c.sec_id, p.sec_id) AS sec_id, coalesce(c.m, p.next_m) AS m, c.m IS NULL AS gone,
         coalesce(c.w, 0.0) AS w1, coalesce(p.w, 0.0) AS w0, c.adv_usd AS c_adv, p.adv_usd AS p_adv, coalesce(c.ret_next, 0.0) AS ret,
         CASE WHEN c.m IS NULL THEN p.spread ELSE c.spread END AS x_spread, CASE WHEN c.m IS NULL THEN p.sigma_d ELSE c.sigma_d END AS x_sigma_d,
         CASE WHEN c.m IS NULL THEN p.adv_usd ELSE c.adv_usd END AS x_adv_usd, p.ret_next AS p_ret, p.spread AS p_spread, p.sigma_d AS p_sigma_d, p.adv_usd AS p_adv_usd,
         c.spread AS c_spread, c.sigma_d AS c_sigma_d, c.adv_usd AS c_adv_usd
  FROM book c FULL JOIN (SELECT b.*, d.next_m FROM book b JOIN book_months d ON b.cell = d.cell AND b.m = d.m WHERE d.next_m IS NOT NULL) p
    ON c.cell = p.cell AND c.sec_id = p.sec_id AND c.m = p.next_m""")
view("ladder", f"""
  SELECT cell, aum, m, sum(w1 * ret) AS gross_ret, sum(w1 * ret) - sum({cost_sql('w1 - w0', 'x_', 'aum')}) AS net_ret_uncapped,
         sum(c1 * ret) AS gross_ret_capped, sum(c1 * ret) - sum({cost_sql('c1 - c0', 'x_', 'aum')}) AS net_ret_capped, sum(abs(c1)) AS gross_capped
  FROM (SELECT *, {cap_sql('w1', 'c_adv', 'aum')} AS c1, {cap_sql('w0', 'p_adv', 'aum')} AS c0 FROM book_trades, {AUM_ROWS}) GROUP BY 1, 2, 3""")


@shared
def scored(t):
    s = t.signals.filter(tradeable())
    cells = F.explode(F.array(
        F.struct(F.lit("EQ").alias("cell"), F.round(row_mean(SIGNALS), 10).alias("score")), F.struct(F.lit("MOM").alias("cell"), F.col("sig_mom").alias("score"))
    ))
    # prices of random goods swing far more than those of securities: bring returns and volatility to a usual size
    calm = [(F.col(c) * 0.002).alias(c) for c in ("ret_next", "sigma_d")]
    return s.withColumn("__c", cells).select("__c.cell", "sec_id", "m", "__c.score", calm[0], "spread", calm[1], "adv_usd", "me").filter("score IS NOT NULL")


@shared
def decile_book(t):
    return t.stage("book", bk.extreme_book(scored(t), by=["cell", "m"], id="sec_id"))


@shared
def ladder(t):
    return t.stage("ladder", bk.ladder(decile_book(t), AUMS, **KEYS))


LADDER = ["gross_ret", "net_ret_uncapped", "gross_ret_capped", "net_ret_capped", "gross_capped"]


def rounded(df, keys, cols, digits=6):
    return df.select(*keys, *[rnd(c, digits).alias(c) for c in cols])


def rsql(cols, digits=6):
    return ", ".join(f"{R(c, digits)} AS {c}" for c in cols)


@query("b1_decile_book", f"SELECT cell, sec_id, m, {R('w')} AS w FROM book")
def b1(t):
    return rounded(decile_book(t), ["cell", "sec_id", "m"], ["w"])


@query("b1_decile_book_cap_weighted", f"""
SELECT cell, sec_id, m, {R('leg * cap / sum(cap) OVER (PARTITION BY cell, m, leg)')} AS w FROM (
  SELECT *, sign(w) AS leg, CASE WHEN me > 0 THEN me ELSE 0.0 END AS cap FROM book)""")
def b1_vw(t):
    out = bk.extreme_book(scored(t), by=["cell", "m"], id="sec_id", cap="me")
    return rounded(out, ["cell", "sec_id", "m"], ["w"])


view("spread_ret", """
  SELECT cell, m, max(n) AS n, CASE WHEN max(n) >= 2 * max(k) + 2 THEN avg(CASE WHEN r >= n - k + 1 THEN ret_next END) - avg(CASE WHEN r <= k THEN ret_next END) END AS ew,
         CASE WHEN max(n) >= 2 * max(k) + 2 THEN sum(CASE WHEN r >= n - k + 1 AND ret_next IS NOT NULL THEN ret_next * me END) / sum(CASE WHEN r >= n - k + 1 AND ret_next IS NOT NULL THEN me END)
           - sum(CASE WHEN r <= k AND ret_next IS NOT NULL THEN ret_next * me END) / sum(CASE WHEN r <= k AND ret_next IS NOT NULL THEN me END) END AS vw
  FROM (SELECT *, greatest(floor(n * 0.1::DOUBLE), 1) AS k FROM ranked_scores) GROUP BY 1, 2""")


@query("b2_decile_spread_return", f"SELECT cell, m, n, {R('ew')} AS ew, {R('vw')} AS vw FROM spread_ret")
def b2(t):
    s = scored(t)
    kw = dict(by=["cell", "m"], id="sec_id", score="score", ret="ret_next")
    ew = bk.spread_return(s, **kw).withColumnRenamed("spread_ret", "ew")
    vw = bk.spread_return(s, **kw, cap="me").select("cell", "m", F.col("spread_ret").alias("vw"))
    return rounded(ew.join(vw, ["cell", "m"]), ["cell", "m", "n"], ["ew", "vw"])


@query("b3_participation_cap", f"SELECT cell, sec_id, m, aum, {R(cap_sql('w', 'adv_usd', 'aum'))} AS w FROM book, {AUM_ROWS} WHERE w <> 0")
def b3(t):
    rows = decile_book(t).filter("w <> 0").withColumn("aum", F.explode(F.array(*[F.lit(a) for a in AUMS])))
    return rows.select("cell", "sec_id", "m", "aum", rnd(bk.cap_participation("w", "adv_usd", "aum")).alias("w"))


@query("b4_trade_vector", f"SELECT cell, sec_id, m, CASE WHEN gone THEN 'exit' ELSE 'held' END AS event, {R('w1 - w0')} AS dw FROM book_trades WHERE w1 <> w0")
def b4(t):
    dw = F.coalesce("cur.w", F.lit(0.0)) - F.coalesce("prev.w", F.lit(0.0))
    return bk.trades(decile_book(t), **KEYS).withColumn("dw", dw).filter("dw <> 0").select("cell", "sec_id", "m", "event", rnd("dw").alias("dw"))


@query("b5_trade_cost", f"""
SELECT sec_id, m, {R('0.5 * spread * 0.01::DOUBLE + 0.0005::DOUBLE * 0.01::DOUBLE', 8)} AS linear, {R('sigma_d * sqrt(1e6::DOUBLE / greatest(adv_usd, 1.0)) * pow(0.01::DOUBLE, 1.5)', 8)} AS impact
FROM panel WHERE spread IS NOT NULL AND sigma_d IS NOT NULL AND adv_usd > 0""")
def b5(t):
    lin, imp = bk.trade_cost(F.lit(0.01), F.col("spread"), F.col("sigma_d"), F.col("adv_usd"), F.lit(1e6))
    rows = t.panel.filter("spread IS NOT NULL AND sigma_d IS NOT NULL AND adv_usd > 0")
    return rows.select("sec_id", "m", rnd(lin, 8).alias("linear"), rnd(imp, 8).alias("impact"))


@query("b6_borrow_cost", f"SELECT cell, m, {R('sum(greatest(-w, 0.0) * 0.03::DOUBLE / 12)', 8)} AS borrow FROM book GROUP BY 1, 2")
def b6(t):
    return decile_book(t).groupBy("cell", "m").agg(rnd(F.sum(bk.borrow_cost(F.col("w"), 0.03)), 8).alias("borrow"))


@query("b7_capacity_ladder", f"SELECT cell, aum, m, {rsql(LADDER)} FROM ladder")
def b7(t):
    return rounded(ladder(t), ["cell", "aum", "m"], LADDER)


@query("b8_infeasibility", f"""
SELECT cell, aum, m, count(*) AS n, {R('quantile_cont(x, 0.5)', 4)} AS median_x_cap, {R('quantile_cont(x, 0.95)', 4)} AS p95_x_cap
FROM (SELECT *, abs(w) * aum / (0.12::DOUBLE * adv_usd) AS x FROM book, {AUM_ROWS} WHERE w <> 0 AND adv_usd > 0) GROUP BY 1, 2, 3""")
def b8(t):
    return rounded(bk.infeasibility(decile_book(t), AUMS, by=["cell"], month="m"), ["cell", "aum", "m", "n"], ["median_x_cap", "p95_x_cap"], 4)


view("drifted", """
  SELECT b.*, CASE WHEN p_ret IS NULL AND w0 = 0 THEN 0.0 ELSE w0 * (1 + coalesce(p_ret, 0.0)) / (1 + coalesce(g.R, 0.0)) END AS wd, c.spread AS i_spread, c.sigma_d AS i_sigma_d, c.adv_usd AS i_adv_usd,
         coalesce(c.spread >= 0 AND c.sigma_d >= 0 AND c.adv_usd > 0, FALSE) AS ok
  FROM book_trades b JOIN cost_inputs c ON b.sec_id = c.sec_id AND b.m = c.m
  LEFT JOIN (SELECT d.cell, d.next_m AS m, sum(w * coalesce(ret_next, 0.0)) AS R FROM book k JOIN book_months d ON k.cell = d.cell AND k.m = d.m GROUP BY 1, 2) g ON b.cell = g.cell AND b.m = g.m""")
view("accounts", f"""
  SELECT *, gross_ret - cost_spread - cost_impact - cost_borrow AS net_ret FROM (
  SELECT cell, m, sum(w1 * ret) AS gross_ret, sum(CASE WHEN ok THEN 0.5 * i_spread * abs(dw) + 0.0005::DOUBLE * abs(dw) ELSE 0.0 END) AS cost_spread,
         sum(CASE WHEN ok THEN i_sigma_d * sqrt(1e5::DOUBLE / greatest(i_adv_usd, 1.0)) * pow(abs(dw), 1.5) ELSE 0.0 END) AS cost_impact,
         sum(greatest(-w1, 0.0) * 0.03::DOUBLE / 12) AS cost_borrow, sum(abs(dw)) / 2 AS turnover, sum(greatest(w1, 0.0) * ret) AS long_ret, sum(least(w1, 0.0) * ret) AS short_ret,
         sum(CASE WHEN ok THEN 0.0 ELSE abs(w1 - wd) END) AS frozen_moved
  FROM (SELECT *, CASE WHEN ok THEN w1 - wd ELSE 0.0 END AS dw FROM drifted) GROUP BY 1, 2)""")
ACCOUNTS = ["gross_ret", "net_ret", "turnover", "cost_spread", "cost_impact", "cost_borrow", "long_ret", "short_ret", "frozen_moved"]


@shared
def accounts(t):
    return t.stage("accounts", bk.backtest_drifted(decile_book(t), t.cost_inputs, **KEYS, aum=1e5, borrow=0.03))


@query("b9_drifted_backtest", f"SELECT cell, m, {rsql(ACCOUNTS)} FROM accounts")
def b9(t):
    return rounded(accounts(t), ["cell", "m"], ACCOUNTS)


PERF = ["gross_sharpe", "net_sharpe", "gross_mean_ann", "net_mean_ann", "vol_ann", "max_drawdown", "turnover_mean", "cost_drag_bps"]


@query("b10_performance_summary", f"""
SELECT cell, count(*) AS months, {R('avg(gross_ret) / stddev_samp(gross_ret) * sqrt(12)')} AS gross_sharpe, {R('avg(net_ret) / stddev_samp(net_ret) * sqrt(12)')} AS net_sharpe,
       {R('avg(gross_ret) * 12')} AS gross_mean_ann, {R('avg(net_ret) * 12')} AS net_mean_ann, {R('stddev_samp(net_ret) * sqrt(12)')} AS vol_ann, {R('min(dd)')} AS max_drawdown,
       {R('avg(turnover)')} AS turnover_mean, {R('(avg(gross_ret) - avg(net_ret)) * 12 * 10000', 4)} AS cost_drag_bps
FROM (SELECT *, v / max(v) OVER (PARTITION BY cell ORDER BY m) - 1 AS dd FROM (
  SELECT *, exp(sum(ln(greatest(1 + net_ret, 1e-300))) OVER (PARTITION BY cell ORDER BY m)) AS v FROM accounts)) GROUP BY 1""")
def b10(t):
    out = bk.performance(accounts(t), by=["cell"], month="m", gross="gross_ret", net="net_ret", turnover="turnover")
    return rounded(out, ["cell", "months"], PERF[:-1]).join(out.select("cell", rnd("cost_drag_bps", 4).alias("cost_drag_bps")), "cell")


@query("b11_capacity_ceiling", f"""
SELECT aum, m, count(*) AS names, {R('sum(least(0.05::DOUBLE, greatest(greatest(0.12::DOUBLE * adv_usd / aum, 1e-6), 1e-5)))')} AS max_gross,
       {R('avg(CASE WHEN greatest(0.12::DOUBLE * adv_usd / aum, 1e-6) < 0.05 THEN 1.0 ELSE 0.0 END)')} AS share_volume_capped
FROM tradeable_rows, {AUM_ROWS} WHERE ok GROUP BY 1, 2""")
def b11(t):
    out = bk.capacity_ceiling(t.cost_inputs, AUMS, month="m", max_weight=0.05)
    return rounded(out, ["aum", "m", "names"], ["max_gross", "share_volume_capped"])


@query("b12_book_stats", f"""
SELECT cell, count(*) AS months, {R('avg(g)')} AS mean_gross, {R('quantile_cont(g, 0.5)')} AS median_gross, {R('max(g)')} AS max_gross, {R('avg(names)')} AS mean_names, {R('avg(abs(net))')} AS mean_abs_net
FROM (SELECT cell, m, sum(abs(w)) AS g, sum(w) AS net, count(*) FILTER (abs(w) > 1e-9) AS names FROM book GROUP BY 1, 2) GROUP BY 1""")
def b12(t):
    out = bk.book_stats(decile_book(t), by=["cell"], month="m")
    return rounded(out, ["cell", "months"], ["mean_gross", "median_gross", "max_gross", "mean_names", "mean_abs_net"])


@query("b13_dose_response", f"""
SELECT cell, aum, count(*) AS months, {R('avg(a)')} AS corr_cap, {R('avg(b)')} AS corr_size_signal, {R('avg(c)')} AS corr_signed_signal, {R('avg(s)')} AS share_at_cap FROM (
  SELECT cell, aum, m, avg(CASE WHEN abs(wc) >= cap * 0.999 THEN 1.0 ELSE 0.0 END) AS s,
         CASE WHEN count(*) >= 10 AND stddev_pop(abs(wc)) >= 1e-15 AND stddev_pop(cap) >= 1e-15 THEN corr(abs(wc), cap) END AS a,
         CASE WHEN count(*) >= 10 AND stddev_pop(abs(wc)) >= 1e-15 AND stddev_pop(abs(score)) >= 1e-15 THEN corr(abs(wc), abs(score)) END AS b,
         CASE WHEN count(*) >= 10 AND stddev_pop(wc) >= 1e-15 AND stddev_pop(score) >= 1e-15 THEN corr(wc, score) END AS c
  FROM (SELECT *, 0.12::DOUBLE * adv_usd / aum AS cap, {cap_sql('w', 'adv_usd', 'aum')} AS wc FROM vw_book, {AUM_ROWS} WHERE abs(w) > 1e-12) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def b13(t):
    out = bk.dose_response(bk.extreme_book(scored(t), by=["cell", "m"], id="sec_id", cap="me"), AUMS, by=["cell"], month="m", signal="score")
    return rounded(out, ["cell", "aum", "months"], ["corr_cap", "corr_size_signal", "corr_signed_signal", "share_at_cap"])


@query("b14_trade_size_vs_volume", f"""
WITH x AS (SELECT b.cell, aum, abs(w1 - w0) AS size, abs(w1 - w0) * aum / c.adv_usd AS x FROM book_trades b JOIN cost_inputs c ON b.sec_id = c.sec_id AND b.m = c.m, {AUM_ROWS}
           WHERE abs(w1 - w0) > 0 AND c.adv_usd > 0),
s AS (SELECT *, sum(size) OVER (PARTITION BY cell, aum ORDER BY x) AS run, sum(size) OVER (PARTITION BY cell, aum) AS tot FROM x)
SELECT cell, aum, {R('sum(CASE WHEN x > 0.12 THEN size ELSE 0.0 END) / sum(size)')} AS share_gt_12pct, {R('sum(CASE WHEN x > 1 THEN size ELSE 0.0 END) / sum(size)')} AS share_gt_100pct,
       {R('min(CASE WHEN run >= tot / 2 * (1 - 1e-12) THEN x END)')} AS median_trade FROM s GROUP BY 1, 2""")
def b14(t):
    out = bk.volume_support(decile_book(t), t.cost_inputs, AUMS, **KEYS)
    return rounded(out, ["cell", "aum"], ["share_gt_12pct", "share_gt_100pct", "median_trade"])


@query("b15_trade_cap_violations", f"""
SELECT cell, count(*) FILTER (live) AS trades, count(*) FILTER (live AND over) AS over_cap, {R('max(CASE WHEN live AND over THEN mv / cap END)', 4)} AS worst_multiple,
       {R('coalesce(sum(CASE WHEN live AND over THEN mv - cap END), 0.0)')} AS excess, {R('coalesce(max(CASE WHEN NOT ok THEN mv END), 0.0)')} AS frozen_moved
FROM (SELECT *, ok AND mv > 1e-12 AS live, mv > cap * 1.001 AS over FROM (
  SELECT d.cell, ok, abs(w1 - wd) AS mv, greatest(0.12::DOUBLE * i_adv_usd / 1e5::DOUBLE, 1e-6) AS cap FROM drifted d
  WHERE m > (SELECT min(m) FROM book x WHERE x.cell = d.cell))) GROUP BY 1""")
def b15(t):
    out = bk.cap_violations(decile_book(t), t.cost_inputs, **KEYS, aum=1e5)
    return out.select("cell", "trades", "over_cap", rnd("worst_multiple", 4).alias("worst_multiple"), rnd("excess").alias("excess"), rnd("frozen_moved").alias("frozen_moved"))


view("proposals", "SELECT sec_id, m, score AS w_prop, round(score + sig_mom * 0.4::DOUBLE, 10) AS w FROM (SELECT s.sec_id, s.m, s.score, g.sig_mom FROM scored s JOIN signals g ON s.sec_id = g.sec_id AND s.m = g.m WHERE cell = 'EQ' AND sig_mom IS NOT NULL)")
spearman_view("prop_ic", "proposals", ["m"], "w", "w_prop", 40)


@shared
def proposals(t):
    s = t.signals.filter(tradeable()).filter("sig_mom IS NOT NULL")
    score = F.round(row_mean(SIGNALS), 10)
    return s.select(F.lit("EQ").alias("cell"), "sec_id", "m", score.alias("w_prop"), F.round(score + F.col("sig_mom") * 0.4, 10).alias("w"))


@query("b16_proposal_fidelity", f"""
SELECT 'EQ' AS cell, count(*) AS months, {R('avg(a)')} AS sign_all, {R('avg(b)')} AS sign_top_half, {R('avg(c)')} AS sign_top_quintile, {R('avg(d)')} AS sign_weighted, {R('avg(ic)')} AS rank_corr
FROM (SELECT p.m, avg(g) AS a, avg(CASE WHEN abs(w_prop) >= q50 THEN g END) AS b, avg(CASE WHEN abs(w_prop) >= q80 THEN g END) AS c, sum(g * abs(w_prop)) / greatest(sum(abs(w_prop)), 1e-12) AS d
      FROM (SELECT *, CASE WHEN sign(w) = sign(w_prop) THEN 1.0 ELSE 0.0 END AS g FROM proposals) p
      JOIN (SELECT m, quantile_cont(abs(w_prop), 0.5) AS q50, quantile_cont(abs(w_prop), 0.8) AS q80 FROM proposals GROUP BY 1 HAVING count(*) >= 40) q ON p.m = q.m GROUP BY 1) x
JOIN prop_ic i ON x.m = i.m""")
def b16(t):
    out = bk.proposal_fidelity(proposals(t), by=["cell"], month="m", w="w", prop="w_prop")
    return rounded(out, ["cell", "months"], ["sign_all", "sign_top_half", "sign_top_quintile", "sign_weighted", "rank_corr"])


spearman_view("arm_ic", "scored", ["cell", "m"], "score", "ret_next", 11)


@query("b17_arm_information", f"SELECT cell, {R('avg(ic)')} AS mean_ic, {R('stddev_samp(ic)')} AS sd_ic, count(ic) AS months FROM arm_ic GROUP BY 1")
def b17(t):
    out = bk.arm_information(scored(t), by=["cell"], month="m", score="score", target="ret_next")
    return rounded(out, ["cell", "months"], ["mean_ic", "sd_ic"])


_V = {f"{d}{x}{b}": f"c_{d}{x}" + (" + fee" if b == "B" else "") for d in "AB" for x in "AB" for b in "AB"}
view("lattice", f"""
  SELECT cell, m, {', '.join(f'{e} AS v_{k}' for k, e in _V.items())} FROM (
    SELECT b.cell, b.m, sum({cost_sql('b.w1 - b.w0', 'b.x_', '1e5::DOUBLE')}) AS c_AA, sum({cost_sql('b.w1 - coalesce(d.wd, b.w0)', 'b.x_', '1e5::DOUBLE')}) AS c_BA,
           sum(CASE WHEN d.ok THEN {cost_sql('b.w1 - b.w0', 'd.i_', '1e5::DOUBLE')} ELSE 0.0 END) AS c_AB,
           sum(CASE WHEN d.ok THEN {cost_sql('b.w1 - d.wd', 'd.i_', '1e5::DOUBLE')} ELSE 0.0 END) AS c_BB, sum(greatest(-b.w1, 0.0) * 0.03::DOUBLE / 12) AS fee
    FROM book_trades b LEFT JOIN (SELECT * FROM drifted WHERE ok) d ON b.cell = d.cell AND b.sec_id = d.sec_id AND b.m = d.m GROUP BY 1, 2)""")


@query("b18_cost_convention_lattice", f"""
SELECT cell, m, {R('v_AAA', 7)} AS v_AAA, {R('v_BBB', 7)} AS v_BBB, {R('v_AAA - v_BBB', 7)} AS "full",
       {R('(2 * (v_ABB - v_BBB) + (v_AAB - v_BAB) + (v_ABA - v_BBA) + 2 * (v_AAA - v_BAA)) / 6', 7)} AS shapley_D,
       {R('(2 * (v_BAB - v_BBB) + (v_AAB - v_ABB) + (v_BAA - v_BBA) + 2 * (v_AAA - v_ABA)) / 6', 7)} AS shapley_X,
       {R('(2 * (v_BBA - v_BBB) + (v_ABA - v_ABB) + (v_BAA - v_BAB) + 2 * (v_AAA - v_AAB)) / 6', 7)} AS shapley_B FROM lattice""")
def b18(t):
    out = bk.cost_lattice(decile_book(t), t.cost_inputs, **KEYS, aum=1e5, borrow=0.03)
    return rounded(out, ["cell", "m"], ["v_AAA", "v_BBB", "full", "shapley_D", "shapley_X", "shapley_B"], 7)


@query("b19_leg_tilts", f"""
SELECT cell, m, {R('lm')} AS long_log_me, {R('sm')} AS short_log_me, {R('lm - sm')} AS size_tilt, {R('ls - ss')} AS spread_tilt, {R('la', 2)} AS long_adv FROM (
  SELECT cell, m, sum(greatest(w, 0.0) * ln(greatest(me, 1.0))) / sum(greatest(w, 0.0)) AS lm, sum(greatest(-w, 0.0) * ln(greatest(me, 1.0))) / sum(greatest(-w, 0.0)) AS sm,
         sum(greatest(w, 0.0) * spread) / sum(greatest(w, 0.0)) AS ls, sum(greatest(-w, 0.0) * spread) / sum(greatest(-w, 0.0)) AS ss,
         sum(greatest(w, 0.0) * adv_usd) / sum(greatest(w, 0.0)) AS la FROM book GROUP BY 1, 2)""")
def b19(t):
    out = bk.leg_tilts(decile_book(t), by=["cell"], month="m", size="me", spread="spread", adv="adv_usd")
    return out.select("cell", "m", *[rnd(c).alias(c) for c in ("long_log_me", "short_log_me", "size_tilt", "spread_tilt")], rnd("long_adv", 2).alias("long_adv"))


@query("b24_prediction_inflation", f"""
SELECT cell, m, {R('i')} AS implied, {R('r')} AS realised, {R('CASE WHEN abs(r) > 1e-12 THEN i / r END', 4)} AS inflation, {R('g')} AS gross, {R('g * g / q', 4)} AS effective_names
FROM (SELECT cell, m, sum(score * 0.02::DOUBLE * w) AS i, sum(coalesce(ret_next, 0.0) * w) AS r, sum(abs(w)) AS g, sum(w * w) AS q FROM book GROUP BY 1, 2)""")
def b24(t):
    b = decile_book(t).withColumn("alpha", F.col("score") * 0.02)
    out = bk.prediction_inflation(b, by=["cell"], month="m", alpha="alpha", ret="ret_next")
    return out.select("cell", "m", *[rnd(c).alias(c) for c in ("implied", "realised", "gross")], rnd("inflation", 4).alias("inflation"), rnd("effective_names", 4).alias("effective_names"))


@query("b25_tax_cost_and_deferral", f"""
SELECT cell, sec_id, m, {R('0.25::DOUBLE * 0.1::DOUBLE * CASE WHEN w0 > 0 THEN greatest(w0 - w1, 0.0) ELSE 0.0 END', 8)} AS tax_cost,
       {R('w1 + CASE WHEN sec_id % 14 > 6 AND sec_id % 14 <= 12 THEN 1.0 ELSE 0.0 END * 0.1::DOUBLE * greatest(coalesce(p_ret, 0.0), 0.0)')} AS bonus
FROM book_trades WHERE w0 <> 0""")
def b25(t):
    tr = bk.trades(decile_book(t), **KEYS).filter("prev.w <> 0")
    w1, w0 = F.coalesce("cur.w", F.lit(0.0)), F.col("prev.w")
    return tr.select(
        "cell", "sec_id", "m", rnd(bk.tax_cost(w1, w0, F.lit(0.1), F.lit(0.25)), 8).alias("tax_cost"),
        rnd(bk.deferral_bonus(w1, F.col("sec_id") % 14, 0.1, F.col("prev.ret_next"))).alias("bonus"),
    )
