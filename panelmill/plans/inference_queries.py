"""Inference on monthly series and the studies built on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import rnd
from panelmill.operators import inference as inf
from panelmill.operators import studies as st
from panelmill.operators import xsection as xs
from panelmill.plans.book_queries import accounts, ladder, rounded, rsql
from panelmill.plans.registry import R, query, shared, view
from panelmill.plans.xsection_queries import SIGNALS, THEMES, spearman_view

#: Bootstrap replications of tests of one difference, and of those over many candidates.
B, B_MANY = 4000, 2000


def hac_sql(source: str, by: list[str], order: str, values: dict[str, str]) -> str:
    keys = ", ".join(by)
    part = f"PARTITION BY {keys}" if by else ""
    d = ", ".join(f"{v} - avg({v}) OVER ({part}) AS d_{k}, {v} AS x_{k}" for k, v in values.items())

    def term(k):
        lags = " + ".join(f"CASE WHEN L >= {j} THEN 2 * (1 - {j} / (L + 1.0::DOUBLE)) * d_{k} * coalesce(lag(d_{k}, {j}) OVER ({part} ORDER BY {order}), 0) ELSE 0 END" for j in range(1, 9))
        return f"d_{k} * d_{k} + {lags} AS g_{k}"

    g = ", ".join(term(k) for k in values)
    out = ", ".join(f"avg(x_{k}) AS mean_{k}, CASE WHEN max(len_) >= 3 THEN sqrt(greatest(sum(g_{k}) / max(len_), 0) / max(len_)) END AS se_{k}" for k in values)
    return f"""SELECT {keys}{',' if by else ''} max(len_) AS n, {out} FROM (SELECT *, {g} FROM (
      SELECT *, greatest(least(floor(4 * pow(len_ / 100.0::DOUBLE, 2.0::DOUBLE / 9)), len_ - 2), 0) AS L, {d} FROM (SELECT *, count(*) OVER ({part}) AS len_ FROM {source}))) {f'GROUP BY {keys}' if by else ''}"""


def influence_sql(source: str, by: list[str], values: dict[str, str]) -> str:
    keys = ", ".join(by)
    cols = ", ".join(f"""avg({v}) OVER p / stddev_samp({v}) OVER p * sqrt(12) AS sr_{k},
      sqrt(12) * (({v} - avg({v}) OVER p) / stddev_samp({v}) OVER p - 0.5 * avg({v}) OVER p / stddev_samp({v}) OVER p * (pow(({v} - avg({v}) OVER p) / stddev_samp({v}) OVER p, 2) - 1)) AS psi_{k}""" for k, v in values.items())
    return f"SELECT *, {cols} FROM {source} WINDOW p AS (PARTITION BY {keys})"


def index_sql(source: str, b: int) -> str:
    """Bootstrap positions for each series length of ``source`` (columns len_)."""
    u = lambda tag: f"('0x' || substr(md5('0|' || b || '|' || t || '|{tag}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return f"""SELECT len_, b, t, (last_value(s IGNORE NULLS) OVER w + t - last_value(f IGNORE NULLS) OVER w) % len_ AS idx FROM (
      SELECT len_, b, t, CASE WHEN t = 0 OR {u('r')} < 1 / 6.0::DOUBLE THEN CAST(floor({u('s')} * len_) AS BIGINT) END AS s, CASE WHEN t = 0 OR {u('r')} < 1 / 6.0::DOUBLE THEN t END AS f
      FROM (SELECT len_, b, unnest(range(len_)) AS t FROM (SELECT DISTINCT len_ FROM {source}), range({b}) r(b)))
      WINDOW w AS (PARTITION BY len_, b ORDER BY t ROWS UNBOUNDED PRECEDING)"""


def resample_sql(source: str, by: list[str], order: str, values: list[str], b: int) -> str:
    keys = ", ".join(by)
    on = f"""(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS len_ FROM {source})"""
    return f"SELECT {', '.join('s.' + k for k in by)}, i.b, i.t, {', '.join(values)} FROM {on} s JOIN ({index_sql(on, b)}) i ON s.len_ = i.len_ AND s.pos = i.idx"


def decide_sql(point: str, draws: str, by: list[str]) -> str:
    """Point (by, n, stat, se) and draws (by, b, d, dse) to the test row."""
    keys = ", ".join(by)
    q = ", ".join("p." + k for k in by)
    on = " AND ".join(f"p.{k} = d.{k}" for k in by)
    return f"""SELECT {keys}, n, count(*) AS n_boot, stat, se, stat / se AS t,
      least(CASE WHEN count(s) >= 100 THEN count(*) FILTER (abs(s) >= abs(stat / se)) / count(s) ELSE 2 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END)) END, 1.0) AS p,
      quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high,
      CASE WHEN count(s) >= 100 THEN stat - quantile_cont(s, 0.975) * se END AS ci_stud_low, CASE WHEN count(s) >= 100 THEN stat - quantile_cont(s, 0.025) * se END AS ci_stud_high
      FROM (SELECT {q}, p.n, p.stat, p.se, d.d, CASE WHEN d.dse > 0 THEN (d.d - p.stat) / d.dse END AS s FROM ({point}) p JOIN ({draws}) d ON {on} WHERE p.n >= 12) GROUP BY {keys}, n, stat, se"""


def sharpe_diff_sql(source: str, by: list[str], order: str, a: str, c: str, b: int = B) -> str:
    src = f"(SELECT {', '.join(by)}, {order}, {a} AS ra, {c} AS rb FROM {source} WHERE {a} IS NOT NULL AND {c} IS NOT NULL)"
    keys = ", ".join(by)
    stat = lambda s, k, o: hac_sql(f"({influence_sql(s, k, {'a': 'ra', 'b': 'rb'})})", k, o, {"psi": "psi_a - psi_b", "sa": "sr_a", "sb": "sr_b"})
    point = f"SELECT {keys}, n, mean_sa - mean_sb AS stat, se_psi AS se FROM ({stat(src, by, order)})"
    boot = f"SELECT {keys}, b, mean_sa - mean_sb AS d, se_psi AS dse FROM ({stat('(' + resample_sql(src, by, order, ['ra', 'rb'], b) + ')', [*by, 'b'], 't')})"
    return decide_sql(point, boot, by)


def mean_diff_sql(source: str, by: list[str], order: str, a: str, c: str, b: int = B) -> str:
    src = f"(SELECT {', '.join(by)}, {order}, {a} - {c} AS x FROM {source} WHERE {a} IS NOT NULL AND {c} IS NOT NULL)"
    keys = ", ".join(by)
    point = f"SELECT {keys}, n, 12 * mean_x AS stat, 12 * se_x AS se FROM ({hac_sql(src, by, order, {'x': 'x'})})"
    boot = f"SELECT {keys}, b, 12 * mean_x AS d, 12 * se_x AS dse FROM ({hac_sql('(' + resample_sql(src, by, order, ['x'], b) + ')', [*by, 'b'], 't', {'x': 'x'})})"
    return decide_sql(point, boot, by)


TEST = ["stat", "se", "t", "p", "ci_low", "ci_high", "ci_stud_low", "ci_stud_high"]


spearman_view("ic_x1", "long_signals", ["signal", "m"], "value", "ret_next", 6)


@query("x1_grouped_spearman", f"SELECT signal, m, n, {R('ic')} AS ic FROM ic_x1")
def x1(t):
    from panelmill.functions import spearman

    long = xs.melt(t.signals, ["sec_id", "m", "ret_next"], SIGNALS)
    return spearman(long, ["signal", "m"], "value", "ret_next", min_n=6).select("signal", "m", "n", rnd("ic").alias("ic"))


@query("x2_newey_west", f"SELECT cell, n, {R('mean_x', 8)} AS mean, {R('se_x', 8)} AS se, {R('mean_x / se_x')} AS t FROM ({hac_sql('cell_returns', ['cell'], 'm', {'x': 'r'})})")
def x2(t):
    out = inf.newey_west(t.cell_returns, ["cell"], "m", "r")
    return out.select("cell", "n", rnd("mean", 8).alias("mean"), rnd("se", 8).alias("se"), rnd("t").alias("t"))


def sharpe_rows(t):
    return inf.sharpe_test(t.cell_returns, ["cell"], "m", "r")


def normal_cdf_sql(z: str) -> str:
    """The normal distribution function as its series of positive terms, in SQL."""
    x = f"least(abs({z}), 12.0)::DOUBLE"
    terms = f"list_sum(list_transform(range(400), lambda k: exp((2 * k + 1) * ln({x}) + k * ln(2.0) - (lgamma(2.0 * k + 2) - k * ln(2.0) - lgamma(k + 1.0)) - {x} * {x} / 2 - k * ln(2.0))))"
    return f"(CASE WHEN {z} = 0 THEN 0.5::DOUBLE ELSE 0.5 + sign({z}) * least({terms} / sqrt(2 * pi()), 0.5) END)"


def two_sided_sql(t: str) -> str:
    return f"(2 * (1 - {normal_cdf_sql(f'abs({t})')}))"


view("sharpe_rows", f"""
  SELECT h.cell, h.n, mean_s AS sharpe, se_psi AS se, sqrt(greatest(1 - skew * mean_s / sqrt(12) + 0.25 * (kurt + 2) * pow(mean_s / sqrt(12), 2), 1e-12) / h.n) * sqrt(12) AS se_iid, skew, kurt, mean_s / se_psi AS t
  FROM ({hac_sql('(' + influence_sql('cell_returns', ['cell'], {'x': 'r'}) + ')', ['cell'], 'm', {'psi': 'psi_x', 's': 'sr_x'})}) h
  JOIN (SELECT cell, skewness(r) AS skew, kurtosis(r) AS kurt FROM cell_returns GROUP BY 1) k ON k.cell = h.cell""")


@query("x3_sharpe_test", f"SELECT cell, n, {rsql(['sharpe', 'se', 'se_iid', 'skew', 'kurt', 't'])}, {R(two_sided_sql('t'))} AS p, abs(t) > 3 AS over_hurdle FROM sharpe_rows")
def x3(t):
    return rounded(sharpe_rows(t), ["cell", "n", "over_hurdle"], ["sharpe", "se", "se_iid", "skew", "kurt", "t", "p"])


@query("x3_sharpe_and_hac_error", f"""
SELECT cell, h.n, {R('mean_s')} AS sharpe, {R('se_psi')} AS se, {R('mean_s / se_psi')} AS t
FROM ({hac_sql('(' + influence_sql('cell_returns', ['cell'], {'x': 'r'}) + ')', ['cell'], 'm', {'psi': 'psi_x', 's': 'sr_x'})}) h""")
def x3_hac(t):
    return rounded(sharpe_rows(t), ["cell", "n"], ["sharpe", "se", "t"])


@query("x4_deflated_sharpe", f"""
WITH RECURSIVE trials AS (SELECT count(*)::DOUBLE AS trials FROM sharpe_rows),
aims AS (SELECT 1 AS k, 1 - 1 / trials AS aim FROM trials UNION ALL SELECT 2, 1 - 1 / (trials * exp(1)) FROM trials),
halved AS (SELECT k, aim, 0::DOUBLE AS lo, 8::DOUBLE AS hi, 0 AS i FROM aims
  UNION ALL SELECT k, aim, CASE WHEN under THEN (lo + hi) / 2 ELSE lo END, CASE WHEN under THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, {normal_cdf_sql('((lo + hi) / 2)')} < aim AS under FROM halved WHERE i < 50)),
best AS (SELECT (1 - 0.5772156649015329::DOUBLE) * max(CASE WHEN k = 1 THEN lo END) + 0.5772156649015329::DOUBLE * max(CASE WHEN k = 2 THEN lo END) AS best FROM halved WHERE i = 50),
z AS (SELECT cell, n, sharpe, best / sqrt(n - 1) AS e, (sharpe / sqrt(12) - best / sqrt(n - 1)) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe / sqrt(12) + 0.25 * (kurt + 2) * pow(sharpe / sqrt(12), 2), 1e-12)) AS z FROM sharpe_rows CROSS JOIN best)
SELECT cell, n, {R('sharpe')} AS sharpe, {R('e * sqrt(12)')} AS expected_max, {R('p')} AS deflated_p, p > 0.95 AS survives FROM (SELECT *, {normal_cdf_sql('z')} AS p FROM z)""")
def x4(t):
    """Every cell is a trial."""
    rows = sharpe_rows(t)
    trials = rows.agg(F.count(F.lit(1)).alias("trials"))
    return rounded(inf.deflated_sharpe(rows.join(F.broadcast(trials), F.lit(True)), F.col("trials")),  # one-row side
                    ["cell", "n", "survives"], ["sharpe", "expected_max", "deflated_p"])


@query("x5_backtest_overfitting", f"""
WITH pos AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS t, count(*) OVER () AS len_ FROM (SELECT DISTINCT m FROM cell_returns)),
blk AS (SELECT m, CASE WHEN t < (len_ % 16) * (len_ // 16 + 1) THEN t // (len_ // 16 + 1) ELSE len_ % 16 + (t - (len_ % 16) * (len_ // 16 + 1)) // greatest(len_ // 16, 1) END AS k FROM pos),
s AS (SELECT cell, k, sum(r) AS s, count(*) AS c FROM cell_returns JOIN blk USING (m) GROUP BY 1, 2),
masks AS (SELECT mask FROM range(65536) x(mask) WHERE bit_count(mask) = 8),
perf AS (SELECT mask, cell, sum(CASE WHEN (mask >> k) & 1 = 1 THEN s END) / sum(CASE WHEN (mask >> k) & 1 = 1 THEN c END) AS i, sum(CASE WHEN (mask >> k) & 1 = 0 THEN s END) / sum(CASE WHEN (mask >> k) & 1 = 0 THEN c END) AS o
         FROM s, masks GROUP BY 1, 2),
rk AS (SELECT *, (rank() OVER (PARTITION BY mask ORDER BY o) + (count(*) OVER (PARTITION BY mask, o) - 1) / 2.0) / count(*) OVER (PARTITION BY mask) AS pct, row_number() OVER (PARTITION BY mask ORDER BY i DESC, cell) AS best FROM perf),
lg AS (SELECT ln(least(greatest(pct, 1e-6), 1 - 1e-6) / (1 - least(greatest(pct, 1e-6), 1 - 1e-6))) AS g FROM rk WHERE best = 1)
SELECT {R('avg(CASE WHEN g <= 0 THEN 1.0 ELSE 0.0 END)')} AS pbo, count(*) AS n_combinations, (SELECT count(DISTINCT cell) FROM cell_returns) AS n_strategies, {R('quantile_cont(g, 0.5)')} AS median_logit FROM lg""")
def x5(t):
    return rounded(inf.pbo(t.cell_returns, order="m", unit="cell", value="r", n_splits=16), ["n_combinations", "n_strategies"], ["pbo", "median_logit"])


@query("x6_bootstrap_index", f"""SELECT b, t, CAST(idx AS INTEGER) AS idx FROM ({index_sql('(SELECT count(DISTINCT m) AS len_ FROM cell_returns)', B)})""")
def x6(t):
    lengths = t.cell_returns.agg(F.count_distinct("m").cast("int").alias("len"))
    return inf.bootstrap_index(lengths, B).select("b", "t", "idx")


_CENTRED = "(SELECT cell, m, r - avg(r) OVER (PARTITION BY cell) AS x FROM cell_returns)"


@query("x7_romano_wolf", f"""
WITH obs AS (SELECT cell, mean_x AS mean, mean_x / se_x AS t_stat, row_number() OVER (ORDER BY mean_x / se_x DESC, cell) AS k FROM ({hac_sql('cell_returns', ['cell'], 'm', {'x': 'r'})})),
dr AS (SELECT cell, b, mean_x / se_x AS t FROM ({hac_sql('(' + resample_sql(_CENTRED, ['cell'], 'm', ['x'], B_MANY) + ')', ['cell', 'b'], 't', {'x': 'x'})})),
mx AS (SELECT o.cell, o.k, o.t_stat, max(d.t) OVER (PARTITION BY b ORDER BY k DESC) AS mx FROM dr d JOIN obs o ON d.cell = o.cell),
p AS (SELECT cell, k, avg(CASE WHEN mx >= t_stat THEN 1.0 ELSE 0.0 END) AS p FROM mx GROUP BY 1, 2)
SELECT o.cell, {R('mean', 8)} AS mean, {R('t_stat')} AS t_stat, {R('max(p) OVER (ORDER BY p.k)')} AS p_adjusted, max(p) OVER (ORDER BY p.k) < 0.05 AS reject FROM obs o JOIN p ON o.cell = p.cell""")
def x7(t):
    out = inf.romano_wolf(t.cell_returns, order="m", unit="cell", value="r", B=B_MANY)
    return out.select("cell", rnd("mean", 8).alias("mean"), rnd("t_stat").alias("t_stat"), rnd("p_adjusted").alias("p_adjusted"), "reject")


_EXCESS = "(SELECT c.cell, c.m, c.r - b.r AS x FROM cell_returns c JOIN cell_returns b ON c.m = b.m AND b.cell = 'L-S-P-0' WHERE c.cell <> 'L-S-P-0')"
_SHIFTED = f"""(SELECT e.cell, e.m, e.x - CASE WHEN mean_x > -sqrt(2 * ln(ln(greatest(n, 3)))) * se_x THEN mean_x ELSE 0 END AS x
  FROM {_EXCESS} e JOIN ({hac_sql(_EXCESS, ['cell'], 'm', {'x': 'x'})}) o ON e.cell = o.cell)"""


@query("x8_superior_predictive_ability", f"""
WITH obs AS (SELECT cell, n, mean_x / se_x AS t FROM ({hac_sql(_EXCESS, ['cell'], 'm', {'x': 'x'})})),
top AS (SELECT max(t) AS t_stat, max_by(cell, t) AS best, count(*) AS n_candidates, max(n) AS months FROM obs),
dr AS (SELECT b, max(mean_x / se_x) AS mx FROM ({hac_sql('(' + resample_sql(_SHIFTED, ['cell'], 'm', ['x'], B_MANY) + ')', ['cell', 'b'], 't', {'x': 'x'})}) GROUP BY 1)
SELECT {R('t_stat')} AS t_stat, best, n_candidates, months, {R('avg(CASE WHEN mx >= t_stat THEN 1.0 ELSE 0.0 END)')} AS p FROM dr, top GROUP BY t_stat, best, n_candidates, months""")
def x8(t):
    out = inf.spa(t.cell_returns, order="m", unit="cell", value="r", benchmark="L-S-P-0", B=B_MANY)
    return out.select(rnd("t_stat").alias("t_stat"), "best", "n_candidates", "months", rnd("p").alias("p"))


@query("x9_sharpe_difference", f"SELECT cell, aum, n, n_boot, {rsql(TEST, 5)} FROM ({sharpe_diff_sql('ladder', ['cell', 'aum'], 'm', 'net_ret_capped', 'net_ret_uncapped')})")
def x9(t):
    out = inf.sharpe_diff(ladder(t), ["cell", "aum"], "m", "net_ret_capped", "net_ret_uncapped", B)
    return rounded(out, ["cell", "aum", "n", "n_boot"], TEST, 5)


@query("x10_mean_difference", f"SELECT cell, aum, n, n_boot, {rsql(TEST, 5)} FROM ({mean_diff_sql('ladder', ['cell', 'aum'], 'm', 'net_ret_capped', 'net_ret_uncapped')})")
def x10(t):
    out = inf.mean_diff(ladder(t), ["cell", "aum"], "m", "net_ret_capped", "net_ret_uncapped", B)
    return rounded(out, ["cell", "aum", "n", "n_boot"], TEST, 5)


view("forecast_errors", """
  SELECT country, m, pow(avg(ret_next - 0.01 * sig_mom), 2) - pow(avg(ret_next - 0.01 * sig_size), 2) AS loss_diff FROM signals WHERE ret_next IS NOT NULL AND sig_mom IS NOT NULL GROUP BY 1, 2""")


@query("x11_diebold_mariano", f"""
SELECT country, n, {R('mean_x')} AS mean_loss_diff, {R('mean_x / se_x')} AS t, {R(two_sided_sql('(mean_x / se_x)'))} AS p, CASE WHEN mean_x < 0 THEN 'a' ELSE 'b' END AS better
FROM ({hac_sql('forecast_errors', ['country'], 'm', {'x': 'loss_diff'})})""")
def x11(t):
    rows = t.signals.filter("ret_next IS NOT NULL AND sig_mom IS NOT NULL").groupBy("country", "m").agg(
        F.avg(F.col("ret_next") - 0.01 * F.col("sig_mom")).alias("ea"), F.avg(F.col("ret_next") - 0.01 * F.col("sig_size")).alias("eb")
    )
    return rounded(inf.diebold_mariano(rows, ["country"], "m", "ea", "eb"), ["country", "n", "better"], ["mean_loss_diff", "t", "p"])


@shared
def p_values(t):
    """A p-value-like share per account from the orders."""
    return t.table("orders").groupBy(F.col("o_custkey").alias("id"), (F.col("o_custkey") % 7).alias("family")).agg(
        F.round(F.avg("o_totalprice") / 500000.0, 10).alias("p")
    )


view("p_values", "SELECT o_custkey AS id, o_custkey % 7 AS family, round(avg(o_totalprice) / 500000.0::DOUBLE, 10) AS p FROM orders GROUP BY 1, 2")


@query("x12_benjamini_hochberg", f"""
SELECT id, family, {R('q')} AS p_adjusted, q < 0.4 AS reject FROM (
  SELECT *, least(greatest(min(a) OVER (PARTITION BY family ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING), 0), 1) AS q
  FROM (SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, id) AS a FROM p_values))""")
def x12(t):
    out = inf.benjamini_hochberg(p_values(t), "p", by=["family"], tie="id", alpha=0.4)
    return out.select("id", "family", rnd("p_adjusted").alias("p_adjusted"), "reject")


@query("x13_holm", f"""
SELECT id, family, {R('max(a) OVER (PARTITION BY family, ok ORDER BY p, id ROWS UNBOUNDED PRECEDING)')} AS p_holm
FROM (SELECT *, TRUE AS ok, least((count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1) * p / 100, 1.0) AS a FROM p_values)""")
def x13(t):
    out = inf.holm(p_values(t).withColumn("p", F.col("p") / 100), "p", by=["family"], tie="id")
    return out.select("id", "family", rnd("p_holm").alias("p_holm"))


@query("x14_inference_report")
def x14(t):
    out = inf.report(t.cell_returns, order="m", unit="cell", value="r", n_trials=64, B=B_MANY)
    return rounded(out, ["cell", "n", "over_hurdle", "survives", "reject"], ["sharpe", "se", "t", "p", "deflated_p", "expected_max", "p_adjusted"])


HORIZONS = {"r_1m": 1, "r_3m": 3, "r_6m": 6, "r_12m": 12}
_LATER = [n for n in HORIZONS.values() if n > 1]
view("fwd", f"""
  SELECT p.m, p.sec_id, s.sig_disc, s.sig_tax, s.sig_vol, s.sig_mom, s.sig_size, {', '.join(HORIZONS)} FROM (
    SELECT sec_id, m, CASE WHEN lead(mi) OVER w = mi + 1 THEN lead(ret) OVER w END AS r_1m, {', '.join(f"CASE WHEN count(ret) OVER a{n} = {n} THEN sum(ret) OVER a{n} END AS r_{n}m" for n in _LATER)}
    FROM (SELECT *, year(m) * 12 + month(m) AS mi FROM panel)
    WINDOW w AS (PARTITION BY sec_id ORDER BY m), {', '.join(f"a{n} AS (PARTITION BY sec_id ORDER BY mi RANGE BETWEEN 1 FOLLOWING AND {n} FOLLOWING)" for n in _LATER)}) p
  JOIN signals s ON p.sec_id = s.sec_id AND p.m = s.m""")
view("fwd_long", "SELECT * FROM (UNPIVOT (SELECT * FROM fwd) ON sig_disc, sig_tax, sig_vol, sig_mom, sig_size INTO NAME signal VALUE value)")
for _n in HORIZONS.values():
    spearman_view(f"ic_{_n}m", "fwd_long", ["signal", "m"], "value", f"r_{_n}m", 6)
view("fwd_pairs", """
  SELECT signal, m, value, CASE WHEN lag(i) OVER w = i - 1 THEN lag(value) OVER w END AS prev FROM (SELECT *, dense_rank() OVER (ORDER BY m) AS i FROM fwd_long) WINDOW w AS (PARTITION BY signal, sec_id ORDER BY i)""")
spearman_view("ic_auto", "fwd_pairs", ["signal", "m"], "value", "prev", 2)


_POINTS = "list_filter([{'h': 1, 'v': mean_ic}, " + ", ".join(f"{{'h': {n}, 'v': i{n}}}" for n in _LATER) + "], lambda p: p.v > 0)"


@query("x15_signal_quality", f"""
SELECT *, CASE WHEN len(points) >= 2 THEN list_filter(points[2:], lambda p: p.v <= points[1].v / 2)[1].h::DOUBLE END AS half_life FROM (
  SELECT h.signal, h.n, {R('mean_ic')} AS mean_ic, {R('sd')} AS ic_sd, {R('mean_ic / sd * sqrt(12)')} AS icir, {R('mean_ic / se_ic')} AS nw_t, {R('ac')} AS autocorr_1m, {R('1 - ac')} AS implied_turnover,
         {R('mean_ic')} AS ic_r_1m, {', '.join(f"{R(f'i{n}')} AS ic_r_{n}m" for n in _LATER)}, {_POINTS} AS points
  FROM ({hac_sql('(SELECT * FROM ic_1m WHERE ic IS NOT NULL)', ['signal'], 'm', {'ic': 'ic'})}) h JOIN (SELECT signal, stddev_samp(ic) AS sd FROM ic_1m GROUP BY 1) s ON h.signal = s.signal
  JOIN (SELECT signal, avg(ic) AS ac FROM ic_auto GROUP BY 1) a ON h.signal = a.signal {' '.join(f"JOIN (SELECT signal, avg(ic) AS i{n} FROM ic_{n}m GROUP BY 1) t{n} ON h.signal = t{n}.signal" for n in _LATER)})""".replace("SELECT *,", "SELECT * EXCLUDE (points),", 1))
def x15(t):
    fwd = xs.forward_returns(t.signals.select("sec_id", "m", "ret", *SIGNALS), id="sec_id", month="m", ret="ret")
    out = st.signal_quality(fwd, SIGNALS, id="sec_id", month="m", target="r_1m", horizons=HORIZONS)
    return rounded(out, ["signal", "n", "half_life"], ["mean_ic", "ic_sd", "icir", "nw_t", "autocorr_1m", "implied_turnover", *(f"ic_{h}" for h in HORIZONS)])


def _pair_corr():
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{c}"
    complete = " AND ".join(f"{s} IS NOT NULL" for s in SIGNALS)
    theme = {s: k for k, names in THEMES.items() for s in names}
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, '{theme[a]}' AS theme, {str(theme[a] == theme[b]).upper()} AS same, corr(r_{a}, r_{b}) AS c FROM rk" for a in SIGNALS for b in SIGNALS
    )
    return f"WITH rk AS (SELECT {', '.join(rank(s) for s in SIGNALS)} FROM signals WHERE {complete}), cm AS ({pairs})"


@query("x16_signal_redundancy", _pair_corr() + f"""
SELECT 'ALL' AS theme, count(DISTINCT a) AS n_signals, {R('pow(count(DISTINCT a), 2) / sum(c * c)')} AS effective_n, {R('avg(CASE WHEN a < b AND same THEN abs(c) END)')} AS within, {R('avg(CASE WHEN a < b AND NOT same THEN abs(c) END)')} AS across FROM cm
UNION ALL SELECT theme, count(DISTINCT a), {R('pow(count(DISTINCT a), 2) / sum(c * c)')}, {R('avg(CASE WHEN a < b THEN abs(c) END)')}, NULL FROM cm WHERE same GROUP BY theme HAVING count(DISTINCT a) > 1""")
def x16(t):
    return rounded(st.redundancy(t.signals, SIGNALS, THEMES, key=["sec_id", "m"]), ["theme", "n_signals"], ["effective_n", "within", "across"])


view("levels", """
  SELECT *, CASE WHEN substr(cell, 1, 1) = 'N' THEN 1 ELSE -1 END AS f1, CASE WHEN substr(cell, 3, 1) = 'C' THEN 1 ELSE -1 END AS f2,
         CASE WHEN substr(cell, 5, 1) = 'E' THEN 1 ELSE -1 END AS f3, CASE WHEN substr(cell, 7, 1) = 'U' THEN 1 ELSE -1 END AS f4 FROM cell_returns""")


def _terms():
    from itertools import combinations

    out = []
    for k in range(1, 5):
        for combo in combinations(inf.FACTORS, k):
            out.append(f"SELECT '{' x '.join(combo)}' AS term, {k} AS ord, m, sum({' * '.join(combo)} * r / 8.0::DOUBLE) AS x FROM levels GROUP BY m")
    return "(" + " UNION ALL ".join(out) + ")"


_EFFECTS = f"SELECT term, ord, n, mean_x, se_x FROM ({hac_sql(_terms(), ['term', 'ord'], 'm', {'x': 'x'})})"


@query("x17_factorial_effects", f"""SELECT term, CAST(ord AS INTEGER) AS "order", {R('mean_x', 8)} AS estimate, {R('se_x', 8)} AS se, {R('mean_x / se_x', 5)} AS t, {R('mean_x * 12', 7)} AS annualised, n AS months FROM ({_EFFECTS})""")
def x17(t):
    out = inf.factorial_effects(t.cell_returns, order="m", cell="cell", value="r")
    return out.select("term", "order", rnd("estimate", 8).alias("estimate"), rnd("se", 8).alias("se"), rnd("t", 5).alias("t"), rnd("annualised", 7).alias("annualised"), "months")


def _shapley_sql():
    """Average marginal value over all 24 orders, step by step."""
    from itertools import permutations

    rows = []
    for order in permutations(inf.FACTORS):
        for i, f in enumerate(order):
            rows.append(f"('{f}', '{''.join(sorted(order[:i]))}', '{''.join(sorted(order[:i + 1]))}')")
    on = "concat(CASE WHEN f1 = 1 THEN 'f1' ELSE '' END, CASE WHEN f2 = 1 THEN 'f2' ELSE '' END, CASE WHEN f3 = 1 THEN 'f3' ELSE '' END, CASE WHEN f4 = 1 THEN 'f4' ELSE '' END)"
    return f"""(WITH val AS (SELECT {on} AS s, avg(r) AS v FROM levels GROUP BY 1)
      SELECT o.factor, sum(b.v - a.v) / 24 AS shapley FROM (VALUES {', '.join(rows)}) AS o(factor, s0, s1) JOIN val a ON a.s = o.s0 JOIN val b ON b.s = o.s1 GROUP BY 1)"""


@query("x18_shapley_attribution", f"""SELECT factor, {R('shapley', 8)} AS shapley, {R('shapley * 12', 7)} AS annualised, {R('shapley / sum(shapley) OVER ()', 4)} AS share FROM {_shapley_sql()}""")
def x18(t):
    out = inf.shapley_attribution(t.cell_returns, order="m", cell="cell", value="r")
    return out.select("factor", rnd("shapley", 8).alias("shapley"), rnd("annualised", 7).alias("annualised"), rnd("share", 4).alias("share"))


@query("x19_attribution_report", f"""
SELECT 'cell' AS section, cell AS name, {R('avg(r) * 12', 7)} AS value, {R('avg(r) / stddev_samp(r) * sqrt(12)', 5)} AS t FROM cell_returns GROUP BY 2
UNION ALL SELECT 'effect', term, {R('mean_x * 12', 7)}, {R('mean_x / se_x', 5)} FROM ({_EFFECTS})
UNION ALL SELECT 'shapley', factor, {R('shapley * 12', 7)}, NULL FROM {_shapley_sql()}
UNION ALL SELECT 'balance', 'months_dropped', CAST(count(*) FILTER (c < 16) AS DOUBLE), NULL FROM (SELECT m, count(*) AS c FROM cell_returns GROUP BY 1)""")
def x19(t):
    out = inf.attribution_report(t.cell_returns, order="m", cell="cell", value="r")
    return out.select("section", "name", rnd("value", 7).alias("value"), rnd("t", 5).alias("t"))


view("comp", """
  SELECT aum, m, avg(gross_ret) AS gross_ret, avg(net_ret_uncapped) AS net_ret_uncapped, avg(gross_ret_capped) AS gross_ret_capped, avg(net_ret_capped) AS net_ret_capped
  FROM ladder GROUP BY 1, 2 HAVING count(*) = 2""")


@query("x20_composite", f"SELECT aum, m, {rsql(['gross_ret', 'net_ret_uncapped', 'gross_ret_capped', 'net_ret_capped'])} FROM comp")
def x20(t):
    cols = ["gross_ret", "net_ret_uncapped", "gross_ret_capped", "net_ret_capped"]
    return rounded(inf.composite(ladder(t), by=["aum"], order="m", unit="cell", values=cols), ["aum", "m"], cols)


view("capacity", f"""
  SELECT s.*, q.months, gross_forgone, cost_saved, CASE WHEN solvent THEN wealth_capped END AS wealth_capped, CASE WHEN solvent THEN b.stat END AS B, CASE WHEN solvent THEN b.se END AS se, CASE WHEN solvent THEN b.p END AS p
  FROM (SELECT aum, min(net_ret_uncapped) AS min_uncapped, min(net_ret_capped) AS min_capped, count(DISTINCT CASE WHEN net_ret_uncapped <= -1 THEN cell END) AS cells_wiped,
               min(CASE WHEN net_ret_uncapped <= -1 THEN m END) AS first_wipeout, min(net_ret_uncapped) > -1 AND min(net_ret_capped) > -1 AS solvent FROM ladder GROUP BY 1) s
  JOIN (SELECT aum, count(*) AS months, 12 * avg(gross_ret_capped - gross_ret) AS gross_forgone, 12 * avg((gross_ret - net_ret_uncapped) - (gross_ret_capped - net_ret_capped)) AS cost_saved,
               product(1 + net_ret_capped) AS wealth_capped FROM comp GROUP BY 1) q ON s.aum = q.aum
  JOIN ({mean_diff_sql('comp', ['aum'], 'm', 'net_ret_capped', 'net_ret_uncapped')}) b ON s.aum = b.aum""")


@query("x21_capacity_effect", f"""
SELECT aum, months, solvent, cells_wiped, first_wipeout, {rsql(['min_uncapped', 'min_capped', 'gross_forgone', 'cost_saved', 'wealth_capped', 'B', 'se', 'p'], 5)},
       {R('CASE WHEN p IS NOT NULL THEN max(least((count(p) OVER (PARTITION BY solvent) - r + 1) * p, 1.0)) OVER (PARTITION BY solvent ORDER BY r) END', 5)} AS p_holm
FROM (SELECT *, row_number() OVER (PARTITION BY solvent ORDER BY p, aum) AS r FROM capacity)""".replace("max(least((count(p) OVER (PARTITION BY solvent) - r + 1) * p, 1.0)) OVER (PARTITION BY solvent ORDER BY r)", "hm").replace(
    "FROM (SELECT *, row_number()", "FROM (SELECT *, max(a) OVER (PARTITION BY solvent ORDER BY r) AS hm FROM (SELECT *, least((count(p) OVER (PARTITION BY solvent) - r + 1) * p, 1.0) AS a FROM (SELECT *, row_number()") + "))")
def x21(t):
    l = ladder(t).withColumn("g", F.lit(1))  # noqa: E741
    out = st.capacity_effect(l, by=["g"], month="m", cell="cell", B=B).withColumn("wealth_capped", F.when(F.col("solvent"), F.col("wealth_capped")))
    return rounded(out, ["aum", "months", "solvent", "cells_wiped", "first_wipeout"], ["min_uncapped", "min_capped", "gross_forgone", "cost_saved", "wealth_capped", "B", "se", "p", "p_holm"], 5)


@query("x22_tier_reconciliation", f"""
SELECT a.aum, a.cell, {R('ta')} AS tier_a, {R('tb')} AS tier_b, {R('tb - ta')} AS difference, sign(ta) = sign(tb) AS same_sign
FROM (SELECT aum, cell, 12 * avg(net_ret_uncapped) AS ta FROM ladder WHERE aum = 1e5 GROUP BY 1, 2) a
JOIN (SELECT 1e5::DOUBLE AS aum, cell, 12 * avg(net_ret) AS tb FROM accounts GROUP BY 2) b ON a.aum = b.aum AND a.cell = b.cell""")
def x22(t):
    a = ladder(t).filter("aum = 100000.0").groupBy("aum", "cell").agg((12 * F.avg("net_ret_uncapped")).alias("v"))
    b = accounts(t).groupBy(F.lit(1e5).alias("aum"), "cell").agg((12 * F.avg("net_ret")).alias("v"))
    return rounded(st.tier_reconcile(a, b, on=["aum", "cell"], value="v"), ["aum", "cell", "same_sign"], ["tier_a", "tier_b", "difference"])


def zero_sql(source: str, by: list[str]) -> str:
    keys = ", ".join(by)
    part = f"PARTITION BY {keys}" if by else ""
    grp = f"GROUP BY {keys}" if by else ""
    return f"""SELECT {keys + ', ' if by else ''}min_by(z, CASE WHEN z IS NOT NULL THEN aum END) AS z FROM (
      SELECT *, CASE WHEN sign(c) <> sign(lead(c) OVER w) AND sign(c) <> 0 THEN log10(aum) - c / (lead(c) OVER w - c) * (log10(lead(aum) OVER w) - log10(aum)) END AS z
      FROM (SELECT {keys + ', ' if by else ''}aum, avg(net_ret_capped) / stddev_samp(net_ret_capped) * sqrt(12) - avg(net_ret_uncapped) / stddev_samp(net_ret_uncapped) * sqrt(12) AS c FROM {source} GROUP BY {keys + ', ' if by else ''}aum)
      WINDOW w AS ({part} ORDER BY aum)) {grp}"""


@query("x23_crossover_size", f"""
SELECT {R('p.z', 5)} AS point_log10, count(*) AS n_boot, {R('1 - count(d.z) / count(*)')} AS no_crossover, {R('CASE WHEN count(d.z) >= 50 THEN quantile_cont(d.z, 0.025) END', 5)} AS ci_low_log10,
       {R('CASE WHEN count(d.z) >= 50 THEN quantile_cont(d.z, 0.975) END', 5)} AS ci_high_log10
FROM ({zero_sql('(' + resample_sql('comp', ['aum'], 'm', ['net_ret_capped', 'net_ret_uncapped'], B) + ')', ['b'])}) d, ({zero_sql('comp', [])}) p GROUP BY p.z""")
def x23(t):
    comp = inf.composite(ladder(t), by=["aum"], order="m", unit="cell", values=["net_ret_capped", "net_ret_uncapped"]).withColumn("g", F.lit(1))
    out = st.crossover(comp, by=["g"], month="m", B=B)
    return out.select(rnd("point_log10", 5).alias("point_log10"), "n_boot", rnd("no_crossover").alias("no_crossover"), rnd("ci_low_log10", 5).alias("ci_low_log10"), rnd("ci_high_log10", 5).alias("ci_high_log10"))


_CELLS_AND_COMP = "(SELECT aum, cell, m, net_ret_capped, net_ret_uncapped FROM ladder UNION ALL SELECT aum, 'COMPOSITE', m, net_ret_capped, net_ret_uncapped FROM comp)"


@query("x24_capacity_channel", f"""
SELECT aum, cell, level, n, {rsql(['stat', 'se', 't', 'p'], 5)}, {R('max(a) OVER (PARTITION BY level ORDER BY r)', 5)} AS p_holm FROM (
  SELECT *, least((count(*) OVER (PARTITION BY level) - r + 1) * p, 1.0) AS a FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY p, k) AS r FROM (
    SELECT *, CASE WHEN cell = 'COMPOSITE' THEN 'composite' ELSE 'cell' END AS level, CASE aum WHEN 1e4 THEN '10000.0' WHEN 1e5 THEN '100000.0' WHEN 1e6 THEN '1000000.0' ELSE '1.0E7' END || '|' || cell AS k
    FROM ({sharpe_diff_sql(_CELLS_AND_COMP, ['aum', 'cell'], 'm', 'net_ret_capped', 'net_ret_uncapped')}))))""")
def x24(t):
    out = st.capacity_channel(ladder(t), by=[], month="m", cell="cell", B=B)
    return rounded(out, ["aum", "cell", "level", "n"], ["stat", "se", "t", "p", "p_holm"], 5)


@query("x25_friction_table", f"""
SELECT aum, count(*) AS months, {R('avg(gross_ret) * 120000', 3)} AS gross_bps, {R('avg(gross_ret - net_ret_uncapped) * 120000', 3)} AS cost_drag_bps, {R('avg(gross_ret - gross_ret_capped) * 120000', 3)} AS capacity_drag_bps,
       {R('sqrt(12) * (avg(net_ret_uncapped) / stddev_samp(net_ret_uncapped) - avg(gross_ret) / stddev_samp(gross_ret))', 5)} AS cost_channel,
       {R('sqrt(12) * (avg(net_ret_capped) / stddev_samp(net_ret_capped) - avg(net_ret_uncapped) / stddev_samp(net_ret_uncapped))', 5)} AS capacity_channel FROM comp GROUP BY 1""")
def x25(t):
    out = st.friction_table(ladder(t), by=[], month="m", cell="cell")
    return out.select("aum", "months", *[rnd(c, 3).alias(c) for c in ("gross_bps", "cost_drag_bps", "capacity_drag_bps")], *[rnd(c, 5).alias(c) for c in ("cost_channel", "capacity_channel")])


_AXES = "(" + " UNION ALL ".join(f"SELECT '{f}' AS axis, m, avg(CASE WHEN {f} = 1 THEN r END) AS o, avg(CASE WHEN {f} = -1 THEN r END) AS f FROM levels GROUP BY m" for f in inf.FACTORS) + ")"


@query("x28_design_axis_tests", f"""
SELECT axis, n, {rsql(['stat', 'se', 't', 'p'], 5)}, {R('max(a) OVER (ORDER BY r)', 5)} AS p_holm FROM (
  SELECT *, least((count(*) OVER () - r + 1) * p, 1.0) AS a FROM (SELECT *, row_number() OVER (ORDER BY p, axis) AS r FROM ({sharpe_diff_sql(_AXES, ['axis'], 'm', 'o', 'f')})))""")
def x28(t):
    out = st.axis_tests(t.cell_returns, by=[], month="m", cell="cell", value="r", B=B)
    return rounded(out, ["axis", "n"], ["stat", "se", "t", "p", "p_holm"], 5)


@query("x28_power_table")
def x28_power(t):
    tests = st.axis_tests(t.cell_returns, by=[], month="m", cell="cell", value="r", B=B)
    return rounded(st.power_table(tests, [0.25, 0.5, 1.0]), ["axis", "n", "effect"], ["se", "power"], 5)


def _theme_sql(t: str) -> str:
    return f"CASE WHEN {' + '.join(f'(CASE WHEN o_{s} IS NULL THEN 0 ELSE 1 END)' for s in THEMES[t])} > 0 THEN ({' + '.join(f'coalesce(o_{s}, 0)' for s in THEMES[t])}) / ({' + '.join(f'(CASE WHEN o_{s} IS NULL THEN 0 ELSE 1 END)' for s in THEMES[t])}) END"


view("early_long", f"SELECT * FROM (UNPIVOT (SELECT sec_id, m, ret_next, {', '.join(SIGNALS)} FROM signals WHERE m < DATE '1997-01-31') ON {', '.join(SIGNALS)} INTO NAME signal VALUE value)")
spearman_view("ic_before", "early_long", ["signal", "m"], "value", "ret_next", 30)
view("signs", "SELECT signal, CASE WHEN avg(ic) < 0 THEN -1 ELSE 1 END AS sign FROM ic_before GROUP BY 1")
view("oriented", f"""
  SELECT sec_id, m, ret_next, adv_usd, {', '.join(f"{s} * coalesce((SELECT sign FROM signs WHERE signal = '{s}'), 1) AS o_{s}" for s in SIGNALS)}
  FROM signals WHERE m >= DATE '1997-01-31' AND ret_next IS NOT NULL AND adv_usd > 0""")
view("terciles", """
  SELECT * FROM (SELECT *, CASE WHEN 3 * (r - 1) <= n - 1 THEN 1 WHEN 3 * (r - 1) <= 2 * (n - 1) THEN 2 ELSE 3 END AS bin FROM (
    SELECT *, row_number() OVER (PARTITION BY m ORDER BY adv_usd, sec_id) AS r, count(*) OVER (PARTITION BY m) AS n FROM oriented)) WHERE n >= 30""")
view("themed", " UNION ALL ".join(f"SELECT 'theme_{t}' AS theme, bin, m, sec_id, ret_next, {_theme_sql(t)} AS score FROM terciles" for t in THEMES))
view("tercile_spreads", """
  SELECT theme, bin, m, CASE WHEN any_value(n) >= 2 * any_value(k) + 2 THEN avg(CASE WHEN r >= n - k + 1 THEN ret_next END) - avg(CASE WHEN r <= k THEN ret_next END) END AS s FROM (
    SELECT *, greatest(floor(n * 0.1::DOUBLE), 1) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY theme, bin, m ORDER BY score, sec_id) AS r, count(*) OVER (PARTITION BY theme, bin, m) AS n FROM themed WHERE score IS NOT NULL)) GROUP BY 1, 2, 3""")
view("tercile_pairs", "SELECT theme, m, max(CASE WHEN bin = 1 THEN s END) AS illiquid, max(CASE WHEN bin = 3 THEN s END) AS liquid FROM tercile_spreads GROUP BY 1, 2")


@query("x29_theme_liquidity_terciles", f"""
SELECT theme, n, {rsql(['stat', 'se', 't', 'p'], 5)}, {R('max(a) OVER (ORDER BY r)', 5)} AS p_holm FROM (
  SELECT *, least((count(*) OVER () - r + 1) * p, 1.0) AS a FROM (SELECT *, row_number() OVER (ORDER BY p, theme) AS r FROM ({sharpe_diff_sql('tercile_pairs', ['theme'], 'm', 'illiquid', 'liquid')})))""")
def x29(t):
    signs = xs.orient(t.signals, SIGNALS, by="m", target="ret_next", cutoff="1997-01-31", min_n=30)
    later = t.signals.filter("m >= DATE '1997-01-31' AND ret_next IS NOT NULL").filter(F.col("adv_usd") > 0)
    out = st.theme_liquidity(later, THEMES, signs, id="sec_id", month="m", ret="ret_next", liquidity="adv_usd", B=B)
    return rounded(out, ["theme", "n"], ["stat", "se", "t", "p", "p_holm"], 5)


view("design_cells", """
  SELECT r.r_name AS country, CASE WHEN l_partkey & 1 = 1 THEN 'N' ELSE 'L' END || '-' || CASE WHEN l_partkey & 2 = 2 THEN 'C' ELSE 'S' END || '-' || CASE WHEN l_partkey & 4 = 4 THEN 'E' ELSE 'P' END || '-' || CASE WHEN l_partkey & 8 = 8 THEN 'U' ELSE '0' END AS cell,
         year(l_shipdate) AS y, avg(l_quantity) / 50 AS turnover, avg(l_discount) AS gross, avg(l_tax) AS tax, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS lt, count(*) AS n
  FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
view("wedge_cells", "SELECT country, cell, sum(turnover * n) / sum(n) AS turnover, sum(gross * n) / sum(n) AS gross, sum(tax * n) / sum(n) AS tax, sum(lt * n) / sum(n) AS lt FROM design_cells GROUP BY 1, 2")


@shared
def design_cells(t):
    """Country x design cell x year accounts."""
    bit = lambda b, on, off: F.when(F.col("l_partkey").bitwiseAND(b) == b, on).otherwise(off)
    cell = F.concat_ws("-", bit(1, "N", "L"), bit(2, "C", "S"), bit(4, "E", "P"), bit(8, "U", "0"))
    li = t.table("lineitem").join(t.securities, F.col("l_suppkey") == F.col("sec_id"))
    return t.stage("design_cells", li.groupBy("country", cell.alias("cell"), F.year("l_shipdate").alias("y")).agg(
        (F.avg("l_quantity") / 50).alias("turnover"), F.avg("l_discount").alias("gross"), F.avg("l_tax").alias("tax"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("lt"), F.count(F.lit(1)).alias("n"),
    ))


def slope_sql(y, x, extra=None):
    src = f"(SELECT country, {y} AS y, {x} AS x{f', {extra} AS z' if extra else ''} FROM wedge_cells)"
    k = 2
    if extra:
        src = f"""(SELECT s.country, y - cy - sy * z AS y, x - cx - sx * z AS x FROM {src} s JOIN (SELECT country, regr_slope(y, z) AS sy, regr_intercept(y, z) AS cy, regr_slope(x, z) AS sx, regr_intercept(x, z) AS cx FROM {src} GROUP BY 1) c ON s.country = c.country)"""
        k = 3
    return f"""SELECT s.country, n, slope, sqrt(sum(pow((x - mx) * (y - c - slope * x), 2)) / (sxx * sxx) * n / (n - {k})) AS se FROM {src} s
      JOIN (SELECT country, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS c, regr_sxx(y, x) AS sxx, avg(x) AS mx FROM {src} GROUP BY 1) f ON s.country = f.country GROUP BY s.country, n, slope, sxx"""


@query("x31_wedge_slopes", f"""
SELECT 'lt_share' AS test, country, n, {R('slope', 5)} AS slope, {R('se', 5)} AS se, {R('slope / se', 5)} AS t FROM ({slope_sql('lt', 'turnover')})
UNION ALL SELECT 'tax_level', country, n, {R('slope', 5)}, {R('se', 5)}, {R('slope / se', 5)} FROM ({slope_sql('tax', 'turnover', 'gross')})""")
def x31(t):
    wm = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    cells = design_cells(t).groupBy("country", "cell").agg(*[wm(c) for c in ("turnover", "gross", "tax", "lt")])
    a = st.hc1_slope(cells, by=["country"], y="lt", x="turnover").withColumn("test", F.lit("lt_share"))
    b = st.hc1_slope(cells, by=["country"], y="tax", x="turnover", extra="gross").withColumn("test", F.lit("tax_level"))
    return rounded(a.unionByName(b), ["test", "country", "n"], ["slope", "se", "t"], 5)


def _passes(source: str, n: int) -> str:
    """CTEs p0 … pn: columns v, x1, x2 of ``source`` less their means by cell and by year, over and over."""
    less = lambda c, key: f"{c} - avg({c}) OVER (PARTITION BY country, {key}) AS {c}"
    step = lambda key, of: f"SELECT country, cell, y, {', '.join(less(c, key) for c in ('v', 'x1', 'x2'))} FROM {of}"
    steps = [f"p0 AS (SELECT country, cell, y, v, x1, x2 FROM {source})"]
    return ",\n".join(steps + [f"p{i} AS ({step('y', '(' + step('cell', f'p{i - 1}') + ')')})" for i in range(1, n + 1)])


@query("x32_difference_in_differences", f"""
WITH a AS (SELECT country, cell, y, tax AS v, turnover - avg(turnover) OVER (PARTITION BY country) AS x2, CASE WHEN y >= 1999 THEN 1.0 ELSE 0.0 END::DOUBLE AS post FROM design_cells),
b AS (SELECT *, post * x2 AS x1 FROM a),
{_passes('b', 25)},
d AS (SELECT * FROM p25),
m AS (SELECT *, a11 * a22 - a12 * a12 AS det, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS beta, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS gam FROM (
  SELECT country, sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1 * v) AS b1, sum(x2 * v) AS b2, count(*) AS n, count(DISTINCT cell) AS units, count(DISTINCT y) AS times FROM d GROUP BY 1)),
e AS (SELECT d.*, v - beta * x1 - gam * x2 AS e, a22, a12, det FROM d JOIN m ON d.country = m.country),
vt AS (SELECT country, sum(pow((a22 * s1 - a12 * s2) / det, 2)) AS v FROM (SELECT country, y, a22, a12, det, sum(x1 * e) AS s1, sum(x2 * e) AS s2 FROM e GROUP BY ALL) GROUP BY 1),
vu AS (SELECT country, sum(pow((a22 * s1 - a12 * s2) / det, 2)) AS v FROM (SELECT country, cell, a22, a12, det, sum(x1 * e) AS s1, sum(x2 * e) AS s2 FROM e GROUP BY ALL) GROUP BY 1)
SELECT m.country, n, units, times, {R('beta', 5)} AS beta, {R('sqrt(vt.v * times / (times - 1) * (n - 1) / (n - (1 + units + times)))', 5)} AS se_time, {R('sqrt(vu.v * units / (units - 1) * (n - 1) / (n - (1 + units + times)))', 5)} AS se_unit
FROM m JOIN vt ON m.country = vt.country JOIN vu ON m.country = vu.country""")
def x32(t):
    rows = design_cells(t).withColumn("post", F.col("y") >= 1999)
    out = st.did_twfe(rows, by=["country"], unit="cell", time="y", y="tax", x="turnover", post="post")
    return rounded(out, ["country", "n", "units", "times"], ["beta", "se_time", "se_unit"], 5)


@query("x32_unbalanced_panel", f"""
WITH thick AS (SELECT * FROM design_cells QUALIFY n >= 0.95 * avg(n) OVER (PARTITION BY country, y)),
a AS (SELECT *, CASE WHEN y >= 1999 THEN 1.0 ELSE 0.0 END::DOUBLE * x2 AS x1 FROM (SELECT country, cell, y, tax AS v, turnover - avg(turnover) OVER (PARTITION BY country) AS x2 FROM thick)),
{_passes('a', 25)},
m AS (SELECT *, a11 * a22 - a12 * a12 AS det, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS beta, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS gam FROM (
  SELECT country, sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1 * v) AS b1, sum(x2 * v) AS b2, count(*) AS n, count(DISTINCT cell) AS units, count(DISTINCT y) AS times FROM p25 GROUP BY 1)),
e AS (SELECT d.*, v - beta * x1 - gam * x2 AS e, a22, a12, det FROM p25 d JOIN m ON d.country = m.country),
vt AS (SELECT country, sum(pow((a22 * s1 - a12 * s2) / det, 2)) AS v FROM (SELECT country, y, a22, a12, det, sum(x1 * e) AS s1, sum(x2 * e) AS s2 FROM e GROUP BY ALL) GROUP BY 1),
vu AS (SELECT country, sum(pow((a22 * s1 - a12 * s2) / det, 2)) AS v FROM (SELECT country, cell, a22, a12, det, sum(x1 * e) AS s1, sum(x2 * e) AS s2 FROM e GROUP BY ALL) GROUP BY 1)
SELECT m.country, n, units, times, {R('beta', 5)} AS beta, {R('sqrt(vt.v * times / (times - 1) * (n - 1) / (n - (1 + units + times)))', 5)} AS se_time, {R('sqrt(vu.v * units / (units - 1) * (n - 1) / (n - (1 + units + times)))', 5)} AS se_unit
FROM m JOIN vt ON m.country = vt.country JOIN vu ON m.country = vu.country""")
def x32_unbalanced(t):
    """Cells with few line items in a year, against the others of that year, are left out of it: a panel with gaps."""
    usual = design_cells(t).groupBy("country", "y").agg(F.avg("n").alias("usual"))
    rows = design_cells(t).join(usual, ["country", "y"]).filter("n >= 0.95 * usual").withColumn("post", F.col("y") >= 1999)
    out = st.did_twfe(rows, by=["country"], unit="cell", time="y", y="tax", x="turnover", post="post")
    return rounded(out, ["country", "n", "units", "times"], ["beta", "se_time", "se_unit"], 5)
