"""Sequential learners, and streams over replayed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import rnd
from panelmill.operators import adaptive as ad
from panelmill.plans.book_queries import rounded
from panelmill.plans.model_queries import predictions, widths
from panelmill.plans.registry import R, query, shared, view
from panelmill.plans.tax_queries import targets
from panelmill.streaming import stateful as sf


@shared
def user_days(t):
    """Daily mean value of each event type."""
    return t.stage("user_days", t.table("events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("x")))


def page_hinkley_sql(source: str, key: str, order: str, value: str, delta: float, threshold: float, burn_in: int) -> str:
    """Alarms (key, order, direction, statistic) of the test, as a recursion over the rows of each series."""
    stat = f"greatest(0, w.{{0}} + ({{1}}1) * (s.x - (w.total + s.x) / s.i) - {delta!r}::DOUBLE)"
    fall, rise = (f"CASE WHEN s.i > {burn_in} THEN {stat.format(*x)} ELSE 0 END" for x in (("fall", "-"), ("rise", "+")))
    return f"""(WITH RECURSIVE s AS (SELECT {key} AS k, {order} AS o, {value}::DOUBLE AS x, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM {source} WHERE {value} IS NOT NULL),
walk AS (SELECT DISTINCT k, 0::BIGINT AS i, NULL::DATE AS o, 0::DOUBLE AS total, 0::DOUBLE AS fall, 0::DOUBLE AS rise, 0::DOUBLE AS f, 0::DOUBLE AS r FROM s
  UNION ALL SELECT k, i, o, total, CASE WHEN hit THEN 0 ELSE f END, CASE WHEN hit THEN 0 ELSE r END, f, r FROM (
    SELECT *, f > {threshold!r}::DOUBLE OR r > {threshold!r}::DOUBLE AS hit FROM (
      SELECT s.k, s.i, s.o::DATE AS o, w.total + s.x AS total, ({fall})::DOUBLE AS f, ({rise})::DOUBLE AS r FROM walk w JOIN s ON s.k = w.k AND s.i = w.i + 1)))
SELECT k AS {key}, o AS {order}, CASE WHEN f > {threshold!r}::DOUBLE THEN 'decline' ELSE 'improvement' END AS direction, CASE WHEN f > {threshold!r}::DOUBLE THEN f ELSE r END AS statistic
FROM walk WHERE f > {threshold!r}::DOUBLE OR r > {threshold!r}::DOUBLE)"""


view("user_days", "SELECT event_type, ts::DATE AS d, avg(value) AS x FROM events GROUP BY 1, 2")
DRIFT = dict(by=["event_type"], order="d", value="x", delta=0.5, threshold=20.0, burn_in=5)


DRIFT_SQL = f"SELECT event_type, d, direction, {R('statistic')} AS statistic FROM {page_hinkley_sql('user_days', 'event_type', 'd', 'x', 0.5, 20.0, 5)}"


@query("u1_drift_batch", DRIFT_SQL)
def u1(t):
    return rounded(ad.drift(user_days(t), **DRIFT), ["event_type", "d", "direction"], ["statistic"])


@query("u1_drift_stream", DRIFT_SQL)
def u1_stream(t):
    out = sf.replay(user_days(t), lambda rows: sf.drift_stream(rows, **DRIFT), at="d")
    return rounded(out.rows, ["event_type", "d", "direction"], ["statistic"])


@query("u2_interval_scale_stream")
def u2(t):
    x = F.abs(F.col("y") - F.col("score")) / F.col("half_width")
    rows = predictions(t).join(widths(t).select("model", "m", "half_width"), ["model", "m"]).filter("y IS NOT NULL")
    monthly = t.stage("ratios", rows.groupBy("model", "m").agg(F.collect_list(x).alias("ratios")))  # one month of names, the stream's event
    out = sf.replay(monthly, lambda rows: sf.interval_scale_stream(rows, by=["model"], order="m", ratios="ratios"), at="m")
    return rounded(out.rows, ["model", "m"], ["scale", "coverage"])


@shared
def experts(t):
    return t.cell_returns.withColumn("panel", F.substring("cell", 1, 1))


@shared
def hedged(t):
    return t.stage("hedged", ad.hedge(experts(t), by=["panel"], month="m", expert="cell", reward="r", share=0.02))


#: Weights by the recursion, month after month, over lists of a panel's experts in order.
view("hedged", """
  WITH RECURSIVE axes AS (SELECT DISTINCT substring(cell, 1, 1) AS panel, m FROM cell_returns),
  grid AS (SELECT a.panel, a.m, c.cell, coalesce(r.r, 0)::DOUBLE AS r, dense_rank() OVER (PARTITION BY a.panel ORDER BY a.m) - 1 AS i
    FROM axes a JOIN (SELECT DISTINCT cell FROM cell_returns) c ON substring(c.cell, 1, 1) = a.panel LEFT JOIN cell_returns r ON r.cell = c.cell AND r.m = a.m),
  past AS (SELECT a.panel, a.i, list(b.r) AS l, median(b.r) AS mid FROM (SELECT DISTINCT panel, i FROM grid) a JOIN grid b ON b.panel = a.panel AND b.i <= a.i GROUP BY 1, 2),
  width AS (SELECT panel, i, greatest(5.9304::DOUBLE * list_median(list_transform(l, lambda x: abs(x - mid))), 1e-6::DOUBLE) AS width FROM past),
  month AS (SELECT g.panel, g.i, any_value(g.m) AS m, list(g.cell ORDER BY g.cell) AS cells, list(g.r ORDER BY g.cell) AS r,
      list(CASE WHEN g.i < 12 THEN 0.0::DOUBLE ELSE sqrt(8.0::DOUBLE * ln(k.n) / (g.i + 1)) * greatest(least(g.r / w.width, 1), -1) END ORDER BY g.cell) AS gain
    FROM grid g JOIN width w ON w.panel = g.panel AND w.i = g.i JOIN (SELECT panel, count(DISTINCT cell)::DOUBLE AS n FROM grid GROUP BY 1) k ON k.panel = g.panel GROUP BY 1, 2),
  walk AS (SELECT panel, i, list_transform(r, lambda x: 1.0::DOUBLE / len(r)) AS w FROM month WHERE i = 0
    UNION ALL SELECT panel, i + 1, list_transform(e, lambda x: 0.98::DOUBLE * x / list_sum(e) + 0.02::DOUBLE / len(e)) FROM (
      SELECT walk.panel, walk.i, list_transform(walk.w, lambda x, k: greatest(x, 1e-300::DOUBLE) * exp(month.gain[k])) AS e FROM walk JOIN month ON month.panel = walk.panel AND month.i = walk.i)
    WHERE i + 1 < (SELECT count(DISTINCT m) FROM axes a WHERE a.panel = panel))
  SELECT month.panel, month.m, unnest(month.cells) AS cell, unnest(walk.w) AS weight, unnest(month.r) AS reward FROM month JOIN walk ON walk.panel = month.panel AND walk.i = month.i""")


@query("u3_expert_weights", f"SELECT panel, m, cell, {R('weight')} AS weight, {R('reward')} AS reward FROM hedged")
def u3(t):
    return rounded(hedged(t), ["panel", "m", "cell"], ["weight", "reward"])


view("member_scores", """
  SELECT m, sec_id, 'disc' AS member, sig_disc AS score, 1.0 + month(m) % 3 AS weight FROM signals WHERE sig_disc IS NOT NULL
  UNION ALL SELECT m, sec_id, 'mom', sig_mom, 2.0 + month(m) % 2 FROM signals WHERE sig_mom IS NOT NULL""")


@query("u4_combine_members", f"SELECT m, sec_id, {R('sum(weight * score)')} AS combined, {R('avg(score)')} AS equal, count(*) AS members FROM member_scores GROUP BY 1, 2")
def u4(t):
    s = t.signals.select("m", "sec_id", F.explode(F.array(
        F.struct(F.lit("disc").alias("member"), F.col("sig_disc").alias("score")), F.struct(F.lit("mom").alias("member"), F.col("sig_mom").alias("score"))
    )).alias("s")).select("m", "sec_id", "s.*").filter("score IS NOT NULL")
    w = t.signals.select("m").distinct().select("m", F.explode(F.array(
        F.struct(F.lit("disc").alias("member"), (1.0 + F.month("m") % 3).alias("weight")), F.struct(F.lit("mom").alias("member"), (2.0 + F.month("m") % 2).alias("weight"))
    )).alias("w")).select("m", "w.*")
    return rounded(ad.combine(w, s, on=["m", "member"], id="sec_id", weight="weight", score="score"), ["m", "sec_id", "members"], ["combined", "equal"])


@query("u5_adaptation_report", f"""
WITH h AS (SELECT *, abs(weight - lag(weight) OVER (PARTITION BY panel, cell ORDER BY m)) AS dw FROM hedged),
monthly AS (SELECT panel, m, sum(weight * reward) AS agg, avg(reward) AS eq, sum(dw) / 2 AS turn, 1 / sum(weight * weight) AS eff FROM h GROUP BY 1, 2),
best AS (SELECT panel, max(total) AS best FROM (SELECT panel, cell, sum(reward) AS total FROM h GROUP BY 1, 2) GROUP BY 1)
SELECT monthly.panel, count(*) AS months, {R('sum(agg)')} AS aggregate_total, {R('sum(eq)')} AS equal_total, {R('avg(turn)')} AS weight_turnover, {R('avg(eff)')} AS effective_members, {R('any_value(best)')} AS best_total,
       {R('any_value(best) - sum(agg)')} AS regret FROM monthly JOIN best ON best.panel = monthly.panel GROUP BY 1""")
def u5(t):
    out = ad.adaptation_report(hedged(t), by=["panel"], month="m", expert="cell")
    return rounded(out, ["panel", "months"], ["aggregate_total", "equal_total", "weight_turnover", "effective_members", "best_total", "regret"])


GRID = [0.005, 0.01, 0.02, 0.03, 0.05]
#: Every cell has more than 72 months, so that the burn-in is two years.
_ALARMS = " UNION ALL ".join(f"SELECT cell, {g!r}::DOUBLE AS threshold, m FROM {page_hinkley_sql('cell_returns', 'cell', 'm', 'r', 0.0005, g, 24)}" for g in GRID)
_CELL_SIZE = "SELECT cell, count(r) AS n FROM cell_returns GROUP BY 1"


@query("u6_threshold_calibration", f"""
WITH alarms AS ({_ALARMS}), sizes AS ({_CELL_SIZE}),
rates AS (SELECT cell, threshold, 120.0::DOUBLE * count(a.m) / any_value(n) AS rate FROM sizes CROSS JOIN (SELECT unnest({GRID}::DOUBLE[]) AS threshold) LEFT JOIN alarms a USING (cell, threshold) GROUP BY 1, 2)
SELECT cell, threshold, {R('rate')} AS rate FROM rates QUALIFY row_number() OVER (PARTITION BY cell ORDER BY abs(rate - 1.0), threshold) = 1""")
def u6(t):
    return ad.calibrate_drift(t.cell_returns, by=["cell"], order="m", value="r", grid=GRID, delta=0.0005).withColumn("rate", rnd("rate"))


@query("u7_refit_schedule", f"""
SELECT c.cell, c.m, month(c.m) = 12 AS calendar_refit, e.direction IS NOT NULL AS drift_refit, e.direction, {R('e.statistic')} AS statistic
FROM cell_returns c LEFT JOIN {page_hinkley_sql('cell_returns', 'cell', 'm', 'r', 0.0005, 0.02, 24)} e ON c.cell = e.cell AND c.m = e.m""")
def u7(t):
    c = t.cell_returns
    events = ad.drift(c, by=["cell"], order="m", value="r", delta=0.0005, threshold=0.02)
    return rounded(ad.refit_schedule(c.select("cell", "m"), events, by=["cell"], month="m"), ["cell", "m", "calendar_refit", "drift_refit", "direction"], ["statistic"])


@query("u8_lots_stream")
def u8(t):
    tr = t.stage("targets", targets(t))
    bundles = max(64, tr.count() // 4000)  # positions are many and short: a call of Python takes some thousand rows
    out = sf.replay(tr, lambda rows: sf.lots_stream(rows, by=["account", "security"], date="d", target="target", growth="growth", method="fifo", bundles=bundles), at="d", parts=2)
    return rounded(out.rows, ["account", "security", "sold", "opened", "long_term"], ["gain"], 2)


WINDOW_SQL = f"""
SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS sd, max(value) AS hi, min(value) AS lo FROM events GROUP BY 1, 2"""


def finished(df):
    return df.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", rnd("mean").alias("mean"), rnd("sd").alias("sd"), "hi", "lo")


_W = WINDOW_SQL.replace("time_bucket(INTERVAL 1 DAY, ts) AS window_start", "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start")


@query("u9_window_features_batch", _W)
def u9(t):
    e = t.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return finished(sf.window_features(e, by=["event_type"], ts="ts", value="value", size="1 day"))


@query("u9_window_features_stream", _W)
def u9_stream(t):
    e = t.table("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = sf.replay(e, lambda rows: sf.window_features(rows, by=["event_type"], ts="ts", value="value", size="1 day", late="1 day"), at="ts", parts=6)
    return finished(out.rows)


@query("u9_activity_sessions", f"""
WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, value, coalesce(ts::TIMESTAMP > lag(ts::TIMESTAMP) OVER w + INTERVAL 6 HOUR, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n, {R('sum(value)')} AS total FROM s GROUP BY user_id, i""")
def u9_sessions(t):
    e = t.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = sf.sessions(e, by=["user_id"], ts="ts", value="value", gap="6 hours")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", shown("session_start"), shown("session_end"), "n", rnd("total").alias("total"))
