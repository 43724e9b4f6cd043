import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import adaptive as ad
from panelmill.operators import daily, quality
from panelmill.operators.asof import asof_join
from panelmill.plans import load
from panelmill.streaming import stateful as sf

D = dt.date
SF = "/root/testdata/sf0.001"


def edge(o, h, l, c):  # noqa: E741
    """The published estimator on one window, written directly."""
    o, h, l, c = np.log(o), np.log(h), np.log(l), np.log(c)  # noqa: E741
    m = (h + l) / 2
    h1, l1, c1, m1 = h[:-1], l[:-1], c[:-1], m[:-1]
    o, h, l, m = o[1:], h[1:], l[1:], m[1:]  # noqa: E741
    r1, r2, r3, r4, r5 = m - o, o - m1, m - c1, c1 - m1, o - c1
    tau = ((h != l) | (l != c1)).astype(float)
    po, pc = (tau * (o != h)).mean() + (tau * (o != l)).mean(), (tau * (c1 != h1)).mean() + (tau * (c1 != l1)).mean()
    if tau.sum() < 2 or po == 0 or pc == 0:
        return np.nan
    d1, d3, d5 = (r - r.mean() / tau.mean() * tau for r in (r1, r3, r5))
    x1, x2 = -4 / po * d1 * r2 - 4 / pc * d3 * r4, -4 / po * d1 * r5 - 4 / pc * d5 * r4
    v1, v2 = x1.var(), x2.var()
    s2 = (v2 * x1.mean() + v1 * x2.mean()) / (v1 + v2) if v1 + v2 > 0 else (x1.mean() + x2.mean()) / 2
    return np.sqrt(abs(s2))


def test_edge_spread(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(3):
        px = 100.0
        for i in range(60):
            o, c = px * np.exp(rng.normal(0, 0.01)), px * np.exp(rng.normal(0, 0.02))
            hi, lo = max(o, c) * np.exp(abs(rng.normal(0, 0.005))), min(o, c) * np.exp(-abs(rng.normal(0, 0.005)))
            rows.append((s, D(2000, 1, 1) + dt.timedelta(days=i), "AAA" if i < 45 else "BBB", o, hi, lo, c))
            px = c
    df = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows], "s int, d date, cur string, o double, h double, l double, c double")
    got = {(r["s"], r["d"]): r for r in daily.edge_spread(df, keys=["s"], date="d", currency="cur", open="o", high="h", low="l", close="c").collect()}
    pdf = df.toPandas()
    for (s, cur), g in pdf.groupby(["s", "cur"]):
        g = g.sort_values("d").reset_index(drop=True)
        for i in (2, 10, len(g) - 1):
            w = g.iloc[max(0, i - 20) : i + 1]
            want = edge(*(w[k].to_numpy() for k in "ohlc"))
            assert got[(s, g["d"][i])]["edge_any"] == pytest.approx(want, rel=1e-6)
        assert (got[(s, g["d"].iloc[-1])]["edge_strict"] is None) == (len(g) < 21)


def test_segments_restart_at_currency_change(spark):
    df = spark.createDataFrame([(1, D(2000, 1, i + 1), c) for i, c in enumerate(["A", "A", "B", None, None, "A"])], "s int, d date, cur string")
    out = daily.currency_segments(df, keys=["s"], date="d", currency="cur").orderBy("d").collect()
    assert [r["segment"] for r in out] == [1, 1, 2, 3, 3, 4]


def test_prefix_truncation(spark):
    """Features up to a month do not change when later rows are removed."""
    reg = load()
    t = reg.market(spark, SF)
    cols = ["sec_id", "m", "obs_21", "sigma_21", "adv_21"]
    full = t.features.filter("m <= DATE '1998-06-30'").select(*cols)
    px = t.daily_px.filter("d <= DATE '1998-06-30'").select("country", "sec_id", "d", "cur", "cl", "hi", "lo", "notional")
    rolled = daily.rolling_features(
        daily.daily_returns(px, keys=["sec_id"], date="d", currency="cur", price="cl", high="hi", low="lo"), keys=["sec_id"], date="d",
        counts={"obs_21": None}, sds={"sigma_21": "ret"}, means={"adv_21": "notional"},
    )
    cut = daily.month_endpoint(rolled, keys=["sec_id"], date="d").select(*cols)
    a, b = (d.toPandas().sort_values(["sec_id", "m"]).reset_index(drop=True) for d in (full, cut))
    pd.testing.assert_frame_equal(a, b)


def test_expanding_z_flags_gaps(spark):
    x = [float(v) for v in np.random.default_rng(2).normal(size=40)]
    x[33] = None
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(x)], "k string, i int, x double")
    out = daily.lagged_expanding_z(df, keys=["k"], date="i", value="x").orderBy("i").collect()
    s = pd.Series(x).shift(1)
    want = ((s - s.expanding(24).mean()) / s.expanding(24).std()).clip(-5, 5)
    assert [r["gap"] for r in out] == [i == 34 for i in range(40)]
    assert np.allclose([r["z"] for r in out], want.fillna(0.0))


def test_contract_violations(spark):
    df = spark.createDataFrame([(D(2000, 1, 31), 1, True, None, 5.0, 1, 3, 50.0), (D(2000, 1, 30), 2, False, -1.0, 5.0, 1, 99, 150.0), (D(2000, 1, 31), 1, False, 2.0, 5.0, 1, 3, 50.0)],
                               "date date, permno long, in_universe boolean, me double, price double, exchcd int, ff49 int, nyse_size_pct double")
    got = {(r["rule"], r["column"]): r["n"] for r in quality.violations(df, "universe").collect()}
    assert got == {("below_minimum", "me"): 1, ("above_maximum", "nyse_size_pct"): 1, ("not_allowed", "ff49"): 1, ("not_month_end", "date"): 1, ("incomplete", "me"): 1, ("duplicate_key", "date,permno"): 1}


def test_asof_takes_the_latest_known(spark):
    left = spark.createDataFrame([("a", D(2000, 1, 5)), ("a", D(2000, 1, 1)), ("b", D(2000, 1, 9))], "k string, t date")
    right = spark.createDataFrame([("a", D(2000, 1, 2), 1.0), ("a", D(2000, 1, 5), 2.0), ("b", D(2000, 1, 10), 3.0)], "k string, d date, v double")
    out = {(r["k"], r["t"]): r["v"] for r in asof_join(left, right, by=["k"], left_on="t", right_on="d", values=["v"]).collect()}
    assert out == {("a", D(2000, 1, 5)): 2.0, ("a", D(2000, 1, 1)): None, ("b", D(2000, 1, 9)): None}


def test_support_simulation_does_not_depend_on_bundling(spark):
    rng = np.random.default_rng(4)
    rows = [("A", s, D(2000 + i // 12, i % 12 + 1, 28), *(bool(v) for v in rng.random(7) < 0.9)) for s in range(40) for i in range(18)]
    df = spark.createDataFrame(rows, "book string, id long, m date, target boolean, priced boolean, usable boolean, dividend boolean, member boolean, costed boolean, certified boolean")
    a, b = (sorted(map(str, quality.support_simulation(df, names_per_task=n).collect())) for n in (1000, 3))
    assert a == b and len(a) == 18


def test_drift_stream_equals_batch(spark):
    rng = np.random.default_rng(6)
    rows = [(k, D(2000, 1, 1) + dt.timedelta(days=i), float(rng.normal(0.0 if i < 60 else 0.1 * (k == "a"), 0.02))) for k in ("a", "b") for i in range(120)]
    df = spark.createDataFrame(rows, "k string, d date, x double")
    kw = dict(by=["k"], order="d", value="x", delta=0.002, threshold=0.15)
    batch = sorted(map(str, ad.drift(df, **kw).collect()))
    got = sf.replay(df, lambda rows: sf.drift_stream(rows, **kw), at="d")
    assert batch and batch == sorted(map(str, got.rows.collect())) and got.late_rows == 0


def test_lots_stream_equals_batch(spark):
    from panelmill.operators.tax import lot_gains

    rng = np.random.default_rng(8)
    rows = [(a, D(2000, 1, 1) + dt.timedelta(days=int(9 * i)), float(rng.integers(-50, 100)), float(rng.normal(0, 0.05))) for a in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "account int, d date, target double, growth double")
    cols = ["account", "sold", "opened", "gain", "long_term"]
    batch = lot_gains(df, by=["account"], method="fifo").select(*cols)
    stream = sf.replay(df, lambda rows: sf.lots_stream(rows, by=["account"], date="d", target="target", growth="growth", method="fifo"), at="d").rows.select(*cols)
    assert sorted(map(str, batch.collect())) == sorted(map(str, stream.collect()))


def test_bundled_positions_equal_batch(spark):
    from panelmill.operators.tax import lot_gains

    rng = np.random.default_rng(9)
    big = 1 << 60  # not a float
    rows = [(None if a == 3 else big + a, D(2000, 1, 1) + dt.timedelta(days=int(9 * i)), float(rng.integers(-50, 100)), 0.01) for a in range(30) for i in range(6)]
    df = spark.createDataFrame(rows, "account long, d date, target double, growth double").where("account is not null or d < '2000-01-05'")
    cols = ["account", "sold", "opened", "gain", "long_term"]
    batch = lot_gains(df.where("account is not null"), by=["account"], method="fifo").select(*cols)
    out = sf.replay(df, lambda rows: sf.lots_stream(rows, by=["account"], date="d", target="target", growth="growth", method="fifo", bundles=4), at="d")
    assert out.late_rows == 0 and sorted(map(str, batch.collect())) == sorted(map(str, out.rows.select(*cols).where("account is not null").collect()))


def test_streams_take_rows_in_event_order(spark):
    """Rows up to 30 days out of order give what the batch gives; rows that come later still are left out and counted."""
    rng = np.random.default_rng(10)
    day = lambda i: D(2000, 1, 1) + dt.timedelta(days=int(i))
    rows = [(k, day(i), float(rng.normal(0.0 if i < 60 else 0.1 * (k == "a"), 0.02)), day(i + rng.integers(0, 30))) for k in ("a", "b") for i in range(120)]
    schema = "k string, d date, x double, seen date"
    kw = dict(by=["k"], order="d", value="x", delta=0.002, threshold=0.15)
    stream = lambda r: sf.drift_stream(r, late="30 days", **kw)
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(str, ad.drift(df, **kw).collect()))
    got = sf.replay(df, stream, at="d", arrives="seen", parts=4, late="30 days")
    assert want and sorted(map(str, got.rows.collect())) == want and got.late_rows == 0
    behind = [("a", day(1), 9.0, day(148)), ("b", day(2), -9.0, day(148)), ("b", None, 1.0, day(148))]
    late = sf.replay(spark.createDataFrame(rows + behind, schema), stream, at="d", arrives="seen", parts=4, late="30 days")
    assert sorted(map(str, late.rows.collect())) == want and late.late_rows == 2


def test_expert_weights_are_causal(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([("p", D(2000 + i // 12, i % 12 + 1, 28), f"e{j}", float(rng.normal(0.01 * j, 0.02))) for i in range(36) for j in range(3)], "p string, m date, e string, r double")
    full = ad.hedge(df, by=["p"], month="m", expert="e", reward="r")
    cut = ad.hedge(df.filter("m < DATE '2001-12-01'"), by=["p"], month="m", expert="e", reward="r")
    want = {(r["m"], r["e"]): r["weight"] for r in full.collect()}
    assert all(want[(r["m"], r["e"])] == pytest.approx(r["weight"]) for r in cut.collect())
    assert np.allclose(full.groupBy("m").agg(F.sum("weight").alias("w")).toPandas()["w"], 1.0)


@pytest.mark.parametrize("name", ["flagship_month_end_features", "q25_gap_runs", "p9_breadth_cap", "t8_fifo_gains", "x2_newey_west", "u9_window_features_batch"])
def test_against_sql(spark, name):
    from check import TABLES, norm

    reg = load()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = reg.QUERIES[name](spark, SF)
    rel = con.sql(reg.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert got and got == want


def test_interval_scale_stream_equals_a_loop(spark):
    rng = np.random.default_rng(11)
    rows = [(k, D(2000 + i // 12, i % 12 + 1, 28), [float(v) for v in rng.gamma(2.0, 0.5, 30)]) for k in ("a", "b") for i in range(18)]
    df = spark.createDataFrame(rows, "k string, m date, ratios array<double>")
    got = sf.replay(df, lambda r: sf.interval_scale_stream(r, by=["k"], order="m", ratios="ratios"), at="m").rows
    want = {}
    for k in ("a", "b"):
        scale = 1.0
        for _, m, xs in sorted(r for r in rows if r[0] == k):
            cover = sum(x <= scale for x in xs) / len(xs)
            want[k, m] = (scale, cover)
            scale = min(max(scale * np.exp(0.05 * (0.9 - cover)), 0.25), 4.0)
    found = {(r.k, r.m): (r.scale, r.coverage) for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_daily_rows_are_sorted_once(spark):
    """Month-end statistics keep the order of the daily windows; the calendar by itself writes no signals."""
    from panelmill.plans.model_queries import m1
    from panelmill.sources.market import Market

    t = Market(spark, "/root/testdata/sf0.001")
    plan = t.panel._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert m1(t).count() > 0 and "signals" not in t.plans
