"""Ranks from cells must equal those of plain windows and of pandas, however groups are cut."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.functions import avg_rank, group_stats, quantiles, row_rank, spearman, spearmans
from panelmill.functions import ranking
from panelmill.functions.ranking import weighted_median
from panelmill.operators import models as md
from panelmill.operators import xsection as xs
from panelmill.operators.book import extreme_book, spread_return


def rows(df, digits=9):
    def norm(v):
        return round(v, digits) if isinstance(v, float) else v

    cols = sorted(df.columns)
    return sorted(tuple(str(norm(r[c])) for c in cols) for r in df.collect())


@pytest.fixture(params=[10**6, 4])
def cell(request, monkeypatch):
    """One cell per group, and many cells: nothing may depend on where groups are cut."""
    monkeypatch.setattr(ranking, "CELL", request.param)
    return request.param


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("col", ["x", "z"])
def test_row_rank(panel, cell, desc, col):
    plain = F.row_number().over(Window.partitionBy("m").orderBy(F.col(col).desc() if desc else F.col(col).asc(), "sec_id")).cast("long")
    p = panel.filter(F.col(col).isNotNull())
    assert rows(row_rank(p, ["m"], col, "sec_id", desc=desc)) == rows(p.withColumn("rank", plain))


@pytest.mark.parametrize("col", ["x", "y", "z"])
def test_avg_rank_and_quantiles(panel, cell, col):
    p = panel.filter(F.col(col).isNotNull())
    plain = F.rank().over(Window.partitionBy("m").orderBy(col)) + (F.count(F.lit(1)).over(Window.partitionBy("m", col)) - 1) / 2.0
    assert rows(avg_rank(p, ["m"], col)) == rows(p.withColumn("rank", plain))
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.77, "e": 1.0}
    exact = p.groupBy("m").agg(F.count(col).alias("n"), *[F.percentile(col, F.lit(v)).alias(k) for k, v in probs.items()])
    assert rows(quantiles(p, ["m"], col, probs)) == rows(exact)


def test_group_functions(panel, cell):
    assert rows(group_stats(panel, ["m"], a=F.avg("y"))) == rows(panel.withColumn("a", F.avg("y").over(Window.partitionBy("m"))))
    want = panel.toPandas().dropna().groupby("m").apply(lambda g: g["x"].rank().corr(g["y"].rank()), include_groups=False)
    got = {r["m"]: r["ic"] for r in spearman(panel, ["m"], "x", "y").collect()}
    assert np.allclose([got[k] for k in want.index], want)


def test_one_month_holds_nearly_all_rows_and_ids_repeat(spark, cell):
    import datetime as dt

    rng = np.random.default_rng(1)
    data = [(dt.date(2000, 1 if i % 20 else 2, 28), int(i // 2), float(v) if i % 9 else None) for i, v in enumerate(rng.integers(0, 12, 600) ** 2.0)]
    df = spark.createDataFrame(data + data[:5], "m date, id long, x double")
    got = xs.xs_rank(df, "x", by=["m"], id="id", out="r")
    assert got.count() == len(data) + 5
    many = xs.xs_rank_many(df, ["x"], by=["m"], id="id")
    for m, g in df.toPandas().groupby("m"):
        n = int(g["x"].notna().sum())
        want = sorted(k / (n - 1) - 0.5 for k in range(n))
        for out, c in ((got, "r"), (many, "x")):
            assert np.allclose(sorted(r[c] for r in out.filter(F.col("m") == F.lit(m)).collect() if r[c] is not None), want)


def test_operators_do_not_depend_on_cells(panel, monkeypatch):
    for fn in (
        lambda: xs.xs_rank(panel, "x", by=["m"], id="sec_id", out="r"),
        lambda: xs.xs_rank_many(panel, ["x", "y"], by=["m"], id="sec_id"),
        lambda: xs.rank_bins(panel, "x", by=["m"], id="sec_id", k=3),
        lambda: extreme_book(panel, by=["m"], id="sec_id", score="y", cap="w"),
        lambda: spread_return(panel, by=["m"], id="sec_id", score="x", ret="y"),
        lambda: md.conformal(panel.withColumn("g", F.lit("a")), by=["g"], id="sec_id", month="m", score="y", truth="z", months=5),
    ):
        monkeypatch.setattr(ranking, "CELL", 10**6)
        one = rows(fn(), 8)
        monkeypatch.setattr(ranking, "CELL", 4)
        assert rows(fn(), 8) == one


def test_rank_bins_match_quantile_cuts(panel):
    import pandas as pd

    p = panel.filter("x IS NOT NULL")
    got = {(r["m"], r["sec_id"]): r["bin"] for r in xs.rank_bins(p, "x", by=["m"], id="sec_id", k=3).collect()}
    for _, g in p.toPandas().sort_values("sec_id").groupby("m"):
        want = pd.qcut(g["x"].rank(method="first"), 3, labels=False) + 1
        assert [got[(m, s)] for m, s in zip(g["m"], g["sec_id"])] == list(want)


def test_weighted_median(panel, cell):
    got = {r["m"]: r["wmedian"] for r in weighted_median(panel, ["m"], "y", "w").collect()}
    for m, g in panel.toPandas().sort_values("y").groupby("m"):
        c = g["w"].cumsum() / g["w"].sum()
        assert got[m] == g["y"].to_numpy()[np.searchsorted(c.to_numpy(), 0.5)]


def test_proxy_book_is_neutral_and_capped(panel):
    b = md.proxy_book(panel, by=["m"], alpha="y", vol="w", cap=0.05).toPandas()
    assert b["w"].abs().max() <= 0.05 + 1e-12
    assert np.allclose(b.groupby("m")["w"].sum(), 0)


def test_cells_do_not_gather_a_group(spark, panel, monkeypatch):
    """Rows meet their cuts without a shuffle by group, however few groups there are, and sorts carry no maps of cells."""
    monkeypatch.setattr(ranking, "CELL", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.createDataFrame(panel.toPandas())
        cells = ranking._cells(rows, ["m"], {"b": [F.col("x"), F.col("sec_id")]})
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        ranks = ranking.row_ranks(rows, ["m"], {"x": "rx", "y": "ry"}, "sec_id")
        windows = [line for line in ranks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number()" in line]
        assert len(windows) == 2 and not any("map<" in f.dataType.simpleString() for f in ranks.schema)
        above = ranks._jdf.queryExecution().optimizedPlan().toString().split("Window [row_number()")
        assert all("__m0" not in part and "__m1" not in part for part in above[:2])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cells_of_many_cuts_by_binary_search(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CELL", 64)
    df = spark.range(20_000).select(F.lit("a").alias("g"), F.col("id"), (F.xxhash64("id") % 5000).cast("double").alias("x"))
    cells = ranking._cells(df, ["g"], {"b": [F.col("x"), F.col("id")]})
    got = [r["b"] for r in sorted(cells.collect(), key=lambda r: (r["x"], r["id"]))]
    steps = np.diff(got)
    # a cell begins behind a cut: cells ascend one by one, and no row is in a cell below that of a smaller row
    assert got[0] == 0 and got[-1] > 200 and set(steps.tolist()) == {0, 1}
    # the cuts are not tried one after another
    assert "filter(" not in cells._jdf.queryExecution().optimizedPlan().toString()


def test_spearmans_of_many_pairs(spark, cell):
    """All pairs at once, each among its own complete rows; ties, a constant, NaN as the largest value, a group without a key, a value that most rows share."""
    rng = np.random.default_rng(3)
    data = [
        ("a" if i % 10 else None if i % 20 else "b", float(rng.normal()), None if i % 7 == 2 else float(rng.integers(0, 5)),
         None if i % 5 == 1 else float("nan") if i % 11 == 3 else float(rng.normal()), 3.0, 0.0 if i % 3 else float(i))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "g string, x double, y double, z double, k double, o double")
    pairs = [("x", "y"), ("x", "z"), ("y", "z"), ("x", "k"), ("o", "x"), ("x", "x"), ("z", "o")]
    got = {(r["g"], r["first"], r["second"]): (r["n"], r["ic"]) for r in spearmans(df, ["g"], pairs, min_n=2).collect()}
    assert len(got) == 3 * len(pairs)
    import pandas as pd

    for g in ("a", "b", None):
        rows_ = [r[1:] for r in data if r[0] == g]
        cols = dict(zip("xyzko", zip(*rows_)))
        for a, b in pairs:
            both = [(u, v) for u, v in zip(cols[a], cols[b]) if u is not None and v is not None]
            u, v = (pd.Series([np.inf if t != t else t for t in side]).rank() for side in zip(*both))
            n, ic = got[(g, a, b)]
            assert n == len(both)
            assert ic is None if u.nunique() == 1 or v.nunique() == 1 else abs(ic - u.corr(v)) < 1e-12


def test_signal_quality_ranks_each_column_once(spark, monkeypatch):
    """What is written grows with the rows, not with the pairs of signal and target; cells don't change a result."""
    import datetime as dt

    from panelmill.operators import studies
    from panelmill.sources import io

    rng = np.random.default_rng(5)
    data = [
        (dt.date(2000 + m // 12, m % 12 + 1, 28), s, *[None if (s + m + j) % 9 == 0 else float(rng.integers(0, 20)) for j in range(2)], *map(float, rng.normal(size=3)))
        for m in range(8) for s in range(40) if (s * m) % 11 != 5
    ]
    df = spark.createDataFrame(data, "m date, id long, a double, b double, r_1m double, r_3m double, r_6m double").cache()
    sizes, plain = [], io.written

    def counted(rows_, name):
        out = plain(rows_, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(io, "written", counted)
    found = []
    for n in (10**6, 4):
        monkeypatch.setattr(ranking, "CELL", n)
        out = studies.signal_quality(df, ["a", "b"], id="id", month="m", target="r_1m", horizons={"r_1m": 1, "r_3m": 3, "r_6m": 6})
        found.append(rows(out, 10))
        assert max(sizes) <= len(data)
        sizes.clear()
    assert found[0] == found[1] and len(found[0]) == 2
    # the last value of a signal counts only where it is of the month before
    last = {(r[0], r[1]): r for r in data}
    months = sorted({r[0] for r in data})
    acs = []
    import pandas as pd

    for before, m in zip(months, months[1:]):
        both = [(r[2], last[before, r[1]][2]) for r in data if r[0] == m and (before, r[1]) in last and r[2] is not None and last[before, r[1]][2] is not None]
        u, v = map(lambda side: pd.Series(side).rank(), zip(*both))
        acs.append(u.corr(v))
    got = {r["signal"]: r["autocorr_1m"] for r in out.collect()}
    assert abs(got["a"] - np.mean(acs)) < 1e-12


def test_books_of_all_strengths_share_one_shuffle(spark):
    """Cross-sections come back as a few broadcast numbers; rows are not repeated for a strength and meet their previous weights by one shuffle."""
    import datetime as dt

    import pandas as pd

    from panelmill.sources.io import written

    rng = np.random.default_rng(11)
    months = [dt.date(2000, i, 28) for i in (1, 2, 3, 5, 6)]
    data = [
        (c, s, m, float(rng.normal()), None if s % 7 == 3 else float(rng.random() / 100), float(rng.random() / 50), None if s % 5 == 1 else float(1e5 * rng.random()),
         None if s % 6 == 2 else float(rng.normal() / 100))
        for c in "ab" for m in months for s in range(25) if rng.random() > 0.2
    ]
    cols = ["cell", "id", "m", "alpha", "spread", "sigma_d", "adv_usd", "ret_next"]
    df = written(spark.createDataFrame(data, "cell string, id long, m date, alpha double, spread double, sigma_d double, adv_usd double, ret_next double"), "test")
    grid = [0.0, 1.0, 4.0]
    out = md.select_kappa(df, grid, by=["cell"], id="id", month="m", alpha="alpha", unc="spread", vol="sigma_d", aum=1e5, borrow=0.03, cap=0.05)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 5 and plan.count("Window [lag") == 1
    below = plan[plan.index("Window [lag") :]
    assert "Generate" not in below and below.count("Exchange hashpartitioning(") == 1
    got = {(r["cell"], r["kappa"]): (r["total"], r["best"]) for r in out.collect()}
    assert len(got) == 6

    p = pd.DataFrame(data, columns=cols)
    for c in "ab":
        totals = []
        for k in grid:
            prev, total = {}, 0.0
            for m in months:
                g = p[(p["cell"] == c) & (p["m"] == m)]
                rel = (g["spread"] / g["spread"].mean()).fillna(1.0)
                a = g["alpha"] / (1 + k * rel**2) / np.maximum(g["sigma_d"] ** 2, 1e-8)
                a = a - a.mean()
                w = (2 * a / a.abs().sum()).clip(-0.05, 0.05)
                long, short = w.clip(lower=0).sum(), -w.clip(upper=0).sum()
                w = w * min(long, short) / np.where(w > 0, long, short)
                w = w * min(1.0, 1 / min(long, short))
                dw = (w - g["id"].map(prev).fillna(0.0)).abs()
                ok = (g["adv_usd"] > 0) & g["spread"].notna()
                cost = np.where(ok, 0.5 * g["spread"] * dw + 0.0005 * dw + g["sigma_d"] * np.sqrt(1e5 / np.maximum(g["adv_usd"], 1.0)) * dw**1.5, 0.0)
                total += (w * g["ret_next"].fillna(0.0) - cost - (-w).clip(lower=0) * 0.03 / 12).sum()
                prev = dict(zip(g["id"], w))
            totals.append(total)
        for k, t in zip(grid, totals):
            assert abs(got[c, k][0] - t) < 1e-9 and got[c, k][1] == (t == max(totals))
