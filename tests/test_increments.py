import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import daily
from panelmill.operators import studies as st
from panelmill.sources import io

D = dt.date


def features(px):
    return daily.rolling_features(px, keys=["k", "year"], date="d", counts={"n": None}, means={"mean": "x"}).select("k", "d", "year", "n", "mean")


def test_increments_equal_one_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, D(2000, 1, 1) + dt.timedelta(days=2 * i), float(rng.normal())) for k in range(3) for i in range(k * 100, 700)]
    df = spark.createDataFrame(rows, "k int, d date, x double")
    asked = lambda *ys: spark.createDataFrame([(y,) for y in ys], "year int")
    path = str(tmp_path / "years")
    assert io.extract_years(df, features, asked(2001), path, date="d") == [2001]
    assert io.extract_years(df, features, asked(2000, 2001, 2002, 2003), path, date="d") == [2000, 2002, 2003]
    assert io.extract_years(df, features, asked(2000, 2003), path, date="d") == []
    whole = features(df.withColumn("year", F.lit(0))).drop("year")
    got = spark.read.parquet(path).drop("year")
    rows = lambda f: sorted((r.k, r.d, r.n, round(r.mean, 9)) for r in f.collect())
    assert rows(got) == rows(whole)


def test_look_back_rows_are_not_written(spark, tmp_path):
    df = spark.createDataFrame([(1, D(2000, 12, 31), 1.0), (1, D(2001, 1, 1), 3.0), (1, D(2000, 1, 1), 5.0)], "k int, d date, x double")
    asked = spark.createDataFrame([(2001,)], "year int")
    io.extract_years(df, features, asked, str(tmp_path / "y"), date="d")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "y")).select("d", "n", "mean").collect()] == [(D(2001, 1, 1), 2, 2.0)]


def test_checked_join_stops_at_repeats(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, 10.0), (3, 30.0), (None, 1.0), (None, 2.0)], "k int, r double")
    want = [("a", 10.0), ("b", None), ("c", None), ("d", None)]
    for expect in ("one_to_one", "many_to_one"):
        assert sorted((r.l, r.r) for r in io.checked_join(left, right, ["k"], expect=expect).collect()) == want
    assert [(r.l, r.r) for r in io.checked_join(left, right, ["k"], how="inner").collect()] == [("a", 10.0)]
    twice = left.union(left)
    assert io.checked_join(twice, right, ["k"], expect="many_to_one").count() == 8
    with pytest.raises(Exception, match="left side repeats the key 1|left side repeats the key 2"):
        io.checked_join(twice, right, ["k"]).collect()
    with pytest.raises(Exception, match="right side repeats the key"):
        io.checked_join(left, right.union(right), ["k"], expect="many_to_one").collect()
    with pytest.raises(ValueError, match="columns of both sides: l"):
        io.checked_join(left, left, ["k"])


@pytest.mark.parametrize("gaps", [0.0, 0.35])
def test_two_way_effects_against_dummies(spark, gaps):
    rng = np.random.default_rng(5)
    rows = [("A", u, t, 0.3 * u - 0.2 * t + float(rng.normal()), float(rng.normal(u % 3)), t >= 4) for u in range(15) for t in range(8) if rng.random() >= gaps]
    rows += [("B", u, t, float(rng.normal()), float(rng.normal()), t >= 4) for u in range(6) for t in range(2, 7)]
    df = spark.createDataFrame([*rows, ("A", 1, 1, None, 1.0, False)], "c string, u int, t int, y double, x double, post boolean")
    out = {r.c: r for r in st.did_twfe(df, by=["c"], unit="u", time="t", y="y", x="x", post="post").collect()}
    for c in "AB":
        some = [r for r in rows if r[0] == c]
        u, t, y, x, p = (np.array([r[i] for r in some], float) for i in range(1, 6))
        x2 = x - x.mean()
        fixed = np.column_stack([*[u == v for v in np.unique(u)], *[t == v for v in np.unique(t)[1:]]]).astype(float)
        z = np.column_stack([p * x2, x2, fixed])
        beta = np.linalg.lstsq(z, y, rcond=None)[0]
        inv, e = np.linalg.inv(z.T @ z), y - z @ beta
        assert out[c].n == len(some) and out[c].beta == pytest.approx(beta[0], abs=1e-9)
        for name, g in (("se_time", t), ("se_unit", u)):
            scores = np.array([(z[g == v] * e[g == v, None]).sum(axis=0) for v in np.unique(g)])
            meat, m, n, k = scores.T @ scores, len(np.unique(g)), len(y), z.shape[1]
            assert out[c][name] == pytest.approx(np.sqrt((inv @ meat @ inv)[0, 0] * m / (m - 1) * (n - 1) / (n - k)), rel=1e-6)
