import datetime as dt

import numpy as np
import pytest

from panelmill.operators import inference as inf
from panelmill.operators import linear


def month(i):
    y, k = divmod(i + 1, 12)
    return dt.date(1990 + y, k + 1, 1) - dt.timedelta(days=1)


def nw(x):
    T = len(x)
    L = max(0, min(int(np.floor(4 * (T / 100) ** (2 / 9))), T - 2))
    e = x - x.mean()
    v = e @ e / T
    for k in range(1, L + 1):
        v += 2 * (1 - k / (L + 1)) * (e[k:] @ e[:-k]) / T
    return np.sqrt(max(v, 0) / T)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(3):
        x = np.zeros(90)
        for i in range(1, 90):
            x[i] = 0.5 * (s == 1) * x[i - 1] + rng.normal(0.01 * s, 0.05)
        rows += [(f"s{s}", month(i), float(v), float(v * 0.5 + rng.normal(0, 0.02))) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "s string, m date, r double, q double").cache()


def test_newey_west(series):
    pdf = series.toPandas()
    for r in inf.newey_west(series, ["s"], "m", "r").collect():
        x = pdf[pdf.s == r["s"]].sort_values("m")["r"].to_numpy()
        assert r["mean"] == pytest.approx(x.mean()) and r["se"] == pytest.approx(nw(x))


def test_newey_west_of_long_and_short_series(spark):
    rng = np.random.default_rng(2)
    data = {"long": np.cumsum(rng.normal(size=5000)) * 0.01 + rng.normal(size=5000), "four": rng.normal(size=4), "two": rng.normal(size=2)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "s string, m int, r double")
    got = {r["s"]: r for r in inf.newey_west(df, ["s"], "m", "r").collect()}
    assert got["two"]["se"] is None
    for k in ("long", "four"):
        assert got[k]["n"] == len(data[k]) and got[k]["se"] == pytest.approx(nw(data[k]))



def test_sharpe_difference_matches_direct_loop(series):
    B = 110
    got = {r["s"]: r for r in inf.sharpe_diff(series, ["s"], "m", "r", "q", B).collect()}
    idx = inf.bootstrap_index(series.sparkSession.createDataFrame([(90,)], "len int"), B).toPandas().sort_values(["b", "t"])
    pdf = series.toPandas()

    def stat(a, b):
        sr = lambda x: x.mean() / x.std(ddof=1) * np.sqrt(12)
        psi = lambda x: np.sqrt(12) * ((x - x.mean()) / x.std(ddof=1) - 0.5 * sr(x) / np.sqrt(12) * (((x - x.mean()) / x.std(ddof=1)) ** 2 - 1))
        return sr(a) - sr(b), nw(psi(a) - psi(b))

    for s, g in pdf.groupby("s"):
        g = g.sort_values("m")
        a, b = g["r"].to_numpy(), g["q"].to_numpy()
        d, se = stat(a, b)
        draws = np.array([stat(a[i], b[i]) for i in (x["idx"].to_numpy() for _, x in idx.groupby("b"))])
        t = (draws[:, 0] - d) / draws[:, 1]
        assert got[s]["stat"] == pytest.approx(d) and got[s]["se"] == pytest.approx(se)
        assert got[s]["p"] == pytest.approx((np.abs(t) >= abs(d / se)).mean())
        assert got[s]["ci_stud_low"] == pytest.approx(d - np.percentile(t, 97.5) * se)


def test_autocorrelation_widens_the_error(series):
    rows = {r["s"]: r for r in inf.sharpe_test(series, ["s"], "m", "r").collect()}
    assert rows["s1"]["se"] > rows["s1"]["se_iid"]
    assert all(0 <= r["p"] <= 1 for r in rows.values())


def test_bootstrap_blocks(spark):
    idx = inf.bootstrap_index(spark.createDataFrame([(60,)], "len int"), 200).toPandas().sort_values(["b", "t"])
    assert len(idx) == 12000 and idx["idx"].between(0, 59).all()
    step = idx.groupby("b")["idx"].diff().dropna() % 60
    assert 0.75 < (step == 1).mean() < 0.92  # restart probability one sixth


def test_multiple_testing(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {r["k"]: r["p_holm"] for r in inf.holm(df, "p", tie="k").collect()}
    assert got == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06), "d": None}
    bh = {r["k"]: r["p_adjusted"] for r in inf.benjamini_hochberg(df, "p", tie="k").collect()}
    assert bh == {"a": pytest.approx(0.03), "b": pytest.approx(0.04), "c": pytest.approx(0.04)}


def cells(spark, months=30):
    rng = np.random.default_rng(11)
    codes = [f"{a}-{b}-{c}-{d}" for a in "NL" for b in "CS" for c in "EP" for d in "U0"]
    return spark.createDataFrame([(month(i), c, float(rng.normal(0.01, 0.03))) for i in range(months) for c in codes], "m date, cell string, r double")


def test_shapley_adds_up_and_effects_are_differences_of_means(spark):
    c = cells(spark).cache()
    means = c.toPandas().groupby("cell")["r"].mean()
    shap = inf.shapley_attribution(c, order="m", cell="cell", value="r").toPandas()
    assert shap["shapley"].sum() == pytest.approx(means["N-C-E-U"] - means["L-S-P-0"])
    eff = {r["term"]: r["estimate"] for r in inf.factorial_effects(c, order="m", cell="cell", value="r").collect()}
    assert len(eff) == 15
    assert eff["f1"] == pytest.approx(means[[k for k in means.index if k[0] == "N"]].mean() - means[[k for k in means.index if k[0] == "L"]].mean())


def test_unknown_cell_code_is_an_error(spark):
    df = spark.createDataFrame([("X-C-E-U",)], "cell string")
    with pytest.raises(Exception, match="unknown cell code"):
        inf.parse_cells(df, "cell").collect()


def test_step_down_and_overfitting(spark):
    c = cells(spark)
    rw = inf.romano_wolf(c, order="m", unit="cell", value="r", B=60).toPandas().sort_values("t_stat", ascending=False)
    assert rw["p_adjusted"].is_monotonic_increasing
    assert 0 <= inf.pbo(c, order="m", unit="cell", value="r", n_splits=6).first()["pbo"] <= 1


def test_least_squares_and_blocks(panel):
    pdf = panel.dropna().toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf[["x", "z"]]])
    w = pdf["w"].to_numpy()
    want = np.linalg.lstsq(X * np.sqrt(w)[:, None], pdf["y"] * np.sqrt(w), rcond=None)[0]
    fit = linear.ols(panel.selectExpr("*", "1 AS g"), by=["g"], y="y", xs=["x", "z"], weight="w").first()
    assert np.allclose(fit["coef"], want)
    g = linear.matrices(linear.gram_blocks(panel.dropna().selectExpr("*", "1 AS g"), by=["g"], cols=["x", "y", "z"], weight="w"), ["g"]).first()["gram"]
    A = pdf[["x", "y", "z"]].to_numpy()
    assert np.allclose(np.array(g), (A * w[:, None]).T @ A)
