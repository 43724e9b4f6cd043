"""Interval widths from buckets, their feedback over months, and overfitting over all splits, against direct loops."""

import datetime as dt
from itertools import combinations

import numpy as np
import pytest

from panelmill.operators import bootstrap
from panelmill.operators import inference as inf
from panelmill.operators import models as md

MONTHS = [dt.date(2000 + i // 12, i % 12 + 1, 28) for i in range(14)]


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(8)
    rows = []
    for model in ("a", "b"):
        for i, m in enumerate(MONTHS):
            for s in range(40 if i % 5 else 5):
                e = [0.0, 0.25, float(np.round(rng.normal(0, 1 + i / 10), 2))][int(rng.integers(0, 3))]
                rows.append((model, s, m, 1.0, None if s % 11 == 3 else 1.0 + e))
    return rows


@pytest.mark.parametrize("octave", [1, 16])
def test_widths_bounds_and_feedback(spark, scores, monkeypatch, octave):
    monkeypatch.setattr(md, "OCTAVE", octave)
    monkeypatch.setattr(md, "BINS", octave)
    df = spark.createDataFrame(scores, "model string, sec_id long, m date, score double, y double")
    widths = md.conformal(df, by=["model"], id="sec_id", month="m", score="score", truth="y", months=3, min_n=30)
    want = {}
    for model in ("a", "b"):
        for i, m in enumerate(MONTHS):
            past = sorted(abs(y - x) for g, _, d, x, y in scores if g == model and y is not None and d in MONTHS[max(i - 3, 0) : i])
            if len(past) >= 30:
                want[model, m] = (len(past), past[min(int(np.ceil((len(past) + 1) * 0.9)), len(past)) - 1])
    found = {(r.model, r.m): (r.n, r.half_width) for r in widths.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    bounds = md.conformal_bounds(df, widths, by=["model"], month="m", score="score", truth="y").collect()
    assert len(bounds) == sum((r[0], r[2]) in want for r in scores)
    assert all(r.inside == (None if r.y is None else r.lower <= r.y <= r.upper) for r in bounds)
    got = {(r.model, r.m): (r.n, r.scale, r.coverage) for r in md.conformal_adaptive(df, widths, by=["model"], month="m", score="score", truth="y", rate=0.6).collect()}
    for model in ("a", "b"):
        scale = 1.0
        for m in MONTHS:
            if (model, m) not in want:
                continue
            x = np.array([abs(y - s) / want[model, m][1] for g, _, d, s, y in scores if g == model and d == m and y is not None])
            assert got[model, m] == pytest.approx((len(x), scale, (x <= scale).mean()))
            scale = float(np.clip(scale * np.exp(0.6 * (0.9 - (x <= scale).mean())), 0.25, 4.0))


def test_overfitting_over_all_splits(spark):
    rng = np.random.default_rng(1)
    r = np.round(rng.normal(0, 1, (26, 5)), 3)
    df = spark.createDataFrame([(t, f"s{k}", float(r[t, k])) for t in range(26) for k in range(5)], "t int, s string, r double")
    got = inf.pbo(df, order="t", unit="s", value="r", n_splits=8).first()
    blocks = np.array_split(np.arange(26), 8)
    logits = []
    for inside in combinations(range(8), 4):
        rows = np.concatenate([blocks[b] for b in inside])
        out = np.setdiff1d(np.arange(26), rows)
        best = int(np.argmax(r[rows].mean(0)))
        oos = r[out].mean(0)
        share = ((oos < oos[best]).sum() + 1 + ((oos == oos[best]).sum() - 1) / 2) / 5
        share = min(share, 1 - 1e-6)
        logits.append(np.log(share / (1 - share)))
    assert got.n_combinations == 70 and got.pbo == pytest.approx(np.mean(np.array(logits) <= 0)) and got.median_logit == pytest.approx(np.median(logits))


def test_bundles_are_the_draws_of_each_replication(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BUNDLE", 7)
    rng = np.random.default_rng(3)
    data = {k: rng.normal(0, 1, n) for k, n in (("x", 30), ("y", 2), ("z", 64))}
    df = spark.createDataFrame([(k, i, float(v)) for k, a in data.items() for i, v in enumerate(a)], "s string, i int, v double")
    got = {(r.s, r.b): (r.mean, r.se) for r in bootstrap.replicate(df, ["s"], "i", ["v"], 16, bootstrap.mean_and_error, ["mean", "se"], block=6, salt="q").collect()}
    assert len(got) == 48
    for s, a in data.items():
        at = bootstrap.draws(len(a), 0, 16, 6, "q")
        mean, se = bootstrap.hac(a[at])
        for b in range(16):
            assert got[s, b][0] == pytest.approx(mean[b]) and (got[s, b][1] is None if len(a) < 3 else got[s, b][1] == pytest.approx(se[b]))
    idx = {(r.len, r.b, r.t): r.idx for r in bootstrap.positions(spark.createDataFrame([(30,), (30,), (2,)], "len int"), 16, block=6, salt="q").collect()}
    assert len(idx) == 16 * 32 and all(idx[30, b, t] == bootstrap.draws(30, b, 1, 6, "q")[0, t] for b in range(16) for t in range(30))
