"""After-tax accounts: a run in dollars as a brute-force twin, and the identities of the exit policies."""

import datetime as dt

import numpy as np
import pytest

from panelmill.operators import aftertax as at

MONTHS = [dt.date(2000 + (9 + i) // 12, (9 + i) % 12 + 1, 1) for i in range(9)]
MONTHS = [(m.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1) for m in MONTHS]
ROWS = "cell string, m date, sec_id long, w double, ret_next double, spread double, sigma_d double, adv_usd double, ok boolean"
RUNS = "cell string, regime string, method string, short_rate double, long_rate double, long_months int, wash_days int, mark_to_market boolean, aum double"


def book(n=6, gone=(), frozen=(), unpriced=(), months=len(MONTHS), seed=1):
    """Rows of a book of ``n`` names; ``gone``, ``frozen`` and ``unpriced`` list (name, first month, month after the last)."""
    rng = np.random.default_rng(seed)
    inside = lambda spans, s, t: any(s == a and lo <= t < hi for a, lo, hi in spans)
    rows = []
    for t in range(months):
        w = np.round(rng.normal(0, 0.3, n), 3)
        for s in range(n):
            r = round(float(rng.normal(0.01, 0.08)), 4)
            if not inside(gone, s, t):
                rows.append(("c", MONTHS[t], s, 0.0 if (s + t) % 4 == 0 else float(w[s]), None if inside(unpriced, s, t) else r, 0.01, 0.02, 1e6 * (s + 1), not inside(frozen, s, t)))
    return rows


def run(spark, rows, exits="as_run", evidence=None, accounting="year_end", method="fifo", marked=False, wash=0):
    df = spark.createDataFrame(rows, ROWS)
    ev = None if evidence is None else spark.createDataFrame(evidence, "sec_id long, event_date date, cost double")
    runs = spark.createDataFrame([("c", "r", method, 0.4, 0.2, 3, wash, marked, 1e5)], RUNS)
    sums = at.month_sums(at.name_paths(df, by=["cell"], evidence=ev), runs, by=["cell"], run=["cell", "regime", "method"], exits=exits)
    return [r.asDict() for r in at.accounts(sums, runs, run=["cell", "regime", "method"], accounting=accounting).orderBy("m").collect()]


def dollars(rows, accounting="year_end", marked=False):
    """The same run in dollars: first-in first-out lots, all scaled when costs and tax are paid."""
    nav, lots, carried, paid, year, out = 1e5, {}, 0.0, 0.0, np.zeros(2), []
    by_month = {}
    for r in rows:
        by_month.setdefault(r[1], {})[r[2]] = r
    calendar = sorted(by_month)
    for i, m in enumerate(calendar):
        gross = cost = short = st = lt = 0.0
        for s in sorted(set(by_month[m]) | set(lots)):
            r = by_month[m].get(s)
            target, held = (r[3] if r else 0.0) * nav, sum(q for _, q, _ in lots.get(s, []))
            book, sign = lots.setdefault(s, []), np.sign(held)
            sell = abs(held) - (abs(target) if held * target > 0 else 0.0)
            while sell > 1e-7 and book:
                opened, q, basis = book[0]
                part = min(sell / abs(q), 1.0)
                gain = part * (q - basis)
                k = opened.month + 2
                anniversary = (dt.date(opened.year + (k + 1) // 12, (k + 1) % 12 + 1, 1) - dt.timedelta(days=1))
                long = sign > 0 and m > min(anniversary, anniversary.replace(day=min(anniversary.day, opened.day)))
                st, lt = (st, lt + gain) if long else (st + gain, lt)
                sell -= abs(q) * part
                book[0] = (opened, q * (1 - part), basis * (1 - part))
                if part >= 1.0 - 1e-12:
                    book.pop(0)
            now = sum(q for _, q, _ in book)
            if abs(target - now) > 1e-7:
                book.append((m, target - now, target - now))
            dw = abs(target - held) / nav
            if r and r[8] and dw:
                cost += 0.5 * r[5] * dw + 5e-4 * dw + r[6] * np.sqrt(1e5 / r[7]) * dw**1.5
            short += max(-target / nav, 0) * 0.03 / 12
            ret = r[4] or 0.0 if r else 0.0
            gross += target / nav * ret
            lots[s] = [(o, q * (1 + ret), b) for o, q, b in book]
            if marked and m.month == 12:
                st += sum(q - b for _, q, b in lots[s])
                lots[s] = [(o, q, q) for o, q, _ in lots[s]]
            if not book:
                lots.pop(s)
        year += (st, lt)
        last = i + 1 == len(calendar) or calendar[i + 1].year != m.year
        loss = carried - min(year[0], 0) - min(year[1], 0)
        use = min(loss, max(year[0], 0))
        due = 0.4 * (max(year[0], 0) - use) + 0.2 * max(max(year[1], 0) - (loss - use), 0)
        tax = due - paid if accounting == "accrual" else due if last else 0.0
        paid = due
        unreal = sum(q - b for book in lots.values() for _, q, b in book) / nav
        net = gross - cost - short - tax / nav
        out.append((m, gross, cost, short, tax / nav, st / nav, lt / nav, unreal, nav))
        if last:
            carried, paid, year = max(carried - year.sum(), 0.0), 0.0, np.zeros(2)
        after = nav * (1 + net)
        f = after / (nav * (1 + gross))
        lots = {s: [(o, q * f, b * f) for o, q, b in book] for s, book in lots.items()}
        nav = after
    return out


NAMES = ["m", "gross_ret", "cost", "borrow", "tax_ret", "realised_st", "realised_lt", "unrealised", "nav"]


@pytest.mark.parametrize("accounting,marked", [("year_end", False), ("accrual", False), ("year_end", True)])
def test_shares_equal_the_run_in_dollars(spark, accounting, marked):
    rows = book(gone=[(1, 4, 6), (2, 7, 9)], frozen=[(3, 2, 5)], unpriced=[(4, 3, 4)])
    got = [tuple(r[c] for c in NAMES) for r in run(spark, rows, accounting=accounting, marked=marked)]
    want = dollars(rows, accounting, marked)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose(np.array([g[1:] for g in got], float), np.array([w[1:] for w in want], float), rtol=1e-9, atol=1e-9)


def test_nav_chain_and_policies_agree_without_exits(spark):
    rows = book()
    a, b = run(spark, rows), run(spark, rows, exits="carry_v1")
    for x, y in zip(a, b):
        assert x["after_tax_ret"] == pytest.approx(y["after_tax_ret"], abs=1e-12) and y["status"] == "resolved"
    for x, nxt in zip(b, b[1:]):
        assert nxt["nav"] / x["nav"] == pytest.approx(1 + x["after_tax_ret"])
        assert x["after_tax_ret"] == pytest.approx(x["gross_ret"] - x["cost"] - x["borrow"] - x["tax_ret"])


def steady(w=0.25, **kw):
    return [(c, m, s, 0.0 if (s, MONTHS.index(m)) in kw.get("out", ()) else (w if s % 2 == 0 else -w), 0.1 if s == 2 and r is not None else r, *x) for c, m, s, _, r, *x in book(n=4, **{k: v for k, v in kw.items() if k != "out"})]


def test_frozen_names_drift_without_cost_and_shorts_pay_borrow(spark):
    out = {(2, t) for t in range(3, 9)} | {(1, t) for t in range(3, 9)}
    free = run(spark, steady(out=out), exits="carry_v1")
    held = run(spark, steady(out=out, frozen=[(2, 3, 9), (1, 3, 9)]), exits="carry_v1")
    assert [r["n_frozen"] for r in held] == [0, 0, 0] + [2] * 6 and all(r["status"] == "resolved" for r in held)
    assert held[3]["turnover"] < free[3]["turnover"] and held[3]["cost"] < free[3]["cost"]
    assert held[3]["realised_st"] + held[3]["realised_lt"] != free[3]["realised_st"] + free[3]["realised_lt"]
    assert held[4]["borrow"] > free[4]["borrow"]
    assert held[4]["gross_ret"] != free[4]["gross_ret"]


def test_recertified_name_is_sold_and_charged(spark):
    out = {(2, t) for t in range(3, 9)}
    got = run(spark, steady(out=out, frozen=[(2, 3, 5)]), exits="carry_v1")
    assert [r["n_frozen"] for r in got] == [0, 0, 0, 1, 1, 0, 0, 0, 0]
    assert got[5]["cost"] > got[6]["cost"] and got[5]["realised_st"] + got[5]["realised_lt"] > 0.01


def test_no_new_position_in_an_uncertified_name(spark):
    got = run(spark, steady(frozen=[(2, 0, 9)]), exits="carry_v1")
    assert all(r["n_blocked"] == 1 and r["n_frozen"] == 0 for r in got)


def test_missing_return_is_stale_for_good(spark):
    got = run(spark, steady(unpriced=[(2, 3, 4)]), exits="carry_v1")
    assert [r["status"] for r in got] == ["resolved"] * 3 + ["unresolved"] * 6 and [r["n_stale"] for r in got] == [0] * 3 + [1] * 6


@pytest.mark.parametrize("cost", [0.02, None])
def test_documented_exit_closes_once(spark, cost):
    rows = steady(gone=[(2, 4, 6)], out={(2, t) for t in range(6, 9)})
    got = run(spark, rows, exits="carry_v1", evidence=[(2, MONTHS[4], cost), (9, MONTHS[4], 0.5)])
    assert [r["n_closed"] for r in got] == [0] * 4 + [1] + [0] * 4 and got[4]["realised_st"] + got[4]["realised_lt"] > 0
    assert got[4]["status"] == ("resolved" if cost else "unsupported")
    none = run(spark, rows, exits="carry_v1", evidence=[(2, MONTHS[4], 0.0)])
    assert got[4]["cost"] - none[4]["cost"] == pytest.approx(0.25 * 1.1 / (1 + got[3]["gross_ret"]) * (cost or 0.0))


def test_disappearance_is_unresolved_and_stays_so(spark):
    rows = steady(gone=[(2, 4, 6)])
    for evidence in (None, [(1, MONTHS[4], 0.01)], [(2, MONTHS[8], 0.01)]):
        got = run(spark, rows, exits="carry_v1", evidence=evidence)
        assert [r["n_unresolved"] for r in got] == [0] * 4 + [1] * 5 and not any(r["n_closed"] for r in got)


def test_total_loss_is_realised_at_the_exit(spark):
    rows = [(*r[:4], -1.0 if (r[2], r[1]) == (2, MONTHS[3]) else r[4], *r[5:]) for r in steady(gone=[(2, 4, 9)])]
    got = run(spark, rows, exits="carry_v1", evidence=[(2, MONTHS[4], 0.0)])
    assert got[4]["n_closed"] == 1 and got[4]["realised_st"] + got[4]["realised_lt"] < -0.2
    lost = run(spark, rows, exits="carry_v1")
    assert not any(r["n_closed"] for r in lost) and lost[8]["n_unresolved"] == 1


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        run(spark, book(), exits="carry_v2")


def test_liquidation_tax_is_the_rise_of_the_year_tax(spark):
    got = run(spark, book(), marked=False)
    for r in got:
        assert r["deferred_tax"] <= 0.4 * max(r["unrealised"], 0) + 0.4 * abs(r["unrealised"]) + 1e-9
    assert any(r["deferred_tax"] > 0 for r in got)


def test_overhang_adds_up(spark):
    rows = book()
    df = spark.createDataFrame(rows, ROWS)
    runs = spark.createDataFrame([("c", "r", "fifo", 0.4, 0.2, 3, 0, False, 1e5)], RUNS)
    acc = at.accounts(at.month_sums(at.name_paths(df, by=["cell"]), runs, by=["cell"], run=["cell"]), runs, run=["cell"])
    all_rows = [r.asDict() for r in acc.orderBy("m").collect()]
    (got,) = at.overhang(acc, by=["cell"], checkpoints=[str(MONTHS[5])]).collect()
    assert got.tax_paid == pytest.approx(sum(r["tax_ret"] * r["nav"] for r in all_rows[:6])) and got.deferred_tax == pytest.approx(all_rows[5]["deferred_tax"] * all_rows[5]["nav"])


def test_runs_of_a_book_share_its_names(spark):
    df = spark.createDataFrame(book(), ROWS)
    names = at.name_paths(df, by=["cell"])
    runs = [("c", "r", m, 0.4, 0.2, 3, w, k, 1e5) for m in ("fifo", "hifo") for w, k in ((0, False), (30, True))]
    runs = [(c, f"{r}{i}", *x) for i, (c, r, *x) in enumerate(runs)]
    key = ["cell", "regime", "method"]
    together = at.month_sums(names, spark.createDataFrame(runs, RUNS), by=["cell"], run=key).orderBy("regime", "t").collect()
    alone = [r for one in runs for r in at.month_sums(names, spark.createDataFrame([one], RUNS), by=["cell"], run=key).orderBy("t").collect()]
    assert [r[:5] for r in together] == [r[:5] for r in alone]
    assert np.allclose([r[5:] for r in together], [r[5:] for r in alone], rtol=1e-12, atol=1e-15)
    # the steps of a name are read once by column; nulls among returns stay nulls
    (path,) = at.paths(names.where("sec_id = 2").select("path").toArrow()["path"].combine_chunks())
    assert path[0].ok and [p.t for p in path.values()] == list(range(len(MONTHS)))


def test_names_are_dealt_over_the_tasks(spark, monkeypatch):
    """One small file of names is walked by as many tasks as a shuffle has.."""
    names = at.name_paths(spark.createDataFrame(book(), ROWS), by=["cell"]).coalesce(1)
    plans, write = [], at.written
    monkeypatch.setattr(at, "written", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), write(df, name))[1])
    runs = spark.createDataFrame([("c", "r", "fifo", 0.4, 0.2, 3, 0, False, 1e5)], RUNS)
    at.month_sums(names, runs, by=["cell"], run=["cell"])
    assert f"RoundRobinPartitioning({spark.conf.get('spark.sql.shuffle.partitions')})" in plans[0]


def test_idle_months_are_skipped():
    step = lambda t, w: at.Step(t, w, 0.01, 0.01, 0.02, 1e6, True)
    path = {t: step(t, w) for t, w in enumerate([0.0, 0.5, 0.0, 0.0, -0.2, 0.3, 0.0, 0.0])}
    run = {"method": "fifo", "long_months": 3, "wash_days": 0, "mark_to_market": False, "aum": 1e5, "gross": [0.0] * 9}
    found = [t for t, *_ in at.walk(path, [], MONTHS, run, "as_run", 1.0, 5.0)]
    assert found == [1, 2, 4, 5, 6]
    del path[2], path[6]  # unpriced months of a held name are steps
    assert [t for t, *_ in at.walk(path, [], MONTHS, run, "as_run", 1.0, 5.0)] == found


@pytest.mark.parametrize("exits", at.POLICIES)
def test_names_walked_at_once_equal_names_walked_alone(exits):
    """Long spells, flips, washes, gaps, freezes and terminal events: the arrays follow the rules of a single name."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    months = [dt.date(2000 + i // 12, i % 12 + 1, 28) for i in range(30)]
    kind = pa.list_(pa.struct([("t", pa.int32()), *((c, pa.float64()) for c in at.STEP[1:-1]), ("ok", pa.bool_())]))
    steps = lambda n: [
        dict(
            t=t, w=float(rng.choice([0.0, 0.3, 0.31, 0.5, -0.2, 0.2])) * (n % 3 < 2 or t > 12) + (n % 2) * 0.05 * t * (n % 5 == 1), r=None if rng.random() < 0.03 else float(rng.choice([0.0, rng.normal(0.0, 0.1)])),
            spread=0.01, sigma_d=0.02, adv_usd=1e5, ok=bool(rng.random() < 0.95),
        )
        for t in range(30) if rng.random() < 0.97
    ]
    column = pa.array([steps(n) for n in range(40)], kind)
    ends = [[{"t": int(t), "cost": None if rng.random() < 0.3 else 0.02} for t in sorted(rng.integers(0, 31, n % 3))] for n in range(40)]
    runs = [
        dict(method=m, long_months=4, wash_days=w, mark_to_market=k, aum=1e5, gross=[0.01 * (-1) ** t for t in range(30)])
        for m in ("fifo", "lifo", "hifo", "tax_optimal") for w, k in ((0, False), (30, False), (75, False), (0, True), (30, True))
    ]
    found = {(j, t): np.array(values) for j, t, *values in at.walk_all(at.dense(column, 30), ends, months, runs, exits, 1.0, 5.0)}
    alone: dict = {}
    for path, own in zip(at.paths(column), ends):
        for j, one in enumerate(runs):
            for t, *values in at.walk(path, own, months, one, exits, 1.0, 5.0):
                alone[j, t] = alone.get((j, t), 0.0) + np.array(values)
    assert found.keys() == alone.keys()
    assert all(np.allclose(found[key], alone[key], rtol=1e-9, atol=1e-12) for key in alone)
    told = dict(zip(at.SUMS, sum(alone.values())))
    assert told["disallowed"] > 0 and told["realised_lt"] != 0 and (exits == "as_run" or min(told[c] for c in ("n_frozen", "n_stale", "n_unresolved", "n_closed", "n_blocked", "n_uncosted")) > 0)
