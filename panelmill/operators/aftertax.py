"""After-tax accounts of long/short runs, with the names of a run walked in parallel.

All amounts are shares of the run's NAV at the start of the month. Costs and tax are paid out of all lots alike, so from one month to the
next a lot's share changes by (1 + its return) / (1 + gross return of the run) and by nothing else: a name needs no NAV and no tax of the
run, only the path of gross returns. So each name is one row with its months, and is walked under every run of its book by the task that
reads it; a task walks its names month by month, all at once as arrays, and adds them up by run and month before the shuffle. The NAV, tax
years and carried losses follow from a few numbers a month.

The gross return of a month depends on target weights alone, unless frozen names drift (``carry_v1``). Then the walk is repeated with
the gross returns of the pass before until they stay; as a month depends on earlier months only, every pass settles further months.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators.tax import Position, anniversary, fill
from panelmill.sources.io import written

POLICIES = ("as_run", "carry_v1")
SUMS = [
    "gross", "cost", "short", "exit_cost", "turnover", "realised_st", "realised_lt", "disallowed", "unreal_st", "unreal_lt",
    "n_frozen", "n_stale", "n_unresolved", "n_closed", "n_blocked", "n_uncosted",
]
STEP = ["t", "w", "r", "spread", "sigma_d", "adv_usd", "ok"]
UNRESOLVED = tuple(float(c == "n_unresolved") for c in SUMS)
SETTLED = 1e-12
#: Sums by run and month that a task holds before it hands them on.
MOST_SUMS = 1 << 18
#: Months of names that are walked at once.
MOST_STEPS = 1 << 19
#: What a total loss leaves of a lot under ``carry_v1``, so that its exit realises the loss.
LEFT = 1e-6


class Shares(Position):
    """Lots in shares of NAV."""

    __slots__ = ()
    DUST = 1e-13


def name_paths(rows: DataFrame, *, by: Sequence[str], id: str = "sec_id", month: str = "m", evidence: DataFrame | None = None) -> DataFrame:
    """One row per book (``by``) and name that is ever held: ``path`` (its months in order), ``exits`` and ``months`` (the book's calendar).

    ``rows`` has every month in which a name is priced, whether or not the book wants it: w, ret_next, spread, sigma_d, adv_usd, ok
    (tradeable). ``evidence`` has documented terminal events: id, event_date, cost (share of the closed value, null: unknown).
    """
    by = list(by)
    calendar = rows.select(*by, month).distinct().groupBy(*by).agg(F.sort_array(F.collect_list(month)).alias("months"))
    at = (F.array_position("months", F.col(month)) - 1).cast("int").alias("t")
    step = F.struct(at, F.col("w"), F.col("ret_next").alias("r"), "spread", "sigma_d", "adv_usd", F.coalesce("ok", F.lit(False)).alias("ok"))
    calendar = F.broadcast(calendar)  # one row per book
    placed = rows.join(calendar, by).select(*by, id, "w", step.alias("step"))
    held = placed.groupBy(*by, id).agg(F.sort_array(F.collect_list("step")).alias("path"), F.max(F.abs("w")).alias("most")).where("most > 0").drop("most")
    names = held.join(calendar, by)
    if evidence is None:
        return names.withColumn("exits", F.array().cast("array<struct<t:int,cost:double>>"))
    events = evidence.groupBy(id).agg(F.sort_array(F.collect_list(F.struct("event_date", F.col("cost").cast("double").alias("cost")))).alias("events"))
    when = lambda e: F.struct(F.size(F.filter("months", lambda m: m < e["event_date"])).alias("t"), e["cost"].alias("cost"))
    return names.join(events, id, "left").withColumn("exits", F.coalesce(F.transform("events", when), F.array().cast("array<struct<t:int,cost:double>>"))).drop("events")


Step = namedtuple("Step", STEP)


def paths(column: pa.Array) -> Iterator[dict[int, Step]]:
    """The steps of each name by month number; ``r`` is None where there is no return."""
    steps, ends = column.values, column.offsets.to_numpy().tolist()
    part = {c: steps.field(c) for c in STEP}
    lists = {c: a.fill_null(0.0 if c == "w" else float("nan")).to_numpy(zero_copy_only=False).tolist() for c, a in part.items() if c not in ("t", "ok")}
    lists["r"] = [None if gone else r for r, gone in zip(lists["r"], part["r"].is_null().to_numpy(zero_copy_only=False).tolist())]
    lists |= {c: part[c].to_numpy(zero_copy_only=False).tolist() for c in ("t", "ok")}
    rows = list(zip(*(lists[c] for c in STEP)))
    for a, b in zip(ends[:-1], ends[1:]):
        yield {row[0]: Step._make(row) for row in rows[a:b]}


def walk(path: dict[int, Step], ends: list[dict], months: list, run: dict, exits: str, k: float, bps: float) -> Iterator[tuple]:
    """(month number, one value for each of SUMS) for the months in which a name is wanted, held or unresolved under the run: the rules of
    ``walk_all`` for a single name."""
    carry = exits == "carry_v1"
    book = Shares(run["method"], run["long_months"], run["wash_days"])
    gross, aum, marked = run["gross"], run["aum"], run["mark_to_market"]
    events = list(ends)
    stale = unresolved = False
    wanted = iter([t for t, p in path.items() if p.w])
    ahead, t, end = next(wanted, len(months)), -1, len(months)
    while True:
        t += 1
        while ahead < t:
            ahead = next(wanted, end)
        if not book.lots:  # nothing happens until the name is wanted again
            t = ahead
        if t >= end:
            return
        p = path.get(t)
        when, now = months[t], book.worth()
        cost = exit_cost = realised_st = realised_lt = disallowed = closed = blocked = uncosted = 0.0
        fixed = False
        target = p.w if p else 0.0
        if carry and (unresolved or not p):
            due = [e for e in events if e["t"] <= t]
            if unresolved or stale or not due:
                unresolved = True
                yield (t, *UNRESOLVED)
                continue
            events.remove(due[0])
            closed = 1.0
            exit_cost = abs(now) * (due[0]["cost"] or 0.0)
            uncosted = float(due[0]["cost"] is None)
        elif carry and (stale or not p.ok):
            fixed, blocked = True, float(bool(target) and not now)
            target = now
        for _, gain, is_long, moved in [] if fixed else book.move(when, target):
            allowed = min(gain + moved, 0.0) if gain < 0 else gain
            if is_long:
                realised_lt += allowed
            else:
                realised_st += allowed
            disallowed += moved
        dw = abs(target - now)
        if p and p.ok and dw:
            cost = 0.5 * p.spread * dw + bps / 1e4 * dw + k * p.sigma_d * (aum / max(p.adv_usd, 1.0)) ** 0.5 * dw**1.5
        stale |= carry and target != 0 and p is not None and p.r is None
        r = 0.0 if stale or not p or p.r is None else p.r
        frozen = float(fixed and not stale and bool(book.lots))
        short = 0.0 if stale else max(-target, 0.0)
        book.grow(max(r, LEFT - 1.0) if carry else r)
        if marked and when.month == 12 and not stale:
            realised_st += book.mark()
        unreal_st, unreal_lt = book.unrealised_by_term(when)
        book.scale(1.0 / (1.0 + gross[t]))
        yield (
            t, target * r, cost, short, exit_cost, dw / 2, realised_st, realised_lt, disallowed, unreal_st, unreal_lt, frozen, float(stale), 0.0, closed, blocked, uncosted,
        )


def dense(column: pa.Array, months: int) -> dict[str, np.ndarray]:
    """The steps of all names as arrays of names by months; ``known`` and ``priced`` tell where there is a step and where it has a return."""
    steps, ends = column.values, column.offsets.to_numpy()
    steps = steps.slice(ends[0], ends[-1] - ends[0])
    at = np.repeat(np.arange(len(column)), np.diff(ends)), steps.field("t").to_numpy(zero_copy_only=False)

    def spread_out(values: np.ndarray, rest) -> np.ndarray:
        out = np.full((len(column), months), rest)
        out[at] = values
        return out

    numbers = {c: steps.field(c).fill_null(0.0 if c in ("w", "r") else float("nan")).to_numpy(zero_copy_only=False) for c in STEP if c not in ("t", "ok")}
    path = {c: spread_out(v, 0.0) for c, v in numbers.items()}
    path["ok"] = spread_out(steps.field("ok").to_numpy(zero_copy_only=False), False)
    path["priced"] = spread_out(steps.field("r").is_valid().to_numpy(zero_copy_only=False), False)
    path["known"] = spread_out(np.ones(len(steps), bool), False)
    return path


def totals(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``total`` of the first ``counts`` cells of each row, which are the only ones used; rounded alike, as equal ratios of lots must stay equal."""
    out = np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
    for n in np.unique(counts[counts >= 8]):
        out[counts == n] = np.sum(np.ascontiguousarray(x[counts == n, :n]), axis=1)
    return out


def fills(amounts: np.ndarray, rooms: np.ndarray) -> np.ndarray:
    """``fill`` row by row."""
    ends = np.cumsum(rooms, axis=1)
    return np.minimum(np.maximum(amounts[:, None] - (ends - rooms), 0.0), rooms)


class Cells:
    """A few cells for each row, those in use leftmost and in order of arrival; unused cells are 0."""

    def __init__(self, rows: int, **kinds):
        self.n = np.zeros(rows, np.int64)
        self.of = {c: np.zeros((rows, 2), kind) for c, kind in kinds.items()}

    def at(self, rows: np.ndarray) -> Cells:
        """A copy of some rows, as wide as the fullest of them."""
        some = object.__new__(Cells)
        some.n = self.n[rows]
        width = int(some.n.max(initial=0))
        some.of = {c: x[rows, :width] for c, x in self.of.items()}
        return some

    def put(self, rows: np.ndarray, some: Cells) -> None:
        self.n[rows] = some.n
        for c, x in some.of.items():
            width, have = x.shape[1], self.of[c].shape[1]
            if width > have:
                self.of[c] = np.pad(self.of[c], ((0, 0), (0, width - have)))
            self.of[c][rows, :width] = x
            self.of[c][rows, width:] = 0

    def add(self, rows: np.ndarray, **values) -> None:
        """One more cell for each of ``rows``, which are distinct."""
        at = self.n[rows]
        wide = int(at.max(initial=-1)) + 1
        for c, v in values.items():
            if wide > self.of[c].shape[1]:
                self.of[c] = np.pad(self.of[c], ((0, 0), (0, wide - self.of[c].shape[1])))
            self.of[c][rows, at] = v
        self.n[rows] += 1

    def keep(self, used: np.ndarray) -> None:
        if not used.all():
            order = np.argsort(~used, axis=1, kind="stable")
            self.n = used.sum(axis=1)
            width = int(self.n.max(initial=0))
            for c, x in self.of.items():
                self.of[c] = np.take_along_axis(np.where(used, x, 0), order[:, :width], axis=1)


def ranked(methods: np.ndarray, value: np.ndarray, basis: np.ndarray, side: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Places of each row's lots in the order in which they are sold; ``Position.ranked`` for many."""
    place = np.broadcast_to(np.arange(value.shape[1]), value.shape)
    gain = side[:, None] * (value - basis)
    optimal, loss = (methods == "tax_optimal")[:, None], gain < 0
    tier = np.where(optimal, np.where(loss, 0, np.where(long, 1, 2)), 0)
    key = np.where(optimal, np.where(loss, gain, -gain), place)  # lots are in order of purchase
    key = np.where((methods == "lifo")[:, None], -place, key)
    key = np.where((methods == "hifo")[:, None], -basis / np.maximum(value, 1e-12), key)
    return np.lexsort((key, np.where(value > 0, tier, 3)), axis=1)


def walk_all(path: dict[str, np.ndarray], ends: list[list[dict]], months: list, runs: list[dict], exits: str, k: float, bps: float) -> Iterator[tuple]:
    """(run number, month number, one sum for each of SUMS) over all names in the months in which any is wanted, held or unresolved.

    Every name under every run is a row, and follows the rules of ``walk`` and ``Shares``.
    """
    carry = exits == "carry_v1"
    names, end = path["w"].shape
    name, run = np.tile(np.arange(names), len(runs)), np.repeat(np.arange(len(runs)), names)
    rows = len(name)
    side, lots, debts = np.zeros(rows), Cells(rows, value=float, basis=float, opened=int, since=int), Cells(rows, left=float, since=int, long=bool)
    stale, unresolved, ahead = np.zeros(rows, bool), np.zeros(rows, bool), np.zeros(rows, int)
    method, wash = np.array([one["method"] for one in runs])[run], np.array([one["wash_days"] for one in runs])[run]
    aum, marked = np.array([one["aum"] for one in runs], float)[run], np.array([one["mark_to_market"] for one in runs])[run]
    gross = np.array([one["gross"] for one in runs], float)
    day = np.array([m.toordinal() for m in months])
    long_from = np.array([[anniversary(m, one["long_months"]).toordinal() for m in months] for one in runs])
    most = max(map(len, ends), default=0) + 1  # a last exit that never comes
    exit_t = np.array([[e["t"] for e in own] + [end] * (most - len(own)) for own in ends]).reshape(names, most)
    exit_cost = np.array([[np.nan if e["cost"] is None else e["cost"] for e in own] + [0.0] * (most - len(own)) for own in ends]).reshape(names, most)
    wanted = path["w"] != 0

    def sums(t: int, i: np.ndarray, found: dict, lost: np.ndarray) -> Iterator[tuple]:
        without = np.bincount(run[lost], minlength=len(runs))
        added = [np.bincount(run[i], found[c], len(runs)) if c in found else without if c == "n_unresolved" else np.zeros(len(runs)) for c in SUMS]
        for j in np.unique(run[np.append(i, lost)]).tolist():
            yield (j, t, *(float(a[j]) for a in added))

    for t in range(end):
        i = np.flatnonzero((lots.n > 0) | np.tile(wanted[:, t], len(runs)))
        closed, lost = np.zeros(rows, bool), i[:0]
        if carry:
            gone = i[unresolved[i] | ~path["known"][name[i], t]]
            due = exit_t[name[gone], ahead[gone]] <= t
            off = unresolved[gone] | stale[gone] | ~due
            lost = gone[off]
            unresolved[lost] = True
            closed[gone[~off]] = True
            i = i[~unresolved[i]]
        if not len(i):
            yield from sums(t, i, {}, lost)
            continue
        n, u = name[i], run[i]
        known, ok, priced = (path[c][n, t] for c in ("known", "ok", "priced"))
        own, owed_to, s = lots.at(i), debts.at(i), side[i]
        lot, debt = own.of, owed_to.of
        now = s * totals(lot["value"], own.n)
        target = path["w"][n, t]
        fixed = (stale[i] | ~ok) & ~closed[i] if carry else np.zeros(len(i), bool)
        blocked = fixed & (target != 0) & (now == 0)
        target = np.where(fixed, now, target)
        found = {"exit_cost": np.zeros(len(i)), "n_uncosted": np.zeros(len(i))}
        if carry:
            fee = exit_cost[n, ahead[i]]
            found["exit_cost"] = np.where(closed[i], np.abs(now) * np.nan_to_num(fee), 0.0)
            found["n_uncosted"] = closed[i] & np.isnan(fee)
            ahead[i] += closed[i]
        realised, disallowed = np.zeros((2, len(i))), np.zeros(len(i))  # short-term, long-term
        owed_to.keep((debt["left"] > 0) & (day[debt["since"]] >= day[t] - wash[i][:, None]))
        same = now * target >= 0
        keep, missing = np.where(same, np.abs(target), 0.0), np.abs(target) - np.where(same, np.abs(now), 0.0)

        q = np.flatnonzero(~fixed & (np.abs(now) > keep))
        if len(q):
            value, basis, opened = lot["value"], lot["basis"], lot["opened"]
            long = (s[q] > 0)[:, None] & (day[t] > long_from[u[q][:, None], lot["since"][q]])
            order = ranked(method[i[q]], value[q], basis[q], s[q], long)
            parts = fills(np.abs(now[q]) - keep[q], np.take_along_axis(value[q], order, axis=1))
            for j in range(parts.shape[1]):  # one after another: a loss may raise the basis of a lot that is sold next
                z = np.flatnonzero(parts[:, j] > 1e-12)
                r, c, part = q[z], order[z, j], parts[z, j]
                cost = basis[r, c] * part / value[r, c]
                gain, is_long = s[r] * (part - cost), long[z, c]
                basis[r, c] -= cost
                value[r, c] -= part
                moved = np.zeros(len(r))
                x = np.flatnonzero((wash[i[r]] > 0) & (gain < 0))
                if len(x):  # into lots bought shortly before, none of which is held from a later day than the sale
                    at, loss = r[x], -gain[x]
                    near = (s[at] > 0)[:, None] & (day[opened[at]] >= day[t] - wash[i[at]][:, None])
                    taken = fills(loss, np.where(near, value[at], 0.0))
                    basis[at] += taken
                    moved[x] = totals(taken, own.n[at])
                    waits = loss - moved[x] > 1e-12
                    owed_to.add(at[waits], left=(loss - moved[x])[waits], since=t, long=is_long[x][waits])
                realised[is_long.astype(int), r] += np.where(gain < 0, np.minimum(gain + moved, 0.0), gain)
                disallowed[r] += moved
            dust = np.zeros_like(value, dtype=bool)
            dust[q] = value[q] <= Shares.DUST
            value[dust] = basis[dust] = 0.0

        q = np.flatnonzero(~fixed & (missing > 0))
        if len(q):
            s[q] = np.where(target[q] > 0, 1.0, -1.0)
            basis, since = missing[q].copy(), np.full(len(q), t)
            x = np.flatnonzero((s[q] > 0) & (owed_to.n[q] > 0))
            if len(x):
                at = q[x]
                taken = fills(missing[at], debt["left"][at])
                basis[x] += totals(taken, owed_to.n[at])
                since[x] = np.where(taken > 0, debt["since"][at], t).min(axis=1)
                today = np.where(debt["since"][at] == t, taken, 0.0)  # sales of other months are told already
                disallowed[at] += today.sum(axis=1)
                realised[0, at] += np.where(debt["long"][at], 0.0, today).sum(axis=1)
                realised[1, at] += np.where(debt["long"][at], today, 0.0).sum(axis=1)
                left = debt["left"][at] - taken
                debt["left"][at] = np.where(left > 1e-12, left, 0.0)
            own.add(q, value=missing[q], basis=basis, opened=t, since=since)

        dw = np.abs(target - now)
        impact = k * path["sigma_d"][n, t] * (aum[i] / np.maximum(path["adv_usd"][n, t], 1.0)) ** 0.5 * dw**1.5
        cost = np.where(known & ok & (dw != 0), 0.5 * path["spread"][n, t] * dw + bps / 1e4 * dw + impact, 0.0)
        if carry:
            stale[i] |= (target != 0) & known & ~priced
        off = stale[i]
        r = np.where(off | ~priced, 0.0, path["r"][n, t])
        frozen = fixed & ~off & (own.n > 0)
        lot["value"] *= np.maximum(1.0 + (np.maximum(r, LEFT - 1.0) if carry else r), 0.0)[:, None]
        own.keep(lot["value"] > Shares.DUST)
        gains = s[:, None] * (lot["value"] - lot["basis"])
        if months[t].month == 12:
            here = marked[i] & ~off
            realised[0] += np.where(here, totals(gains, own.n), 0.0)
            lot["basis"] = np.where(here[:, None], lot["value"], lot["basis"])
            gains[here] = 0.0
        long = (s > 0)[:, None] & (day[t] > long_from[u[:, None], lot["since"]])
        yield from sums(t, i, found | {
            "gross": target * r, "cost": cost, "short": np.where(off, 0.0, np.maximum(-target, 0.0)), "turnover": dw / 2,
            "realised_st": realised[0], "realised_lt": realised[1], "disallowed": disallowed,
            "unreal_st": np.where(long, 0.0, gains).sum(axis=1), "unreal_lt": np.where(long, gains, 0.0).sum(axis=1),
            "n_frozen": frozen, "n_stale": off, "n_closed": closed[i], "n_blocked": blocked,
        }, lost)
        factor = (1.0 / (1.0 + gross[u, t]))[:, None]
        lot["value"] *= factor
        lot["basis"] *= factor
        debt["left"] *= factor
        side[i] = s
        lots.put(i, own)
        debts.put(i, owed_to)


def _gross(sums: DataFrame, run: Sequence[str]) -> DataFrame:
    """Gross returns of each run as an array by month number; months without rows are 0."""
    by_month = sums.groupBy(*run).agg(F.map_from_entries(F.collect_list(F.struct("t", "gross"))).alias("__g"), F.max("n_months").alias("__n"))
    return by_month.select(*run, F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda t: F.coalesce(F.element_at("__g", t), F.lit(0.0))).alias("gross"))


def month_sums(names: DataFrame, runs: DataFrame, *, by: Sequence[str], run: Sequence[str], exits: str = "as_run", k: float = 1.0, bps: float = 5.0) -> DataFrame:
    """(run, t, m, SUMS) of every run; ``runs`` has its book (``by``), method, long_months, wash_days, mark_to_market and aum."""
    if exits not in POLICIES:
        raise ValueError(f"exits must be one of {POLICIES}")
    by, run = list(by), list(run)
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = names.select(*by, F.size("months").alias("n_months"), F.explode("path").alias("p")).groupBy(*by, "n_months", "p.t").agg(F.sum(F.col("p.w") * F.coalesce("p.r", F.lit(0.0))).alias("gross"))
    path = runs.select(*run).join(_gross(steps, by), by)
    fields = [f"{r} {runs.schema[r].dataType.simpleString()}" for r in run]
    schema = ", ".join([*fields, "t int", "m date", "n_months int", *(f"{c} double" for c in SUMS)])
    rules = list(dict.fromkeys([*run, "method", "long_months", "wash_days", "mark_to_market", "aum", "gross"]))

    def months(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[tuple, list] = {}  # by run: for each month None or its sums

        def rows() -> pa.RecordBatch:
            found = [(*key, t, calendar[t], len(calendar), *values) for key, (calendar, sums) in added.items() for t, values in enumerate(sums) if values]
            added.clear()
            return pa.RecordBatch.from_pandas(_frame(dict(zip([*run, "t", "m", "n_months", *SUMS], zip(*found)))), preserve_index=False)

        held = 0
        for batch in batches:
            books: dict[tuple, list[int]] = {}
            for i, book in enumerate(zip(*(batch.column(c).to_pylist() for c in by))):
                if book in of_book:
                    books.setdefault(book, []).append(i)
            for book, mine in books.items():
                calendar, under = batch.column("months")[mine[0]].as_py(), of_book[book]
                keys = [tuple(one[c] for c in run) for one in under]
                for some in np.array_split(mine, -(-len(mine) * len(calendar) // MOST_STEPS)):
                    part = batch.take(pa.array(some))
                    for j, t, *values in walk_all(dense(part.column("path"), len(calendar)), part.column("exits").to_pylist(), calendar, under, exits, k, bps):
                        if keys[j] not in added:
                            added[keys[j]] = calendar, [None] * len(calendar)
                        sums = added[keys[j]][1]
                        have = sums[t]
                        held += have is None
                        sums[t] = values if have is None else list(map(add, have, values))
                    if held > MOST_SUMS:
                        yield rows()
                        held = 0
        if held:
            yield rows()

    while True:
        # one row per book: its runs and a few numbers a month, sent to the tasks once and not with every name
        of_book: dict[tuple, list[dict]] = {}
        for one in path.join(runs, run).select(*dict.fromkeys([*by, *rules])).collect():
            of_book.setdefault(tuple(one[c] for c in by), []).append(one.asDict())
        # names are walked in Python: they are dealt by number, as their size would gather them in a few tasks
        each = names.repartition(tasks).select(*by, "path", "exits", "months")
        sums = each.mapInArrow(months, schema).groupBy(*run, "t", "m", "n_months").agg(*[F.sum(c).alias(c) for c in SUMS])
        sums = written(sums, "month-sums")
        new = _gross(sums, run)
        off = new.withColumnRenamed("gross", "__new").join(path, run).select(F.array_max(F.zip_with("__new", "gross", lambda a, b: F.abs(a - b))).alias("d")).agg(F.max("d")).first()[0]
        if off is None or off < SETTLED:
            return sums
        path = written(new, "gross")


def _frame(columns: dict):
    import pandas as pd

    return pd.DataFrame(columns).astype({"t": "int32", "n_months": "int32"})


ACCOUNTS = (
    "m date, gross_ret double, cost double, borrow double, tax_ret double, after_tax_ret double, realised_st double, realised_lt double, disallowed double, "
    "unrealised double, deferred_tax double, turnover double, nav double, n_frozen long, n_stale long, n_unresolved long, n_closed long, n_blocked long, status string"
)


def owed(year: np.ndarray, carried: float, rates: np.ndarray) -> float:
    """Tax on a year's (short-term, long-term) gains; losses, carried ones too, lower short-term gains first."""
    gains, losses = np.maximum(year, 0.0), float(-np.minimum(year, 0.0).sum())
    return float(rates @ (gains - fill(carried + losses, gains)))


def accounts(sums: DataFrame, runs: DataFrame, *, run: Sequence[str], accounting: str = "year_end", borrow: float = 0.03) -> DataFrame:
    """Monthly accounts of every run from its sums: the NAV chain, tax by ``accounting`` and tax on liquidation.

    ``year_end`` pays in the last month of a year, ``accrual`` the monthly change of the liability, ``exempt`` nothing. ``deferred_tax`` is what
    closing all lots at the end of the month would add to the year's tax. ``status``: ``unresolved`` when a held name has no valuation,
    ``unsupported`` when an exit has no cost; from the rows of such months only the resolved part is told.
    """
    run = list(run)
    fields = ", ".join(f"{r} {runs.schema[r].dataType.simpleString()}" for r in run)
    names = [*run, *(c.split()[0] for c in ACCOUNTS.split(", "))]
    months = F.sort_array(F.collect_list(F.struct("t", "m", *SUMS))).alias("months")

    def chain(row: dict) -> Iterator[tuple]:
        nav, carried, paid, year = float(row["aum"]), 0.0, 0.0, np.zeros(2)
        rates = np.array([row["short_rate"], row["long_rate"]], float)
        steps = row["months"]
        for i, s in enumerate(steps):
            last = i + 1 == len(steps) or steps[i + 1]["m"].year != s["m"].year
            year = year + nav * np.array([s["realised_st"], s["realised_lt"]])
            due = owed(year, carried, rates)
            tax = {"accrual": due - paid, "year_end": due if last else 0.0}.get(accounting, 0.0)
            paid = due
            cost, lent = s["cost"] + s["exit_cost"], s["short"] * borrow / 12.0
            net = s["gross"] - cost - lent - tax / nav
            closing = owed(year + nav * np.array([s["unreal_st"], s["unreal_lt"]]), carried, rates) - due
            status = "unresolved" if s["n_stale"] + s["n_unresolved"] else "unsupported" if s["n_uncosted"] else "resolved"
            count = [int(s[c]) for c in ("n_frozen", "n_stale", "n_unresolved", "n_closed", "n_blocked")]
            yield (
                *(row[r] for r in run), s["m"], s["gross"], cost, lent, tax / nav, net, s["realised_st"], s["realised_lt"], s["disallowed"],
                s["unreal_st"] + s["unreal_lt"], closing / nav, s["turnover"], nav, *count, status,
            )
            if last:
                carried, paid, year = max(carried - float(year.sum()), 0.0), 0.0, np.zeros(2)
            nav = max(nav * (1.0 + net), 1e-6)

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for batch in batches:
            found = [v for row in batch.to_pylist() for v in chain(row)]
            if found:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=names), preserve_index=False)

    rows = sums.groupBy(*run).agg(months).join(runs.select(*run, "short_rate", "long_rate", "aum"), run)
    return rows.mapInArrow(chains, f"{fields}, {ACCOUNTS}")


def summary(monthly: DataFrame, *, by: Sequence[str], periods: int = 12) -> DataFrame:
    """Sharpe before and after costs and tax, drags, the long-term share of realised gains, turnover, and how many months are resolved."""
    from panelmill.functions import ratio

    net = F.col("gross_ret") - F.col("cost") - F.col("borrow")
    sharpe = lambda e: ratio(F.avg(e), F.stddev_samp(e)) * float(periods) ** 0.5
    gain = lambda c: F.sum(F.greatest(F.col(c), F.lit(0.0)))
    return monthly.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("months"), sharpe(F.col("gross_ret")).alias("gross_sharpe"), sharpe(net).alias("net_sharpe"),
        sharpe(F.col("after_tax_ret")).alias("after_tax_sharpe"), (F.avg("tax_ret") * periods * 1e4).alias("tax_drag_bps"),
        (F.avg(F.col("cost") + F.col("borrow")) * periods * 1e4).alias("cost_drag_bps"), F.avg("turnover").alias("turnover_mean"),
        ratio(gain("realised_lt"), gain("realised_lt") + gain("realised_st")).alias("lt_share"), F.avg("disallowed").alias("disallowed_mean"),
        F.sum((F.col("status") == "resolved").cast("long")).alias("resolved_months"),
    )


def overhang(monthly: DataFrame, *, by: Sequence[str], checkpoints: Sequence[str]) -> DataFrame:
    """Tax on liquidation at each checkpoint against the tax paid and the losses realised until then."""
    from pyspark.sql import Window

    from panelmill.functions import ratio

    w = Window.partitionBy(*by).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    run = monthly.withColumn("tax_paid", F.sum(F.col("tax_ret") * F.col("nav")).over(w))
    run = run.withColumn("harvested", F.sum(F.least(F.col("realised_st") + F.col("realised_lt"), F.lit(0.0)) * F.col("nav")).over(w))
    points = run.filter(reduce(lambda a, b: a | b, [F.col("m") == F.lit(c).cast("date") for c in checkpoints]))
    deferred = F.col("deferred_tax") * F.col("nav")
    return points.select(*by, "m", deferred.alias("deferred_tax"), "tax_paid", "harvested", ratio(deferred, deferred + F.col("tax_paid")).alias("overhang_share"))
