"""Long/short books, their trades, trading and borrow costs, capacity.

Books are long tables (keys, month, id, w). Trades come from one window per (keys, id): the previous book month is the
lag, and a name that leaves is seen from its last row, so no book is joined with itself. Mandate sizes are exploded
after that window, because the sort does not depend on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import count_if, group_stats, positive, quantiles, ratio, row_rank, spearman
from panelmill.functions.ranking import weighted_median
from panelmill.operators.xsection import tradeable

IMPACT_K, COMMISSION_BPS, IMPACT_EXPONENT, PARTICIPATION = 1.0, 5.0, 1.5, 0.12


def extreme_book(
    scores: DataFrame, *, by: Sequence[str], id: str, score: str = "score", groups: int = 10, gross: float = 2.0, cap: str | None = None,
) -> DataFrame:
    """Long the top and short the bottom group of every cross-section; other scored names stay with weight zero.

    ``cap`` weights each leg by capitalisation, equal weight when a leg has none.
    """
    by = list(by)
    rows = scores.filter(F.col(score).isNotNull())
    ranked = row_rank(rows, by, score, id, "__r")
    ranked = group_stats(ranked, by, __n=F.count(F.lit(1))).filter(F.col("__n") >= 2 * groups)
    edge = F.greatest(F.floor(F.col("__n") / groups), F.lit(1))
    leg = F.when(F.col("__r") <= edge, -1).when(F.col("__r") > F.col("__n") - edge, 1).otherwise(0)
    ranked = ranked.withColumn("__leg", leg).withColumn("__edge", edge)
    equal = F.col("__leg") * (gross / 2.0) / F.col("__edge")
    if cap is None:
        return ranked.withColumn("w", equal.cast("double")).drop("__r", "__n", "__leg", "__edge")
    ranked = group_stats(ranked.withColumn("__cap", positive(cap)), [*by, "__leg"], __tot=F.sum("__cap"))
    weighted = F.when(F.col("__tot") > 0, F.col("__leg") * (gross / 2.0) * F.coalesce("__cap", F.lit(0.0)) / F.col("__tot")).otherwise(equal)
    return ranked.withColumn("w", weighted.cast("double")).drop("__r", "__n", "__leg", "__edge", "__cap", "__tot")


def spread_return(
    df: DataFrame, *, by: Sequence[str], id: str, score: str, ret: str, frac: float = 0.1, cap: str | None = None
) -> DataFrame:
    """Top minus bottom mean return of each cross-section, equal- or cap-weighted; null below 2k+2 names."""
    by = list(by)
    rows = df.filter(F.col(score).isNotNull())
    ranked = group_stats(row_rank(rows, by, score, id, "__r"), by, __n=F.count(F.lit(1)))
    k = F.greatest(F.floor(F.col("__n") * frac), F.lit(1))
    top, bottom = F.col("__r") >= F.col("__n") - k + 1, F.col("__r") <= k
    if cap is None:
        leg = lambda side: F.avg(F.when(side, F.col(ret)))
    else:
        ok = (F.col(cap) > 0) & F.col(ret).isNotNull()
        leg = lambda side: ratio(F.sum(F.when(side & ok, F.col(ret) * F.col(cap))), F.sum(F.when(side & ok, F.col(cap))))
    g = ranked.withColumn("__k", k).groupBy(*by).agg(
        F.max("__n").cast("long").alias("n"), (leg(top) - leg(bottom)).alias("__s"), F.max("__k").alias("__k")
    )
    return g.select(*by, "n", F.when(F.col("n") >= 2 * F.col("__k") + 2, F.col("__s")).alias("spread_ret"))


def cap_participation(w: str | Column, adv: str | Column, aum: str | Column, p: float = PARTICIPATION) -> Column:
    """Weight held to a share of daily volume; no volume means no position."""
    w = F.col(w) if isinstance(w, str) else w
    limit = F.coalesce(p * (F.col(adv) if isinstance(adv, str) else adv) / (F.col(aum) if isinstance(aum, str) else aum), F.lit(0.0))
    return F.signum(w) * F.least(F.abs(w), limit)


def trade_cost(
    dw: Column, spread: Column, sigma: Column, adv: Column, aum: Column, k: float = IMPACT_K, bps: float = COMMISSION_BPS,
    e: float = IMPACT_EXPONENT,
) -> tuple[Column, Column]:
    """(half-spread plus commission, market impact) of a trade; missing inputs cost nothing."""
    size = F.abs(dw)
    ok = (adv > 0) & spread.isNotNull() & sigma.isNotNull()
    linear = F.when(ok, 0.5 * spread * size + bps / 10000.0 * size).otherwise(0.0)
    impact = F.when(ok, k * sigma * F.sqrt(aum / F.greatest(adv, F.lit(1.0))) * F.pow(size, e)).otherwise(0.0)
    return linear, impact


def borrow_cost(w: Column, fee: Column | float) -> Column:
    return F.greatest(-w, F.lit(0.0)) * fee / 12.0


def book_dates(book: DataFrame, by: Sequence[str], month: str) -> DataFrame:
    """Position of each book month, and whether it is the last."""
    w = Window.partitionBy(*by).orderBy(month)
    return book.select(*by, month).distinct().select(
        *by, month, F.row_number().over(w).alias("__i"), F.lead(month).over(w).alias("__next_m")
    )


STATE = ("w", "ret_next", "spread", "sigma_d", "adv_usd")


def trades(book: DataFrame, *, by: Sequence[str], id: str, month: str) -> DataFrame:
    """Current and previous position of every name in every book month.

    ``event`` is ``held`` for names scored this month and ``exit`` for names that were in the previous book month and are
    not scored now. ``cur`` and ``prev`` are structs of weight, return and cost inputs; the missing side is null.
    """
    by = list(by)
    rows = book.join(book_dates(book, by, month), [*by, month])
    w = Window.partitionBy(*by, id).orderBy(month)
    now = F.struct(*STATE)
    rows = rows.select(
        *by, id, month, "__i", "__next_m", now.alias("__now"),
        F.when(F.lag("__i").over(w) == F.col("__i") - 1, F.lag(now).over(w)).alias("__prev"),
        F.coalesce(F.lead("__i").over(w) == F.col("__i") + 1, F.lit(False)).alias("__stays"),
    )
    leaves = ~F.col("__stays") & F.col("__next_m").isNotNull()
    held = F.struct(F.lit("held").alias("event"), F.col(month).alias("m"), F.col("__now").alias("cur"), F.col("__prev").alias("prev"))
    gone = F.struct(
        F.lit("exit").alias("event"), F.col("__next_m").alias("m"), F.when(F.lit(False), F.col("__now")).alias("cur"), F.col("__now").alias("prev")
    )
    events = F.explode(F.when(leaves, F.array(held, gone)).otherwise(F.array(held)))
    return rows.select(*by, id, events.alias("__e")).select(
        *by, id, "__e.event", F.col("__e.m").alias(month), F.col("__e.cur").alias("cur"), F.col("__e.prev").alias("prev")
    )


def _side(field: str) -> Column:
    """Inputs of this month for held names, of last month for names that left."""
    return F.when(F.col("event") == "held", F.col(f"cur.{field}")).otherwise(F.col(f"prev.{field}"))


def ladder(
    book: DataFrame, aums: Sequence[float], *, by: Sequence[str], id: str, month: str, k: float = IMPACT_K, bps: float = COMMISSION_BPS,
    e: float = IMPACT_EXPONENT, p: float = PARTICIPATION,
) -> DataFrame:
    """Monthly gross and net returns of the uncapped and the participation-capped book at every mandate size."""
    t = trades(book, by=by, id=id, month=month).withColumn("aum", F.explode(F.array(*[F.lit(float(a)) for a in aums])))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    w1, w0 = zero(F.col("cur.w")), zero(F.col("prev.w"))
    c1 = zero(cap_participation(F.col("cur.w"), F.col("cur.adv_usd"), "aum", p))
    c0 = zero(cap_participation(F.col("prev.w"), F.col("prev.adv_usd"), "aum", p))
    inputs = (_side("spread"), _side("sigma_d"), _side("adv_usd"), F.col("aum"), k, bps, e)
    total = lambda dw: sum(trade_cost(dw, *inputs)[1:], trade_cost(dw, *inputs)[0])
    r = zero(F.col("cur.ret_next"))
    g = t.groupBy(*by, "aum", month).agg(
        F.sum(w1 * r).alias("gross_ret"), F.sum(total(w1 - w0)).alias("__cu"),
        F.sum(c1 * r).alias("gross_ret_capped"), F.sum(total(c1 - c0)).alias("__cc"), F.sum(F.abs(c1)).alias("gross_capped"),
    )
    return g.select(
        *by, "aum", month, "gross_ret", (F.col("gross_ret") - F.col("__cu")).alias("net_ret_uncapped"), "gross_ret_capped",
        (F.col("gross_ret_capped") - F.col("__cc")).alias("net_ret_capped"), "gross_capped",
    )


def infeasibility(book: DataFrame, aums: Sequence[float], *, by: Sequence[str], month: str, p: float = PARTICIPATION) -> DataFrame:
    """Median and 95th percentile of position size over its participation cap."""
    held = book.filter((F.col("w") != 0) & (F.col("adv_usd") > 0) & F.col("spread").isNotNull() & F.col("sigma_d").isNotNull())
    mult = held.withColumn("aum", F.explode(F.array(*[F.lit(float(a)) for a in aums])))
    mult = mult.withColumn("x", F.abs("w") * F.col("aum") / (p * F.col("adv_usd")))
    return quantiles(mult, [*by, "aum", month], "x", {"median_x_cap": 0.5, "p95_x_cap": 0.95})


def drifted_trades(book: DataFrame, *, by: Sequence[str], id: str, month: str, inputs: DataFrame) -> DataFrame:
    """Trades against last month's book drifted by its returns: previous weight * (1 + r) / (1 + R).

    ``inputs`` (id, month, spread, sigma_d, adv_usd) tells who is still in the panel: without a row the position has been
    closed and drops out; with unusable inputs it is frozen.
    """
    by = list(by)
    gross = book.groupBy(*by, month).agg(F.sum(F.col("w") * F.coalesce("ret_next", F.lit(0.0))).alias("__R"))
    t = trades(book, by=by, id=id, month=month)
    dates = book_dates(book, by, month).select(*by, F.col("__next_m").alias(month), F.col(month).alias("__pm")).filter(F.col(month).isNotNull())
    prior = dates.join(gross.withColumnRenamed(month, "__pm"), [*by, "__pm"]).select(*by, month, F.col("__R"))
    now = inputs.select(id, month, *[F.col(c).alias(f"in_{c}") for c in ("spread", "sigma_d", "adv_usd")], F.lit(True).alias("__in"))
    out = t.join(prior, [*by, month], "left").join(now, [id, month], "left").filter(F.col("__in"))
    drift = F.col("prev.w") * (1.0 + F.coalesce("prev.ret_next", F.lit(0.0))) / (1.0 + F.coalesce("__R", F.lit(0.0)))
    return out.select(
        *by, id, month, "event", F.coalesce("cur.w", F.lit(0.0)).alias("w"), F.coalesce(drift, F.lit(0.0)).alias("w_prev"),
        F.coalesce("prev.w", F.lit(0.0)).alias("w_target_prev"), F.coalesce("cur.ret_next", F.lit(0.0)).alias("ret_next"),
        F.col("in_spread").alias("spread"), F.col("in_sigma_d").alias("sigma_d"), F.col("in_adv_usd").alias("adv_usd"),
        tradeable("in_spread", "in_sigma_d", "in_adv_usd").alias("ok"), F.col("prev").alias("prev"),
    )


def backtest_drifted(
    book: DataFrame, inputs: DataFrame, *, by: Sequence[str], id: str, month: str, aum: float, borrow: float, k: float = IMPACT_K,
    bps: float = COMMISSION_BPS,
) -> DataFrame:
    """Monthly accounts: trade cost on tradeable names, borrow on every short, returns on the whole book."""
    t = drifted_trades(book, by=by, id=id, month=month, inputs=inputs)
    dw = F.when(F.col("ok"), F.col("w") - F.col("w_prev")).otherwise(0.0)
    lin, imp = trade_cost(dw, F.col("spread"), F.col("sigma_d"), F.col("adv_usd"), F.lit(float(aum)), k, bps)
    w, r = F.col("w"), F.col("ret_next")
    g = t.groupBy(*by, month).agg(
        F.sum(w * r).alias("gross_ret"), F.sum(lin).alias("cost_spread"), F.sum(imp).alias("cost_impact"),
        F.sum(borrow_cost(w, borrow)).alias("cost_borrow"), (F.sum(F.abs(dw)) / 2).alias("turnover"),
        F.sum(F.greatest(w, F.lit(0.0)) * r).alias("long_ret"), F.sum(F.least(w, F.lit(0.0)) * r).alias("short_ret"),
        F.sum(F.when(~F.col("ok"), F.abs(F.col("w") - F.col("w_prev"))).otherwise(0.0)).alias("frozen_moved"),
    )
    net = F.col("gross_ret") - F.col("cost_spread") - F.col("cost_impact") - F.col("cost_borrow")
    return g.withColumn("net_ret", net)


def performance(returns: DataFrame, *, by: Sequence[str], month: str, gross: str, net: str, turnover: str, periods: int = 12) -> DataFrame:
    """Sharpe ratios, annual mean and volatility, worst drawdown of compounded wealth, turnover, cost drag."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(month)  # one row per month
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    # wealth as a running product; once a month loses everything the path stays at zero
    logs = F.sum(F.ln(F.greatest(1.0 + F.col(net), F.lit(1e-300)))).over(run)
    curve = returns.withColumn("__v", F.exp(logs))
    curve = curve.withColumn("__dd", F.col("__v") / F.max("__v").over(run) - 1.0)
    sharpe = lambda c: ratio(F.avg(c), F.stddev_samp(c)) * float(periods) ** 0.5
    return curve.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("months"), sharpe(gross).alias("gross_sharpe"), sharpe(net).alias("net_sharpe"),
        (F.avg(gross) * periods).alias("gross_mean_ann"), (F.avg(net) * periods).alias("net_mean_ann"),
        (F.stddev_samp(net) * float(periods) ** 0.5).alias("vol_ann"), F.min("__dd").alias("max_drawdown"),
        F.avg(turnover).alias("turnover_mean"), ((F.avg(gross) - F.avg(net)) * periods * 10000.0).alias("cost_drag_bps"),
    )


def capacity_ceiling(inputs: DataFrame, aums: Sequence[float], *, month: str, max_weight: float, p: float = PARTICIPATION) -> DataFrame:
    """Largest gross exposure the caps allow per month and mandate size."""
    rows = inputs.filter(tradeable()).withColumn("aum", F.explode(F.array(*[F.lit(float(a)) for a in aums])))
    by_volume = F.greatest(p * F.col("adv_usd") / F.col("aum"), F.lit(1e-6))
    return rows.groupBy("aum", month).agg(
        F.count(F.lit(1)).cast("long").alias("names"),
        F.sum(F.least(F.lit(max_weight), F.greatest(by_volume, F.lit(1e-5)))).alias("max_gross"),
        F.avg((by_volume < max_weight).cast("double")).alias("share_volume_capped"),
    )


def book_stats(book: DataFrame, *, by: Sequence[str], month: str) -> DataFrame:
    per_month = book.groupBy(*by, month).agg(
        F.sum(F.abs("w")).alias("g"), F.sum("w").alias("net"), count_if(F.abs("w") > 1e-9).alias("names")
    )
    return per_month.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("months"), F.avg("g").alias("mean_gross"), F.percentile("g", F.lit(0.5)).alias("median_gross"),
        F.max("g").alias("max_gross"), F.avg("names").alias("mean_names"), F.avg(F.abs("net")).alias("mean_abs_net"),
    )


def _corr(x: Column, y: Column, min_n: int = 10) -> Column:
    """Correlation over complete pairs, null for few pairs or a constant side."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    flat = (F.stddev_pop(a) < 1e-15) | (F.stddev_pop(b) < 1e-15) | (F.count(a) < min_n)
    return F.when(~F.coalesce(flat, F.lit(True)), F.corr(a, b))


def dose_response(book: DataFrame, aums: Sequence[float], *, by: Sequence[str], month: str, signal: str, p: float = PARTICIPATION) -> DataFrame:
    """Per month and mandate size: is position size explained by liquidity or by the signal, and how many sit at the cap."""
    rows = book.filter(F.abs("w") > 1e-12).withColumn("aum", F.explode(F.array(*[F.lit(float(a)) for a in aums])))
    rows = rows.withColumn("cap", p * F.col("adv_usd") / F.col("aum")).withColumn("wc", cap_participation("w", "adv_usd", "aum", p))
    size = F.abs("wc")
    per_month = rows.groupBy(*by, "aum", month).agg(
        F.count("cap").cast("long").alias("n"), _corr(size, F.col("cap")).alias("corr_cap"), _corr(size, F.abs(signal)).alias("corr_size_signal"),
        _corr(F.col("wc"), F.col(signal)).alias("corr_signed_signal"),
        F.avg(F.when(F.col("cap").isNotNull(), (size >= F.col("cap") * 0.999).cast("double"))).alias("share_at_cap"),
    )
    return per_month.groupBy(*by, "aum").agg(
        F.count(F.lit(1)).cast("long").alias("months"), *[F.avg(c).alias(c) for c in ("corr_cap", "corr_size_signal", "corr_signed_signal", "share_at_cap")]
    )


def volume_support(book: DataFrame, inputs: DataFrame, aums: Sequence[float], *, by: Sequence[str], id: str, month: str) -> DataFrame:
    """Share of traded notional above 12% and 100% of daily volume, and the notional-weighted median trade."""
    t = trades(book, by=by, id=id, month=month)
    size = F.abs(F.coalesce("cur.w", F.lit(0.0)) - F.coalesce("prev.w", F.lit(0.0)))
    t = t.select(*by, id, month, size.alias("size")).filter("size > 0").join(inputs.select(id, month, "adv_usd"), [id, month])
    rows = t.filter("adv_usd > 0").withColumn("aum", F.explode(F.array(*[F.lit(float(a)) for a in aums])))
    rows = rows.withColumn("x", F.col("size") * F.col("aum") / F.col("adv_usd"))
    above = lambda lim: ratio(F.sum(F.when(F.col("x") > lim, F.col("size")).otherwise(0.0)), F.sum("size"))
    shares = rows.groupBy(*by, "aum").agg(above(0.12).alias("share_gt_12pct"), above(1.0).alias("share_gt_100pct"))
    return shares.join(weighted_median(rows, [*by, "aum"], "x", "size", "median_trade"), [*by, "aum"])


def cap_violations(
    book: DataFrame, inputs: DataFrame, *, by: Sequence[str], id: str, month: str, aum: float, p: float = PARTICIPATION, tol: float = 1.001
) -> DataFrame:
    """Trades beyond their participation cap against the drifted book, and movement of names that could not trade."""
    t = drifted_trades(book, by=by, id=id, month=month, inputs=inputs)
    first = book_dates(book, by, month).filter("__i = 1").select(*by, F.col(month).alias("__first"))
    t = t.join(first, list(by)).filter(F.col(month) > F.col("__first"))
    moved = F.abs(F.col("w") - F.col("w_prev"))
    cap = F.greatest(p * F.col("adv_usd") / aum, F.lit(1e-6))
    live = F.col("ok") & (moved > 1e-12)
    over = live & (moved > cap * tol)
    return t.groupBy(*by).agg(
        count_if(live).alias("trades"), count_if(over).alias("over_cap"), F.max(F.when(over, moved / cap)).alias("worst_multiple"),
        F.coalesce(F.sum(F.when(over, moved - cap)), F.lit(0.0)).alias("excess"),
        F.coalesce(F.max(F.when(~F.col("ok"), moved)), F.lit(0.0)).alias("frozen_moved"),
    )


def proposal_fidelity(pairs: DataFrame, *, by: Sequence[str], month: str, w: str, prop: str, min_n: int = 40) -> DataFrame:
    """Sign agreement of weights with proposals, overall, among large proposals and size-weighted; mean rank correlation."""
    keys = [*by, month]
    rows = pairs.withColumn("__a", F.abs(prop))
    cuts = quantiles(rows, keys, "__a", {"__q50": 0.5, "__q80": 0.8}).filter(F.col("n") >= min_n)
    rows = rows.join(cuts, keys)
    agree = (F.signum(w) == F.signum(prop)).cast("double")
    monthly = rows.groupBy(*keys).agg(
        F.avg(agree).alias("sign_all"), F.avg(F.when(F.col("__a") >= F.col("__q50"), agree)).alias("sign_top_half"),
        F.avg(F.when(F.col("__a") >= F.col("__q80"), agree)).alias("sign_top_quintile"),
        (F.sum(agree * F.col("__a")) / F.greatest(F.sum("__a"), F.lit(1e-12))).alias("sign_weighted"),
    )
    ranks = spearman(pairs, keys, w, prop, min_n=min_n, out="rank_corr").drop("n")
    cols = ["sign_all", "sign_top_half", "sign_top_quintile", "sign_weighted", "rank_corr"]
    return monthly.join(ranks, keys).groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("months"), *[F.avg(c).alias(c) for c in cols])


def arm_information(df: DataFrame, *, by: Sequence[str], month: str, score: str, target: str, min_n: int = 11) -> DataFrame:
    ics = spearman(df, [*by, month], score, target, min_n=min_n)
    return ics.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"), F.count("ic").cast("long").alias("months"))


SWITCHES = "DXB"


def cost_lattice(book: DataFrame, inputs: DataFrame, *, by: Sequence[str], id: str, month: str, aum: float, borrow: float) -> DataFrame:
    """Monthly cost under all eight conventions, with the Shapley share of each switch.

    Switches (A or B): D trades against last targets or the drifted book; X charges every exit at last month's inputs or
    only names priced now; B leaves out or charges borrow.
    """
    t = drifted_trades(book, by=by, id=id, month=month, inputs=inputs.filter(tradeable()))
    every = trades(book, by=by, id=id, month=month).select(*by, id, month, "event", "prev", "cur")
    dates = t.select(*by, id, month, "w_prev", F.lit(True).alias("__now"), "spread", "sigma_d", "adv_usd")
    rows = every.join(dates, [*by, id, month], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aum_c = F.lit(float(aum))
    cost = lambda dw, s: sum(trade_cost(dw, F.col(f"{s}spread"), F.col(f"{s}sigma_d"), F.col(f"{s}adv_usd"), aum_c)[1:],
                             trade_cost(dw, F.col(f"{s}spread"), F.col(f"{s}sigma_d"), F.col(f"{s}adv_usd"), aum_c)[0])
    w1 = zero(F.col("cur.w"))
    basis = {"A": zero(F.col("prev.w")), "B": zero(F.coalesce("w_prev", "prev.w"))}
    value: dict[str, Column] = {}
    for d in "AB":
        dw = w1 - basis[d]
        exit_ = F.col("event") == "exit"
        all_exits = F.when(exit_, cost(dw, "prev.")).otherwise(cost(dw, "cur."))
        priced = F.when(F.col("__now"), cost(dw, "")).otherwise(0.0)
        value[d + "A"], value[d + "B"] = F.sum(all_exits), F.sum(priced)
    fee = F.sum(borrow_cost(w1, borrow))
    g = rows.groupBy(*by, month).agg(*[v.alias(f"c_{k}") for k, v in value.items()], fee.alias("fee"))
    total = {f"{k}{b}": F.col(f"c_{k}") + (F.col("fee") if b == "B" else 0.0) for k in value for b in "AB"}
    shares = []
    for m in SWITCHES:
        acc = F.lit(0.0)
        for order in permutations(SWITCHES):
            done = order[: order.index(m)]
            code = lambda on: "".join("A" if s in on else "B" for s in SWITCHES)
            acc = acc + total[code((*done, m))] - total[code(done)]
        shares.append((acc / 6.0).alias(f"shapley_{m}"))
    return g.select(*by, month, *[c.alias(f"v_{k}") for k, c in total.items()], *shares, (total["AAA"] - total["BBB"]).alias("full"))


def leg_tilts(book: DataFrame, *, by: Sequence[str], month: str, size: str, spread: str, adv: str) -> DataFrame:
    """Weighted-average size, spread and volume of the long and the short leg, and their differences."""
    rows = book.withColumn("__lm", F.ln(F.greatest(F.col(size), F.lit(1.0))))
    long_w, short_w = F.greatest("w", F.lit(0.0)), F.greatest(-F.col("w"), F.lit(0.0))
    wavg = lambda c, w: F.when(F.sum(w) > 1e-12, F.sum(F.col(c) * w) / F.sum(w))
    g = rows.groupBy(*by, month).agg(
        *[wavg(c, w).alias(f"{leg}_{n}") for leg, w in (("long", long_w), ("short", short_w)) for n, c in (("log_me", "__lm"), ("spread", spread), ("adv", adv))]
    )
    return g.select("*", (F.col("long_log_me") - F.col("short_log_me")).alias("size_tilt"), (F.col("long_spread") - F.col("short_spread")).alias("spread_tilt"))


def prediction_inflation(df: DataFrame, *, by: Sequence[str], month: str, alpha: str, ret: str) -> DataFrame:
    """Implied against realised return of a book, and its effective number of names."""
    g = df.groupBy(*by, month).agg(
        F.sum(F.coalesce(alpha, F.lit(0.0)) * F.col("w")).alias("implied"), F.sum(F.coalesce(ret, F.lit(0.0)) * F.col("w")).alias("realised"),
        F.sum(F.abs("w")).alias("gross"), F.sum(F.col("w") ** 2).alias("__q"),
    )
    return g.select(
        *by, month, "implied", "realised", F.when(F.abs("realised") > 1e-12, F.col("implied") / F.col("realised")).alias("inflation"), "gross",
        F.coalesce(ratio(F.col("gross") ** 2, "__q"), F.lit(0.0)).alias("effective_names"),
    )


def tax_cost(w: Column, w_prev: Column, gain_rate: Column, tax_rate: Column) -> Column:
    """Tax of a sale in return units: only long positions that shrink realise a gain."""
    sold = F.when(w_prev > 0, F.greatest(w_prev - w, F.lit(0.0))).otherwise(0.0)
    return tax_rate * gain_rate * sold


def deferral_bonus(alpha: Column, months_held: Column, rate_spread: float, gain: Column) -> Column:
    """Alpha plus the value of waiting when a gain is within six months of the twelve-month boundary."""
    near = F.coalesce((months_held > 6) & (months_held <= 12), F.lit(False)).cast("double")
    return alpha + near * rate_spread * F.greatest(F.coalesce(gain, F.lit(0.0)), F.lit(0.0))
