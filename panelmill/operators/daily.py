"""Daily bars to month-end market features.

All per-security operators share one partitioning key, so a chain of them plans as one shuffle and one sort. A window
holds one security's trading days, which the calendar bounds however many trades a security has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import col, count_if, finite, month_end, positive, ratio


def adjust_prices(
    df: DataFrame, *, close="prccd", adj="ajexdi", factor="trfd", volume="cshtrd", unit="qunit", usd_per_local="usd_per_local"
) -> DataFrame:
    """Adjusted price, total-return index and notional in reported, unit-scaled and USD terms, under positive guards."""
    price = positive(close) / positive(adj)
    traded = F.when(F.col(volume) >= 0, positive(close) * F.col(volume))
    scaled = traded / positive(unit)
    return df.select(
        "*",
        price.alias("adjusted_price"),
        (price * positive(factor)).alias("return_index"),
        traded.alias("notional_reported"),
        scaled.alias("notional_qunit"),
        (scaled * positive(usd_per_local)).alias("notional_usd"),
    )


def prefer_rate(fx: DataFrame, *, keys=("d", "tocurd"), status="exrattpd", preferred="AR") -> DataFrame:
    """One quote per date and currency, the preferred status first."""
    order = [F.when(F.col(status) == preferred, 0).otherwise(1), F.col(status)]
    w = Window.partitionBy(*keys).orderBy(*order)
    return fx.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def cross_rate(fx: DataFrame, *, date="d", currency="tocurd", rate="exratd", quote="USD") -> DataFrame:
    """``quote`` per unit of each currency through the common base; the quote currency itself is exactly 1."""
    usd = fx.filter(F.col(currency) == quote).select(date, F.col(rate).alias("__q"))
    value = F.when(F.col(currency) == quote, F.lit(1.0)).otherwise(positive("__q") / positive(rate))
    return fx.join(usd, date).select(date, F.col(currency).alias("cur"), value.alias("usd_per_local"))


def trading_days(df: DataFrame, *, status="prcstd", keep: Sequence[int] = (3, 4, 10)) -> DataFrame:
    return df.filter(F.col(status).isin(*keep))


def daily_returns(
    df: DataFrame, *, keys: Sequence[str], date: str, currency: str, price: str, index: str | None = None,
    high: str, low: str,
) -> DataFrame:
    """Return on the previous row when both rows carry the same currency, range of the day, gap to the previous row."""
    w = Window.partitionBy(*keys).orderBy(date)
    same = F.col(currency) == F.lag(currency).over(w)  # a missing currency never matches

    def change(c: str) -> Column:
        prior = F.lag(c).over(w)
        return F.when(same & (F.col(c) > 0) & (prior > 0), F.col(c) / prior - 1.0)

    h, l = F.col(high), F.col(low)  # noqa: E741
    out = df.select(
        "*",
        change(price).alias("ret"),
        F.when((h > 0) & (l > 0) & (h >= l), (h - l) / ((h + l) / 2.0)).alias("hl_range"),
        F.datediff(F.col(date), F.lag(date).over(w)).cast("long").alias("gap_days"),
        *([change(index).alias("total_ret")] if index else []),
    )
    return out


def rolling_features(
    df: DataFrame, *, keys: Sequence[str], date: str, n: int = 21,
    counts: Mapping[str, str | None] = {}, sds: Mapping[str, str] = {}, means: Mapping[str, str | Column] = {},
    maxes: Mapping[str, str] = {},
) -> DataFrame:
    """Statistics over the last ``n`` rows of each key. Frames count rows, so observation counts are separate outputs."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(-(n - 1), 0)
    return df.select(
        "*",
        *[F.count(F.lit(1) if c is None else F.col(c)).over(w).cast("long").alias(o) for o, c in counts.items()],
        *[F.stddev_samp(c).over(w).alias(o) for o, c in sds.items()],
        *[F.avg(col(c)).over(w).alias(o) for o, c in means.items()],
        *[F.max(c).over(w).alias(o) for o, c in maxes.items()],
    )


def amihud(ret: str, notional: str) -> Column:
    return F.abs(F.col(ret)) / positive(notional)


def month_stats(df: DataFrame, *, keys: Sequence[str], date: str, close: str, volume: str, ret: str, currency: str) -> DataFrame:
    """Calendar-month counts, first date, volume and currency span; pre-aggregated, so no sort of the daily rows."""
    return df.groupBy(*keys, F.last_day(date).alias("m")).agg(
        F.count(F.lit(1)).cast("long").alias("month_rows"),
        F.count(close).cast("long").alias("month_close_rows"),
        F.count(volume).cast("long").alias("month_volume_rows"),
        F.count(ret).cast("long").alias("month_return_rows"),
        F.min(date).alias("month_first_date"),
        F.sum(volume).alias("month_volume"),
        F.min(currency).alias("month_min_currency"),
        F.max(currency).alias("month_max_currency"),
    )


def month_endpoint(df: DataFrame, *, keys: Sequence[str], date: str, out: str = "m") -> DataFrame:
    """The last row of every calendar month: the next row of the key falls in another month.

    It reuses the sort order of the daily windows instead of ranking each month again.
    """
    nxt = F.lead(F.last_day(date)).over(Window.partitionBy(*keys).orderBy(date))
    return (
        df.withColumn(out, F.last_day(date)).withColumn("__next", nxt)
        .filter(F.col("__next").isNull() | (F.col("__next") != F.col(out)))
        .drop("__next")
    )


def attach_requested(requested: DataFrame, endpoints: DataFrame, *, keys: Sequence[str], present: str) -> DataFrame:
    """Requested keys with their endpoint, and whether one exists."""
    return requested.join(endpoints, list(keys), "left").withColumn("endpoint_present", F.col(present).isNotNull())


def currency_segments(df: DataFrame, *, keys: Sequence[str], date: str, currency: str, out: str = "segment") -> DataFrame:
    """Running island number; a currency change starts a new island and a missing currency is a currency of its own."""
    w = Window.partitionBy(*keys).orderBy(date)
    broken = (~F.col(currency).eqNullSafe(F.lag(currency).over(w))) | (F.row_number().over(w) == 1)
    tagged = df.withColumn("__brk", broken.cast("int"))
    return tagged.withColumn(out, F.sum("__brk").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__brk")


def abdi_ranaldo(
    df: DataFrame, *, keys: Sequence[str], date: str, currency: str, close: str, high: str, low: str, n: int = 20, min_pairs: int = 2
) -> DataFrame:
    """Close-to-midrange spread of two-day pairs inside a currency segment, averaged over the last ``n`` rows."""
    usable = df.filter((F.col(close) > 0) & (F.col(high) > 0) & (F.col(low) > 0))
    logs = usable.withColumn("__c", F.ln(close)).withColumn("__eta", (F.ln(high) + F.ln(low)) / 2.0)
    seg = currency_segments(logs, keys=keys, date=date, currency=currency)
    w = Window.partitionBy(*keys, "segment").orderBy(date)
    pair = (F.lag("__c").over(w) - F.lag("__eta").over(w)) * (F.lag("__c").over(w) - F.col("__eta"))
    recent = w.rowsBetween(-(n - 1), 0)
    rolled = seg.withColumn("__g", pair).select(
        "*", F.count("__g").over(recent).cast("long").alias("pair_obs"), F.avg("__g").over(recent).alias("mean_gamma")
    )
    value = 2.0 * F.sqrt(F.greatest(F.col("mean_gamma"), F.lit(0.0)))
    return rolled.select(
        "*",
        F.when(F.col("pair_obs") >= min_pairs, value).alias("ar_any"),
        F.when(F.col("pair_obs") == n, value).alias("ar_strict"),
    ).drop("__c", "__eta", "__g")


def edge_spread(
    df: DataFrame, *, keys: Sequence[str], date: str, currency: str, open: str, high: str, low: str, close: str,
    n: int = 21, min_rows: int = 3,
) -> DataFrame:
    """Efficient open-high-low-close spread estimator over ``n`` rows (Ardia, Guidotti and Kroencke, 2024).

    The published estimator demeans its terms inside each window, so the window mean of its squares is not a plain
    rolling mean. Written out, every moment it needs is a mean of products of row values, and all of them are rolling
    averages over one frame of the ``n - 1`` day pairs.
    """
    cols = {"o": open, "h": high, "l": low, "c": close}
    seg = currency_segments(df, keys=keys, date=date, currency=currency)
    w = Window.partitionBy(*keys, "segment").orderBy(date)
    logs = seg.select("*", *[F.ln(positive(c)).alias(f"__{k}") for k, c in cols.items()])
    logs = logs.withColumn("__m", (F.col("__h") + F.col("__l")) / 2.0)
    logs = logs.select("*", *[F.lag(f"__{k}").over(w).alias(f"__{k}1") for k in ("h", "l", "c", "m")])
    v = lambda k: F.col(f"__{k}")
    moved = ((v("h") != v("l")) | (v("l") != v("c1"))).cast("double")
    terms = {
        "tau": moved,
        "po": moved * ((v("o") != v("h")).cast("double") + (v("o") != v("l")).cast("double")),
        "pc": moved * ((v("c1") != v("h1")).cast("double") + (v("c1") != v("l1")).cast("double")),
        "r1": F.when(v("c1").isNotNull(), v("m") - v("o")), "r2": v("o") - v("m1"), "r3": v("m") - v("c1"), "r4": v("c1") - v("m1"), "r5": v("o") - v("c1"),
    }
    rows = logs.select("*", *[e.alias(f"t_{k}") for k, e in terms.items()])
    t = lambda k: F.col(f"t_{k}")
    # the two estimating equations are A*p0 - A*k*p1 + B*p2 - B*j*p3 over these row products
    products = {
        "x": [t("r1") * t("r2"), t("tau") * t("r2"), t("r3") * t("r4"), t("tau") * t("r4")],
        "y": [t("r1") * t("r5"), t("tau") * t("r5"), t("r5") * t("r4"), t("tau") * t("r4")],
    }
    frame = w.rowsBetween(-(n - 2), 0)
    means = {k: t(k) for k in ("tau", "po", "pc", "r1", "r3", "r5")}
    for s, ps in products.items():
        for i, p in enumerate(ps):
            means[f"{s}{i}"] = p
            for j in range(i, 4):
                means[f"{s}{i}{j}"] = p * ps[j]
    rolled = rows.select(
        "*",
        *[F.avg(e).over(frame).alias(f"e_{k}") for k, e in means.items()],
        F.sum("t_tau").over(frame).alias("e_n"),
        F.count("t_r3").over(frame).alias("e_pairs"),
        F.count(F.lit(1)).over(w.rowsBetween(-(n - 1), 0)).cast("long").alias("rows_n"),
        count_if_over(
            finite("__o") & finite("__h") & finite("__l") & finite("__c"), w.rowsBetween(-(n - 1), 0)
        ).alias("complete_n"),
    )
    e = lambda k: F.col(f"e_{k}")
    a, b = ratio(F.lit(-4.0), e("po")), ratio(F.lit(-4.0), e("pc"))
    coeffs = {
        "x": [a, -a * ratio(e("r1"), e("tau")), b, -b * ratio(e("r3"), e("tau"))],
        "y": [a, -a * ratio(e("r1"), e("tau")), b, -b * ratio(e("r5"), e("tau"))],
    }
    first, var = {}, {}
    for s, cs in coeffs.items():
        first[s] = sum((cs[i] * e(f"{s}{i}") for i in range(1, 4)), cs[0] * e(f"{s}0"))
        second = F.lit(0.0)
        for i in range(4):
            for j in range(i, 4):
                second = second + cs[i] * cs[j] * e(f"{s}{i}{j}") * (1.0 if i == j else 2.0)
        var[s] = second
    rolled = rolled.select(
        "*", first["x"].alias("e1"), first["y"].alias("e2"), var["x"].alias("q1"), var["y"].alias("q2")
    )
    v1, v2 = F.col("q1") - F.col("e1") ** 2, F.col("q2") - F.col("e2") ** 2
    s2 = F.when(v1 + v2 > 0, (v2 * F.col("e1") + v1 * F.col("e2")) / (v1 + v2)).otherwise((F.col("e1") + F.col("e2")) / 2)
    ok = (F.col("e_n") >= 2) & (F.col("e_po") > 0) & (F.col("e_pc") > 0) & (F.col("e_pairs") >= min_rows - 1)
    value = F.when(ok, F.sqrt(F.abs(s2)))
    return rolled.select(
        *df.columns, "segment", "rows_n", "complete_n", value.alias("edge_any"),
        F.when((F.col("rows_n") == n) & (F.col("complete_n") == n), value).alias("edge_strict"),
    )


def count_if_over(cond: Column, w) -> Column:
    return F.sum(cond.cast("long")).over(w)


def strict_gate(df: DataFrame, values: Mapping[str, str], n: int = 21) -> DataFrame:
    """Null every value whose observation count differs from ``n``; ``values`` maps value column to count column."""
    return df.select(*[F.when(F.col(values[c]) == n, F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def attach_fx_exact(
    df: DataFrame, fx: DataFrame, *, date: str, currency: str, multiply: Sequence[str] = (), divide: Sequence[str] = ()
) -> DataFrame:
    """Convert with the rate of exactly that date; a missing rate leaves the USD value missing, never carried."""
    rates = fx.select(F.col("d").alias(date), F.col("cur").alias(currency), F.col("usd_per_local"))
    joined = df.join(rates, [date, currency], "left")
    return joined.select(
        "*",
        *[(F.col(c) * F.col("usd_per_local")).alias(f"{c}_usd") for c in multiply],
        *[(F.col(c) / positive("usd_per_local")).alias(f"{c}_usd") for c in divide],
    )


def coalesce_sources(df: DataFrame, ordered: Mapping[str, str], *, out: str, label: str, missing: str = "MISSING") -> DataFrame:
    """First non-null source in order, and its label."""
    tag = F.lit(missing)
    for column, name in reversed(list(ordered.items())):
        tag = F.when(F.col(column).isNotNull(), name).otherwise(tag)
    return df.select("*", F.coalesce(*[F.col(c) for c in ordered]).alias(out), tag.alias(label))


def prior_month_members(ledger: DataFrame, *, date: str = "m", out: str = "active_month") -> DataFrame:
    """Membership decided at a month end is active in the following month."""
    return ledger.withColumn(out, month_end(date, 1))


def cap_weighted_return(
    daily: DataFrame, members: DataFrame, *, id: str, country: str, date: str, currency: str, index: str, cap: str, min_share: float = 0.5
) -> DataFrame:
    """Daily market return weighted by the previous row's cap, on days when enough of last month's members report."""
    w = Window.partitionBy(id).orderBy(date)
    same = F.col(currency) == F.lag(currency).over(w)
    rows = daily.select(
        country, id, date,
        F.when(same, F.col(index) / F.lag(index).over(w) - 1.0).alias("__r"),
        F.when(same, F.lag(cap).over(w)).alias("__w"),
        F.last_day(date).alias("active_month"),
    ).filter(F.col("__r").isNotNull() & (F.col("__w") > 0))
    active = rows.join(members.select(id, "active_month"), [id, "active_month"], "left_semi")
    sums = active.groupBy(country, "active_month", date).agg(
        F.sum(F.col("__r") * F.col("__w")).alias("__rw"), F.sum("__w").alias("prior_cap"), F.count(F.lit(1)).cast("long").alias("constituents")
    )
    expected = members.groupBy(country, "active_month").agg(F.count(F.lit(1)).cast("long").alias("expected"))
    return (
        sums.join(expected, [country, "active_month"])
        .withColumn("participation", F.col("constituents") / F.col("expected"))
        .filter(F.col("participation") >= min_share)
        .select(country, date, (F.col("__rw") / F.col("prior_cap")).alias("mkt_ret"), "prior_cap", "constituents", "expected", "participation")
    )


def vol_state(market: DataFrame, *, country: str, date: str, ret: str, n: int = 21) -> DataFrame:
    """Log standard deviation of the last ``n`` market returns at each month end; needs all of them."""
    rolled = rolling_features(market, keys=[country], date=date, n=n, counts={"obs": ret}, sds={"__sd": ret})
    ends = month_endpoint(rolled, keys=[country], date=date)
    return ends.select(
        country, "m", "obs", F.when(F.col("obs") == n, F.ln(positive("__sd"))).alias("vol_raw")
    )


def illiq_state(
    panel: DataFrame, *, country: str, month: str, value: str, cap: str, obs: Sequence[str], min_obs: int = 15, min_cover: float = 0.5
) -> DataFrame:
    """Cap-weighted illiquidity over names with enough observations; null when they cover too little of the cap."""
    enough = F.lit(True)
    for c in obs:
        enough = enough & (F.col(c) >= min_obs)
    v = F.when(enough, F.col(value))
    weight = positive(cap)
    used = F.when(v.isNotNull(), weight)
    sums = panel.groupBy(country, month).agg(
        F.sum(weight).alias("total_cap"), F.sum(used).alias("valid_cap"), F.sum(v * used).alias("__vw"),
        F.count(F.lit(1)).cast("long").alias("names"), F.count(v).cast("long").alias("valid_names"),
    )
    cover = ratio("valid_cap", "total_cap")
    return sums.select(
        country, month, "names", "valid_names", cover.alias("cover"),
        F.when(cover >= min_cover, ratio("__vw", "valid_cap")).alias("illiq_vw"),
    )


def log_deviation(df: DataFrame, *, keys: Sequence[str], date: str, value: str, n: int = 12, m: int = 9, out: str = "log_dev") -> DataFrame:
    """Log of the value against its trailing mean over ``n`` rows, when ``m`` of them were observed."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(-(n - 1), 0)
    trailing = F.when(F.count(value).over(w) >= m, F.avg(value).over(w))
    return df.withColumn(out, F.ln(positive(value)) - F.ln(positive(trailing)))


def densify(df: DataFrame, *, keys: Sequence[str], month: str) -> DataFrame:
    """Every key on every month between the first and last month of the whole table (null rows where absent)."""
    span = df.agg(F.min(month).alias("__a"), F.max(month).alias("__z")).withColumn("__one", F.lit(1))
    grid = (
        df.select(*keys).distinct().withColumn("__one", F.lit(1)).join(F.broadcast(span), "__one")  # one-row side
        .select(*keys, F.explode(F.sequence(F.trunc("__a", "month"), F.trunc("__z", "month"), F.expr("interval 1 month"))).alias("__s"))
        .select(*keys, F.last_day("__s").alias(month))
    )
    return grid.join(df, [*keys, month], "left")


def lagged_expanding_z(
    df: DataFrame, *, keys: Sequence[str], date: str, value: str, m: int = 24, bound: float = 5.0, ddof: int = 1
) -> DataFrame:
    """Lag one row, standardise by the statistics known so far, clip; zero before activation.

    ``gap`` marks a missing value after activation, which the caller must treat as an error rather than as a zero.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    lagged = df.withColumn("lagged", F.lag(value).over(w))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sd = F.stddev_samp("lagged") if ddof == 1 else F.stddev_pop("lagged")
    n = F.count("lagged").over(run)
    stats = lagged.select("*", F.when(n >= m, F.avg("lagged").over(run)).alias("__mu"), F.when(n >= m, sd.over(run)).alias("__sd"))
    active = F.col("__mu").isNotNull() & (F.col("__sd") > 0) & F.col("lagged").isNotNull()
    z = F.when(active, (F.col("lagged") - F.col("__mu")) / F.col("__sd"))
    flagged = stats.withColumn("active", F.coalesce(active, F.lit(False))).withColumn("__z", z)
    started = F.max(F.col("active").cast("int")).over(run) == 1
    return (
        flagged.withColumn("gap", started & F.col("__z").isNull())
        .withColumn("z", F.least(F.greatest(F.coalesce("__z", F.lit(0.0)), F.lit(-bound)), F.lit(bound)))
        .drop("__mu", "__sd", "__z")
    )


def assemble_states(tables: Sequence[DataFrame], *, keys: Sequence[str]) -> DataFrame:
    """Full outer join of state tables on their keys."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, list(keys), "full_outer")
    return out


def state_violations(df: DataFrame, *, numeric: Sequence[str], binary: Sequence[str]) -> DataFrame:
    """Per column: rows that are not finite, and binary rows other than 0 and 1."""
    checks = [F.struct(F.lit(c).alias("column"), F.lit("finite").alias("rule"), count_if(~finite(c)).alias("n")) for c in numeric]
    checks += [
        F.struct(F.lit(c).alias("column"), F.lit("binary").alias("rule"), count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))).alias("n"))
        for c in binary
    ]
    return df.agg(F.array(*checks).alias("v")).select(F.inline("v"))


def derived_states(df: DataFrame, *, month: str, ret: str, factors: Sequence[str]) -> DataFrame:
    """Bear flag from the sign of the trailing 24-month sum, and 12-month momentum of each factor, lagged one month."""
    w = Window.orderBy(month)  # one row per month: a few hundred rows
    s24, s12 = w.rowsBetween(-23, 0), w.rowsBetween(-11, 0)
    cum = F.when(F.count(ret).over(s24) >= 6, F.sum(ret).over(s24))
    raw = df.select(
        month, (F.coalesce(cum, F.lit(0.0)) < 0).cast("double").alias("BEAR"),
        *[F.coalesce(F.when(F.count(f).over(s12) >= 6, F.sum(f).over(s12)), F.lit(0.0)).alias(f"FMOM_{f}") for f in factors],
    )
    return raw.select(month, *[F.lag(c).over(w).alias(c) for c in raw.columns if c != month])


def block_permute(df: DataFrame, *, month: str, values: Sequence[str], block: int = 24, salt: int = 1) -> DataFrame:
    """Placebo states: whole blocks of months change places in a seeded order; dates stay."""
    from panelmill.functions import uniform

    w = Window.orderBy(month)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__blk", F.floor(F.col("__i") / block))
    order = rows.select("__blk").distinct().withColumn(
        "__to", F.row_number().over(Window.orderBy(uniform(salt, F.col("__blk")), "__blk"))
    )
    moved = rows.join(order, "__blk").withColumn("__j", F.row_number().over(Window.orderBy("__to", "__i")) - 1)
    return rows.select(month, "__i").join(moved.select("__j", *values), F.col("__i") == F.col("__j")).select(month, *values)
