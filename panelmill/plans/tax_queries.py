"""Dated rules, lots, yearly accounts and after-tax results."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import rnd
from panelmill.operators import aftertax as at
from panelmill.operators import dated
from panelmill.operators import inference as inf
from panelmill.operators import studies as st
from panelmill.operators import tax as tx
from panelmill.operators.xsection import tradeable
from panelmill.plans.book_queries import decile_book, rounded
from panelmill.plans.registry import R, query, shared, view

# An illustrative dated schedule (country, from, to, regime, short, long, months, inclusion, buy tax, sell tax).
SCHEDULE = [
    ("AFRICA", "1994-01-01", "1997-06-30", "A1", 0.30, 0.15, 12, 1.0, 0.001, 0.001),
    ("AFRICA", "1997-07-01", "1999-12-31", "A2", 0.30, 0.20, 12, 1.0, 0.001, 0.002),
    ("AFRICA", "2000-01-01", "2003-12-31", "A3", 0.25, 0.10, 24, 1.0, 0.0, 0.001),
    ("AMERICA", "1994-01-01", "2003-12-31", "M1", 0.37, 0.20, 12, 1.0, 0.0, 0.0),
    ("ASIA", "1994-01-01", "1999-12-31", "S1", 0.25, 0.25, 12, 1.0, 0.0, 0.003),
    ("ASIA", "2000-03-01", "2003-12-31", "S2", 0.25, 0.25, 12, 1.0, 0.0, 0.001),
    ("EUROPE", "1994-01-01", "1999-12-31", "E1", 0.40, 0.0, 12, 0.5, 0.0, 0.0),
    ("EUROPE", "1999-06-01", "2003-12-31", "E2", 0.25, 0.25, 12, 1.0, 0.0, 0.0),
    ("MIDDLE EAST", "1994-01-01", "2003-12-31", "F1", 0.10, 0.10, 12, 1.0, 0.0, 0.0),
]
NAMES = ["country", "effective_from", "effective_to", "legal_regime", "cgt_short", "cgt_long", "holding_period_months", "gain_inclusion_fraction", "stt_buy", "stt_sell"]
view("schedule", "SELECT country, CAST(f AS DATE) AS effective_from, CAST(t AS DATE) AS effective_to, legal_regime, CAST(s AS DOUBLE) AS cgt_short, CAST(l AS DOUBLE) AS cgt_long, CAST(h AS INTEGER) AS holding_period_months, CAST(i AS DOUBLE) AS gain_inclusion_fraction, CAST(b AS DOUBLE) AS stt_buy, CAST(x AS DOUBLE) AS stt_sell FROM (VALUES "
     + ", ".join(str(r) for r in SCHEDULE) + ") AS v(country, f, t, legal_regime, s, l, h, i, b, x)")


@shared
def schedule(t):
    rows = t.spark.createDataFrame(SCHEDULE, ", ".join(f"{n} {'int' if n.startswith('holding') else 'string' if i < 4 else 'double'}" for i, n in enumerate(NAMES)))
    return rows.withColumns({c: F.col(c).cast("date") for c in ("effective_from", "effective_to")})


_REGION = "CASE account % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END"


def region(account: str = "account"):
    return F.element_at(F.array(*[F.lit(c) for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]), (F.col(account) % 5 + 1).cast("int"))


view("order_rules", """
  SELECT r_name AS country, year(o_orderdate) AS y, CAST(min(o_orderdate) AS DATE) AS f, CAST(max(o_orderdate) AS DATE) + CAST(CASE WHEN year(o_orderdate) % 2 = 0 THEN 40 ELSE -40 END AS INTEGER) AS t
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")


@query("t1_schedule_gaps_and_overlaps", """
SELECT country, count(*) AS rules, CAST(sum(greatest(datediff('day', p, s) - 1, 0)) + greatest(datediff('day', max(e), DATE '2000-12-31'), 0) AS BIGINT) AS gap_days,
       CAST(sum(greatest(datediff('day', s, least(p, e)) + 1, 0)) AS BIGINT) AS overlap_days
FROM (SELECT *, coalesce(max(e) OVER (PARTITION BY country ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), DATE '1995-12-31') AS p
      FROM (SELECT country, greatest(f, DATE '1996-01-01') AS s, least(t, DATE '2000-12-31') AS e FROM order_rules WHERE f <= DATE '2000-12-31' AND t >= DATE '1996-01-01')) GROUP BY 1""")
def t1(t):
    o = t.table("orders").join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = o.groupBy(F.col("r_name").alias("country"), F.year("o_orderdate").alias("y")).agg(F.to_date(F.min("o_orderdate")).alias("f"), F.to_date(F.max("o_orderdate")).alias("t"))
    g = g.withColumn("t", F.date_add("t", F.when(F.col("y") % 2 == 0, 40).otherwise(-40)))
    return tx.schedule_gaps(g, by=["country"], start="f", end="t", lo="1996-01-01", hi="2000-12-31")


view("fifo", """
  WITH r AS (SELECT *, sum(qty) OVER (PARTITION BY account, security, side ORDER BY d) AS z, qty AS q FROM covered_trades)
  SELECT b.account, b.security, b.d AS opened, s.d AS sold, least(b.z, s.z) - greatest(b.z - b.q, s.z - s.q) AS qty, b.amount / b.q AS bp, s.amount / s.q AS sp
  FROM r b JOIN r s ON b.account = s.account AND b.security = s.security AND b.side = 'B' AND s.side = 'S' AND b.z > s.z - s.q AND s.z > b.z - b.q""")


@shared
def fifo(t):
    return t.stage("fifo", tx.fifo_gains(t.covered_trades, by=["account", "security"]))


@query("t8_fifo_gains", f"""
SELECT account, security, opened, sold, {R('sum(qty)', 4)} AS qty, {R('sum(qty * bp)', 2)} AS basis, {R('sum(qty * sp)', 2)} AS proceeds, sold > opened + INTERVAL 12 MONTH AS long_term
FROM fifo WHERE qty > 1e-9 GROUP BY 1, 2, 3, 4""")
def t8(t):
    out = fifo(t).filter("qty > 1e-9").groupBy("account", "security", "opened", "sold", "long_term").agg(*[F.sum(c).alias(c) for c in ("qty", "basis", "proceeds")])
    return out.select("account", "security", "opened", "sold", rnd("qty", 4).alias("qty"), rnd("basis", 2).alias("basis"), rnd("proceeds", 2).alias("proceeds"), "long_term")


view("disposals", f"""
  SELECT account || '|' || security || '|' || opened || '|' || sold AS id, account, security, {_REGION} AS country, opened, sold, sum(qty * bp) AS basis, sum(qty * sp) AS sale, sum(qty * bp) * 1.1::DOUBLE AS fmv
  FROM fifo WHERE qty > 1e-9 GROUP BY account, security, opened, sold""")


@shared
def disposals(t):
    g = fifo(t).filter("qty > 1e-9").groupBy("account", "security", "opened", "sold").agg(F.sum("basis").alias("basis"), F.sum("proceeds").alias("sale"))
    return g.select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in ("account", "security", "opened", "sold")]).alias("id"), "account", "security", region().alias("country"),
        "opened", "sold", "basis", "sale", (F.col("basis") * 1.1).alias("fmv"),
    )


RULES = ["legal_regime", "cgt_short", "cgt_long", "holding_period_months", "gain_inclusion_fraction", "stt_buy", "stt_sell"]
view("resolved", """
  SELECT d.*, CASE WHEN d.country = 'EUROPE' AND opened < DATE '1996-01-01' THEN opened ELSE sold END AS rule_date,
         (SELECT count(*) FROM schedule s WHERE s.country = d.country AND CASE WHEN d.country = 'EUROPE' AND opened < DATE '1996-01-01' THEN opened ELSE sold END BETWEEN s.effective_from AND s.effective_to) AS matches
  FROM disposals d""")
view("ruled", """
  SELECT r.*, s.legal_regime, s.cgt_short, s.cgt_long, s.holding_period_months, s.gain_inclusion_fraction, s.stt_sell,
         CASE WHEN matches = 0 THEN 'no_rule' WHEN matches > 1 THEN 'several_rules' END AS violation
  FROM resolved r LEFT JOIN schedule s ON matches = 1 AND s.country = r.country AND r.rule_date BETWEEN s.effective_from AND s.effective_to""")


@shared
def resolved(t):
    return tx.resolve_rules(disposals(t), schedule(t), country="country", date="sold", acquired="opened", grandfather=("EUROPE", "1996-01-01"), rules=RULES)


@query("t2_resolve_dated_rules", "SELECT id, rule_date, matches, legal_regime, violation FROM ruled")
def t2(t):
    return resolved(t).select("id", "rule_date", "matches", "legal_regime", "violation")


@query("t3_regime_view", """
SELECT d.country, d.m, s.legal_regime, s.cgt_short, s.cgt_long, s.holding_period_months, round(s.cgt_short - s.cgt_long, 6) + 0.0 AS wedge,
       (SELECT count(DISTINCT (cgt_short, cgt_long, holding_period_months)) = 1 FROM schedule c WHERE c.country = d.country AND c.effective_from <= DATE '1999-12-31' AND c.effective_to >= DATE '1996-01-01') AS constant
FROM (SELECT DISTINCT country, m FROM monthly_px) d
LEFT JOIN schedule s ON s.country = d.country AND d.m BETWEEN s.effective_from AND s.effective_to AND (SELECT count(*) FROM schedule x WHERE x.country = d.country AND d.m BETWEEN x.effective_from AND x.effective_to) = 1""")
def t3(t):
    dates = t.monthly_px.select("country", "m").distinct()
    out = tx.regimes_at(dates, schedule(t), country="country", date="m", lo="1996-01-01", hi="1999-12-31")
    return out.withColumn("wedge", F.round("wedge", 6))


@query("t5_point_in_time_fx", f"""
WITH f AS (SELECT * FROM fx_rates WHERE dayofweek(d) NOT IN (0, 6)), e AS (SELECT DISTINCT sec_id, m, CASE (sec_id + year(m)) % 3 WHEN 0 THEN 'AAA' WHEN 1 THEN 'BBB' ELSE 'CCC' END AS src, 'AAA' AS dst FROM monthly_px)
SELECT sec_id, m, src, dst, {R("CASE WHEN src = dst THEN 1.0 ELSE a.usd_per_local / b.usd_per_local END")} AS rate, a.d AS src_date, b.d AS dst_date
FROM e ASOF LEFT JOIN f a ON e.src = a.cur AND e.m >= a.d ASOF LEFT JOIN f b ON e.dst = b.cur AND e.m >= b.d""")
def t5(t):
    k = (F.col("sec_id") + F.year("m")) % 3
    e = t.monthly_px.select("sec_id", "m", F.when(k == 0, "AAA").when(k == 1, "BBB").otherwise("CCC").alias("src"), F.lit("AAA").alias("dst"))
    return tx.fx_asof(e, t.fx_rates, date="m", src="src", dst="dst").withColumn("rate", rnd("rate"))


@query("t6_deemed_cost", f"SELECT id, {R('greatest(basis, least(fmv, sale))', 2)} AS deemed FROM disposals")
def t6(t):
    return disposals(t).select("id", rnd(tx.deemed_cost(F.col("basis"), F.col("fmv"), F.col("sale")), 2).alias("deemed"))


@query("t7_holding_period", "SELECT account, security, opened, sold, sold > opened + INTERVAL 24 MONTH AS long_term FROM disposals")
def t7(t):
    return disposals(t).select("account", "security", "opened", "sold", tx.long_term(F.col("opened"), F.col("sold"), 24).alias("long_term"))



@shared
def targets(t):
    """Dollar target of each position after each day, with a small growth in between."""
    net = t.covered_trades.groupBy("account", "security", "d").agg(F.sum(F.when(F.col("side") == "B", F.col("amount")).otherwise(-F.col("amount"))).alias("flow"))
    from pyspark.sql import Window

    w = Window.partitionBy("account", "security").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return net.select("account", "security", "d", F.sum("flow").over(w).alias("target"), (((F.month("d") % 5) - 2) * 0.05).alias("growth"))


def lots(t, method, wash=0):
    return rounded(tx.lot_gains(targets(t), by=["account", "security"], method=method, wash_days=wash), ["account", "security", "sold", "opened", "long_term"], ["gain", "disallowed", "allowed"], 2)


@query("t9_lifo_lots")
def t9_lifo(t):
    return lots(t, "lifo")


@query("t9_hifo_lots")
def t9_hifo(t):
    return lots(t, "hifo")


@query("t9_tax_optimal_lots")
def t9_opt(t):
    return lots(t, "tax_optimal")


@query("t10_wash_sale_lots")
def t10_lots(t):
    return lots(t, "hifo", 30)


@query("t10_wash_flags", f"""
SELECT account, security, sold, {R('gain', 2)} AS gain, gain < 0 AND EXISTS (SELECT 1 FROM covered_trades b WHERE b.account = g.account AND b.security = g.security AND b.side = 'B' AND abs(datediff('day', b.d, g.sold)) <= 30) AS washed
FROM (SELECT account, security, sold, sum(qty * (sp - bp)) AS gain FROM fifo WHERE qty > 0 GROUP BY 1, 2, 3) g""")
def t10(t):
    buys = t.covered_trades.filter("side = 'B'").select("account", "security", "d")
    return tx.wash_flags(fifo(t), buys, by=["account", "security"]).withColumn("gain", rnd("gain", 2))


@query("t11_roll_lots", f"""
WITH x AS (SELECT sec_id, m, sum(ln(CASE WHEN 1 + coalesce(ret, 0) > 0 THEN 1 + coalesce(ret, 0) END)) OVER (PARTITION BY sec_id ORDER BY m) AS lg FROM panel)
SELECT a.sec_id, a.m AS opened, b.m, {R('100 * exp(b.lg - a.lg)', 3)} AS market_value, {R('100 * exp(b.lg - a.lg) - 100', 3)} AS unrealised, {R('least(greatest(1 - 1 / exp(b.lg - a.lg), -1.0), 1.0)', 5)} AS gain_rate
FROM x a JOIN x b ON a.sec_id = b.sec_id AND b.m >= a.m WHERE month(a.m) = 12""")
def t11(t):
    p = t.panel.select("sec_id", "m", "ret")
    opened = p.filter("month(m) = 12").select("sec_id", F.col("m").alias("opened"), F.lit(100.0).alias("value"))
    out = tx.roll_lots(opened, p, id="sec_id", month="m", opened="opened", value="value", ret="ret")
    return out.select("sec_id", "opened", "m", rnd("market_value", 3).alias("market_value"), rnd("unrealised", 3).alias("unrealised"), rnd("gain_rate", 5).alias("gain_rate"))


view("stated_trades", """
  WITH px AS (SELECT security, max_by(amount / qty, d) AS px FROM (SELECT security, d, sum(amount) AS amount, sum(qty) AS qty FROM covered_trades WHERE d <= DATE '1996-06-30' GROUP BY 1, 2) GROUP BY 1),
  f AS (SELECT d, usd_per_local FROM fx_rates WHERE cur = 'BBB' AND dayofweek(d) NOT IN (0, 6))
  SELECT t.*, amount / usd_per_local AS local_basis, qty * px AS reference FROM covered_trades t ASOF LEFT JOIN f ON t.d >= f.d LEFT JOIN px ON px.security = t.security""")


@shared
def stated_trades(t):
    """Trades with their amount in a local currency at the last business-day rate, and at the security's price of a statutory date."""
    early = t.covered_trades.filter("d <= DATE '1996-06-30'").groupBy("security", "d").agg((F.sum("amount") / F.sum("qty")).alias("px"))
    price = early.groupBy("security").agg(F.max_by("px", "d").alias("px"))
    rates = dated.steps(t.fx_rates.filter(~F.dayofweek("d").isin(1, 7)), by="cur", date="d", values=["usd_per_local"])
    rows = dated.lookup(t.covered_trades, rates, key=F.lit("BBB"), at=F.col("d"), out="fx").join(price, "security", "left")
    return t.stage("stated_trades", rows.select("account", "security", "d", "side", "qty", "amount", (F.col("amount") / F.col("fx.v.usd_per_local")).alias("local_basis"), (F.col("qty") * F.col("px")).alias("reference")))


@query("t9_split_lot_state", f"""
WITH r AS (SELECT *, sum(qty) OVER (PARTITION BY account, security, side ORDER BY d) AS z, qty AS q FROM stated_trades)
SELECT b.account, b.security, b.d AS opened, {R('sum(least(b.z, s.z) - greatest(b.z - b.q, s.z - s.q))', 4)} AS qty, {R('sum((least(b.z, s.z) - greatest(b.z - b.q, s.z - s.q)) * b.amount / b.q)', 2)} AS basis,
       {R('sum((least(b.z, s.z) - greatest(b.z - b.q, s.z - s.q)) * b.local_basis / b.q)', 2)} AS local_basis, {R('sum((least(b.z, s.z) - greatest(b.z - b.q, s.z - s.q)) * b.reference / b.q)', 2)} AS reference
FROM r b JOIN r s ON b.account = s.account AND b.security = s.security AND b.side = 'B' AND s.side = 'S' AND b.z > s.z - s.q AND s.z > b.z - b.q
WHERE least(b.z, s.z) - greatest(b.z - b.q, s.z - s.q) > 1e-9 GROUP BY 1, 2, 3""")
def t9_state(t):
    g = tx.fifo_gains(stated_trades(t), by=["account", "security"], state=["local_basis", "reference"]).filter("qty > 1e-9")
    out = g.groupBy("account", "security", "opened").agg(*[F.sum(c).alias(c) for c in ("qty", "basis", "local_basis", "reference")])
    return out.select("account", "security", "opened", rnd("qty", 4).alias("qty"), *[rnd(c, 2).alias(c) for c in ("basis", "local_basis", "reference")])


@query("t11_liquidation", f"""
WITH c AS (SELECT *, coalesce(sum(CASE WHEN side = 'S' THEN qty END) OVER (PARTITION BY account, security), 0) AS sold, sum(CASE WHEN side = 'B' THEN qty END) OVER (PARTITION BY account, security ORDER BY d, side) AS z FROM stated_trades),
o AS (SELECT *, least(qty, greatest(z - sold, 0)) AS q FROM c WHERE side = 'B'),
px AS (SELECT security, max_by(amount / qty, d) AS px FROM (SELECT security, d, sum(amount) AS amount, sum(qty) AS qty FROM covered_trades GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT o.account, o.security, d AS opened, q, q / qty * amount AS basis, q / qty * local_basis AS local_basis, q / qty * reference AS reference, q * px AS value, DATE '2002-01-31' > d + INTERVAL 12 MONTH AS long_term FROM o JOIN px ON px.security = o.security WHERE q > 0)
SELECT account, security, opened, long_term, {R('q', 4)} AS qty, {R('basis', 2)} AS basis, {R('local_basis', 2)} AS local_basis, {R('reference', 2)} AS reference, {R('value', 2)} AS value, {R('value - basis', 2)} AS unrealised,
       {R('value - CASE WHEN long_term AND reference IS NOT NULL THEN greatest(basis, least(reference, value)) ELSE basis END', 2)} AS taxable_gain FROM v""")
def t11_liquidation(t):
    days = t.covered_trades.groupBy("security", "d").agg((F.sum("amount") / F.sum("qty")).alias("px"))
    last = days.groupBy("security").agg(F.max_by("px", "d").alias("px"))
    lots = tx.open_lots(stated_trades(t), by=["account", "security"], state=["local_basis", "reference"]).join(last, "security")
    out = tx.marked(lots, F.col("px"), F.lit("2002-01-31").cast("date"), reference="reference")
    money = ["basis", "local_basis", "reference", "value", "unrealised", "taxable_gain"]
    return out.select("account", "security", "opened", "long_term", rnd("qty", 4).alias("qty"), *[rnd(c, 2).alias(c) for c in money])


view("classified", """
  SELECT *, (sale - tax_basis) * coalesce(gain_inclusion_fraction, 1.0) AS taxable_gain, CASE WHEN is_long THEN cgt_long ELSE cgt_short END AS tax_rate, CASE WHEN is_long THEN 'LT' ELSE 'ST' END AS bucket FROM (
    SELECT *, CASE WHEN is_long AND opened < DATE '1998-02-01' AND sold >= DATE '1998-04-01' THEN greatest(basis, least(fmv, sale)) ELSE basis END AS tax_basis FROM (
      SELECT *, CAST(sold AS TIMESTAMP) > CAST(opened AS TIMESTAMP) + to_months(holding_period_months) AS is_long FROM ruled))""")


@shared
def classified(t):
    return tx.classify_events(resolved(t), opened="opened", sold="sold", basis="basis", sale="sale", fmv="fmv", basis_cut=("1998-02-01", "1998-04-01"))


@query("t12_classified_events", f"""
SELECT id, violation, CASE WHEN violation IS NULL THEN bucket END AS bucket, tax_rate, {R('taxable_gain', 2)} AS taxable_gain FROM (
  SELECT * REPLACE (CASE WHEN violation IS NULL THEN taxable_gain END AS taxable_gain) FROM classified)""")
def t12(t):
    ruled = F.col("violation").isNull()
    return classified(t).select("id", "violation", F.when(ruled, F.col("bucket")).alias("bucket"), "tax_rate", rnd(F.when(ruled, F.col("taxable_gain")), 2).alias("taxable_gain"))


@query("t13_transaction_tax", f"""
SELECT account, country, count(*) AS n_trades, count(*) FILTER (n <> 1) AS n_violations, {R("sum(CASE WHEN n = 1 THEN tax END)", 6)} AS tax FROM (
  SELECT t.account, t.country, t.d, t.side, t.amount, count(s.country) AS n, max(CASE WHEN t.side = 'B' THEN t.amount * s.stt_buy ELSE t.amount * s.stt_sell END) AS tax
  FROM (SELECT row_number() OVER () AS line, *, {_REGION} AS country FROM covered_trades) t LEFT JOIN schedule s ON s.country = t.country AND t.d BETWEEN s.effective_from AND s.effective_to
  GROUP BY t.line, t.account, t.country, t.d, t.side, t.amount) GROUP BY 1, 2""")
def t13(t):
    tr = t.covered_trades.withColumn("country", region())
    r = tx.resolve_rules(tr, schedule(t), country="country", date="d", rules=["stt_buy", "stt_sell"])
    tax = tx.transaction_tax(F.col("side"), F.col("amount"), F.col("stt_buy"), F.col("stt_sell"))
    return r.groupBy("account", "country").agg(
        F.count(F.lit(1)).alias("n_trades"), F.count("violation").alias("n_violations"), rnd(F.sum(tax), 6).alias("tax")
    )


@query("t14_tax_year_labels", "SELECT year(o_orderdate) + CASE WHEN month(o_orderdate) > 3 THEN 1 ELSE 0 END AS tax_year, count(*) AS n FROM orders GROUP BY 1")
def t14(t):
    return t.table("orders").groupBy(tx.tax_year(F.col("o_orderdate"), 3).alias("tax_year")).agg(F.count(F.lit(1)).alias("n"))


@shared
def yearly(t):
    g = fifo(t).withColumn("year", F.year("sold"))
    split = lambda lt: F.sum(F.when(F.col("long_term") == lt, F.col("gain")).otherwise(0.0))
    return t.stage("yearly", g.groupBy("account", "year").agg(split(False).alias("st_gain"), split(True).alias("lt_gain")))


view("yearly", """
  SELECT account, year(sold) AS year, sum(CASE WHEN sold > opened + INTERVAL 12 MONTH THEN 0.0 ELSE qty * (sp - bp) END) AS s, sum(CASE WHEN sold > opened + INTERVAL 12 MONTH THEN qty * (sp - bp) ELSE 0.0 END) AS l FROM fifo WHERE qty > 0 GROUP BY 1, 2""")


@query("t15_annual_netting", f"""
SELECT account, year, {R('ns', 2)} AS net_st, {R('nl', 2)} AS net_lt, {R('greatest(ns, 0) * 0.37 + greatest(nl, 0) * 0.2 - least(-(least(ns, 0) + least(nl, 0)), 3000) * 0.37', 2)} AS tax FROM (
  SELECT account, year, s + x AS ns, l - x AS nl FROM (SELECT *, CASE WHEN s < 0 AND l > 0 THEN least(-s, l) WHEN l < 0 AND s > 0 THEN -least(-l, s) ELSE 0 END AS x FROM yearly))""")
def t15(t):
    out = tx.annual_netting(yearly(t), by=["account", "year"], st="st_gain", lt="lt_gain", short_rate=0.37, long_rate=0.2, ordinary_offset=3000.0)
    return rounded(out, ["account", "year"], ["net_st", "net_lt", "tax"], 2)


@query("t16_loss_vintages", f"""
WITH RECURSIVE cells AS (SELECT account, year, bucket, gain, row_number() OVER (PARTITION BY account ORDER BY year, gain > 0, bucket) AS i FROM (
    SELECT account, year, unnest(['st_gain', 'lt_gain']) AS bucket, unnest([s, l]) AS gain FROM yearly) WHERE abs(gain) > 1e-12),
walk AS (SELECT account, 0::BIGINT AS i, 0::BIGINT AS year, '' AS bucket, 0::DOUBLE AS gain, 0::DOUBLE AS used, []::STRUCT(o BIGINT, b VARCHAR, x DOUBLE)[] AS v FROM (SELECT DISTINCT account FROM cells)
  UNION ALL SELECT account, i, year, bucket, gain, coalesce(list_sum(takes), 0)::DOUBLE,
    CASE WHEN gain < 0 THEN list_append(v, {{'o': year, 'b': bucket, 'x': -gain}}) ELSE list_filter(list_transform(v, lambda s, k: {{'o': s.o, 'b': s.b, 'x': s.x - takes[k]}}), lambda s: s.x > 1e-12) END
  FROM (SELECT *, list_transform(open, lambda x, k: least(x, greatest(gain - coalesce(list_sum(open[1:k - 1]), 0), 0))) AS takes FROM (
    SELECT *, CASE WHEN gain < 0 THEN [] ELSE list_transform(v, lambda s: CASE WHEN s.b = 'st_gain' OR bucket = 'lt_gain' THEN s.x ELSE 0 END) END AS open FROM (
      SELECT c.account, c.i, c.year::BIGINT AS year, c.bucket, c.gain::DOUBLE AS gain, list_filter(w.v, lambda s: c.gain < 0 OR c.year - s.o <= 4) AS v
      FROM walk w JOIN cells c ON c.account = w.account AND c.i = w.i + 1))))
SELECT account, year::INTEGER AS year, bucket, {R('gain', 2)} AS gain, {R('used', 2)} AS offset_used, {R('gain - used', 2)} AS taxable, {R('coalesce(list_sum(list_transform(v, lambda s: s.x)), 0)', 2)} AS carried
FROM walk WHERE gain > 0""")
def t16(t):
    rows = yearly(t).unpivot(["account", "year"], ["st_gain", "lt_gain"], "bucket", "gain")
    out = tx.loss_vintages(rows, by=["account"], life=4, ring={"st_gain": {"st_gain", "lt_gain"}, "lt_gain": {"lt_gain"}})
    return rounded(out, ["account", "year", "bucket"], ["gain", "offset_used", "taxable", "carried"], 2)


@query("t17_annual_threshold", f"""
SELECT account, security, opened, sold, {R('greatest(r - 5000, 0) - greatest(r - p - 5000, 0)', 2)} AS excess FROM (
  SELECT *, sum(p) OVER (PARTITION BY account, year(sold) ORDER BY sold, security, opened ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, greatest(sale - basis, 0.0) AS p FROM disposals))""")
def t17(t):
    d = disposals(t).withColumn("year", F.year("sold")).withColumn("gain", F.col("sale") - F.col("basis"))
    out = tx.annual_threshold(d, by=["account", "year"], order=["sold", "security", "opened"], taxable="gain", amount=5000.0)
    return out.select("account", "security", "opened", "sold", rnd("excess", 2).alias("excess"))


@shared
def names(t):
    """Months of every name that a book ever holds, wanted or not, and its documented exits: a month's bars that were all returned."""
    cells = F.explode(F.array(*[F.lit(c) for c in ("EQ", "MOM")])).alias("cell")
    priced = t.signals.select(cells, "sec_id", "m", (F.col("ret_next") * 0.002).alias("ret_next"), "spread", (F.col("sigma_d") * 0.002).alias("sigma_d"), "adv_usd", tradeable().alias("ok"))
    book = decile_book(t).select("cell", "sec_id", "m", "w")
    rows = priced.join(book.select("cell", "m").distinct(), ["cell", "m"]).join(book, ["cell", "sec_id", "m"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    back = t.table("lineitem").groupBy(F.col("l_suppkey").alias("sec_id"), F.last_day("l_shipdate").alias("event_date"))
    back = back.agg(F.avg("l_discount").alias("cost"), F.min((F.col("l_returnflag") == "R")).alias("gone")).where("gone").drop("gone")
    return t.stage("names", at.name_paths(rows, by=["cell"], evidence=back))


@shared
def runs(t):
    """Every book under every regime and lot method."""
    regimes = [("wedge", 0.37, 0.20, 30, False), ("flat", 0.25, 0.25, 0, False), ("marked", 0.30, 0.18, 0, True)]
    rows = [(c, n, m, s, lo, 12, w, k, 1e5) for c in ("EQ", "MOM") for n, s, lo, w, k in regimes for m in ("fifo", "lifo", "hifo", "tax_optimal")]
    return t.spark.createDataFrame(rows, "cell string, regime string, method string, short_rate double, long_rate double, long_months int, wash_days int, mark_to_market boolean, aum double")


RUN = ["cell", "regime", "method"]
MONTHLY = ["gross_ret", "cost", "borrow", "tax_ret", "after_tax_ret", "realised_st", "realised_lt", "disallowed", "unrealised", "deferred_tax", "turnover"]


@shared
def run_sums(t):
    return at.month_sums(names(t), runs(t), by=["cell"], run=RUN)


@shared
def after_tax(t):
    return t.stage("after_tax", at.accounts(run_sums(t), runs(t), run=RUN))


@query("t18_after_tax_accounts")
def t18(t):
    return rounded(after_tax(t), [*RUN, "m"], MONTHLY)


@query("t18_accrual_accounting")
def t18_accrual(t):
    return rounded(at.accounts(run_sums(t), runs(t), run=RUN, accounting="accrual"), [*RUN, "m"], MONTHLY)


view("gross_paths", f"""
  SELECT b.cell, b.m, sum(b.w * coalesce(ret_next, 0)) AS gross_ret, sum(greatest(-b.w, 0)) * 0.03::DOUBLE / 12 AS borrow FROM book b GROUP BY 1, 2""")


@query("t18_gross_and_borrow", f"""
SELECT cell, regime, method, m, {R('gross_ret')} AS gross_ret, {R('borrow')} AS borrow
FROM gross_paths, (VALUES ('wedge'), ('flat'), ('marked')) r(regime), (VALUES ('fifo'), ('lifo'), ('hifo'), ('tax_optimal')) l(method)""")
def t18_gross(t):
    return rounded(after_tax(t), [*RUN, "m"], ["gross_ret", "borrow"])


@query("t19_carry_exit_policy")
def t19(t):
    sums = at.month_sums(names(t), runs(t), by=["cell"], run=RUN, exits="carry_v1")
    out = at.accounts(sums, runs(t), run=RUN)
    return rounded(out, [*RUN, "m", "status", "n_frozen", "n_stale", "n_unresolved", "n_closed", "n_blocked"], MONTHLY)


SUMMARY = ["gross_sharpe", "net_sharpe", "after_tax_sharpe", "tax_drag_bps", "cost_drag_bps", "turnover_mean", "lt_share", "disallowed_mean"]


@shared
def summary(t):
    return at.summary(after_tax(t), by=RUN)


@query("t20_after_tax_summary")
def t20(t):
    return rounded(summary(t), [*RUN, "months", "resolved_months"], SUMMARY, 5)


@query("t21_deferral_overhang")
def t21(t):
    out = at.overhang(after_tax(t), by=RUN, checkpoints=["1997-12-31", "1999-12-31", "2001-06-30"])
    return rounded(out, [*RUN, "m"], ["deferred_tax", "tax_paid", "harvested", "overhang_share"], 4)


@query("t22_turnover_sweep", f"""
WITH p AS (SELECT country, avg(sig_disc) * 0.2::DOUBLE AS g, avg(sig_tax) * 0.05::DOUBLE AS k, 0.1::DOUBLE AS tl FROM monthly_px GROUP BY 1),
x AS (SELECT *, 1e-4 + i * ((1.0::DOUBLE - 1e-4) / 2000) AS p FROM p, (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.17::DOUBLE)) w(wedge), range(2001) r(i)),
y AS (SELECT *, least(greatest(1 - 12 * pow(1 - p, 11) + 11 * pow(1 - p, 12), 0), 1) AS phi FROM x),
z AS (SELECT *, g * (1 - exp(-p / 0.1)) * (1 - tl) - k * p - g * (1 - exp(-p / 0.1)) * wedge * phi AS r FROM y)
SELECT country, wedge, {R('arg_max(p, r)')} AS p_star, {R('1 - arg_max(phi, r)')} AS lt_share, {R('max(tl) + wedge * arg_max(phi, r)')} AS effective_rate, {R('max(r)', 8)} AS after_tax_return FROM z GROUP BY 1, 2""")
def t22(t):
    params = t.monthly_px.groupBy("country").agg((F.avg("sig_disc") * 0.2).alias("g"), (F.avg("sig_tax") * 0.05).alias("k"), F.lit(0.1).alias("tl"))
    out = tx.turnover_sweep(params, [0.0, 0.05, 0.17], key=["country"], g="g", kappa="k", theta_l="tl")
    return out.select("country", "wedge", rnd("p_star").alias("p_star"), rnd("lt_share").alias("lt_share"), rnd("effective_rate").alias("effective_rate"), rnd("after_tax_return", 8).alias("after_tax_return"))


@query("x25_tax_friction")
def x25_tax(t):
    s = summary(t).withColumn("arm", F.col("cell"))
    out = st.tax_friction(s, by=["regime"], arm="arm")
    return rounded(out, ["regime", "arm", "cells"], ["cost_drag_bps", "tax_drag_bps", "after_tax_sharpe", "lt_share", "tax_channel"], 5)


@query("x26_matched_book_accounting")
def x26(t):
    m = after_tax(t).withColumn("net", F.col("gross_ret") - F.col("cost") - F.col("borrow"))
    cost = inf.sharpe_diff(m, RUN, "m", "net", "gross_ret").withColumn("channel", F.lit("cost"))
    tax = inf.sharpe_diff(m, RUN, "m", "after_tax_ret", "net").withColumn("channel", F.lit("tax"))
    return rounded(cost.unionByName(tax), [*RUN, "channel", "n"], ["sharpe_a", "sharpe_b", "stat", "se", "p"], 5)


@query("x27_after_tax_inference")
def x27(t):
    m = after_tax(t).withColumn("net", F.col("gross_ret") - F.col("cost") - F.col("borrow"))
    zero = inf.sharpe_test(m, RUN, "m", "after_tax_ret").select(*RUN, F.col("sharpe"), F.col("t").alias("t_zero"), F.col("p").alias("p_zero"))
    pair = inf.sharpe_diff(m, RUN, "m", "after_tax_ret", "net").select(*RUN, F.col("stat").alias("diff"), "p")
    out = zero.join(pair, RUN).withColumn("key", F.concat_ws("|", *RUN))
    out = inf.holm(out, "p", by=["regime"], tie="key").drop("key")
    return rounded(out, RUN, ["sharpe", "t_zero", "p_zero", "diff", "p", "p_holm"], 5)
