"""SQL text of the panel views, for the check queries."""

from panelmill.plans.registry import view

view("daily_px", """
  SELECT r.r_name AS country, l.l_suppkey AS sec_id, CAST(l.l_shipdate AS DATE) AS d,
         CASE (l.l_suppkey + year(l.l_shipdate)) % 3 WHEN 0 THEN 'AAA' WHEN 1 THEN 'BBB' ELSE 'CCC' END AS cur,
         (min(l.l_extendedprice / l.l_quantity) + max(l.l_extendedprice / l.l_quantity)) / 2 AS op,
         max(l.l_extendedprice / l.l_quantity) AS hi, min(l.l_extendedprice / l.l_quantity) AS lo,
         sum(l.l_extendedprice) / sum(l.l_quantity) AS cl,
         sum(l.l_quantity) AS vol, sum(l.l_extendedprice) AS notional,
         avg(l.l_discount) AS disc, avg(l.l_tax) AS tax
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2, 3, 4""")

view("vendor_daily", """
  SELECT country, sec_id, d, cur AS curcdd, cl AS prccd, op AS prcod, hi AS prchd, lo AS prcld, vol AS cshtrd,
         vol * 1000.0 AS cshoc, CASE WHEN d < DATE '1998-07-01' THEN 2.0 ELSE 1.0 END::DOUBLE AS ajexdi,
         (1.0 + (year(d) - 1995) * 0.01::DOUBLE) AS trfd, CASE WHEN sec_id % 7 = 0 THEN 100.0 ELSE 1.0 END::DOUBLE AS qunit,
         CASE (sec_id + day(d)) % 9 WHEN 0 THEN 10 WHEN 1 THEN 4 WHEN 8 THEN 5 ELSE 3 END AS prcstd
  FROM daily_px""")

view("fx_quotes", """
  SELECT CAST(l_shipdate AS DATE) AS d, CASE l_linenumber % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'AAA' WHEN 2 THEN 'BBB' ELSE 'CCC' END AS tocurd,
         CASE WHEN l_linestatus = 'O' THEN 'AR' ELSE 'CF' END AS exrattpd, 1 + avg(l_discount) AS exratd
  FROM lineitem GROUP BY 1, 2, 3""")

view("fx_rates", """
  SELECT CAST(l_shipdate AS DATE) AS d, CASE l_returnflag WHEN 'A' THEN 'AAA' WHEN 'N' THEN 'BBB' ELSE 'CCC' END AS cur,
         1 + avg(l_discount) AS usd_per_local
  FROM lineitem WHERE day(l_shipdate) % 3 = 0 GROUP BY 1, 2""")

view("monthly_px", """
  SELECT country, sec_id, last_day(d) AS m, count(*) AS n_days, sum(notional) AS me, max_by(cl, d) AS cl,
         round(avg(disc), 10) AS sig_disc, round(avg(tax), 10) AS sig_tax, avg(hi - lo) AS sig_range, sum(vol) AS sig_vol
  FROM daily_px GROUP BY 1, 2, 3""")

view("daily_ret", """
  SELECT *, CASE WHEN cur = lag(cur) OVER w AND cl > 0 AND lag(cl) OVER w > 0 THEN cl / lag(cl) OVER w - 1 END AS ret,
         CASE WHEN hi > 0 AND lo > 0 AND hi >= lo THEN (hi - lo) / ((hi + lo) / 2) END AS hl_range,
         d - lag(d) OVER w AS gap_days
  FROM daily_px WINDOW w AS (PARTITION BY sec_id ORDER BY d)""")

view("rolled", """
  SELECT *, count(*) OVER w AS obs_21, count(ret) OVER w AS ret_obs_21, count(hl_range) OVER w AS range_obs_21,
         stddev_samp(ret) OVER w AS sigma_21, avg(notional) OVER w AS adv_21, avg(hl_range) OVER w AS range_21,
         max(gap_days) OVER w AS max_gap_21
  FROM daily_ret WINDOW w AS (PARTITION BY sec_id ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")

view("features", """
  SELECT *, last_day(d) AS m FROM rolled
  QUALIFY row_number() OVER (PARTITION BY sec_id, last_day(d) ORDER BY d DESC) = 1""")

view("cost_inputs", """
  SELECT country, sec_id, m, CASE WHEN range_obs_21 = 21 THEN range_21 + 0.001 END AS spread,
         CASE WHEN ret_obs_21 = 21 THEN sigma_21 END AS sigma_d, CASE WHEN obs_21 = 21 THEN adv_21 END AS adv_usd,
         CAST(NULL AS DOUBLE) AS borrow_fee
  FROM features""")

view("panel", """
  SELECT p.country, p.sec_id, p.m, n_days, n_days >= 5 AS in_universe, me, cl AS price, sig_disc, sig_tax, sig_range, sig_vol,
         ret, ret_next, spread, sigma_d, adv_usd, borrow_fee
  FROM (SELECT *,
               CASE WHEN last_day(lag(m) OVER w + INTERVAL 1 MONTH) = m THEN cl / lag(cl) OVER w - 1 END AS ret,
               CASE WHEN last_day(m + INTERVAL 1 MONTH) = lead(m) OVER w THEN lead(cl) OVER w / cl - 1 END AS ret_next
        FROM monthly_px WINDOW w AS (PARTITION BY sec_id ORDER BY m)) p
  LEFT JOIN cost_inputs c ON p.sec_id = c.sec_id AND p.m = c.m""")

_RANK = """CASE WHEN {c} IS NULL THEN NULL WHEN count({c}) OVER (PARTITION BY m) <= 1 THEN -0.5::DOUBLE
           ELSE (row_number() OVER (PARTITION BY m ORDER BY {c} NULLS LAST, sec_id) - 1)::DOUBLE / (count({c}) OVER (PARTITION BY m) - 1) - 0.5 END"""


def xs_rank_sql(c: str) -> str:
    return _RANK.format(c=c)


view("signals", f"""
  SELECT country, sec_id, m, me, price, ret, ret_next, spread, sigma_d, adv_usd, borrow_fee, in_universe,
         {xs_rank_sql('sig_disc')} AS sig_disc, {xs_rank_sql('sig_tax')} AS sig_tax, {xs_rank_sql('sig_vol')} AS sig_vol,
         {xs_rank_sql('ret')} AS sig_mom, {xs_rank_sql('me')} AS sig_size
  FROM panel""")

view("trades", """
  SELECT o.o_custkey AS account, l.l_suppkey % 10 AS security, CAST(l.l_shipdate AS DATE) AS d,
         CASE WHEN l.l_returnflag = 'R' THEN 'S' ELSE 'B' END AS side,
         sum(l.l_quantity) AS qty, sum(l.l_extendedprice) AS amount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3, 4""")

view("covered_trades", """
  SELECT account, security, d, side, qty, amount FROM trades
  UNION ALL
  SELECT account, security, DATE '1994-12-31', 'B', q, q * 1000.0 FROM (
    SELECT account, security, greatest(max(net), 0.0) AS q FROM (
      SELECT account, security, sum(CASE WHEN side = 'S' THEN qty ELSE -qty END)
             OVER (PARTITION BY account, security ORDER BY d, side ROWS UNBOUNDED PRECEDING) AS net FROM trades)
    GROUP BY 1, 2) WHERE q > 0""")

view("cell_returns", """
  SELECT last_day(CAST(l.l_shipdate AS DATE)) AS m,
         CASE WHEN p.p_partkey & 1 = 1 THEN 'N' ELSE 'L' END || '-' || CASE WHEN p.p_partkey & 2 = 2 THEN 'C' ELSE 'S' END || '-' ||
         CASE WHEN p.p_partkey & 4 = 4 THEN 'E' ELSE 'P' END || '-' || CASE WHEN p.p_partkey & 8 = 8 THEN 'U' ELSE '0' END AS cell,
         avg(l.l_discount) - avg(l.l_tax) - 0.01 AS r
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2""")
