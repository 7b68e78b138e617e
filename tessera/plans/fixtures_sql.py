"""The projections of ``tessera.sources.tables`` as SQL, for the oracle queries."""

PX_DAILY = """px_daily AS (SELECT concat(event_type, '_', CAST(user_id % 4 AS VARCHAR)) AS ticker, CAST(ts AS DATE) AS dt,
  avg(value) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
_BRAND = """{name} AS (SELECT p_brand AS ticker, {dt} AS dt, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
PX_MONTHLY = _BRAND.format(name="px_monthly", dt="CAST(date_trunc('month', l_shipdate) AS DATE)")
PX_SPARSE = _BRAND.format(name="px_sparse", dt="CAST(l_shipdate AS DATE)")
IDX_DAILY = "idx_daily AS (SELECT CAST(ts AS DATE) AS dt, avg(value) AS close FROM events GROUP BY 1)"
FUNDAMENTALS = """fundamentals AS (SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS ticker, p_name AS company, p_brand AS sector, p_type AS industry,
  p_retailprice AS price, rev AS market_cap, p_retailprice / nullif(CAST(p_size % 7 AS DOUBLE), 0) AS pe,
  p_retailprice / nullif(CAST(p_size % 5 AS DOUBLE), 0) AS forward_pe, p_retailprice / nullif(qty, 0) AS pb, rev / nullif(qty * p_retailprice, 0) AS ps,
  p_retailprice / nullif(CAST((p_size % 7) * (p_size % 3) AS DOUBLE), 0) AS peg, 100 * tax / nullif(disc, 0) AS debt_equity,
  disc / nullif(cnt, 0) AS roe, tax / nullif(cnt, 0) AS roa, (disc - tax) / nullif(disc + tax, 0) AS profit_margin
  FROM part LEFT JOIN (SELECT l_partkey, sum(l_extendedprice) AS rev, sum(l_quantity) AS qty, sum(l_tax) AS tax, sum(l_discount) AS disc,
  CAST(count(*) AS DOUBLE) AS cnt FROM lineitem GROUP BY l_partkey) f ON p_partkey = f.l_partkey)"""
TICKER_GROUPS = "ticker_groups AS (SELECT DISTINCT p_type AS group_name, concat('P', CAST(p_partkey AS VARCHAR)) AS symbol FROM part)"
STATEMENTS = """statements AS (SELECT n_name AS ticker, CASE o_orderstatus WHEN 'F' THEN 'income' WHEN 'O' THEN 'balance' ELSE 'cash' END AS stmt,
  make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS period,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Total Assets' WHEN '2-HIGH' THEN 'Total Liabilities' ELSE o_orderpriority END AS row_label,
  sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4)"""
WEIGHTS = """weights AS (SELECT concat(event_type, '_0') AS ticker, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events WHERE user_id % 4 = 0) AS weight
  FROM events WHERE user_id % 4 = 0 GROUP BY 1)"""
MARKET_CAPS = "market_caps AS (SELECT concat(event_type, '_', CAST(user_id % 4 AS VARCHAR)) AS ticker, sum(value) AS market_cap FROM events GROUP BY 1)"
