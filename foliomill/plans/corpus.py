"""A deterministic invoice corpus from the star schema, as SQL that Spark and DuckDB both run.

One document an order. The order's first item gives seller, model and horsepower; the price is the order's total. Ground
truth are those columns; the lines are what a reader of the page would see, with wrong and missing parts by the key's
remainders, so that every branch of the extraction is met.
"""

from __future__ import annotations

import re

#: First item of each order by its whole key, as (l_orderkey, l_linenumber) repeats.
ITEMS = """
items AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS n FROM lineitem),
truth AS (SELECT o_orderkey AS doc_id, s_name AS dealer, CASE WHEN p_brand IS NOT NULL THEN concat(p_brand, ' ', p_type, ' ', cast(p_size AS VARCHAR(9))) END AS model,
  10 + p_size AS hp, cast(floor(o_totalprice) AS BIGINT) AS cost, o_orderkey % 3 = 0 AS stamp, o_orderkey % 4 = 0 AS signature
  FROM orders LEFT JOIN (SELECT * FROM items WHERE n = 1) i ON o_orderkey = l_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey),
lines AS (
  SELECT doc_id, 0 AS line_no, coalesce(dealer, 'Estimate') AS text FROM truth UNION ALL
  SELECT doc_id, 1, CASE WHEN doc_id % 7 = 0 THEN coalesce(dealer, '') ELSE concat('Dealer: ', coalesce(dealer, 'unknown')) END FROM truth UNION ALL
  SELECT doc_id, 2, concat(CASE WHEN doc_id % 5 = 0 THEN 'Model - ' ELSE 'Model: ' END, coalesce(model, '')) FROM truth UNION ALL
  SELECT doc_id, 3, CASE WHEN hp IS NULL THEN 'Horse Power: n/a' WHEN doc_id % 13 = 0 THEN concat('Power ', cast(hp * 10 AS VARCHAR(9)), ' HP') ELSE concat('Horse Power: ', cast(hp AS VARCHAR(9)), ' H.P.') END FROM truth UNION ALL
  SELECT doc_id, 4, 'Item Qty Rate Amount' FROM truth UNION ALL
  SELECT l_orderkey, cast(4 + n AS INT), concat('Part ', cast(l_partkey AS VARCHAR(20)), ' ', cast(cast(l_quantity AS INT) AS VARCHAR(9)), ' ', cast(cast(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20))) FROM items UNION ALL
  SELECT doc_id, 90, CASE WHEN doc_id % 11 = 0 THEN 'Sub total pending' ELSE concat('Grand Total: Rs ', cast(cost AS VARCHAR(20))) END FROM truth UNION ALL
  SELECT doc_id, 91, 'Ph: 9876501234' FROM truth WHERE doc_id % 3 = 1 UNION ALL
  SELECT doc_id, 92, CASE WHEN doc_id % 6 = 0 THEN 'Stamp duty paid' ELSE 'Dealer seal (Stamp)' END FROM truth WHERE stamp UNION ALL
  SELECT doc_id, 93, CASE WHEN doc_id % 8 = 0 THEN 'Sd/ manager' ELSE 'Authorised signatory' END FROM truth WHERE signature)
"""
#: What the page gives: labelled values, the first that fits; see the functions below for the same rules on columns.
FOUND = """
found AS (SELECT doc_id,
  max(CASE WHEN line_no = 1 AND regexp_extract(text, '^Dealer *[:-] *(.+)$', 1) <> '' THEN regexp_extract(text, '^Dealer *[:-] *(.+)$', 1) END) AS dealer,
  max(CASE WHEN line_no = 2 AND regexp_extract(text, '^Model *[:-] *(.+)$', 1) <> '' THEN regexp_extract(text, '^Model *[:-] *(.+)$', 1) END) AS model,
  max(CASE WHEN regexp_extract(text, '([0-9]{1,3}) *(H[.]P|HP)', 1) <> '' AND cast(concat('0', regexp_extract(text, '([0-9]{1,3}) *(H[.]P|HP)', 1)) AS INT) BETWEEN 10 AND 125 THEN cast(concat('0', regexp_extract(text, '([0-9]{1,3}) *(H[.]P|HP)', 1)) AS INT) END) AS hp,
  max(CASE WHEN regexp_extract(text, 'Total: Rs ([0-9]+)', 1) <> '' THEN cast(concat('0', regexp_extract(text, 'Total: Rs ([0-9]+)', 1)) AS BIGINT) END) AS cost,
  max(CASE WHEN regexp_extract(lower(text), '(stamp|seal)', 1) <> '' AND regexp_extract(lower(text), '(stamp duty)', 1) = '' THEN 1 ELSE 0 END) = 1 AS stamp,
  max(CASE WHEN regexp_extract(lower(text), '(signatory|sd/|signed)', 1) <> '' THEN 1 ELSE 0 END) = 1 AS signature
  FROM lines GROUP BY doc_id),
-- One row a document and field: whether the value is right; null where there is no truth to compare with.
judged AS (SELECT t.doc_id, f.field, CASE f.field
    WHEN 'dealer_name' THEN CASE WHEN t.dealer IS NOT NULL THEN coalesce(lower(p.dealer) = lower(t.dealer), false) END
    WHEN 'model_name' THEN CASE WHEN t.model IS NOT NULL THEN coalesce(lower(p.model) = lower(t.model), false) END
    WHEN 'horse_power' THEN CASE WHEN t.hp IS NOT NULL THEN coalesce(p.hp = t.hp, false) END
    WHEN 'asset_cost' THEN coalesce(p.cost = t.cost, false)
    WHEN 'stamp' THEN p.stamp = t.stamp ELSE p.signature = t.signature END AS ok
  FROM truth t JOIN found p ON t.doc_id = p.doc_id CROSS JOIN (SELECT 'dealer_name' AS field UNION ALL SELECT 'model_name' UNION ALL SELECT 'horse_power' UNION ALL SELECT 'asset_cost' UNION ALL SELECT 'stamp' UNION ALL SELECT 'signature') f),
-- Confidence as a weighted mean over the fields that were found, less a step for each that wasn't.
conf AS (SELECT doc_id, p.dealer, p.model, p.hp, p.cost, p.stamp, p.signature,
  round(greatest(0.0e0, least(1.0e0, CASE WHEN p.dealer IS NULL AND p.model IS NULL AND p.hp IS NULL AND p.cost IS NULL THEN 0.0e0 ELSE
    ((CASE WHEN p.dealer IS NULL THEN 0.0e0 ELSE 0.2125e0 END) + (CASE WHEN p.model IS NULL THEN 0.0e0 ELSE 0.1875e0 END) + (CASE WHEN p.hp IS NULL THEN 0.0e0 ELSE 0.18e0 END) + (CASE WHEN p.cost IS NULL THEN 0.0e0 ELSE 0.276e0 END)) /
    ((CASE WHEN p.dealer IS NULL THEN 0.0e0 ELSE 0.25e0 END) + (CASE WHEN p.model IS NULL THEN 0.0e0 ELSE 0.25e0 END) + (CASE WHEN p.hp IS NULL THEN 0.0e0 ELSE 0.2e0 END) + (CASE WHEN p.cost IS NULL THEN 0.0e0 ELSE 0.3e0 END)) END
    - 0.08e0 * ((CASE WHEN p.dealer IS NULL THEN 1 ELSE 0 END) + (CASE WHEN p.model IS NULL THEN 1 ELSE 0 END) + (CASE WHEN p.hp IS NULL THEN 1 ELSE 0 END) + (CASE WHEN p.cost IS NULL THEN 1 ELSE 0 END)))), 4) AS confidence FROM found p),
-- An extraction run's log: events stand for documents' stages.
runs AS (SELECT event_id AS doc_id, user_id, event_type AS stage, value AS latency, ts, 0.0002e0 + 0.0006e0 * (1 + event_id % 3) + 0.00009e0 AS cost_usd,
  1 + event_id % 3 AS pages, event_id % 17 AS failures, (event_id % 100) / 100.0e0 AS conf FROM events)
"""
BASE = "WITH " + ITEMS.strip() + ", " + FOUND.strip()

#: Spark's spellings of two of the corpus' tables. A branch of a union reads its tables for itself, so a document's lines come from one array, and
#: the first item is the least one, which is aggregated before it is shuffled, where a window would sort all items.
_FIRST = """(SELECT f.l_orderkey, f.i.l_partkey, f.i.l_suppkey FROM (SELECT l_orderkey, min(struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus)) AS i FROM lineitem GROUP BY l_orderkey) f) i"""
_ONE_PASS = """lines AS (
  SELECT doc_id, l.line_no, l.text FROM truth LATERAL VIEW inline(array_compact(array(
    named_struct('line_no', 0, 'text', coalesce(dealer, 'Estimate')),
    named_struct('line_no', 1, 'text', CASE WHEN doc_id % 7 = 0 THEN coalesce(dealer, '') ELSE concat('Dealer: ', coalesce(dealer, 'unknown')) END),
    named_struct('line_no', 2, 'text', concat(CASE WHEN doc_id % 5 = 0 THEN 'Model - ' ELSE 'Model: ' END, coalesce(model, ''))),
    named_struct('line_no', 3, 'text', CASE WHEN hp IS NULL THEN 'Horse Power: n/a' WHEN doc_id % 13 = 0 THEN concat('Power ', cast(hp * 10 AS VARCHAR(9)), ' HP') ELSE concat('Horse Power: ', cast(hp AS VARCHAR(9)), ' H.P.') END),
    named_struct('line_no', 4, 'text', 'Item Qty Rate Amount'),
    named_struct('line_no', 90, 'text', CASE WHEN doc_id % 11 = 0 THEN 'Sub total pending' ELSE concat('Grand Total: Rs ', cast(cost AS VARCHAR(20))) END),
    CASE WHEN doc_id % 3 = 1 THEN named_struct('line_no', 91, 'text', 'Ph: 9876501234') END,
    CASE WHEN stamp THEN named_struct('line_no', 92, 'text', CASE WHEN doc_id % 6 = 0 THEN 'Stamp duty paid' ELSE 'Dealer seal (Stamp)' END) END,
    CASE WHEN signature THEN named_struct('line_no', 93, 'text', CASE WHEN doc_id % 8 = 0 THEN 'Sd/ manager' ELSE 'Authorised signatory' END) END))) l AS line_no, text UNION ALL
  SELECT l_orderkey, cast(4 + n AS INT), concat('Part ', cast(l_partkey AS VARCHAR(20)), ' ', cast(cast(l_quantity AS INT) AS VARCHAR(9)), ' ', cast(cast(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20))) FROM items)"""


def spark_base(sql: str) -> str:
    """A statement over the corpus as Spark runs it: the same rows, each of the given tables read fewer times."""
    text = lambda x: re.sub(r"VARCHAR\(\d+\)", "STRING", x)
    lines = ITEMS.strip()[ITEMS.strip().index("lines AS (") :]
    return text(sql).replace(text(lines), text(_ONE_PASS)).replace("(SELECT * FROM items WHERE n = 1) i", _FIRST).replace("truth AS (SELECT ", "truth AS (SELECT /*+ SHUFFLE_MERGE(i) */ ")
