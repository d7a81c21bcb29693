"""Queries over the invoice corpus' pages: regions, fields with confidences, figures as they are misread, learnt rules.

The Spark side composes the engine's operators; the SQL for DuckDB states the same results on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import fields, layout, regions
from foliomill.plans.corpus import BASE
from foliomill.plans.sql import run_sql

#: The corpus' lines on pages of 842 points; the end of some documents is on a second page.
PLACED = """placed AS (SELECT doc_id, CASE WHEN line_no >= 90 AND doc_id % 19 = 0 THEN 1 ELSE 0 END AS page_index, line_no, text, 40 AS x1,
  CASE WHEN line_no < 90 THEN 60 + 24 * line_no ELSE 690 + 18 * (line_no - 90) END AS y1, cast(40 + 6 * length(text) AS INT) AS x2,
  CASE WHEN line_no < 90 THEN 72 + 24 * line_no ELSE 702 + 18 * (line_no - 90) END AS y2, round(CASE WHEN doc_id % 29 = 0 THEN 0.5e0 ELSE 0.9e0 END - (line_no % 5) / 100.0e0, 4) AS avg_conf FROM lines)"""
#: The same lines by region (DuckDB).
REGIONS = (
    PLACED
    + """, b AS (SELECT *, CASE WHEN y2 <= 151 THEN 'header' WHEN y1 >= 690 THEN 'footer' ELSE 'body' END AS band,
  length(text) >= 6 AND length(regexp_replace(text, '[^\\p{Nd}]+', '', 'g')) >= 0.25 * length(text) AS dense FROM placed),
c AS (SELECT *, band = 'body' AND (dense OR regexp_matches(lower(text), '"""
    + "|".join(regions.TABLE_WORDS)
    + """')) AS cand, count(*) FILTER (band = 'body') OVER (PARTITION BY doc_id, page_index) AS n_body FROM b),
d AS (SELECT *, count(*) FILTER (cand) OVER (PARTITION BY doc_id, page_index) AS n_cand FROM c),
reg AS (SELECT *, band AS region, CASE WHEN band = 'body' THEN 0.8e0 ELSE 0.85e0 END AS region_conf FROM d UNION ALL
  SELECT *, 'body', 0.4e0 FROM d WHERE n_body = 0 UNION ALL SELECT *, 'table', 0.75e0 FROM d WHERE cand AND n_cand >= 4),
pg AS (SELECT p.doc_id, p.page_index, k.region, count(r.text) AS n_lines,
  coalesce(min(r.x1), 0) AS x1, coalesce(min(r.y1), 0) AS y1, coalesce(max(r.x2), CASE WHEN k.region = 'table' THEN 0 ELSE 595 END) AS x2, coalesce(max(r.y2), CASE WHEN k.region = 'table' THEN 0 ELSE 842 END) AS y2,
  coalesce(max(r.region_conf), CASE k.region WHEN 'table' THEN 0e0 WHEN 'body' THEN 0.4e0 ELSE 0.35e0 END) AS confidence
  FROM (SELECT DISTINCT doc_id, page_index FROM placed) p CROSS JOIN (VALUES ('header'), ('body'), ('table'), ('footer')) k(region) LEFT JOIN reg r ON r.doc_id = p.doc_id AND r.page_index = p.page_index AND r.region = k.region GROUP BY p.doc_id, p.page_index, k.region)"""
)
DUCK = BASE.replace("VARCHAR(9)", "VARCHAR").replace("VARCHAR(20)", "VARCHAR") + ", " + REGIONS


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"{BASE}, {PLACED} SELECT * FROM placed")


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.pages(placed(spark, sf_dir))


def doc_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.documents(page_regions(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def block_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a block of the page, placed by the page's boxes."""
    lines = placed(spark, sf_dir)
    return regions.placed_blocks(lines, regions.pages(lines)).select("doc_id", "line_no", "region")


def hp_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.horse_power(regions.by_region(placed(spark, sf_dir)))


def cost_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.asset_cost(regions.by_region(placed(spark, sf_dir)))


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model of the parts, in order of its first part."""
    return run_sql(spark, sf_dir, "SELECT concat(p_brand, ' ', p_type, ' ', cast(p_size AS VARCHAR(9))) AS name, min(p_partkey) AS place FROM part GROUP BY 1")


def model_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.model(regions.by_region(placed(spark, sf_dir)), _models(spark, sf_dir))


def dealer_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = run_sql(spark, sf_dir, "SELECT s_name AS name, s_suppkey AS place FROM supplier")
    return fields.dealer(regions.by_region(placed(spark, sf_dir)), names)


def calibrated_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence from the figure and the price: the mean, less for empty regions, fallbacks and replays."""
    df = fields.figures(placed(spark, sf_dir))
    return df.select("doc_id", fields.calibrated(F.col("base"), F.col("gaps"), F.col("doc_id") % 29 == 0, F.col("doc_id") % 23 == 0, F.col("strong")).alias("confidence"))


#: Figures as they are misread, from parts' keys.
MISREAD = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('Model yo', CASE WHEN p_partkey % 2 = 0 THEN ' HP' ELSE 'HP' END) WHEN 1 THEN concat('power ', cast(p_partkey % 9 AS VARCHAR(9)), '?+ 0 HP now') WHEN 2 THEN concat(cast(p_partkey % 9 AS VARCHAR(9)), ' 5 h. p.') WHEN 3 THEN concat('x', cast(p_size AS VARCHAR(9)), ' 5 HPX') ELSE concat('plain ', cast(p_size AS VARCHAR(9)), ' HP') END AS text FROM part"


def hp_misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, MISREAD).select("p_partkey", T.repair_hp_text(F.col("text")).alias("text"))


def hp_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one document a part brand, of which some split a figure."""
    text = "CASE p_partkey % 3 WHEN 0 THEN concat('Power ', cast(p_partkey % 7 AS VARCHAR(9)), ' ?+') WHEN 1 THEN '0 HP' ELSE p_type END"
    lines = run_sql(spark, sf_dir, f"SELECT cast(floor(p_partkey / 50) AS BIGINT) AS doc_id, p_partkey, {text} AS text FROM part")
    docs = lines.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "text"))), lambda s: s["text"]).alias("lines"))
    return docs.select("doc_id", F.posexplode(T.fused_hp_lines(F.col("lines"))).alias("line_no", "text"))


def dealer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('Authorised Dealer for ', s_name, ' ,;') WHEN 1 THEN concat('The dealer  for ', s_name) WHEN 2 THEN concat('the ', s_name, ' | ') ELSE s_name END AS text FROM supplier"
    return run_sql(spark, sf_dir, said).select("s_suppkey", T.dealer_line(F.col("text")).alias("dealer"))


def indic_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    written = F.translate(F.col("p_partkey").cast("string"), "0123456789", T.INDIC_DIGITS[:10])
    return parts.select("p_partkey", written.alias("written"), T.digits_only(written).alias("digits"))


def decimal_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts written with groups and decimals, read back."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("cents", F.round(F.col("p_retailprice") * 100).cast("long"))
    text = F.concat(F.lit("Cost "), F.regexp_replace(F.floor(F.col("cents") / 100).cast("string"), r"^(\d+)(\d{3})$", "$1,$2"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.lit(" for "), (F.col("p_partkey") % 9 + 1).cast("string"))
    return parts.select("p_partkey", F.element_at(T.decimal_money(text), 1).cast("long").alias("amount"), F.size(T.decimal_money(text)).cast("long").alias("n"))


def model_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier's lines the one most like a model's."""
    text = "CASE p_partkey % 4 WHEN 0 THEN concat('Cost of new tractor Rs ', cast(p_size AS VARCHAR(9))) WHEN 1 THEN concat('Tractor ', p_brand, ' trailer') WHEN 2 THEN concat('Tractor HP ', cast(p_size AS VARCHAR(9))) ELSE concat('tractor ', p_type) END"
    lines = run_sql(spark, sf_dir, f"SELECT p_size AS doc_id, p_partkey, {text} AS text FROM part")
    best = lines.groupBy("doc_id").agg(F.min(F.struct(T.model_rank(F.col("text")).alias("r"), "p_partkey", "text")).alias("b"))
    return best.select("doc_id", "b.text", "b.r.penalty", "b.r.no_token", "b.r.amount")


def language_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = F.split(F.concat_ws(",", F.lit(" Hindi"), F.when(F.col("n_nationkey") % 2 == 0, "en"), F.when(F.col("n_nationkey") % 3 == 0, "gu"), F.lit("hi"), F.col("n_name")), ",")
    there = F.when(F.col("n_nationkey") % 5 == 0, F.array().cast("array<string>")).when(F.col("n_nationkey") % 5 == 1, F.array(F.lit("guj"))).otherwise(F.array(F.lit("eng"), F.lit("hin")))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", T.language_codes(hints, there).alias("codes"))


#: Boxes of two labels on pages, from line items.
BOXES = "SELECT l_orderkey AS doc_id, cast(0 AS INT) AS page_index, CASE l_linenumber % 3 WHEN 0 THEN 'sign' WHEN 1 THEN 'Seal' ELSE 'stamp' END AS label, cast(l_partkey % 40 AS INT) AS x1, cast(l_suppkey % 40 AS INT) AS y1, cast(l_partkey % 40 + 30 AS INT) AS x2, cast(l_suppkey % 40 + 30 AS INT) AS y2, (l_partkey % 100) / 100.0e0 AS conf FROM lineitem"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, BOXES).withColumn("label", T.detection_label(F.col("label")))


def detections_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest box of each label, the smallest of equals."""
    best = _boxes(spark, sf_dir).groupBy("doc_id", "label").agg(F.min(F.struct((-F.col("conf")).alias("c"), "x1", "y1")).alias("b"))
    return best.select("doc_id", "label", (-F.col("b.c")).alias("conf"), "b.x1", "b.y1")


def detections_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppression of overlapping boxes leaves."""
    return layout.suppressed(_boxes(spark, sf_dir))


def adapter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules learnt from suppliers' names with misread characters; the names as the rules mend them."""
    pairs = run_sql(spark, sf_dir, "SELECT s_suppkey, replace(replace(lower(s_name), 'l', '1'), 'm', 'rn') AS pred, lower(s_name) AS gt FROM supplier")
    rules = fields.learnt_rules(pairs)
    return pairs.select("s_suppkey", fields.replaced(F.col("pred"), rules).alias("mended"), F.lit(",".join("".join((a, ">", b)) for a, b in rules)).alias("rules"))


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines by what they look like: table words, dense figures."""
    line = F.explode(F.split("text", "\n"))
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", line.alias("line"))
    return df.groupBy("doc_id").agg(F.count_if(F.lower("line").rlike("|".join(regions.TABLE_WORDS))).alias("worded"), F.count_if(regions.dense(F.col("line"))).alias("dense"), F.count("line").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (page_regions, doc_layout, block_regions, hp_by_region, cost_by_region, model_by_region, dealer_by_region, calibrated_confidence, hp_misread, hp_fused, dealer_normalize, indic_digits, decimal_amounts, model_lines, language_arguments, detections_top, detections_kept, adapter_rules, keyword_lines)
}

_WEIGHT = "CASE WHEN region = '{0}' THEN 1e0 {1} ELSE 0.6e0 END"
_TABLE = _WEIGHT.format("table", "WHEN region = 'body' THEN 0.85e0")
_FOOTER = _WEIGHT.format("footer", "WHEN region IN ('table', 'body') THEN 0.75e0")
_HP = f"""hp AS (SELECT doc_id, value, round(avg_conf * 0.9 * w * region_conf, 4) AS conf, region FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY avg_conf * w DESC, list_position(['table', 'body', 'header', 'footer'], region), page_index, line_no) AS rn FROM
  (SELECT *, {_TABLE} AS w, try_cast(regexp_extract(text, '(?i)([0-9]{{1,3}})\\s*(?:h\\.?\\s?p\\.?)', 1) AS INTEGER) AS value FROM reg) WHERE value BETWEEN 1 AND 300) WHERE rn = 1)"""
_COST = f"""m AS (SELECT *, list_max(list_transform(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '(?i)(₹|rs\\.?|inr)', ' ', 'g'), '([0-9][0-9,.\\s]{{2,}}[0-9]|[0-9]+)', 1), lambda t: regexp_replace(t, '[^0-9]+', '', 'g')), lambda t: length(t) <= 18), lambda t: cast(t AS BIGINT))) AS value,
  regexp_matches(text, '(?i)asset\\s*cost|invoice\\s*amount|grand\\s*total|net\\s*amount|total\\b|amount\\b') AS total, page_index = max(page_index) OVER (PARTITION BY doc_id) AS here FROM reg),
k AS (SELECT *, round(avg_conf * CASE WHEN total AND NOT here THEN 0.506e0 WHEN total THEN 0.92e0 ELSE 0.65e0 END * {_FOOTER} * region_conf * CASE WHEN here THEN 1.15e0 ELSE 0.9e0 END, 4) AS conf FROM m WHERE value > 0),
cost AS (SELECT doc_id, value, conf, region FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, value DESC, list_position(['footer', 'table', 'body', 'header'], region), page_index, line_no) AS rn FROM k) WHERE rn = 1)"""
_LAYOUT = "lay AS (SELECT doc_id, region, cast(sum(n_lines) AS BIGINT) AS n_lines, coalesce(min(x1) FILTER (x2 > x1 OR y2 > y1), 0) AS x1, coalesce(min(y1) FILTER (x2 > x1 OR y2 > y1), 0) AS y1, coalesce(max(x2) FILTER (x2 > x1 OR y2 > y1), 0) AS x2, coalesce(max(y2) FILTER (x2 > x1 OR y2 > y1), 0) AS y2, round(avg(confidence), 6) AS confidence FROM pg GROUP BY doc_id, region)"
_DUCK_BOXES = BOXES.replace("'Seal'", "'stamp'").replace("'sign'", "'signature'")
_PLAIN = MISREAD.replace("VARCHAR(9)", "VARCHAR")
_MARK = "(\\s*(?:hp|h\\.\\s*p\\.?)(?:[^A-Za-z0-9_]|$))"

ORACLE_SQL: dict[str, str] = {
    "page_regions": f"{DUCK} SELECT * FROM pg",
    "doc_layout": f"{DUCK}, {_LAYOUT} SELECT * FROM lay",
    "block_regions": f"""{DUCK} SELECT b.doc_id, b.line_no, CASE WHEN t.x2 > 0 AND greatest(0, least(t.x2, b.x2) - greatest(t.x1, b.x1)) * greatest(0, least(t.y2, b.y2) - greatest(t.y1, b.y1)) / greatest(1, (b.x2 - b.x1) * (b.y2 - b.y1)) >= 0.2 THEN 'table'
  WHEN (b.y1 + b.y2) / 2.0 <= h.y2 THEN 'header' WHEN (b.y1 + b.y2) / 2.0 >= f.y1 THEN 'footer' ELSE 'body' END AS region FROM placed b
  JOIN pg t ON (t.doc_id, t.page_index, t.region) = (b.doc_id, b.page_index, 'table') JOIN pg h ON (h.doc_id, h.page_index, h.region) = (b.doc_id, b.page_index, 'header') JOIN pg f ON (f.doc_id, f.page_index, f.region) = (b.doc_id, b.page_index, 'footer')""",
    "hp_by_region": f"{DUCK}, {_HP} SELECT * FROM hp",
    "cost_by_region": f"{DUCK}, {_COST} SELECT * FROM cost",
    "model_by_region": f"""{DUCK}, names AS (SELECT concat(p_brand, ' ', p_type, ' ', p_size) AS name, min(p_partkey) AS place FROM part GROUP BY 1),
hits AS (SELECT doc_id, region, page_index, line_no, avg_conf, region_conf, name AS value, 0.98e0 AS rule, 1 AS stage, place FROM reg JOIN names ON contains(lower(text), lower(name)) UNION ALL
  SELECT doc_id, region, page_index, line_no, avg_conf, region_conf, trim(regexp_replace(regexp_extract(text, '[:-](.*)$', 1), '\\s+', ' ', 'g')), 0.55e0, 2, 0 FROM reg WHERE regexp_matches(text, '(?i)\\bmodel\\b') AND trim(regexp_extract(text, '[:-](.*)$', 1)) <> '')
SELECT doc_id, value, round(avg_conf * rule * {_TABLE} * region_conf, 4) AS conf, region FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, list_position(['table', 'body', 'header', 'footer'], region), page_index, line_no, place) AS rn FROM hits) WHERE rn = 1""",
    "calibrated_confidence": f"""{DUCK}, {_LAYOUT}, {_HP}, {_COST}, sure AS (SELECT doc_id, avg(conf) AS base, count(*) FILTER (conf >= 0.7) AS strong FROM (SELECT doc_id, conf FROM hp UNION ALL SELECT doc_id, conf FROM cost) GROUP BY doc_id)
SELECT g.doc_id, round(greatest(0e0, least(1e0, coalesce(base, 0e0) - 0.03e0 * gaps - CASE WHEN g.doc_id % 29 = 0 THEN 0.06e0 ELSE 0e0 END - CASE WHEN g.doc_id % 23 = 0 THEN 0.03e0 ELSE 0e0 END + least(0.06e0, 0.02e0 * coalesce(strong, 0)))), 4) AS confidence
FROM (SELECT doc_id, count(*) FILTER (n_lines = 0) AS gaps FROM lay GROUP BY doc_id) g LEFT JOIN sure f ON g.doc_id = f.doc_id""",
    "hp_misread": f"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(text, '(?i)(^|[^A-Za-z0-9_])yo{_MARK.replace('*', '+', 1)}', '\\140\\2', 'g'), '(?i)(^|[^A-Za-z0-9_])([0-9])\\s*[?+]+\\s*([0-9]){_MARK}', '\\1\\2\\3\\4', 'g'), '(?i)(^|[^A-Za-z0-9_])([0-9])\\s+([0-9]){_MARK}', '\\1\\2\\3\\4', 'g') AS text FROM ({_PLAIN}) t",
    "dealer_normalize": "SELECT s_suppkey, s_name AS dealer FROM supplier",
    "indic_digits": "SELECT p_partkey, translate(cast(p_partkey AS VARCHAR), '0123456789', '०१२३४५६७८९') AS written, cast(p_partkey AS VARCHAR) AS digits FROM part",
    "decimal_amounts": "SELECT p_partkey, cast(floor(round(p_retailprice * 100) / 100) AS BIGINT) AS amount, cast(2 AS BIGINT) AS n FROM part",
    "model_lines": """SELECT doc_id, text, penalty, no_token, amount FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY penalty, no_token, amount, p_partkey) AS rn FROM (SELECT p_size AS doc_id, p_partkey, text,
  CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 0 END AS penalty, CASE WHEN regexp_matches(text, '\\b[0-9]{2,5}\\b') THEN 0 ELSE 1 END AS no_token, CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END AS amount
  FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN concat('Cost of new tractor Rs ', p_size) WHEN 1 THEN concat('Tractor ', p_brand, ' trailer') WHEN 2 THEN concat('Tractor HP ', p_size) ELSE concat('tractor ', p_type) END AS text FROM part) t) s) r WHERE rn = 1""",
    "language_arguments": "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'hin+eng' ELSE 'hin' END || CASE WHEN n_nationkey % 3 = 0 THEN '+guj' ELSE '' END WHEN 1 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'guj' ELSE '' END ELSE CASE WHEN n_nationkey % 2 = 0 THEN 'hin+eng' ELSE 'hin' END END AS codes FROM nation",
    "detections_top": f"SELECT doc_id, label, conf, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY conf DESC, x1, y1) AS rn FROM ({_DUCK_BOXES}) b) WHERE rn = 1",
    "keyword_lines": "SELECT doc_id, count(*) FILTER (regexp_matches(lower(line), '" + "|".join(regions.TABLE_WORDS) + "')) AS worded, count(*) FILTER (length(line) >= 6 AND length(regexp_replace(line, '[^\\p{Nd}]+', '', 'g')) >= 0.25 * length(line)) AS dense, count(line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l GROUP BY doc_id",
}
