"""Evaluation queries: the operators over the corpus, and their rules written apart as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import evaluation
from foliomill.plans.corpus import BASE
from foliomill.plans.sql import run_sql

_RIGHT = "SELECT c.confidence, d.good FROM conf c JOIN (SELECT doc_id, min(CASE WHEN ok = false THEN 0 ELSE 1 END) = 1 AS good FROM judged GROUP BY doc_id) d ON c.doc_id = d.doc_id"


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_trials(run_sql(spark, sf_dir, f"{BASE} {_RIGHT}"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir)


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_trial(_trials(spark, sf_dir))


def grid_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.grid(spark)


#: What a first reading gives and what a second one would: figures misread ten times too large, prices cut, both missing at times.
_READ = "SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN hp * 10 ELSE hp END AS hp, CASE WHEN doc_id % 5 = 0 THEN hp + 60 ELSE hp END AS hp2, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN cost % 10000 ELSE cost END AS cost, CASE WHEN doc_id % 3 = 0 THEN cost % 20000 ELSE cost END AS cost2 FROM truth"


def range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return run_sql(spark, sf_dir, f"{BASE} {_READ}").select("doc_id", evaluation.plausible(c("hp"), c("hp2"), 10, 125).alias("hp"), evaluation.plausible(c("cost"), c("cost2"), 10000).alias("cost"))


#: Run records: flags, failures and counts by the events' numbers.
_RECORDS = "SELECT event_id, value <= 90 AS latency_ok, event_id % 23 <> 0 AS cost_ok, CASE WHEN event_id % 17 > 13 THEN 1 ELSE 0 END AS failures, CASE WHEN event_id % 19 = 0 THEN NULL ELSE 0.4e0 + (event_id % 61) / 100.0e0 END AS conf, event_id % 9 AS region_lines, event_id % 2 = 1 AS yolo_used, event_id % 3 = 0 AS signature, event_id % 5 = 0 AS stamp, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS missing FROM events"


def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    df = run_sql(spark, sf_dir, _RECORDS)
    kind = evaluation.failure_category(c("latency_ok"), c("cost_ok"), c("failures"), c("conf"), c("region_lines"), c("yolo_used"), c("signature") | c("stamp"), c("missing"))
    return df.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))


_CLEAN = "SELECT doc_id, dealer, model, hp, cost, signature, stamp, confidence FROM conf"
#: Three noisy readings of each document: other case and marks; figures moved; values lost.
_NOISY = """SELECT doc_id, 'rotate' AS kind, concat(upper(dealer), ' !') AS dealer, concat('  ', model, '.') AS model, hp + doc_id % 5 AS hp, cost + 400 * (doc_id % 4) AS cost, signature, stamp, confidence - 0.01e0 * (doc_id % 3) AS confidence FROM conf UNION ALL
SELECT doc_id, 'blur', CASE WHEN doc_id % 2 = 0 THEN dealer END, concat(model, 'x'), CASE WHEN doc_id % 3 = 0 THEN hp END, cost - 999, NOT signature, stamp, confidence - 0.05e0 FROM conf UNION ALL
SELECT doc_id, 'jpeg', dealer, model, hp - 3, CAST(NULL AS BIGINT), signature, CASE WHEN doc_id % 4 = 0 THEN NOT stamp ELSE stamp END, confidence FROM conf"""


def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.robustness(run_sql(spark, sf_dir, f"{BASE} {_CLEAN}"), run_sql(spark, sf_dir, f"{BASE} {_NOISY}"))


#: Labels as they stand on invoices in three writings, and what the keywords make of them.
LABELS = [("मॉडल: 475", "model: 475"), ("કુલ રકમ ૫૦૦", "total amount ૫૦૦"), ("कुल राशि 900", "total 900"), ("કિંમત  -  7", "amount - 7"), ("45 एच.पी", "45 hp"), ("45 હોર્સ પાવર", "45 hp"), ("Horse Power 45", "hp 45"), ("ટોટલ राशि", "total amount"), ("माडल મોડેલ HORSEPOWER", "model model hp"), ("plain line", "plain line")]


def keyword_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*[F.lit(a) for a, _ in LABELS]), (F.col("p_partkey") % len(LABELS)).cast("int"))
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", said.alias("said"))
    return df.select("p_partkey", T.normalize_keywords(F.col("said")).alias("canon"), T.parse_hp(F.col("said")).alias("hp"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (threshold_sweep, best_threshold, grid_trials, range_checks, failure_categories, robustness, keyword_canon)}

_SWEEP = f"""t AS (SELECT k, count(*) FILTER (round(confidence * 10000) < k * 100 AND NOT good) AS tp, count(*) FILTER (round(confidence * 10000) < k * 100 AND good) AS fp,
  count(*) FILTER (round(confidence * 10000) >= k * 100 AND NOT good) AS fn, count(*) FILTER (round(confidence * 10000) >= k * 100 AND good) AS tn FROM ({_RIGHT}) r, range(40, 96) g(k) GROUP BY k),
m AS (SELECT k / 100e0 AS threshold, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0e0 END AS prec, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0e0 END AS recall,
  CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0e0 END AS false_review_rate, CASE WHEN fn + tp > 0 THEN fn::DOUBLE / (fn + tp) ELSE 0e0 END AS missed_bad_rate FROM t),
s AS (SELECT *, CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0e0 END AS f1 FROM m)"""
_NAME = "coalesce(trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', ' ', 'g')), '')"

ORACLE_SQL: dict[str, str] = {
    "threshold_sweep": f"{BASE}, {_SWEEP} SELECT * FROM s",
    "best_threshold": f"{BASE}, {_SWEEP} SELECT * FROM s ORDER BY f1 DESC, recall DESC, false_review_rate, threshold LIMIT 1",
    "grid_trials": """SELECT cast(row_number() OVER (ORDER BY a.i, b.i, c.i, d.i, e.i) - 1 AS BIGINT) AS trial, a.v AS dealer_threshold, b.v AS ocr_variants, c.v AS region_weights, d.v AS yolo_conf, e.v AS yolo_iou
FROM (VALUES (1, 80), (2, 85), (3, 90), (4, 92), (5, 95)) a(i, v), (VALUES (1, 'TTT'), (2, 'FTT'), (3, 'TFT'), (4, 'TTT+FTT'), (5, 'TTT+TFT')) b(i, v), (VALUES (1, 'none'), (2, 'header'), (3, 'table'), (4, 'footer')) c(i, v),
  (VALUES (1, 0.2e0), (2, 0.25e0), (3, 0.3e0)) d(i, v), (VALUES (1, 0.4e0), (2, 0.5e0), (3, 0.6e0)) e(i, v)""",
    "range_checks": f"""{BASE} SELECT doc_id, CASE WHEN hp >= 10 AND hp <= 125 THEN hp WHEN hp2 >= 10 AND hp2 <= 125 THEN hp2 END AS hp, CASE WHEN cost >= 10000 THEN cost WHEN cost2 >= 10000 THEN cost2 END AS cost FROM ({_READ}) r""",
    "failure_categories": f"""SELECT CASE WHEN latency_ok = false THEN 'Validation' WHEN cost_ok = false THEN 'Validation' WHEN failures > 0 THEN 'OCR' WHEN conf IS NULL OR conf < 0.55 THEN 'OCR' WHEN region_lines = 0 THEN 'Layout'
  WHEN yolo_used AND NOT signature AND NOT stamp THEN 'Vision' WHEN missing > 0 THEN 'Extraction' ELSE 'OK' END AS category, count(*) AS n FROM ({_RECORDS}) r GROUP BY 1""",
    "robustness": f"""{BASE}, c AS ({_CLEAN}), v AS ({_NOISY}), x AS (SELECT kind, 1 - (CASE WHEN {_NAME.format('c.dealer')} = {_NAME.format('v.dealer')} THEN 1 ELSE 0 END + CASE WHEN {_NAME.format('c.model')} = {_NAME.format('v.model')} THEN 1 ELSE 0 END
  + CASE WHEN abs(c.hp - v.hp) <= 2 THEN 1 ELSE 0 END + CASE WHEN abs(c.cost - v.cost) <= 1000 THEN 1 ELSE 0 END + CASE WHEN c.signature IS NOT DISTINCT FROM v.signature THEN 1 ELSE 0 END + CASE WHEN c.stamp IS NOT DISTINCT FROM v.stamp THEN 1 ELSE 0 END) / 6e0 AS loss,
  c.confidence - v.confidence AS fall FROM c JOIN v ON c.doc_id = v.doc_id) SELECT kind, round(avg(loss), 6) AS avg_accuracy_drop, round(avg(fall), 6) AS avg_confidence_drop, count(*) AS n FROM x GROUP BY kind""".replace("VARCHAR(9)", "VARCHAR"),
    "keyword_canon": "SELECT p_partkey, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(LABELS)) + " END AS canon, CASE WHEN p_partkey % 10 IN (4, 5) THEN 45 END AS hp FROM part",
}
