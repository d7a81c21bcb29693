"""The engine's queries by name. Each is one declarative statement over the corpus; Spark and DuckDB run the same text,
but for the spellings in ``_SPARK``, so that the optimiser of either plans it as it likes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import fields, layout, matching
from foliomill.plans import evaluation, forms, scans
from foliomill.plans.corpus import BASE
from foliomill.plans.sql import TABLES, run_sql

FLAGSHIP = "wf_field_accuracy"

#: Statements over the corpus' tables (truth, lines, found, judged, conf, runs) and the given ones, in common SQL.
STATEMENTS = {
    # Evaluation
    "wf_field_accuracy": "SELECT field, count(ok) AS n, isum(CASE WHEN ok THEN 1 ELSE 0 END) AS n_correct, round(avg(CASE WHEN ok THEN 1.0e0 WHEN NOT ok THEN 0.0e0 END), 6) AS accuracy, round(1 - avg(CASE WHEN ok THEN 1.0e0 WHEN NOT ok THEN 0.0e0 END), 6) AS error_rate FROM judged GROUP BY field",
    "dla_variants": "SELECT count(*) AS docs, isum(all_ok) AS docs_right, round(avg(all_ok * 1.0e0), 6) AS dla, round(sum(CASE WHEN n > 3 THEN all_ok ELSE 0 END) * 1.0e0 / sum(CASE WHEN n > 3 THEN 1 ELSE 0 END), 6) AS dla_labelled FROM (SELECT doc_id, min(CASE WHEN ok = false THEN 0 ELSE 1 END) AS all_ok, count(ok) AS n FROM judged GROUP BY doc_id) d",
    "doc_confidence": "SELECT doc_id, confidence, confidence < 0.75e0 AS review_required FROM conf",
    "failure_cases": "SELECT c.doc_id, c.confidence, isum(CASE WHEN j.ok = false THEN 1 ELSE 0 END) AS n_wrong FROM conf c JOIN judged j ON c.doc_id = j.doc_id GROUP BY c.doc_id, c.confidence HAVING sum(CASE WHEN j.ok = false THEN 1 ELSE 0 END) > 0",
    "error_clusters": "SELECT cluster, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT t.doc_id, CASE WHEN f.cost IS NULL OR f.cost = 0 THEN 'price' WHEN t.dealer IS NOT NULL AND f.dealer IS NULL THEN 'dealer' WHEN t.model IS NOT NULL AND f.model IS NULL THEN 'model' WHEN f.hp IS NULL THEN 'layout' ELSE 'other' END AS cluster FROM truth t JOIN found f ON t.doc_id = f.doc_id) c GROUP BY cluster",
    "whitelist_violations": "SELECT f.doc_id, f.dealer FROM found f LEFT JOIN (SELECT s_name FROM supplier WHERE s_suppkey % 5 <> 0) w ON f.dealer = w.s_name WHERE w.s_name IS NULL AND f.dealer IS NOT NULL",
    "presence_flags": "SELECT doc_id, stamp, signature FROM found",
    "labels_semi": "SELECT t.doc_id, t.dealer FROM truth t WHERE t.doc_id IN (SELECT doc_id FROM judged WHERE ok = false)",
    "regression_gate": "SELECT b.doc_id, CASE WHEN b.dealer IS DISTINCT FROM a.dealer THEN 'dealer' WHEN a.confidence < b.confidence - 0.05e0 THEN 'confidence_drop' ELSE 'new_review' END AS issue FROM conf b JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE dealer END AS dealer, confidence - CASE WHEN doc_id % 10 = 0 THEN 0.2e0 ELSE 0.0e0 END AS confidence FROM conf) a ON b.doc_id = a.doc_id WHERE b.dealer IS DISTINCT FROM a.dealer OR a.confidence < b.confidence - 0.05e0 OR (a.confidence < 0.75e0 AND b.confidence >= 0.75e0)",
    "replay_gain": "SELECT doc_id, base, best, round(best - base, 6) AS gain FROM (SELECT c.doc_id, c.confidence AS base, max(c.confidence + a.k * (c.doc_id % 7) / 100.0e0) AS best FROM conf c CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT -1) a WHERE c.confidence < 0.75e0 GROUP BY c.doc_id, c.confidence) x WHERE best > base",
    # Extraction
    "asset_cost_rank": "SELECT doc_id, value, score FROM (SELECT doc_id, value, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, value DESC, line_no) AS rn FROM (SELECT doc_id, line_no, cast(concat('0', regexp_extract(text, '([0-9]+)$', 1)) AS BIGINT) AS value, CASE WHEN regexp_extract(lower(text), '(total|amount)', 1) <> '' THEN 0.92e0 ELSE 0.65e0 END AS score FROM lines WHERE line_no >= 4 AND regexp_extract(text, '^Ph', 0) = '' AND length(regexp_extract(text, '([0-9]+)$', 1)) BETWEEN 4 AND 9) s) r WHERE rn = 1",
    "model_first_match": "SELECT doc_id, master FROM (SELECT l.doc_id, m.master, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.line_no, m.master) AS rn FROM lines l JOIN (SELECT DISTINCT concat(p_brand, ' ', p_type, ' ', cast(p_size AS VARCHAR(9))) AS master FROM part) m ON position(lower(m.master) IN lower(l.text)) > 0) x WHERE rn = 1",
    "page_first_last": "SELECT conv_id, turn, first_value(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS first_page, max(turn) OVER (PARTITION BY conv_id) AS last_page FROM conversations",
    "table_continuation": "SELECT conv_id, turn, has_table, max(has_table) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near_table FROM (SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END AS has_table FROM conversations) c",
    "region_bands": "SELECT region, count(*) AS n_lines, min(y1) AS y1, max(y1 + 12) AS y2 FROM (SELECT y1, CASE WHEN y1 + 12 <= 151 THEN 'header' WHEN y1 >= 690 THEN 'footer' ELSE 'body' END AS region FROM (SELECT 60 + 8 * line_no AS y1 FROM lines) a) b GROUP BY region",
    "numeric_dense_lines": "SELECT doc_id, line_no, cast(length(text) AS BIGINT) AS n, cast(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS digits FROM lines WHERE length(text) >= 6 AND length(regexp_replace(text, '[^0-9]', '', 'g')) >= 0.25e0 * length(text)",
    "iou_pairs": "SELECT a_id, b_id, round(i * 1.0e0 / (400 + 600 - i), 6) AS iou FROM (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, greatest(0, least(a.p_size + 20, b.p_size + 30) - greatest(a.p_size, b.p_size)) * 20 AS i FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey) x",
    # Run logs
    "latency_p95": "SELECT stage, max(CASE WHEN rn = cast(round_even_idx AS BIGINT) + 1 THEN latency END) AS p95_round, max(CASE WHEN rn = cast(floor(0.95e0 * (n - 1)) AS BIGINT) + 1 THEN latency END) AS p95_floor FROM (SELECT stage, latency, row_number() OVER (PARTITION BY stage ORDER BY latency) AS rn, n, ROUND_EVEN(0.95e0 * (n - 1)) AS round_even_idx FROM (SELECT stage, latency, count(*) OVER (PARTITION BY stage) AS n FROM runs) r) x GROUP BY stage",
    "latency_hist": "SELECT stage, bin, count(*) AS n FROM (SELECT r.stage, cast(floor((r.latency - m.lo) / (m.hi - m.lo) * 19) AS BIGINT) AS bin FROM runs r JOIN (SELECT stage, min(latency) AS lo, max(latency) AS hi FROM runs GROUP BY stage) m ON r.stage = m.stage WHERE m.hi > m.lo) x GROUP BY stage, bin",
    "latency_stats": "SELECT stage, count(*) AS n, round(avg(latency), 6) AS mean, min(latency) AS low, max(latency) AS high, round(median(latency), 6) AS mid FROM runs GROUP BY stage",
    "cost_breakdown": "SELECT doc_id, round(cost_usd, 6) AS total, round(0.0002e0, 6) AS overhead, round(0.0006e0 * pages, 6) AS ocr, cost_usd <= 0.01e0 AS within_budget FROM runs",
    "stage_log_fold": "SELECT user_id, stage, latency FROM (SELECT user_id, stage, latency, row_number() OVER (PARTITION BY user_id, stage ORDER BY ts DESC, doc_id DESC) AS rn FROM runs) x WHERE rn = 1",
    "field_proxy": "SELECT stage, round(avg(CASE WHEN failures = 0 THEN 0.0e0 ELSE 1.0e0 END), 6) AS present_rate, round(avg(CASE WHEN failures > 0 AND conf >= 0.75e0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS sure_rate, round(avg(conf), 6) AS mean_conf FROM runs GROUP BY stage",
    "latency_guard": "SELECT user_id, doc_id, latency, sum(latency) OVER (PARTITION BY user_id ORDER BY ts, doc_id ROWS UNBOUNDED PRECEDING) <= 200 AS within FROM (SELECT user_id, doc_id, ts, cast(floor(latency) AS BIGINT) AS latency FROM runs) r",
    "judge_gate": "SELECT stage, isum(CASE WHEN latency <= 30 AND cost_usd < 0.01e0 THEN 1 ELSE 0 END) AS passed, count(*) AS tested FROM runs GROUP BY stage",
    "ocr_attempt_pick": "SELECT user_id, doc_id, conf, pages FROM (SELECT user_id, doc_id, conf, pages, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN conf >= 0.70e0 AND pages >= 2 THEN 0 ELSE 1 END, CASE WHEN conf >= 0.70e0 AND pages >= 2 THEN doc_id END, conf DESC, pages DESC, doc_id) AS rn FROM runs) x WHERE rn = 1",
    "heatmap": "SELECT gy, gx, count(*) AS n FROM (SELECT least(7, cast(floor(latency / 100 * 8) AS BIGINT)) AS gx, least(7, doc_id % 10) AS gy FROM runs) x GROUP BY gy, gx",
    # Selection
    "leaderboard_topk": "SELECT rank, doc_id, score FROM (SELECT doc_id, score, cast(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM (SELECT doc_id, round(0.7e0 * conf + 0.2e0 * greatest(0, least(1, 1 - latency / 100)) + 0.1e0 * greatest(0, least(1, 1 - cost_usd / 0.01e0)), 6) AS score FROM runs) s) r WHERE rank <= 10",
    "select_config": "SELECT doc_id, CASE WHEN feasible = 0 THEN 'meets_constraints' ELSE 'no_trial_met_constraints' END AS reason FROM (SELECT doc_id, feasible, row_number() OVER (ORDER BY feasible, conf DESC, doc_id) AS rn FROM (SELECT doc_id, conf, CASE WHEN conf >= 0.9e0 AND latency <= 30 AND cost_usd <= 0.01e0 THEN 0 ELSE 1 END AS feasible FROM runs) r) x WHERE rn = 1",
    # Selection over trials and thresholds, joins of results
    "mining_join": "SELECT c.doc_id, c.confidence, w.n_wrong, r.stage, r.latency, CASE WHEN w.n_labelled > 0 THEN w.n_wrong > 0 ELSE w.n_missing >= 2 OR c.confidence < 0.55e0 END AS failed FROM conf c JOIN (SELECT j.doc_id, isum(CASE WHEN ok = false THEN 1 ELSE 0 END) AS n_wrong, count(ok) AS n_labelled, isum(CASE WHEN ok IS NULL THEN 1 ELSE 0 END) AS n_missing FROM judged j GROUP BY j.doc_id) w ON c.doc_id = w.doc_id LEFT JOIN runs r ON c.doc_id = r.doc_id",
    "determinism_check": "SELECT a.doc_id, a.dealer IS NOT DISTINCT FROM b.dealer AND a.model IS NOT DISTINCT FROM b.model AND a.hp IS NOT DISTINCT FROM b.hp AND a.cost IS NOT DISTINCT FROM b.cost AS same_fields, (a.confidence < 0.75e0) = (b.confidence < 0.75e0) AS same_review FROM conf a JOIN (SELECT doc_id, dealer, model, CASE WHEN doc_id % 50 = 0 THEN hp + 1 ELSE hp END AS hp, cost, CASE WHEN doc_id % 40 = 0 THEN 0.1e0 ELSE confidence END AS confidence FROM conf) b ON a.doc_id = b.doc_id",
    "missing_items": "SELECT 'missing' AS kind, r.name FROM (SELECT 'ECONOMY' AS name UNION ALL SELECT 'GILDED' UNION ALL SELECT 'PROMO') r LEFT JOIN (SELECT DISTINCT p_type FROM part) p ON r.name = p.p_type WHERE p.p_type IS NULL UNION ALL SELECT 'extra', p.p_type FROM (SELECT DISTINCT p_type FROM part) p LEFT JOIN (SELECT 'ECONOMY' AS name UNION ALL SELECT 'GILDED' UNION ALL SELECT 'PROMO') r ON r.name = p.p_type WHERE r.name IS NULL",
    "page_union": "SELECT conv_id, count(*) AS pages, isum(has_table) AS tables FROM (SELECT conv_id, turn, 1 AS has_table FROM conversations WHERE length(text) % 5 = 0 UNION ALL SELECT conv_id, turn, 0 FROM conversations WHERE length(text) % 5 <> 0) u GROUP BY conv_id",
    "candidate_lines": "SELECT line, min(why) AS why FROM (SELECT text AS line, 'keyword' AS why FROM lines WHERE regexp_extract(lower(text), '(total|amount|rate)', 1) <> '' UNION ALL SELECT text, 'dense' FROM lines WHERE length(text) >= 6 AND length(regexp_replace(text, '[^0-9]', '', 'g')) >= 0.25e0 * length(text)) u GROUP BY line",
    "candidate_pick": "SELECT user_id, doc_id, score FROM (SELECT user_id, doc_id, score, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN score >= 6000 THEN 0 ELSE 1 END, CASE WHEN score >= 6000 THEN doc_id END, score DESC, doc_id) AS rn FROM (SELECT user_id, doc_id, (3 * (doc_id % 2) + 3 * CASE WHEN failures > 8 THEN 1 ELSE 0 END + pages) * 1000 + failures AS score FROM runs) r) x WHERE rn = 1",
    "tuning_best": "SELECT stage, doc_id, conf FROM (SELECT stage, doc_id, conf, row_number() OVER (PARTITION BY stage ORDER BY conf DESC, failures DESC, doc_id) AS rn FROM (SELECT stage, doc_id, conf, failures FROM runs WHERE latency <= 30) r) x WHERE rn = 1",
    "judge_summary": "SELECT stage, count(*) AS docs_tested, round(avg(CASE WHEN failures > 0 THEN 0.0e0 ELSE 1.0e0 END), 6) AS pass_rate, round(sum(CASE WHEN failures > 0 THEN 0.0e0 ELSE latency END) / count(*), 6) AS latency_tested, round(sum(CASE WHEN failures > 0 THEN 0.0e0 ELSE latency END) / nullif(sum(CASE WHEN failures > 0 THEN 0 ELSE 1 END), 0), 6) AS latency_ok, isum(CASE WHEN conf < 0.75e0 THEN 1 ELSE 0 END) AS review FROM runs GROUP BY stage",
    "strategy_row": "SELECT upscale, CASE WHEN upscale >= 2 THEN 300 WHEN upscale >= 1.5e0 THEN 250 ELSE 200 END AS dpi, header_first, n_langs FROM (SELECT CASE WHEN short_rate >= 0.45e0 THEN 2.0e0 WHEN short_rate >= 0.2e0 THEN 1.5e0 ELSE 1.0e0 END AS upscale, top_rate >= 0.5e0 AS header_first, n_langs FROM (SELECT avg(CASE WHEN n_chars < 500 THEN 1.0e0 ELSE 0.0e0 END) AS short_rate, avg(CASE WHEN position('.' IN text) > 40 THEN 1.0e0 ELSE 0.0e0 END) AS top_rate, count(DISTINCT lang) AS n_langs FROM documents) s) t",
    "word_stats": "SELECT doc_id, isum(n) AS words, count(*) AS n_lines, round(sum(n * CASE WHEN doc_id % 29 = 0 THEN 0.5e0 ELSE 0.9e0 - (line_no % 5) / 100.0e0 END) / sum(n), 6) AS avg_conf, round(sum(CASE WHEN line_no <= 6 THEN n ELSE 0 END) * 1.0e0 / sum(n), 6) AS top_ratio FROM (SELECT doc_id, line_no, length(text) - length(replace(text, ' ', '')) + 1 AS n FROM lines) x GROUP BY doc_id",
    "amount_tiers": "SELECT doc_id, max(CASE WHEN digits BETWEEN 4 AND 9 THEN value END) AS preferred, max(CASE WHEN digits <= 9 THEN value END) AS any_size, count(*) AS n FROM (SELECT doc_id, length(amount) AS digits, cast(concat('0', amount) AS BIGINT) AS value FROM (SELECT doc_id, regexp_extract(text, '([0-9]+)$', 1) AS amount FROM lines WHERE regexp_extract(lower(text), '^(ph|phone|mob|mobile|tel|tin|gst|pan|account|ifsc|bank|pin)[^a-z]', 1) = '') a WHERE amount <> '') t GROUP BY doc_id",
    # Texts
    "keyword_freq": "SELECT word, n FROM (SELECT 'the' AS word, sum((length(t) - length(replace(t, 'the', ''))) / 3) AS n FROM d UNION ALL SELECT 'total', sum((length(t) - length(replace(t, 'total', ''))) / 5) FROM d UNION ALL SELECT 'tion', sum((length(t) - length(replace(t, 'tion', ''))) / 4) FROM d) x",
    "lang_counts": "SELECT lang, count(*) AS n, isum(n_chars) AS chars FROM documents GROUP BY lang",
    "label_agreement": "SELECT d.lang, count(*) AS n, isum(l.quality) AS good, isum(l.toxic) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang",
    "unlabelled_docs": "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL",
    "dataset_profile": "SELECT count(*) AS docs, round(avg(CASE WHEN n_chars < 500 THEN 1.0e0 ELSE 0.0e0 END), 6) AS short_rate, round(median(n_chars), 6) AS mid, CASE WHEN avg(CASE WHEN n_chars < 500 THEN 1.0e0 ELSE 0.0e0 END) >= 0.45e0 THEN 2.0e0 WHEN avg(CASE WHEN n_chars < 500 THEN 1.0e0 ELSE 0.0e0 END) >= 0.2e0 THEN 1.5e0 ELSE 1.0e0 END AS upscale FROM documents",
    "sample_md5": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('7|', cast(doc_id AS VARCHAR(20)))), doc_id) AS rn FROM documents) x WHERE rn <= 50",
}

#: Statements that Spark runs in another form than DuckDB: what is gathered by few keys is counted by value first, so no
#: task gets all rows of a stage, and no document meets each threshold.
COUNTED = {
    "latency_p95": "SELECT stage, min(CASE WHEN upto > ROUND_EVEN(0.95e0 * (n - 1)) THEN latency END) AS p95_round, min(CASE WHEN upto > floor(0.95e0 * (n - 1)) THEN latency END) AS p95_floor FROM (SELECT stage, latency, sum(c) OVER (PARTITION BY stage ORDER BY latency) AS upto, sum(c) OVER (PARTITION BY stage) AS n FROM (SELECT stage, latency, count(*) AS c FROM runs GROUP BY stage, latency) v) x GROUP BY stage",
}

#: Spellings that differ: (pattern, Spark, DuckDB).
_SPARK = [(r"VARCHAR\(\d+\)", "STRING", "VARCHAR"), (r"ROUND_EVEN\(", "bround(", "round_even_("), (r", 'g'\)", ")", ", 'g')")]


def _whole_sums(sql: str) -> str:
    """isum(x): a sum of whole numbers as a BIGINT."""
    while (at := sql.find("isum(")) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}cast(sum({sql[at + 5 : end - 1]}) AS BIGINT){sql[end:]}"
    return sql


def _statement(name: str, spark: bool) -> str:
    own = COUNTED.get(name, STATEMENTS[name]) if spark else STATEMENTS[name]
    base = "WITH d AS (SELECT lower(text) AS t FROM documents) " if " FROM d " in own or own.endswith(" FROM d)") or "FROM d UNION" in own else BASE + " "
    sql = base + _whole_sums(own)
    for pattern, here, there in _SPARK:
        sql = re.sub(pattern, here if spark else there, sql)
    if not spark:
        sql = sql.replace("round_even_(0.95e0 * (n - 1))", "round_even(0.95e0 * (n - 1), 0)")
    return sql


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, _statement(name, True))


#: Words of the corpus' lines with boxes; y wavers, so that neighbouring lines can touch. {split}: the words of a line, numbered from 0.
_WORDS = "SELECT doc_id, line_no * 100 + pos AS word_no, word AS text, 10 + 40 * pos AS x1, cast(60 + 18 * line_no + (doc_id * 31 + pos * 7) % 9 - 4 AS INT) AS y1, 40 + 40 * pos AS x2, cast(72 + 18 * line_no + (doc_id * 31 + pos * 7) % 9 - 4 AS INT) AS y2, CASE WHEN doc_id % 29 = 0 THEN 0.5e0 ELSE 0.9e0 END AS conf FROM {split}"


def lines_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = run_sql(spark, sf_dir, BASE + " " + _WORDS.format(split="(SELECT doc_id, line_no, pos, word FROM lines LATERAL VIEW posexplode(split(text, ' ')) w AS pos, word) x"))
    lines = layout.lines_of(words.withColumn("page_index", F.lit(0)))
    return lines.select("doc_id", "line_no", "text", "x1", "y1", "x2", "y2", F.round("avg_conf", 6).alias("avg_conf"))


_LINES_SQL = (
    BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", words AS ("
    + _WORDS.format(split="(SELECT doc_id, line_no, cast(i AS INT) AS pos, w[i + 1] AS word FROM (SELECT doc_id, line_no, string_split(text, ' ') AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM lines) s) x")
    + """), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, word_no) AS k FROM words),
r(doc_id, k, a, n) AS (SELECT doc_id, k, y1, 0 FROM o WHERE k = 1 UNION ALL
  SELECT o.doc_id, o.k, CASE WHEN abs(o.y1 - r.a) <= 12 THEN r.a ELSE o.y1 END, CASE WHEN abs(o.y1 - r.a) <= 12 THEN r.n ELSE r.n + 1 END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
SELECT o.doc_id, r.n AS line_no, string_agg(trim(text), ' ' ORDER BY x1, y1, word_no) FILTER (trim(text) <> '') AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(conf), 6) AS avg_conf
FROM o JOIN r ON o.doc_id = r.doc_id AND o.k = r.k GROUP BY o.doc_id, r.n HAVING count(*) FILTER (trim(text) <> '') > 0"""
)


def line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the column functions find in each line: label value, horsepower, digits, presence, text without currency marks."""
    x = F.col("text")
    lines = run_sql(spark, sf_dir, BASE + " SELECT doc_id, line_no, text FROM lines")
    return lines.select("doc_id", "line_no", T.label_value(x).alias("label_value"), T.parse_hp(x).alias("hp"), T.digits_only(x).alias("digits"), T.is_stamp(x).alias("stamp"), T.is_signature(x).alias("signature"), T.normalize_spaces(T.strip_currency(x)).alias("bare"), T.language(x).alias("language"))


_LINE_VALUES_SQL = BASE + r""", named AS (SELECT *, try_cast(regexp_extract(regexp_replace(text, '(?i)horse ?power', 'hp', 'g'), '(?i)([0-9]{1,3})\s*(?:h\.?\s*p\.?)', 1) AS INTEGER) AS n FROM lines)
SELECT doc_id, line_no, nullif(trim(regexp_extract(text, '[:-](.*)$', 1)), '') AS label_value, CASE WHEN n BETWEEN 1 AND 300 THEN n END AS hp,
  regexp_replace(text, '[^0-9]+', '', 'g') AS digits, regexp_matches(lower(text), '\b(stamp|seal|rubber\s+stamp|company\s+seal)\b') AND NOT contains(lower(text), 'stamp duty') AS stamp,
  regexp_matches(lower(text), '\bauthori[sz]ed\s+signatory\b') OR regexp_matches(lower(text), '\bsd/\b') OR regexp_matches(lower(text), '\bsigned\b') OR regexp_matches(lower(text), '\bsignature\s+of\s+(the\s+)?(beneficiary|customer|purchaser|receiver)\b') AS signature,
  trim(regexp_replace(regexp_replace(text, '(?i)(₹|rs\.?|inr)', ' ', 'g'), '\s+', ' ', 'g')) AS bare,
  CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM named"""


def amount_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as words, from the parts' keys, read back."""
    ones, tens = list(T.ONES), list(T.TENS)
    word = lambda n: F.when(n < 20, F.element_at(F.array(*[F.lit(w) for w in ones]), n.cast("int"))).otherwise(F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for w in tens]), (F.floor(n / 10) - 1).cast("int")), F.get(F.array(F.lit(None).cast("string"), *[F.lit(w) for w in ones[:9]]), (n % 10).cast("int"))))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 99 + 1).alias("a"), (F.col("p_partkey") % 97 + 1).alias("b"))
    text = F.upper(F.concat(F.lit("RUPEES "), word(F.col("a")), F.lit(" lakh and "), word(F.col("b")), F.lit(" thousand only")))
    return parts.select("p_partkey", T.amount_in_words(text).alias("amount"))


def model_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first model of the parts that a line of the document holds: all lines against all models."""
    lines = run_sql(spark, sf_dir, BASE + " SELECT doc_id, line_no, text FROM lines")
    names = run_sql(spark, sf_dir, "SELECT DISTINCT concat(p_brand, ' ', p_type, ' ', cast(p_size AS VARCHAR(9))) AS name FROM part")
    best = fields.holding(lines, names).groupBy("doc_id").agg(F.min(F.struct("line_no", "name")).alias("b"))
    return best.select("doc_id", F.col("b.name").alias("master"))


def dealer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealers as found against the list of suppliers: the exact or best fuzzy name of each."""
    found = run_sql(spark, sf_dir, BASE + " SELECT DISTINCT dealer AS text FROM found WHERE dealer IS NOT NULL").withColumn("line_id", F.md5("text"))
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("name"))
    exact = found.join(names, F.lower("text") == F.lower("name")).select("line_id", "name", F.lit(100.0).alias("score"))
    open_ = found.join(exact, "line_id", "left_anti")
    best = exact.unionByName(matching.best_fuzzy(open_, names))
    return found.join(best, "line_id", "left").select(F.col("text").alias("dealer"), "name", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(name) for name in STATEMENTS} | T.QUERIES | forms.QUERIES | evaluation.QUERIES | scans.QUERIES | {"lines_from_words": lines_from_words, "line_values": line_values, "amount_words": amount_words, "model_first_match": model_first_match, "dealer_match": dealer_match}
ORACLE_SQL: dict[str, str] = {name: _statement(name, False) for name in STATEMENTS} | T.ORACLE_SQL | forms.ORACLE_SQL | scans.ORACLE_SQL | {name: re.sub(r"VARCHAR\(\d+\)", "VARCHAR", sql) for name, sql in evaluation.ORACLE_SQL.items()} | {"lines_from_words": _LINES_SQL, "line_values": _LINE_VALUES_SQL, "amount_words": "SELECT p_partkey, cast((p_partkey % 99 + 1) * 100000 + (p_partkey % 97 + 1) * 1000 AS BIGINT) AS amount FROM part"}
