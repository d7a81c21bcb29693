"""Quality rules: a threshold table compiled into one projection of text ratios.

Everything is a built-in expression: no user function, no shuffle. Nulls and empty texts count as texts without words
(all counts 0, ``base_failed``); a null id is carried; repeated rows are judged each on its own; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.shared import SPACE_CHARS, fresh, words_of

#: Frequent function words of the corpus languages, as they stand in texts.
STOP_WORDS = (
    "the be to of and that have with in is for on a it as at by was are from or this "
    "le la les de des et un une du en que dans est pour qui par pas sur au avec "
    "der die das und zu den von mit ist ein eine nicht im auf es sich für "
    "el los las del y se por con no una su al lo como más"
).split()

#: (metric, smallest, largest); None leaves a side open. A text is kept if all hold.
THRESHOLDS = [
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.25),
    ("upper_ratio", None, 0.5),
    ("stop_words", 2, None),
    ("dup_line_ratio", None, 0.45),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
]

WINDOW = 8


def _ratio(a: str, b: str) -> str:
    return f"if({b} = 0, 0D, {a} / cast({b} as double))"


#: Metrics of the table, as SQL over the counts below.
METRICS = {
    "mean_word_chars": _ratio("word_chars", "n_words"),
    "symbol_ratio": _ratio("n_symbols", "n_words"),
    "upper_ratio": _ratio("n_upper", "word_chars"),
    "stop_words": "n_stop_words",
    "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
    "bullet_line_ratio": _ratio("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": _ratio("n_ellipsis_lines", "n_lines"),
}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines"]


def verdict_sql(thresholds=THRESHOLDS, metrics=METRICS) -> str:
    """The threshold table as one boolean SQL expression."""
    terms = []
    for name, low, high in thresholds:
        terms += [f"({metrics[name]}) >= {low}"] * (low is not None) + [f"({metrics[name]}) <= {high}"] * (high is not None)
    return " and ".join(terms) or "true"


def judged(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned too): the counts, ``base_failed`` and ``kept``."""
    t, w, lines, h, s, out = (fresh(docs, f"_q{x}") for x in ("t", "w", "lines", "h", "s", "q"))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bare = F.translate(t, SPACE_CHARS, "")
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, words_of(t)).withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != ""))
    # Hashes of all windows; sorted with their places only where one occurs twice.
    df = df.withColumn(h, F.expr(f"if(size({w}) > {WINDOW}, transform(sequence(1, size({w}) - {WINDOW - 1}), i -> xxhash64(slice({w}, i, {WINDOW}))), array())"))
    placed = f"zip_with({h}, sequence(0, size({h}) - 1), (x, i) -> named_struct('h', x, 'i', i))"
    df = df.withColumn(s, F.expr(f"if(size(array_distinct({h})) < size({h}), sort_array({placed}), array())"))
    # `same`: start places of windows that another window equals; a place counts once however many cover it.
    same = f"sort_array(transform(filter({s}, (x, k) -> (k > 0 and {s}[k - 1].h = x.h) or (k < size({s}) - 1 and {s}[k + 1].h = x.h)), x -> x.i))"
    repeat = f"aggregate({same}, named_struct('p', cast(-{WINDOW} as int), 'c', 0L), (a, d) -> named_struct('p', d, 'c', a.c + least({WINDOW}, d - a.p)), a -> a.c)"
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(bare),
        "n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.expr(repeat),
        "n_upper": F.length(t) - F.length(F.translate(t, letters, "")),
        "n_stop_words": F.size(F.array_intersect(F.col(w), F.array(*[F.lit(x) for v in STOP_WORDS for x in (v, v.capitalize())]))),
        "n_lines": F.size(lines),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    }
    df = df.withColumn(out, F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))
    own = {c: f"{out}.{c}" for c in COUNTS}
    sql = verdict_sql(thresholds, {k: _qualified(v, own) for k, v in METRICS.items()})
    failed = f"({own['n_words']} < 20 or 100 * {own['n_repeat_words']} > 30 * {own['n_words']})"
    df = df.withColumn(out, F.struct(*[F.col(own[c]).alias(c) for c in COUNTS], F.expr(failed).alias("base_failed"), F.expr(f"not {failed} and {sql}").alias("kept")))
    return df.drop(t, w, lines, h, s), out


def _qualified(sql: str, names: dict[str, str]) -> str:
    import re

    return re.sub(r"\b[a-z_]+\b", lambda m: names.get(m[0], m[0]), sql)


def kept(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    df, q = judged(docs, text, thresholds)
    # A column that isn't deterministic keeps the filter above the projection; pushed below, it would compute all ratios anew for each use.
    row = fresh(df, "_row")
    return df.withColumn(row, F.monotonically_increasing_id()).where(F.col(f"{q}.kept") & (F.col(row) >= 0)).select(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df, q = judged(docs)
    return df.select("doc_id", f"{q}.*")


_STOPS = ", ".join(f"'{x}'" for v in STOP_WORDS for x in (v, v.capitalize()))
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: translate(x, {_WS}, '') <> '') AS lines FROM d),
win AS (SELECT r, i, hash(w[i:i + 7]) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(8, i - p)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8) AS p FROM dup) GROUP BY r),
c AS (SELECT w.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(translate(t, {_WS}, '')) AS BIGINT) AS word_chars,
  cast(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, cast(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  cast(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper,
  cast(len(list_intersect(list_distinct(w), [{_STOPS}])) AS BIGINT) AS n_stop_words, cast(len(lines) AS BIGINT) AS n_lines,
  cast(len(list_filter(lines, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•'))) AS BIGINT) AS n_bullet_lines,
  cast(len(list_filter(lines, lambda x: rtrim(x, ' ').ends_with('...') OR rtrim(x, ' ').ends_with('…'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND {verdict_sql(metrics={k: v.replace("if(", "if(").replace("0D", "0e0") for k, v in METRICS.items()})} AS kept FROM f
"""
