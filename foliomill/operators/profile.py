"""What a set of scanned pages looks like: rates, flags and advice, keywords, languages, hit rates by region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that are counted in texts.
KEYWORDS = ["dealer", "seller", "vendor", "supplier", "invoice", "invoice no", "invoice number", "date", "total", "grand total", "net amount", "amount", "asset cost", "model", "hp", "horse power", "signature", "stamp"]
#: Names of Hindi among languages; order of recognition with and without it.
HINDI = ("hi", "hindi", "devanagari")
HINDI_FIRST, ENGLISH_FIRST = ["devanagari", "en", "gujarati"], ["en", "devanagari", "gujarati"]


def keyword_totals(texts: DataFrame, keywords: list[str] = KEYWORDS, most: int | None = None) -> DataFrame:
    """(text) -> how often each keyword stands in all texts, in any case, not overlapping; most frequent first.

    Blank keywords are left out. Each text is read once; a task hands on one number a keyword.
    """
    words = [k for k in dict.fromkeys(keywords) if k.strip()]
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))

    def times(k: str) -> Column:
        k = k.strip().lower()
        return F.floor((F.length("low") - F.length(F.replace(F.col("low"), F.lit(k), F.lit("")))) / len(k)).cast("long")

    sums = texts.select(low.alias("low")).agg(*[F.coalesce(F.sum(times(k)), F.lit(0).cast("long")).alias(f"k{i}") for i, k in enumerate(words)])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("n")) for i, k in enumerate(words)]))).orderBy(F.desc("n"), "keyword")
    return rows if most is None else rows.limit(most)


def languages(pages: DataFrame) -> DataFrame:
    """(language) -> pages by language, most frequent first."""
    return pages.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")


def profile(pages: DataFrame) -> DataFrame:
    """(width, height, avg_conf, word_count, language, top_ratio) -> one row of rates, flags and advice; no pages give zeros.

    Low resolution: a side under 900 or under a million points; noisy: words of a confidence under 0.6 or fewer than ten;
    top-heavy: 0.55 of the words or more in the top quarter. Pages without words are neither of the last two.
    """
    c, any_words = F.col, F.col("word_count") > 0
    rate = lambda x: F.coalesce(F.avg(F.when(x, 1.0).otherwise(0.0)), F.lit(0.0))
    rates = pages.agg(
        F.count(F.lit(1)).alias("pages"),
        rate((F.least("width", "height") < 900) | (c("width").cast("long") * c("height") < 1_000_000)).alias("low_res"),
        rate(F.lower("language").isin(*HINDI)).alias("hindi"),
        rate(any_words & ((c("avg_conf") < 0.6) | (c("word_count") < 10))).alias("noisy"),
        rate(any_words & (c("top_ratio") >= 0.55)).alias("top_heavy"),
    )
    langs = lambda v: F.array(*[F.lit(x) for x in v])
    return rates.select(
        "pages",
        *[F.round(k, 4).alias(f"{k}_rate") for k in ("low_res", "hindi", "noisy", "top_heavy")],
        (c("top_heavy") >= 0.5).alias("header_first"),
        (c("noisy") >= 0.3).alias("keyword_anchored"),
        (c("hindi") >= 0.05).alias("hindi_detected"),
        F.when(c("low_res") >= 0.45, 2.0).when(c("low_res") >= 0.2, 1.5).otherwise(1.0).alias("upscale_factor"),
        F.when(c("hindi") >= 0.05, langs(HINDI_FIRST)).otherwise(langs(ENGLISH_FIRST)).alias("ocr_langs"),
    )


def region_rates(runs: DataFrame, least: float = 0.75) -> DataFrame:
    """(fields: a map of structs with value, conf, region) -> by region how many fields were read and the share of sure ones that have a value."""
    rows = runs.select(F.explode("fields").alias("field", "m")).where("m is not null")
    sure = F.coalesce(F.col("m.value"), F.lit("")).cast("string") != ""
    sure = sure & (F.coalesce(F.col("m.conf"), F.lit(0.0)) >= least)
    region = F.coalesce(F.nullif(F.col("m.region"), F.lit("")), F.lit("unknown"))
    return rows.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(sure, 1.0).otherwise(0.0)).alias("rate"))


def page_mode(tries: DataFrame, enough: int = 110) -> DataFrame:
    """(page_id, try_no, words, avg_conf) -> the try that each page's text is taken from.

    The first with ``enough`` words; else that of most words plus a quarter of their confidence, the first of equals.
    """
    score = F.when(F.coalesce(F.col("words"), F.lit(0)) > 0, F.col("words") + 0.25 * F.coalesce(F.col("avg_conf"), F.lit(0.0))).otherwise(0.0)
    first = F.min(F.when(F.col("words") >= enough, F.col("try_no")))
    best = F.max(F.struct(score.alias("score"), (-F.col("try_no")).alias("t")))
    return tries.groupBy("page_id").agg(first.alias("first"), best.alias("best")).select("page_id", F.coalesce("first", -F.col("best.t")).alias("try_no"))


def kinds(*reports: DataFrame) -> DataFrame:
    """Frames with ``kind`` -> each kind once, in order."""
    every = reports[0].select("kind")
    for r in reports[1:]:
        every = every.unionByName(r.select("kind"))
    return every.distinct().orderBy("kind")


def strategy(flags: dict, recommendations: dict, forced: dict | None = None) -> dict:
    """How to read a set of pages, from its profile: advice goes before flags, what is forced before both; the scale stays within 1 and 2.5."""
    forced = forced or {}
    pick = lambda advice, flag: bool(forced.get(advice) or next((v for v in (recommendations.get(advice), flags.get(flag)) if v is not None), False))
    scale = recommendations.get("upscale_factor")
    return {
        "header_first": pick("header_first", "top_heavy_text"),
        "keyword_anchored": pick("keyword_anchored", "noisy_layout"),
        "hindi_detected": bool(flags.get("hindi_detected") or False),
        "upscale_factor": min(2.5, max(1.0, float(1.0 if scale is None else scale))),
        "ocr_langs": [str(x) for x in recommendations.get("ocr_langs") or [] if str(x)] or ENGLISH_FIRST,
    }


def page_scale(width: Column, height: Column, dpi: int = 200, most_points: int = 20_000_000, most_side: int = 8000) -> Column:
    """How much a page (in points of 1/72 inch) is scaled down before it is drawn, 0.05 at least; 1 where it fits or has no size."""
    w, h = width * (dpi / 72), height * (dpi / 72)
    side = F.greatest(w, h)
    fitted = F.least(F.lit(1.0), F.sqrt(F.lit(float(most_points)) / (w * h)), F.lit(float(most_side)) / side)
    return F.when((w > 0) & (h > 0) & ((w * h > most_points) | (side > most_side)), F.greatest(F.lit(0.05), fitted)).otherwise(1.0)


def with_defaults(defaults: Column, own: Column) -> Column:
    """A map with the defaults' entries for the keys that it lacks."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)), own)


def pseudo_label(fields: Column) -> Column:
    """A map without entries that are null or empty."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (v != ""))


def lines_function(spark: SparkSession, name: str = "text_lines") -> None:
    """Registers a table function for SQL: a text's lines with their numbers, blank ones left out."""
    from pyspark.sql.functions import udtf

    class TextLines:
        def eval(self, text: str):
            for i, line in enumerate((text or "").split("\n")):
                if line.strip():
                    yield i, line.strip()

    spark.udtf.register(name, udtf(TextLines, returnType="line_no int, line string"))
