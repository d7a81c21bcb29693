"""Column functions on texts of business documents: normalising, numbers, number words, presence. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that name a field in Hindi, Gujarati and English writing, longest first when applied.
KEYWORDS = {
    "मॉडल": "model",
    "माडल": "model",
    "मोडल": "model",
    "મોડલ": "model",
    "મોડેલ": "model",
    "एचपी": "hp",
    "एच.पी": "hp",
    "એચપી": "hp",
    "એચ.પી": "hp",
    "હોર્સ પાવર": "hp",
    "હૉર્સ પાવર": "hp",
    "horse power": "hp",
    "horsepower": "hp",
    "राशि": "amount",
    "कुल": "total",
    "कुल राशि": "total",
    "कुल रकम": "total",
    "किंमत": "amount",
    "કુલ": "total",
    "રકમ": "amount",
    "કિંમત": "amount",
    "ટોટલ": "total",
}
INDIC_DIGITS, DIGITS = "०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯", "01234567890123456789"
#: Number words of prices.
ONES = dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(1, 20), strict=True))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))


def normalize_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " "))


def normalize_name(x: Column) -> Column:
    """Lower case, marks as spaces (letters of the two Indic blocks stay), spaces collapsed."""
    return normalize_spaces(F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}_\s\x{0900}-\x{097F}\x{0A80}-\x{0AFF}]+", " "))


#: Text that a field name outside ASCII can be in.
BEYOND_ASCII = r"[^\x00-\x7F]"


def is_ascii(x: Column) -> Column:
    """Whether a text has a byte a character; costs no match."""
    return F.octet_length(x) == F.length(x)


def ascii_digit_count(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, "0123456789", ""))


def normalize_keywords(x: Column) -> Column:
    """Field names in one writing, spaces collapsed; of equally long tokens the one listed first goes first.

    Plain text can only hold the names in ASCII, so the others aren't looked for there.
    """
    order, bare = sorted(KEYWORDS, key=len, reverse=True), normalize_spaces(x)
    mend = lambda names: reduce(lambda c, k: F.regexp_replace(c, "(?iu)" + k.replace(".", r"\."), KEYWORDS[k]), names, bare)
    return F.when(x.rlike(BEYOND_ASCII), mend(order)).otherwise(mend([k for k in order if k.isascii()]))


def ascii_digits(x: Column) -> Column:
    return F.translate(x, INDIC_DIGITS, DIGITS)


def digits_only(x: Column) -> Column:
    return F.regexp_replace(ascii_digits(x), "[^0-9]+", "")


def strip_currency(x: Column) -> Column:
    """Without currency marks, which need no word border."""
    return F.regexp_replace(x, r"(?i)(₹|rs\.?|inr)", " ")


def parse_hp(x: Column) -> Column:
    """The first horsepower figure of 1 to 300. Plain text without an h holds none, in any writing."""
    found = F.regexp_extract(normalize_keywords(ascii_digits(x)), r"(?i)([0-9]{1,3})\s*(?:h\.?\s*p\.?|horse\s*power|एच\.?\s*पी\.?|હો\.?\s*પી\.?)", 1)
    n = F.regexp_extract(F.lpad(found, 3, "0"), "^(?:00[1-9]|0[1-9][0-9]|[12][0-9][0-9]|300)$", 0)  # one use of what costs most
    return F.when(x.rlike("[hH]|" + BEYOND_ASCII), n.try_cast("int"))


def repair_hp(n: Column) -> Column:
    """Figures of 10 to 125 stay; larger ones of three digits or more lose each digit once: the most frequent value in range, the larger of equals."""
    s = n.cast("string")
    tries = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))).try_cast("int"))
    good = F.filter(tries, lambda v: v.between(10, 125))
    best = F.array_max(F.transform(good, lambda v: F.struct(F.size(F.filter(good, lambda w: w == v)).alias("n"), v.alias("v"))))["v"]
    return F.when(n.between(10, 125), n).when((n > 125) & (F.length(s) >= 3), best)


def money_tokens(x: Column) -> Column:
    """Numbers with separators in them, as digits."""
    found = F.regexp_extract_all(strip_currency(x), F.lit(r"([0-9][0-9,.\s]{2,}[0-9]|[0-9]+)"), 1)
    return F.transform(found, lambda t: F.regexp_replace(t, "[^0-9]+", ""))


def label_value(x: Column) -> Column:
    """What stands behind the first colon or dash."""
    return F.nullif(F.trim(F.get(F.split(x, "[:-]", 2), F.lit(1))), F.lit(""))


def is_stamp(x: Column) -> Column:
    low = F.lower(x)
    return low.rlike(r"\b(stamp|seal|rubber\s+stamp|company\s+seal)\b") & ~low.contains("stamp duty")


def is_signature(x: Column) -> Column:
    return F.lower(x).rlike(r"\bauthori[sz]ed\s+signatory\b|\bsd/\b|\bsigned\b|\bsignature\s+of\s+(the\s+)?(beneficiary|customer|purchaser|receiver)\b")


def language(x: Column) -> Column:
    """en, hi or gu by letters; mixed if the second has 0.35 of the first; unknown without letters."""
    n = {k: F.length(x) - F.length(F.regexp_replace(x, c, "")) for k, c in (("en", "[A-Za-z]"), ("hi", r"[\x{0900}-\x{097F}]"), ("gu", r"[\x{0A80}-\x{0AFF}]"))}
    order = F.sort_array(F.array(*[F.struct(v.alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(n.items())]), asc=False)
    return F.when(order[0]["n"] == 0, "unknown").when(order[1]["n"] >= 0.35 * order[0]["n"], "mixed").otherwise(order[0]["k"])


def _below_hundred(x: Column) -> Column:
    words = F.split(F.trim(x), r"\s+")
    table = F.create_map(*[F.lit(v) for kv in {**ONES, **TENS}.items() for v in kv])
    values = F.transform(words, lambda w: F.coalesce(F.element_at(table, w), F.lit(0)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def amount_in_words(x: Column) -> Column:
    """X lakh Y thousand, with up to six other words between, as a number."""
    low = F.trim(F.regexp_replace(F.lower(F.regexp_replace(x, "/", "I")), r"[^a-z]+", " "))
    lakh, thousand = F.regexp_extract(low, r"((?:[a-z]+ )?[a-z]+) lakh", 1), F.regexp_extract(low, r"lakh(?: [a-z]+){0,6}? ((?:(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety) )?[a-z]+) thousand", 1)
    n = _below_hundred(lakh).cast("long") * 100_000 + F.when(thousand != "", _below_hundred(thousand).cast("long") * 1000).otherwise(0)
    return F.when(lakh != "", n)


#: How horsepower is written behind its figure; brands, and words that speak against a model line.
HP_MARK = r"(\s*(?:hp|h\.\s*p\.?)(?:[^A-Za-z0-9_]|$))"
BRANDS = r"\b(swaraj|mahindra|massey|ferguson|new\s+holland|sonalika|farmtrac|john\s+deere|kubota|eicher)\b"
NO_MODEL = r"\b(servicing|service|free|materials|guarantee|terms|conditions|subsidy|permit|department|delivery)\b"
ACCESSORY = r"\b(hood|hitch|trailer|trailor|plough|disc\.?\s*plough|tiller|leveller|cage\s*wheel|wheel|toolskit|battery)\b"
#: Languages by their names, as codes of the recogniser.
LANGUAGE_CODES = {"en": "eng", "english": "eng", "devanagari": "hin", "hi": "hin", "hindi": "hin", "gujarati": "guj", "gu": "guj"}
#: Other writings of what detectors find.
LABELS = {"sign": "signature", "seal": "stamp"}


def repair_hp_text(x: Column) -> Column:
    """"yo HP" is 40 HP; a figure's two digits that marks or spaces part come together before HP."""
    x = F.regexp_replace(x, r"(?i)(^|[^A-Za-z0-9_])yo" + HP_MARK.replace(r"\s*", r"\s+", 1), "$1" + "40$2")  # there is no group 14
    x = F.regexp_replace(x, r"(?i)(^|[^A-Za-z0-9_])([0-9])\s*[?+]+\s*([0-9])" + HP_MARK, "$1$2$3$4")
    return F.regexp_replace(x, r"(?i)(^|[^A-Za-z0-9_])([0-9])\s+([0-9])" + HP_MARK, "$1$2$3$4")


def fused_hp_lines(lines: Column) -> Column:
    """Array of lines: one that ends in a lone digit takes the next one if that starts with a digit and HP; each line is used once."""
    ends, starts = r"(?i)\b\d\s*[?+]*\s*$", r"(?i)^\d\s*(?:hp|h\.\s*p\.?)\b"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("used"))

    def step(s: Column, x: Column) -> Column:
        joins = ~s["used"] & F.element_at(s["out"], -1).rlike(ends) & x.rlike(starts)
        joined = F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(F.concat_ws(" ", F.element_at(s["out"], -1), x)))
        return F.when(joins, F.struct(joined.alias("out"), F.lit(True).alias("used"))).otherwise(F.struct(F.array_append(s["out"], x).alias("out"), F.lit(False).alias("used")))

    return F.aggregate(lines, start, step, lambda s: s["out"])


def clean_line(x: Column) -> Column:
    """Without a leading article and trailing separators."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_spaces(x), r"(?i)^the\s+", ""), r"[\s|,:;]+$", ""))


def dealer_line(x: Column) -> Column:
    """Who a dealer deals for, if the line says so; else the line."""
    line = clean_line(x)
    return F.coalesce(*[F.nullif(clean_line(F.regexp_extract(line, p, 1)), F.lit("")) for p in (r"(?i)\bauthori[sz]ed\s+dealer\s+for\s+(.+)$", r"(?i)\bdealer\s+for\s+(.+)$")], line)


def strict_money(x: Column) -> Column:
    """Whole numbers, grouped by commas or plain, that no digit adjoins."""
    return F.regexp_extract_all(x, F.lit(r"(?<!\d)(?:\d{1,3}(?:,\d{2,3})+|\d+)(?!\d)"), 0)


def decimal_money(x: Column) -> Column:
    """Amounts as whole numbers; two decimals are cut off."""
    found = F.regexp_extract_all(x, F.lit(r"(?<!\d)(?:\d[\d,]*\.\d{2}|\d{1,3}(?:,\d{2,3})+|\d+)(?!\d)"), 0)
    return F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, r"\.\d{2}$", ""), "[^0-9]+", "").try_cast("decimal(38,0)"))


def model_rank(x: Column) -> Column:
    """How little a line looks like a model's: (penalty, no model's token, an amount); the least is the best."""
    hit = lambda p, n: F.when(x.rlike("(?i)" + p), n).otherwise(0)
    penalty = hit(r"\bcost\b", 1) + F.when(x.rlike(r"(?i)\bcost\s+of\s+new\b") & x.rlike(r"(?i)\btractor\b"), -2).otherwise(0) + hit(r"\b(?:rs|inr|₹)\b", 2) + hit(r"\bHP\b", 1) + hit(NO_MODEL, 4) + hit(ACCESSORY, 4)
    token = x.rlike("(?i)" + BRANDS) | x.rlike(r"\b[A-Z]{1,4}\d{2,5}[A-Z0-9\-/+]*\b|\b\d{2,5}\b")
    return F.struct(penalty.alias("penalty"), F.when(token, 0).otherwise(1).alias("no_token"), F.when(x.rlike(r"\d"), 1).otherwise(0).alias("amount"))


def language_codes(hints: Column, available: Column) -> Column:
    """Codes of the known and available languages among the hints, once each in their order; eng if there is none."""
    table = F.create_map(*[F.lit(v) for kv in LANGUAGE_CODES.items() for v in kv])
    codes = F.array_distinct(F.array_compact(F.transform(hints, lambda h: F.element_at(table, F.lower(F.trim(h))))))
    codes = F.when(F.size(available) > 0, F.filter(codes, lambda c: F.array_contains(available, c))).otherwise(codes)
    spare = F.when((F.size(available) == 0) | F.array_contains(available, "eng"), "eng").otherwise("")
    return F.when(F.size(codes) > 0, F.array_join(codes, "+")).otherwise(spare)


def detection_label(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv]), low), low)


# Queries over the documents, with their SQL.


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(normalize_spaces(F.col("text"))).alias("spaces"), F.md5(normalize_name(F.col("text"))).alias("name"))


def lang_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(language(F.col("text")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def money_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = money_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(tokens, ",")).alias("digest"))


def hp_digit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = (F.col("p_partkey") % 900).cast("int")
    return parts.select("p_partkey", n.alias("seen"), repair_hp(n).alias("hp"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"text_normalize": text_normalize, "lang_bucket": lang_bucket, "money_tokens": money_of_documents, "hp_digit_repair": hp_digit_repair}
ORACLE_SQL = {
    "text_normalize": r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS spaces, md5(trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s\x{0900}-\x{097F}\x{0A80}-\x{0AFF}]+', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))) AS name FROM documents",
    "lang_bucket": r"SELECT CASE WHEN n = 0 THEN 'unknown' ELSE 'en' END AS bucket, count(*) AS n FROM (SELECT length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n FROM documents) d GROUP BY 1",
    "money_tokens": r"SELECT doc_id, cast(len(t) AS BIGINT) AS n, md5(array_to_string(list_transform(t, lambda x: regexp_replace(x, '[^0-9]+', '', 'g')), ',')) AS digest FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(?i)(₹|rs\.?|inr)', ' ', 'g'), '([0-9][0-9,.\s]{2,}[0-9]|[0-9]+)', 1) AS t FROM documents) d",
    "hp_digit_repair": r"SELECT p_partkey, cast(n AS INTEGER) AS seen, cast(CASE WHEN n BETWEEN 10 AND 125 THEN n WHEN n > 125 THEN (SELECT v FROM (SELECT try_cast(substr(cast(n AS VARCHAR), 1, i - 1) || substr(cast(n AS VARCHAR), i + 1) AS INTEGER) AS v FROM (SELECT unnest([1, 2, 3]) AS i)) t WHERE v BETWEEN 10 AND 125 GROUP BY v ORDER BY count(*) DESC, v DESC LIMIT 1) END AS INTEGER) AS hp FROM (SELECT p_partkey, p_partkey % 900 AS n FROM part) p",
}
