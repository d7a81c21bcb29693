"""Readers of what recognition and runs leave behind."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def words_of_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words of tab-separated recognition output: twelve columns, level 5, a confidence of at least 0, text that isn't blank."""
    cells = F.split("value", "\t")
    df = spark.read.text(path).select(cells.alias("c")).where((F.size("c") >= 12) & (F.col("c")[0] == "5"))
    n = {k: F.col("c")[i].try_cast("int") for k, i in (("page_index", 1), ("x1", 6), ("y1", 7), ("w", 8), ("h", 9))}
    df = df.select(*[v.alias(k) for k, v in n.items()], F.col("c")[10].try_cast("double").alias("conf"), F.trim(F.col("c")[11]).alias("text"))
    return df.where((F.col("conf") >= 0) & (F.col("text") != "")).select("page_index", "text", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), (F.col("conf") / 100).alias("conf"))


def log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def flag_of(x: Column) -> Column:
    """A flag as people write it; null if it is none."""
    low = F.lower(F.trim(x))
    return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth, nested under ``fields`` or flat; presence as a flag or in ``present``."""
    inner = "dealer_name string, model_name string, horse_power int, asset_cost bigint, signature string, stamp string"
    df = spark.read.schema(f"doc_id string, fields struct<{inner.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>, {inner}").option("multiLine", "true").json(path)
    flag = lambda c: flag_of(F.coalesce(F.get_json_object(c, "$.present"), c))
    pick = lambda c: F.coalesce(F.col(f"fields.{c}"), F.col(c))
    return df.select("doc_id", *[pick(c).alias(c) for c in ("dealer_name", "model_name", "horse_power", "asset_cost")], *[flag(pick(c)).alias(c) for c in ("signature", "stamp")])


#: First cells of a list that name its column.
HEADERS = ("dealer_name", "dealer", "name", "model_name", "model")


def master_list(spark: SparkSession, path: str) -> DataFrame:
    """Names, one a line, with their places; comments and blank lines are skipped."""
    df = spark.read.text(path).select(F.trim("value").alias("name"), F.monotonically_increasing_id().alias("place"))
    return df.where((F.col("name") != "") & ~F.col("name").startswith("#"))


def master_csv(spark: SparkSession, path: str) -> DataFrame:
    """First cells of a CSV file with their places; blank ones and column names are skipped."""
    df = spark.read.schema("name string").option("mode", "PERMISSIVE").csv(path)
    df = df.select(F.trim("name").alias("name"), F.monotonically_increasing_id().alias("place"))
    return df.where((F.col("name") != "") & ~F.lower("name").isin(*HEADERS))


def first_list(*lists: DataFrame) -> DataFrame:
    """The first of the lists (name, place) that isn't empty."""
    ranked = [df.select("name", "place", F.lit(i).alias("rank")) for i, df in enumerate(lists)]
    every = reduce(DataFrame.unionByName, ranked)
    first = every.agg(F.min("rank").alias("rank"))  # one row
    return every.join(F.broadcast(first), "rank").select("name", "place")


# Files, and what recognisers give. Spark's scan passes over files of no bytes, so none of the listings has them.


def discovered(spark: SparkSession, path: str, ending: str = ".pdf", any_case: bool = True) -> DataFrame:
    """(path, length) of a file, of all files below a folder or that a pattern matches, by their ending, in order; contents aren't read.

    A path that matches nothing is an error; files of no bytes are left out.
    """
    end = F.lower("path").endswith(ending.lower()) if any_case else F.col("path").endswith(ending)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.where(end).select("path", "length").orderBy("path")


def other_files(spark: SparkSession, path: str, ending: str = ".png") -> DataFrame:
    """(path, length) of files below a folder with another ending, in order."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.where(~F.lower("path").endswith(ending.lower())).select("path", "length").orderBy("path")


#: Endings of images that become pages.
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, is_image) of all files below a folder: which of them can become pages."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", "length", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*IMAGES).alias("is_image"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of all files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.sha2("content", 256).alias("sha256"))


def config(spark: SparkSession, *paths: str) -> dict:
    """The first of the paths that holds a JSON object; missing and broken ones are passed over, without any it is empty."""
    for path in paths:
        try:
            row = spark.read.text(path, wholetext=True).head()
            found = json.loads(row["value"]) if row else None
        except (AnalysisException, ValueError):
            continue
        if isinstance(found, dict):
            return found
    return {}


def digital_words(words: DataFrame, conf: float = 0.95) -> DataFrame:
    """(text, x1, y1, x2, y2, ...) of a page with digital text -> words with four corners and a fixed confidence; blank ones go."""
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    box = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    return words.where(F.trim("text") != "").withColumn("text", F.trim("text")).withColumn("box", box).withColumn("conf", F.lit(conf)).drop("x1", "y1", "x2", "y2")


def recognised(pages: DataFrame) -> DataFrame:
    """(page_id, result: a recogniser's output as JSON) -> words (page_id, word_no, text, box as JSON, conf).

    Lines are [box, [text, conf]] or objects with text, score or conf, bbox or box; a list in a list of one is taken out of
    it. Lines without a text, or with a confidence that is no number, are skipped; a missing confidence is 0.
    """
    cells = lambda x: F.from_json(x, "array<string>")
    items = cells(F.col("result"))
    items = F.when((F.size(items) == 1) & F.get(items, F.lit(0)).startswith("["), cells(F.get(items, F.lit(0)))).otherwise(items)
    lines = pages.select("page_id", F.posexplode(items).alias("word_no", "line")).where("line is not null")
    at = lambda c, i: F.get(c, F.lit(i))
    key = lambda k: F.get_json_object("line", f"$.{k}")
    listed, named = F.col("line").startswith("["), F.col("line").startswith("{")
    pair = F.when(at(cells(F.col("line")), 1).startswith("["), cells(at(cells(F.col("line")), 1)))
    pair = F.when(F.size(pair) >= 2, pair)
    zero = lambda x: F.when(x.try_cast("double") != 0, x)
    score = F.coalesce(F.when(key("score").try_cast("double").isNull(), F.nullif(key("score"), F.lit(""))), zero(key("score")), key("conf"))
    rows = lines.select(
        "page_id",
        "word_no",
        F.when(listed, at(pair, 0)).when(named, key("text")).alias("text"),
        F.when(listed, at(cells(F.col("line")), 0)).when(named, F.coalesce(key("bbox"), key("box"))).alias("box"),
        F.when(listed, at(pair, 1)).when(named, score).alias("raw"),
    ).where("text is not null")
    conf = F.when(F.coalesce(F.col("raw"), F.lit("")) == "", 0.0).otherwise(F.col("raw").try_cast("double"))
    return rows.withColumn("conf", conf).where("conf is not null").drop("raw")


def box_of_points(points: Column) -> Column:
    """Four points -> (x1, y1, x2, y2) as whole numbers, cut towards zero; null for another number of points."""
    along = lambda i: F.transform(points, lambda p: F.get(p, F.lit(i)))
    ends = F.struct(*[f(along(i)).cast("int").alias(n) for n, f, i in (("x1", F.array_min, 0), ("y1", F.array_min, 1), ("x2", F.array_max, 0), ("y2", F.array_max, 1))])
    return F.when(F.size(points) == 4, ends)
