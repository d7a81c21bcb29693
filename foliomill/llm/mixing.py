"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the rest.

Each source gets a target number of words. A document is taken whole as often as its source's target goes into the
source's size; what then lacks is drawn without replacement, at a fixed size in words: documents are ranked by their
random odds u / (1 - u) divided by their inclusion odds p / (1 - p), and the first ones are taken until their words come
nearest the rest. p is the share that lacks, tilted towards longer documents (the fourth root of their words).

Random numbers are hashes of seed, id and text, so reruns agree. Null texts and texts without words have size 0 and are
taken 0 times; a null source is a source of its own, the last; rows that agree in id and text tie and are
interchangeable; an empty table gives an empty result. No task gathers a source: ranks come from counted key ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.llm.shared import stored, words_of

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with its target: words for its weight, at most ``most`` times its size, the excess reshared.

    Sources are capped in order of size over weight until the share that is left fits all others. One row a source.
    """
    everything = Window.partitionBy(F.lit(0))
    listed = ", ".join(f"{float(w)!r}D" for w in weights)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("rn", F.row_number().over(order) - 1)
    df = df.withColumn("weight", F.expr(f"element_at(array({listed}), cast(pmod(rn, {len(weights)}) as int) + 1)"))
    df = df.withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rn")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("share", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    df = df.withColumn("open", F.col("share") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("rn"), F.col("share")))).over(everything)["share"]
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("rn")))).over(everything)
    here = F.struct(F.col("cap") / F.col("weight"), F.col("rn"))
    df = df.withColumn("target", F.when(here >= first, level * F.col("weight")).otherwise(F.col("cap").cast("double")))
    return df.select("source", "source_size", "target")


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, buckets: int = 4096, whole: bool = False) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken, and the text's MD5 as text_key; ``whole``: and the row as a struct."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("text_key"))), 1, 12), 16, 10)
    df = docs.select("doc_id", "source", F.size(words_of("text")).cast("long").alias("size"), digest.alias("text_key"), *[F.struct(*docs.columns).alias("whole")] * whole)
    df = stored(df.withColumn("u", (unit.cast("double") + 0.5) / F.lit(float(1 << 48))), "mix")
    root = F.sqrt(F.sqrt(F.col("size").cast("double")))
    tilt = F.floor(root * 1024).cast("long")
    sums = df.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * tilt).alias("tilted"))
    plan = targets(sums.select("source", "source_size"), weights, most)
    plan = plan.alias("a").join(sums.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.tilted")
    # Copies that are certain, words that lack, and their share of the source.
    plan = plan.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    plan = plan.withColumn("p0", F.when(F.col("tilted") > 0, F.col("rest") / F.col("tilted")).otherwise(0.0)).withColumn("r", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
    plan = stored(plan.drop("tilted"), "mix-plan")  # a row a source
    df = df.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    df = df.select("d.doc_id", "d.source", "d.size", "d.text_key", "d.u", *["d.whole"] * whole, *[f"p.{c}" for c in plan.columns if c != "source"])
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("p0") * tilt))
    # The ranking variable, scaled by the source's own odds into (0, 1) so that equal steps hold like numbers of rows.
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    r = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("r")))
    scaled = odds * (r / (1 - r))
    df = df.withColumn("key", scaled / (1 + scaled)).withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.col("key") * buckets)).cast("int"))
    drawn = F.col("size") > 0
    sums = df.where(drawn).groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cut = sums.where((F.col("base") < F.col("rest")) & (F.col("base") + F.col("words") >= F.col("rest")))
    cut = stored(cut.select(F.col("source").alias("cs"), F.col("bucket").alias("cb"), "base"), "mix-cut")  # at most a row a source
    df = df.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left")
    # Whole buckets before the cut are in (all, if nothing is cut, as the rest is then 0 or all); rows of the cut bucket are ranked.
    inside = drawn & (F.col("bucket") == F.col("cb"))
    sure = drawn & (F.col("rest") > 0) & (F.col("cb").isNull() | (F.col("bucket") < F.col("cb")))
    edge = df.where(F.coalesce(inside, F.lit(False)))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "text_key", "size")
    up_to = F.col("base") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A document is in if with it the words come nearer the rest than without.
    edge = edge.withColumn("extra", F.when(up_to - F.col("size") / 2.0 <= F.col("rest"), 1).otherwise(0))
    calm = df.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.when(F.coalesce(sure, F.lit(False)), 1).otherwise(0))
    out = calm.unionByName(edge).withColumn("copies", F.when(drawn, F.col("certain") + F.col("extra")).otherwise(F.lit(0)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_key", *["whole"] * whole)


def mixture(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, with its columns, each as often as it is taken."""
    taken = mixed(docs, weights, most, seed, whole=True).where("copies > 0")
    return taken.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "whole").select("whole.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  md5(coalesce(text, '')) AS tk FROM documents),
e AS (SELECT *, (cast('0x' || substr(md5('20|' || coalesce(cast(doc_id AS VARCHAR), '') || '|' || tk), 1, 12) AS BIGINT)::DOUBLE + 0.5e0) / 281474976710656e0 AS u,
  cast(floor(sqrt(sqrt(size::DOUBLE)) * 1024e0) AS BIGINT) AS tilt FROM d),
s0 AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size, cast(sum(size * tilt) AS BIGINT) AS tilted FROM e GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rn FROM s0),
s2 AS (SELECT *, [5e0, 2e0, 1e0][cast(rn % 3 AS INT) + 1] AS weight, source_size * 3 AS cap, cast(sum(source_size) OVER () AS BIGINT) AS total FROM s1),
fill(k, share, capped) AS (
  SELECT 0, (SELECT any_value(total) / sum(weight) FROM s2), []::VARCHAR[] UNION ALL
  SELECT k + 1, (SELECT (any_value(total) - coalesce(cast(sum(cap) FILTER (WHERE share * weight > cap OR list_contains(capped, coalesce('s' || source, '')) ) AS BIGINT), 0)) / nullif(sum(weight) FILTER (WHERE NOT (share * weight > cap OR list_contains(capped, coalesce('s' || source, '')))), 0) FROM s2),
    (SELECT list(coalesce('s' || source, '')) FROM s2 WHERE share * weight > cap OR list_contains(capped, coalesce('s' || source, '')))
  FROM fill WHERE EXISTS (SELECT 1 FROM s2 WHERE share * weight > cap AND NOT list_contains(capped, coalesce('s' || source, '')))),
lvl AS (SELECT share, coalesce(capped, []) AS capped FROM fill ORDER BY k DESC LIMIT 1),
s3 AS (SELECT s2.*, CASE WHEN list_contains(capped, coalesce('s' || source, '')) THEN cap::DOUBLE ELSE share * weight END AS target FROM s2, lvl),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s3),
s5 AS (SELECT *, target - whole * source_size AS rest FROM s4),
s6 AS (SELECT *, CASE WHEN tilted > 0 THEN rest / tilted ELSE 0e0 END AS p0, least(1e0 - 1e-9, greatest(1e-12, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0e0 END)) AS r FROM s5),
k0 AS (SELECT e.*, s6.* EXCLUDE (source, tilted), least(1e0 - 1e-9, greatest(1e-12, p0 * tilt)) AS p FROM e JOIN s6 ON e.source IS NOT DISTINCT FROM s6.source),
k1 AS (SELECT *, ((u / (1 - u)) / (p / (1 - p))) * (r / (1 - r)) AS sc FROM k0),
k2 AS (SELECT *, sc / (1 + sc) AS key FROM k1),
k3 AS (SELECT *, cast(sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY size = 0, key, doc_id NULLS FIRST, tk, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS up_to FROM k2)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN size * (whole + CASE WHEN rest > 0 AND up_to - size / 2e0 <= rest THEN 1 ELSE 0 END) ELSE 0 END AS taken FROM k3
"""
