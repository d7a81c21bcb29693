"""Sharding along a Hilbert curve: close metadata lies in the same shard, so files can be skipped in several dimensions.

Language, source and size are quantised, each in its order, so that a cell is a range of values and a file's smallest and
largest values tell what it can't hold: names by their place among all documents' names (cells of like numbers of
documents, as far as single names allow), sizes by steps of their logarithm. A cell's place is its index on the Hilbert
curve through the grid, and the sorted documents are cut into runs. The grid is bounded, so cells are counted and only
the counts get running sums; documents get their places in their cells by parts (``shared.ranked``), never in one task.

Law of the cuts: ``rows`` (counts at most one apart). Null texts have 0 bytes, their checksum is 0; null languages and
sources are in the first cell; documents that agree in all columns that are read tie and are interchangeable; texts are
measured whole, however long; an empty table gives an empty result. ``sharded`` doesn't read further columns;
``write_shards`` carries them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.llm.shared import fresh, ranked, stored

BITS = 4


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (n, dims) with ``bits`` bits in each dimension (Skilling's transposition)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    index = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def cell_starts(docs: DataFrame, column: str, cells: int) -> list[tuple[int, str]]:
    """(cell, smallest name) of the cells in which names start: at most ``cells`` rows, in order.

    Names are counted and sorted by ranges; a range's counts get running sums on top of those of the ranges before it.
    """
    counts = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.repartitionByRange("name").withColumn("p", F.spark_partition_id()), "names")
    ranges = counts.groupBy("p").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    ranges = ranges.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), total.alias("total"))  # a row a task
    inside = Window.partitionBy("p").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(F.broadcast(ranges), "p").withColumn("at", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    starts = placed.groupBy(F.expr(f"at * {cells} div total").alias("cell")).agg(F.min("name").alias("name"))
    return [(r["cell"], r["name"]) for r in starts.orderBy("cell").collect()]


def _cell(column: str, starts: list[tuple[int, str]]):
    """The last cell that starts at or before a name (null: 0)."""
    out = F.lit(0)
    for cell, name in starts:
        out = F.when(F.col(column) >= F.lit(name), F.lit(cell)).otherwise(out)
    return out.cast("int")


def sharded(docs: DataFrame, shards: int, bits: int = BITS, whole: bool = False) -> DataFrame:
    """(doc_id, text, lang, source) -> doc_id, size, text_crc32, the cell's curve index, shard and slot in the shard; ``whole``: and the row as a struct."""
    grid = 1 << bits
    df = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("text_crc32"), _cell("lang", cell_starts(docs, "lang", grid)).alias("x0"), _cell("source", cell_starts(docs, "source", grid)).alias("x1"), *[F.struct(*docs.columns).alias("whole")] * whole)
    df = stored(df.withColumn("x2", F.least(F.lit(grid - 1), F.floor(F.log2(F.col("size").cast("double")) * grid / 20)).cast("int")), "shard")
    total = df.count()

    def indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(curve=hilbert(f[["x0", "x1", "x2"]].to_numpy(), bits))

    # At most 2 ** (3 * bits) cells, whatever the table.
    cells = df.groupBy("x0", "x1", "x2").agg(F.count(F.lit(1)).alias("n")).mapInPandas(indexed, "x0 int, x1 int, x2 int, n long, curve long")
    before = Window.partitionBy(F.lit(0)).orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    df = ranked(df, ["x0", "x1", "x2"], ["doc_id", "text_crc32", "size"], "place", total).join(F.broadcast(cells), ["x0", "x1", "x2"])
    place = F.col("first") + F.col("place")
    df = df.withColumn("place", place).withColumn("shard", F.expr(f"cast(place * {shards} div {max(1, total)} as int)"))
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return df.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("place") - start).cast("long").alias("slot"), *["whole"] * whole)


def write_shards(docs: DataFrame, shards: int, path: str, file_rows: int = 1_000_000) -> None:
    """Write ``docs`` as one folder a shard, in files of about ``file_rows`` rows, each sorted along the curve, so that its statistics let scans skip it."""
    placed = stored(sharded(docs, shards, whole=True), "placed")
    at = fresh(docs, "shard")
    files = max(shards, -(-placed.count() // file_rows))  # runs of slots, a task each
    rows = placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").select("whole.*", F.col("shard").alias(at))
    rows.write.partitionBy(at).parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    df = sharded(docs, 8)
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
