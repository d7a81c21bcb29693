"""Helpers that several corpus operators use: shared storage, ranks and lookups that stand hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words in all operators here: space and tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder's URI below the cluster's ``spark.checkpoint.dir``, on the default file system if it names none.

    Where it is unset, a temporary folder serves a local master (tests); any other master raises, as its executors share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir: the executors of {master} need a shared folder")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="foliomill-"))
    if "://" not in base:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(file system, path) of a URI, for any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


#: Has shuffled files removed when a query ends, where else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    What was shuffled to make it is removed from the executors' disks at once.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: Rows of numbers and digests that a file of a stored table holds at least, where there are more than the cluster's tasks.
FILE_ROWS = 1 << 16


def gathered(df: DataFrame, rows: int, per_file: int = FILE_ROWS) -> DataFrame:
    """``df`` of at most ``rows`` narrow rows in as many partitions as they need, to be stored: one a task that can run, or more.

    Small tables that come out of a shuffle would be a file a partition, and on a local file system without native code
    Hadoop starts processes to set each file's rights. No row moves; what the last stage does must be light.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_file)))


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables. Nothing that is still to be run may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give a Python worker's unused memory back to the machine. Workers outlive their tasks, and what allocators keep counts as used."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column | str) -> Column:
    """Array of a text's words; null and blank texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ranked(df: DataFrame, classes: list[str], order: list[str], rank: str, rows: int, per_part: int = 250_000) -> DataFrame:
    """Add the 0-based place of each row in its class, without ever gathering a class in one task.

    Rows of a class are dealt into parts by a hash of the ``order`` columns; parts are counted (with map-side sums),
    the counts' running sums give each part's first place, and only the rows of one part are sorted together.
    The place is a fixed function of the data up to rows that agree in all ``order`` columns.
    ``classes`` must hold no nulls. ``rows``: of the table, for the number of parts.
    """
    part, base = fresh(df, "_part"), fresh(df, "_base")
    parts = max(64, rows // per_part)
    df = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    keys = [*classes, part]
    before = Window.partitionBy(*classes).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(base))
    counts = counts.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    inside = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn(rank, F.row_number().over(inside) - 1).join(counts, keys).withColumn(rank, (F.col(base) + F.col(rank)).cast("long")).drop(base, part)


#: A key that more than one in so many rows has is hot. At most so many keys can be hot, whatever the size of the table.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of ``table`` (unique ``key``; ``count``: how many of the ``total`` rows have it); inner join.

    Keys of more than one in HOT_SHARE rows, at most HOT_SHARE of them by counting, are broadcast; the rows of the others
    are joined by a shuffle in which no key is hot.
    """
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    hit = fresh(rows, "_hot")
    few = table.where(hot).select(key, F.struct(*values).alias(hit))
    marked = rows.join(F.broadcast(few), key, "left")
    done = marked.where(F.col(hit).isNotNull()).select(*rows.columns, *[F.col(f"{hit}.{v}").alias(v) for v in values])
    rest = marked.where(F.col(hit).isNull()).select(*rows.columns).join(table.where(~hot).select(key, *values), key)
    return done.unionByName(rest.select(*done.columns))
