"""Exact top-k by inner product over vector-approximation files.

Vectors become integers, floor(scale * x). Equal vectors are one row of the files, with the smallest ids that have it.
Three files lie side by side: the exact vectors, their cells (one byte a dimension; borders split each dimension's
range), and their ids. Queries lie in files of blocks of bounded size. Tasks read these files by place:

1. Each block scans all cells; its k-th largest lower bound in any part of the files is a threshold that the k-th score
   reaches.
2. A second scan of the cells lists, for each query, the vectors whose upper bound reaches the threshold. No exact vector
   has been read so far.
3. In rounds of growing size, each query's candidates are taken in order of falling upper bound; only their exact vectors
   are read (by place), until the k-th exact score is above every upper bound that is left.

All blocks go through each step in one job, as (block, part of the files) units; the driver holds only the borders.

Scores tie to the smaller id. Null vectors, vectors with null, NaN or infinite components (after scaling, as doubles) and
rows without an id take no part; there is no other limit on components: where doubles can't hold a sum exactly, Python's
integers do. A score beyond a long is null in ``score``; ``exact_score`` holds every score as a string. Shorter vectors
are as if filled with zeros; empty vectors score 0. A query is compared with all rows of other ids, copies included; a
repeated id that is a query gets ranks for each of its rows. Empty tables give an empty result; columns besides the two
named ones are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.llm.shared import filesystem, shared_dir, stored

SCALE = 1024
QUERY_BLOCK = 1024
CELLS = 256
#: Vectors in a file, and bytes of vectors that a task holds while it looks for copies.
FILE_ROWS, HELD_BYTES = 1 << 16, 32 << 20
#: Files that a unit scans against a block.
UNIT_FILES = 8
#: Rows whose bounds are held at once.
STEP = 2048
#: Vectors that lie at most so many rows apart are read at once.
GAP = 16


def scaled(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """id, x (array of doubles that are integers) of the vectors that take part."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double") * F.lit(float(scale)))
    fine = F.forall(F.col("x"), lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    return vectors.select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of whole numbers, shorter ones filled with zeros."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < size[:, None]] = np.floor(flat) + 0.0  # no minus zero
    return out


def ranges(exact: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest component of each dimension, zero included; one row a task and dimension is shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = np.zeros(0)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), max(len(low), int(np.diff(batch.column(0).offsets.to_numpy()).max(initial=0))))
                pad = np.zeros(x.shape[1] - len(low))
                low = np.minimum(np.append(low, pad), x.min(0, initial=0))
                high = np.maximum(np.append(high, pad), x.max(0, initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    rows = exact.select("x").mapInArrow(task, "d long, low double, high double").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()  # a row a dimension
    return np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])


def borders_of(low: np.ndarray, high: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """(dims, cells + 1): borders that grow and include both ends."""
    t = np.linspace(0, 1, cells + 1)
    out = np.maximum.accumulate(low[:, None] * (1 - t) + high[:, None] * t, axis=1)
    out[:, -1] = np.maximum(out[:, -1], high)
    return out


def _codes(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    code = np.empty(x.shape, dtype=np.uint8)
    for d in range(x.shape[1]):
        code[:, d] = np.clip(np.searchsorted(borders[d], x[:, d], side="right") - 1, 0, borders.shape[1] - 2)
    return code


def _fewest(ids: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k + 1 smallest of the ids, each with its sum of counts (k suffices)."""
    own, at = np.unique(ids, return_inverse=True)
    n = np.zeros(len(own), dtype=np.int64)
    np.add.at(n, at, counts)
    return own[: k + 1], np.minimum(n[: k + 1], k)


def written(exact: DataFrame, borders: np.ndarray, k: int, folder: str) -> DataFrame:
    """Write the files of (id, x); returns (file, rows). Equal vectors meet after their copies in each task became one."""
    dims = len(borders)
    shown = exact.sparkSession.sparkContext.broadcast(borders)
    kind = "key binary, x binary, ids array<long>, counts array<long>"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(key, x, *_fewest(np.array(own), np.ones(len(own), np.int64), k)) for key, (x, own) in held.items()]
            for at in range(0, len(rows), STEP):
                cols = list(zip(*rows[at : at + STEP], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["key", "x", "ids", "counts"])

        size = 0
        for batch in batches:
            rows = matrix(batch.column(1), dims)
            for i, x in zip(batch.column(0).to_pylist(), rows, strict=True):
                raw = x.tobytes()
                hit = held.get(key := hashlib.blake2b(raw, digest_size=16).digest())
                if hit is None:
                    held[key] = (raw, [i])
                    size += len(raw) + 200
                else:
                    hit[1].append(i)
                    size += 40
            if size > HELD_BYTES:
                yield from out()
                held, size = {}, 0
        yield from out()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        done, streams, name, n = [], None, "", 0

        def put(x: bytes, ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal streams, name, n
            if streams is None:
                name, n = uuid.uuid4().hex, 0
                streams = [fs.open_output_stream(f"{top}/{name}.{c}", compression=None) for c in "xci"]
            ids, counts = _fewest(ids, counts, k)
            member = np.zeros(2 * (k + 1), dtype="<i8")
            member[: len(ids)], member[k + 1 : k + 1 + len(ids)] = ids, counts
            streams[0].write(x)
            streams[1].write(_codes(np.frombuffer(x).reshape(1, -1), shown.value).tobytes() if dims else b"")
            streams[2].write(member.tobytes())
            n += 1
            if n == FILE_ROWS:
                closed()

        def closed() -> None:
            nonlocal streams
            if streams is not None:
                for s in streams:
                    s.close()
                done.append((name, n))
                streams = None

        last: tuple | None = None
        for batch in batches:
            for key, x, ids, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, counts = np.array(ids), np.array(counts)
                if last is not None and last[0] == key:  # what was merged stays small
                    last = (key, x, *_fewest(np.append(last[2], ids), np.append(last[3], counts), k))
                    continue
                if last is not None:
                    put(*last[1:])
                last = (key, x, ids, counts)
        if last is not None:
            put(*last[1:])
        closed()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([r for _, r in done], pa.int64())], names=["file", "rows"])

    copies = exact.select("id", "x").mapInArrow(merged, kind)
    return stored(copies.repartition("key").sortWithinPartitions("key").mapInArrow(store, "file string, rows long"), "vector-files")


def asked(exact: DataFrame, every: int, dims: int, block: int, folder: str) -> DataFrame:
    """Write the queries (ids divisible by ``every``) as files of at most ``block`` rows, ids first; returns (block, rows)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{top}/{name}.q", compression=None) as s:
                s.write(np.array(ids, dtype="<i8").tobytes() + np.array(rows).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], names=["block", "rows"])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), matrix(batch.column(1), dims), strict=True):
                ids.append(i)
                rows.append(x.copy())
                if len(ids) == block:
                    yield out()
                    ids, rows = [], []
        if ids:
            yield out()

    queries = exact.select("id", "x").where(F.col("id") % every == 0)
    n = -(-queries.count() // block)
    # Whole blocks: dealt out evenly, a task a block.
    return stored(queries.repartition(max(1, n)).mapInArrow(task, "block string, rows long"), "query-blocks")


def _bounds(q: np.ndarray, borders: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries (rows) and cells (columns)."""
    d = np.arange(codes.shape[1])
    low, high = borders[d, codes], borders[d, codes.astype(np.int64) + 1]
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        slack = 1e-9 * (np.abs(q).sum(1, keepdims=True) * max(1.0, float(np.abs(borders).max(initial=0)))) + 1e-6  # rounding of the sums
        below, above = plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack
    return np.where(np.isnan(below), -np.inf, below), np.where(np.isnan(above), np.inf, above)


class _Files:
    """Reads the files of one folder by place, and counts the bytes of exact vectors read."""

    def __init__(self, folder: str, dims: int, k: int):
        self.fs, self.top = filesystem(folder)
        self.dims, self.k = dims, k

    def _read(self, name: str, width: int, start: int, n: int) -> bytes:
        with self.fs.open_input_file(f"{self.top}/{name}") as f:
            return f.read_at(n * width, start * width)

    def queries(self, block: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of a block."""
        with self.fs.open_input_file(f"{self.top}/{block}.q") as f:
            raw = f.read()
        n = len(raw) // (8 * (self.dims + 1))
        return np.frombuffer(raw[: 8 * n], dtype="<i8"), np.frombuffer(raw[8 * n :]).reshape(n, self.dims)

    def cells(self, name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and the ids (n, 2 (k + 1)) of a file."""
        codes = np.frombuffer(self._read(f"{name}.c", self.dims, 0, n), dtype=np.uint8).reshape(n, self.dims)
        return codes, self.members(name, 0, n)

    def members(self, name: str, start: int, n: int) -> np.ndarray:
        width = 2 * (self.k + 1)
        return np.frombuffer(self._read(f"{name}.i", 8 * width, start, n), dtype="<i8").reshape(n, width)

    def exact(self, name: str, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and ids at sorted places; places up to GAP rows apart are read at once."""
        x, m = np.empty((len(places), self.dims)), np.empty((len(places), 2 * (self.k + 1)), dtype=np.int64)
        for run in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) > GAP) + 1):
            first, last = int(places[run[0]]), int(places[run[-1]])
            at = places[run] - first
            x[run] = np.frombuffer(self._read(f"{name}.x", 8 * self.dims, first, last - first + 1)).reshape(last - first + 1, self.dims)[at]
            m[run] = self.members(name, first, last - first + 1)[at]
        return x, m


def _own(members: np.ndarray, k: int, qid: np.ndarray) -> np.ndarray:
    """(queries, vectors): vectors that only rows with the query's own id have."""
    alone = members[:, k + 2] == 0 if k else np.ones(len(members), bool)
    return alone[None, :] & (members[None, :, 0] == qid[:, None])


def thresholds(units: DataFrame, folder: str, borders, dims: int, k: int) -> DataFrame:
    """(block, i, low): a bound that the k-th score of query ``i`` reaches; none where a part has fewer than k vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, dims, k)
        for batch in batches:
            for u in batch.to_pylist():
                qid, q = files.queries(u["block"])
                best = np.full((len(q), k), -np.inf)
                for f in u["files"]:
                    codes, members = files.cells(f["file"], f["rows"])
                    for at in range(0, len(codes), STEP):
                        low, _ = _bounds(q, borders.value, codes[at : at + STEP])
                        low[_own(members[at : at + STEP], k, qid)] = -np.inf
                        best = -np.partition(-np.hstack([best, low]), k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array([u["block"]] * len(q)), pa.array(np.arange(len(q))), pa.array(best.min(1))], names=["block", "i", "low"])

    return units.mapInArrow(task, "block string, i long, low double").groupBy("block", "i").agg(F.max("low").alias("low"))


def candidates(units: DataFrame, folder: str, borders, dims: int, k: int) -> DataFrame:
    """(block, i, file, place, high): the vectors whose upper bound reaches the query's threshold (``lows`` of the unit)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, dims, k)
        for batch in batches:
            for u in batch.to_pylist():
                (qid, q), known = files.queries(u["block"]), np.array(u["lows"])
                for f in u["files"]:
                    codes, members = files.cells(f["file"], f["rows"])
                    for at in range(0, len(codes), STEP):
                        _, high = _bounds(q, borders.value, codes[at : at + STEP])
                        i, j = np.nonzero((high >= known[:, None]) & ~_own(members[at : at + STEP], k, qid))
                        yield pa.RecordBatch.from_arrays([pa.array([u["block"]] * len(i), pa.string()), pa.array(i), pa.array([f["file"]] * len(i), pa.string()), pa.array(j + at), pa.array(high[i, j])], names=["block", "i", "file", "place", "high"])

    return units.mapInArrow(task, "block string, i long, file string, place long, high double")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray | list[int]:
    """Exact inner products of whole rows: by floating point while every sum stays below 2 ** 53."""
    with np.errstate(over="ignore", invalid="ignore"):
        small = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53
    if small:
        return np.einsum("ij,ij->i", a, b).astype(np.int64).tolist()
    return [sum(int(v) * int(w) for v, w in zip(p, r, strict=True)) for p, r in zip(a, b, strict=True)]


def order_key(v: int) -> bytes:
    """Bytes that sort as integers of any size do: eight for a long, else length and magnitude (complements if negative)."""
    if -(2**63) <= v < 2**63:
        return b"\x08" + (v + 2**63).to_bytes(8, "big")
    n = (abs(v).bit_length() + 7) // 8
    if v > 0:
        return b"\x09" + n.to_bytes(4, "big") + v.to_bytes(n, "big")
    return b"\x07" + (0xFFFFFFFF - n).to_bytes(4, "big") + bytes(255 - b for b in (-v).to_bytes(n, "big"))


def scores(pairs: DataFrame, folder: str, dims: int, k: int) -> DataFrame:
    """(block, i, file, place) -> (block, i, query_id, vec_id, copies, key, exact_score): rows of other ids, at most k ids a vector; only the vectors of the pairs are read."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last = _Files(folder, dims, k), ("", None, None)
        names = ["block", "i", "query_id", "vec_id", "copies", "key", "exact_score"]
        for batch in batches:
            block, name = (np.array(batch.column(c).to_pylist(), dtype=object) for c in (0, 2))
            i, place = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            starts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (name[1:] != name[:-1]))) if len(block) else []
            for s, e in zip(starts, np.append(starts, len(block))[1:], strict=False):
                if block[s] != last[0]:
                    last = (block[s], *files.queries(block[s]))
                _, ids, q = last
                for at in range(s, e, STEP):
                    to = min(e, at + STEP)
                    own, where = np.unique(place[at:to], return_inverse=True)
                    x, members = files.exact(name[s], own)
                    score = _dot(q[i[at:to]], x[where])
                    out: list[list] = [[] for _ in names]
                    for n, (v, m) in enumerate(zip(score, members[where], strict=True)):
                        asker = int(ids[i[at + n]])
                        near = [(int(a), int(c)) for a, c in zip(m[: k + 1], m[k + 1 :], strict=True) if c and a != asker][:k]
                        for a, c in near:
                            for col, value in zip(out, (block[s], int(i[at + n]), asker, a, c, order_key(v), str(v)), strict=True):
                                col.append(value)
                    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    # A block's pairs with one file are one task's; a vector that all queries want is read once for each block.
    dealt = pairs.select("block", "i", "file", "place").repartition("block", "file").sortWithinPartitions("block", "file", "place")
    return dealt.mapInArrow(task, "block string, i long, query_id long, vec_id long, copies long, key binary, exact_score string")


def top_k(vectors: DataFrame, k: int, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", block: int = QUERY_BLOCK, first: int | None = None) -> DataFrame:
    """Queries (rows whose id is divisible by ``every``) -> query_id, rank, vec_id, score, exact_score. ``first``: candidates a query in the first round."""
    spark = vectors.sparkSession
    exact = scaled(vectors, vec_id, embedding)
    low, high = ranges(exact)
    borders, dims = borders_of(low, high), len(low)
    folder = shared_dir(spark, "vectors")
    manifest, blocks = written(exact, borders, k, folder), asked(exact, every, dims, block, folder)
    shown = spark.sparkContext.broadcast(borders)  # dims x (cells + 1)
    # Units: every block meets every part of the files.
    n_files, n_blocks = manifest.count(), blocks.count()
    parts = -(-n_files // UNIT_FILES)
    numbered = manifest.withColumn("part", F.pmod(F.xxhash64("file"), F.lit(max(1, parts))).cast("int"))
    files = stored(numbered.groupBy("part").agg(F.collect_list(F.struct("file", "rows")).alias("files")), "vector-parts")
    meet = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(1, parts) - 1)))).join(files, "part")
    tasks = min(max(1, n_blocks * parts), 100_000)
    lows = thresholds(meet.select("block", "files").repartition(tasks, "block", "files"), folder, shown, dims, k)
    lows = lows.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "low"))), lambda r: r["low"]).alias("lows"))  # at most `block` numbers each
    found = candidates(meet.join(stored(lows, "thresholds"), "block").select("block", "files", "lows").repartition(tasks, "block", "files"), folder, shown, dims, k)
    place = F.row_number().over(Window.partitionBy("block", "i").orderBy(F.desc("high"), "file", "place"))
    left = stored(found.withColumn("n", place), "candidates")
    results, seen, upto = None, 0, first or 4 * k
    while True:
        new = stored(scores(left.where((F.col("n") > seen) & (F.col("n") <= upto)), folder, dims, k), "scores")
        results = new if results is None else stored(_best(results.unionByName(new), k).drop("rank"), "scores")
        # The k-th score so far: what can't reach it is not read.
        kth = _best(results, k).groupBy("block", "i").agg(F.max("rank").alias("have"), F.min("key").alias("key"), F.min_by("exact_score", "key").alias("kth"))
        kth = kth.where(F.col("have") >= k).select("block", "i", F.col("kth").cast("double").alias("kth"))
        more = left.where(F.col("n") > upto).join(kth, ["block", "i"], "left")
        left = stored(more.where(F.col("kth").isNull() | (F.col("high") >= F.col("kth") * F.when(F.col("kth") > 0, 1 - 1e-12).otherwise(1 + 1e-12))).drop("kth"), "candidates")
        if not left.limit(1).count():
            break
        seen, upto = upto, upto * 8
    out = _best(results, k).select("query_id", "vec_id", F.expr("try_cast(exact_score as bigint)").alias("score"), "exact_score", "rank", "copies", "i", "block")
    # Copies of one id in one vector are rows of their own.
    out = out.withColumn("rank", F.explode(F.sequence(F.col("rank") - F.col("copies") + 1, F.col("rank")))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "exact_score")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The rows that hold a query's first k; ``rank``: the place of a row's last copy."""
    order = Window.partitionBy("block", "i").orderBy(F.desc("key"), "vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
    rank = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return few.withColumn("rank", rank).where(F.col("rank") - F.col("copies") < k)


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, 10)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, try_cast(score AS BIGINT) AS score, cast(cast(score AS HUGEINT) AS VARCHAR) AS exact_score FROM r WHERE rank <= 10
"""
