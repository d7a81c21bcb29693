"""Best-fit packing by linear grouping.

Documents become token sequences; those longer than a sequence are cut. What is packed is then a histogram: at most as
many lengths as a sequence has tokens, however many documents there are. On it, in the driver:

1. Lengths over a share of a sequence (a half, a third or a quarter: all are tried) are large. Sorted by length they are cut into groups of equal cardinality, and
   each length is rounded up to the longest of its group.
2. The few rounded sizes are packed by configurations (how many of each size fit a sequence): a linear program over
   configurations, solved by column generation with a knapsack as pricing, rounded down; the few left over are packed
   best-fit decreasing.
3. Actual documents take the places of the rounded ones. Lengths are exchanged within a group only, so all fits.
4. Small lengths, and the large ones that come out better so, go best-fit into what is free.

The plan lists runs of equal sequences. A document finds its place by its length and its rank among the documents of
that length; ranks come by parts (``shared.ranked``), so no length is gathered in one task. Null texts are empty texts
(one token, the closing id); documents that agree in id and tokens are interchangeable; no documents, no sequences.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.shared import ranked, release, stored

CAPACITY = 2048
END_ID = 0
GROUPS = 64
#: Lengths up to a sequence over this are small; the scheme is run for each, and the plan with the fewest sequences is used.
SMALL = (2, 4, 3)


# Tokens


def _table(of) -> np.ndarray:
    return np.array([of(c) for c in range(256)], dtype=np.uint8)


class Encoder:
    """Ids of texts, equal to the library's.

    Plain texts (ASCII and Latin-1 letters, no apostrophe, none of the library's special strings) are cut into words by
    classes of bytes, many texts at once; each distinct word, known by a 64-bit hash, is encoded once and remembered.
    Other texts go to the library.
    """

    SPACE, LETTER, DIGIT, MARK = range(4)
    #: Classes of bytes; 0xC3 and what follows it is a letter (but for the two signs among Latin-1's letters).
    CLASS = _table(lambda c: 0 if c in b"\t\n\r " else 2 if 48 <= c <= 57 else 1 if chr(c).isalpha() and c < 128 or c >= 128 else 3)
    LOWER = _table(lambda c: c + 32 if 65 <= c <= 90 else c)
    #: Bytes of texts that aren't plain, whatever stands beside them.
    ODD = _table(lambda c: c < 32 and c not in b"\t\n\r" or c in (39, 127) or c > 0xC3 or 0xC0 <= c < 0xC3).astype(bool)
    BASE = 0x9E3779B97F4A7C15
    #: Words that are remembered; beyond, all are forgotten.
    CACHE = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words that are normalised and cut already: only spaces part them.
        self.direct = Tokenizer.from_file(path)
        self.direct.normalizer = None
        self.direct.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.cache: dict[int, list[int]] = {}
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _encoded(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(words), 1000):
            ids = np.array(self.direct.encode_batch_fast([" ".join(words[at : at + 1000])], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.last[ids]) + 1
            assert len(ends) == len(words[at : at + 1000]), "a word of this vocabulary ends in an id of its own"
            out += [x.tolist() for x in np.split(ids, ends[:-1])]
        return out

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.BASE, -k, 1 << 64))])
        return self.up, self.down

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        place = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        low = self.LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        before, after = np.concatenate([[0], low[:-1]]).astype(np.uint8), np.concatenate([low[1:], [0]]).astype(np.uint8)
        lead, rest = low == 0xC3, (low >= 0x80) & (low < 0xC0)
        odd = self.ODD[low] | (rest & ((before != 0xC3) | (low == 0x97) | (low == 0xB7))) | ((low == 60) & (after == 124))
        hard = np.diff(np.concatenate([[0], np.cumsum(odd)])[place]) > 0
        low = np.where(rest & (before == 0xC3) & (low <= 0x9E), low + 32, low).astype(np.uint8)
        kind = np.where(lead | rest, self.LETTER, self.CLASS[low])
        kind[np.repeat(hard, np.diff(place))] = self.SPACE
        cut = np.zeros(len(low) + 1, dtype=bool)
        cut[place] = True
        cut[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)
        own = np.flatnonzero((kind != self.SPACE) & cut[:-1])
        end = np.flatnonzero((kind != self.SPACE) & cut[1:]) + 1
        up, down = self._powers(len(low) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)])])
        h = (sums[end] - sums[own]) * down[own] ^ ((end - own).astype(np.uint64) << np.uint64(48))
        distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.cache]
        data = low.tobytes()
        words = [data[own[first[i]] : end[first[i]]].decode() for i in new]
        self.cache.update(zip([keys[i] for i in new], self._encoded(words), strict=True))
        lists = [self.cache[k] for k in keys]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(size.sum()))
        start, each = (np.cumsum(size) - size)[at], size[at]
        behind = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        ids = flat[np.repeat(start - behind[:-1], each) + np.arange(behind[-1])] if len(own) else flat
        limits = behind[np.searchsorted(own, place)]
        out = [ids[s:e] for s, e in zip(limits[:-1], limits[1:], strict=True)]
        for i in np.flatnonzero(hard):
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def _runs(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters (a longer text is a range of its own)."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32: each document's ids and a closing id, cut at ``capacity``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for low, high in _runs(texts):
                some = batch.slice(low, high - low)
                take, piece, start, length, crc = [], [], [], [], []
                for i, own in enumerate(encode(texts[low:high])):
                    ids = np.append(own, np.uint32(END_ID)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        take.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        # A worker serves other steps next; what it knows of words is this task's.
        encode.cache.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# The plan. A run is (number of sequences, lengths in each).

Run = tuple[int, tuple[int, ...]]


def best_fit(open_runs: list[Run], items: dict[int, int], capacity: int) -> list[Run]:
    """Put items (length -> number), longest first, each into the sequence with the least room that has enough; new ones if none has."""
    rooms: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for n, own in open_runs:
        if n:
            rooms[capacity - sum(own)].append((n, own))
    used = np.array([bool(x) for x in rooms])
    for length in sorted(items, reverse=True):
        left = items[length]
        while left:
            at = np.flatnonzero(used[length:])
            if len(at):
                room = length + int(at[0])
                n, own = rooms[room].pop()
                used[room] = bool(rooms[room])
            else:
                room, n, own = capacity, left, ()  # as many empty ones as could be needed; those not used are dropped below
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            made = [(full, own + (length,) * each)] if full else []
            if 0 < rest < each:
                made.append((1, own + (length,) * rest))
            else:
                rest = 0
            left -= full * each + rest
            untouched = n - full - (rest > 0)
            if own or room < capacity:
                made.append((untouched, own))
            for m, lengths in made:
                if m:
                    free = capacity - sum(lengths)
                    rooms[free].append((m, lengths))
                    used[free] = True
    return [run for some in rooms for run in some]


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Column generation for the linear program min sum x, sum x * configuration >= demand; solutions rounded down."""
    k = len(sizes)
    columns = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    x = demand / columns.diagonal()
    for _ in range(rounds):
        try:
            prices = np.linalg.solve(columns.T, np.ones(k))
        except np.linalg.LinAlgError:
            break
        value, new = _knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        way = np.linalg.solve(columns, new)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        if not np.isfinite(step):
            break
        x = np.maximum(0, x - step * way)
        x[leave] = step
        columns[:, leave] = new
    return [(columns[:, j].astype(int), int(x[j] + 1e-6)) for j in range(k)]


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    worth = np.flatnonzero(prices > 1e-12)
    own, gain = sizes[worth], prices[worth]
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        fit = own <= c
        if fit.any():
            v = np.where(fit, best[c - np.minimum(own, c)] + gain, -1)
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], pick[c] = v[i], i
    new, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            new[worth[pick[c]]] += 1
            c -= own[pick[c]]
    return float(best[capacity]), new


def grouped(items: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, parts: int = SMALL[0]) -> list[Run]:
    """The linear grouping scheme over a histogram (length -> number)."""
    small = {s: n for s, n in items.items() if s <= capacity // parts}
    large = sorted(((s, n) for s, n in items.items() if s > capacity // parts), reverse=True)
    runs: list[Run] = [(items[capacity], (capacity,))] if items.get(capacity) else []
    large = [(s, n) for s, n in large if s < capacity]
    total = sum(n for _, n in large)
    if not total:
        return best_fit(runs, small, capacity)
    # Groups of equal cardinality, longest first; a length can lie in two groups.
    share = -(-total // groups)
    members: list[list[list[int]]] = [[]]
    room = share
    for s, n in large:
        while n:
            if not room:
                members.append([])
                room = share
            part = min(n, room)
            members[-1].append([s, part])
            n, room = n - part, room - part
    # Groups with the same longest length have the same rounded size.
    merged: list[list[list[int]]] = []
    for g in members:
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    sizes = np.array([g[0][0] for g in merged])
    demand = np.array([sum(n for _, n in g) for g in merged], dtype=float)
    plans = [(own, n) for own, n in _configurations(sizes, demand, capacity) if n]
    have = demand.astype(int)
    for own, n in plans:
        # Actual documents, longest first in each group, into the places of the configuration; runs split where a length ends.
        while n and own.any():
            own = np.minimum(own, have)
            fits = min([n, *(have[g] // c for g, c in enumerate(own) if c)]) if own.any() else 0
            if not fits:
                break
            slots: list[tuple[int, int]] = []
            lengths, part = [], fits
            for g, c in enumerate(own):
                for _ in range(c):
                    slots.append((g, c))
            # Each place of a group takes its own stretch of documents: as many sequences as all stretches reach.
            for g, c in {g: c for g, c in slots}.items():
                s, m = merged[g][0]
                if m >= c:
                    part = min(part, m // c)
                else:
                    part = 1
            for g, c in {g: c for g, c in slots}.items():
                need = c * part
                while need:
                    s, m = merged[g][0]
                    use = min(m, need)
                    lengths += [s] * (use // part if m >= need or part == 1 else 0)
                    merged[g][0][1] -= use
                    if not merged[g][0][1]:
                        merged[g].pop(0)
                    need -= use
                have[g] -= c * part
            runs.append((part, tuple(lengths)))
            n -= part
    rest = dict(small)
    for g in merged:
        for s, n in g:
            rest[s] = rest.get(s, 0) + n
    return best_fit(runs, rest, capacity)


def planned(items: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs that hold each item of the histogram once; the best of the scheme's runs with each limit for small lengths."""
    least = -(-sum(s * n for s, n in items.items()) // capacity)
    best: list[Run] = []
    for parts in SMALL:
        runs = grouped(items, capacity, parts=parts)
        if not best or sum(n for n, _ in runs) < sum(n for n, _ in best):
            best = runs
        if sum(n for n, _ in best) <= least:
            break
    return best


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset."""
    items = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    total = sum(items.values())
    first: dict[int, int] = {}
    table: dict[int, list[tuple[int, int, int]]] = {}  # length -> (first rank, first sequence, offset) of each place
    sequence = 0
    for n, own in planned(items, capacity):
        offset = 0
        for length in own:
            rank = first.get(length, 0)
            table.setdefault(length, []).append((rank, sequence, offset))
            first[length] = rank + n
            offset += length
        sequence += n
    assert first == items, "the plan holds each piece once"
    places = found.sparkSession.sparkContext.broadcast({k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in table.items()})  # a place a run and length
    columns = found.columns
    rank = "place"
    df = ranked(found, ["length"], ["doc_id", "piece", "ids_crc32"], rank, total)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            length, place = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.schema.get_field_index(rank)).to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                ranks, sequences, offsets = places.value[int(s)]
                i = np.searchsorted(ranks, place[at], side="right") - 1
                seq[at], offset[at] = sequences[i] + place[at] - ranks[i], offsets[i]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in columns], pa.array(seq), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in found.schema)
    return df.select(*columns, rank).mapInArrow(task, f"{schema}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(stored(pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))
