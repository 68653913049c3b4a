"""Benchmark decontamination with SimHash windows.

Each benchmark item is compared with windows of its own number of words. A window's 64-bit SimHash is looked up in a
multi-index: fingerprints are cut into four blocks of 16 bits, and each item is listed under all values that differ from
its own block in at most five bits. Two fingerprints within 23 bits agree in some block to that degree, so no item within
the radius is missed. At a similarity of 0.8 windows are 9 bits apart on average; none of 25,826 made ones at 0.80 to 0.83
was over 23 (1.3 % were over 15, 0.02 % over 19). What is found is verified by the similarity of the 5-word shingles, weighted by how often they
occur: the sum of the smaller counts over the sum of the larger ones, 0.8 or more.

Only windows that share a shingle with an item of their length are fingerprinted; any other has similarity 0.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import shingles
from veridoc.sources import scratch
from veridoc.sources.tables import table

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, WITHIN = 4, 5
RADIUS = BLOCKS * (WITHIN + 1) - 1
#: Bytes of benchmark text and items that are sent to the tasks at once; a larger benchmark goes in several blocks. An item
#: has 27,540 entries of 4 bytes in the multi-index, so 1,000 of them take 110 MB.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 1000
_PLAIN = bytes(i if i >= 0x80 or chr(i).isalnum() else 32 for i in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words; every ASCII character but letters and digits parts them."""
    return text.lower().encode().translate(_PLAIN).split() if text else []


def codes(ids: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k word numbers; runs with an unknown word (0) get 0."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        out = out * _STEP + part.astype(np.uint64)
        out ^= out >> np.uint64(29)
        known &= part > 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


class Index:
    """A block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = [(i, t) for i, t in ((i, tokens(t)) for i, t in items) if t]
        self.words = {w: n + 1 for n, w in enumerate(dict.fromkeys(w for _, t in self.items for w in t))}
        self.size = [len(t) for _, t in self.items]
        self.width = [min(SHINGLE, n) for n in self.size]
        hashed = [shingles.hashes(t, k) for (_, t), k in zip(self.items, self.width, strict=True)]
        self.counts = [Counter(h.tolist()) for h in hashed]
        self.prints = np.array([shingles.simhash(h) for h in hashed], np.int64).view(np.uint64)
        self.anchors: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for k in sorted(set(self.width)):
            owners: dict[int, list[int]] = {}
            for n, (_, t) in enumerate(self.items):
                if self.width[n] == k:
                    for c in set(codes(np.array([self.words[w] for w in t]), k).tolist()):
                        owners.setdefault(c, []).append(n)
            self.anchors[k] = np.array(sorted(owners), np.uint64), owners
        bits = 64 // BLOCKS
        near = np.array([sum(1 << b for b in c) for d in range(WITHIN + 1) for c in itertools.combinations(range(bits), d)], np.uint64)
        self.lists = []
        for b in range(BLOCKS):
            own = self.prints >> np.uint64(bits * b) & np.uint64((1 << bits) - 1)
            values = (own[:, None] ^ near[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            start = np.searchsorted(values[order], np.arange((1 << bits) + 1, dtype=np.uint64))
            self.lists.append((start, np.repeat(np.arange(len(own), dtype=np.int32), len(near))[order]))

    def candidates(self, prints: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) within the radius, by the multi-index."""
        found, bits = [], 64 // BLOCKS
        for b, (start, listed) in enumerate(self.lists):
            value = (prints >> np.uint64(bits * b) & np.uint64((1 << bits) - 1)).astype(np.int64)
            count = start[value + 1] - start[value]
            window = np.repeat(np.arange(len(prints)), count)
            item = listed[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[value], count)]
            ok = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            found.append(np.stack([window[ok], item[ok]], axis=1))
        return set(map(tuple, np.concatenate(found).tolist()))

    def matches(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window for each item that the text has."""
        words = tokens(text)
        ids = np.fromiter(map(self.words.get, words, itertools.repeat(0)), np.int64, len(words))
        spots: dict[int, list[int]] = {}
        for k, (known, owners) in self.anchors.items():
            c = codes(ids, k)
            at = np.flatnonzero(c)
            at = at[known[np.minimum(np.searchsorted(known, c[at]), len(known) - 1)] == c[at]] if len(at) else at
            for p in at.tolist():
                for item in owners[int(c[p])]:
                    spots.setdefault(item, []).append(p)
        best: dict[int, tuple[float, int, int]] = {}
        by_shape: dict[tuple[int, int], set[int]] = {}
        for item, places in spots.items():
            size, k = min(self.size[item], len(words)), self.width[item]
            starts = by_shape.setdefault((size, k), set())
            for p in places:
                starts.update(range(max(0, p - size + k), min(p, len(words) - size) + 1))
        for (size, k), starts in by_shape.items():
            order = np.array(sorted(starts))
            for run in np.split(order, np.flatnonzero(np.diff(order) > size) + 1) if len(order) else []:
                for a in range(0, len(run), 8192):
                    self._windows(words, run[a : a + 8192], size, k, best)
        return [(self.items[i][0], s, a, n) for i, (s, a, n) in sorted(best.items())]

    def _windows(self, words: list[bytes], starts: np.ndarray, size: int, k: int, best: dict) -> None:
        low = int(starts[0])
        h = shingles.hashes(words[low : int(starts[-1]) + size], k)
        ones = np.zeros((len(h) + 1, 64), np.int32)
        np.cumsum(np.unpackbits(np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32, out=ones[1:])
        a, n = starts - low, size - k + 1
        prints = np.packbits(2 * (ones[a + n] - ones[a]) > n, axis=1, bitorder="little").view("<u8")[:, 0]
        counted: dict[int, Counter] = {}
        for window, item in sorted(self.candidates(prints)):
            # windows made for an item of another size do not count
            if self.width[item] != k or min(self.size[item], len(words)) != size:
                continue
            s = int(a[window])
            own = counted.setdefault(window, Counter(h[s : s + n].tolist()))
            other = self.counts[item]
            shared = sum((own & other).values())
            similarity = shared / (n + self.size[item] - k + 1 - shared)
            if similarity >= SIMILARITY and similarity > best.get(item, (0,))[0]:
                best[item] = similarity, int(starts[window]), size


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items, each of about BLOCK_BYTES of text and BLOCK_ITEMS items at most."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total, items = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(-(-(total or 0) // BLOCK_BYTES), -(-items // BLOCK_ITEMS))
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toArrow()
        index = Index(sorted(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True), key=str))
        if index.items:
            yield index


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document row and item that it has: ``doc_id``, ``item_id``, ``similarity``, ``start_word``, ``words``.

    The window is the best one, the first of equals. Items of under five words count as one shingle; items and texts
    without words match nothing. Items that repeat are each reported. Repeated documents are reported as often. Null texts
    and empty tables give no row, a very long text is looked through whole, and other columns are ignored. A benchmark of
    several blocks is one pass over the documents for each.
    """
    spark, kinds = docs.sparkSession, "doc_id long, item_id long, similarity double, start_word long, words long"
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for index in blocks(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in sent.value.matches(t)]
                columns = zip(*found, strict=True) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "start_word", "words"])

        found = scratch.keep(rows.mapInArrow(run, kinds), "leaks")
        sent.destroy()  # one block is in memory at a time
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], kinds) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any item of the benchmark, with their columns. Null and empty texts have none and stay,
    repeated rows stay or go together, and an empty benchmark or table changes nothing."""
    for index in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not sent.value.matches(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold an item of the benchmark."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
