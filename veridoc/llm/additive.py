"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of several full-dimensional codebooks. The codebooks are fitted one after
another to what the earlier ones leave over; a beam search then picks each vector's codes. A query's products with all
codewords form a table, and the sum of a candidate's looked-up entries approximates its score, scaled by the stored
norms of the vector and of its approximation. The best candidates of the scan are scored again on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.sources import scratch
from veridoc.sources.tables import table

#: Fitting reads at most so many vectors. Codes: so many bytes a vector.
SAMPLE, BOOKS, WORDS, BEAM, ROUNDS = 16_384, 16, 256, 4, 5
#: Candidates that a query scores exactly of each so many rows of a task, and queries in a block.
RERANK, ROWS, BLOCK = 400, 20_000, 4096


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 0) -> np.ndarray:
    """Residual k-means: books x words x dimensions. With few vectors there are as many words as vectors."""
    rng, left, found = np.random.default_rng(seed), sample.astype(np.float32), []
    words = min(words, len(sample))
    for _ in range(books):
        centre = left[rng.choice(len(left), words, replace=False)].copy()
        for _ in range(ROUNDS):
            near = (left @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
            count = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            sums = np.add.reduceat(left[order], np.minimum(np.concatenate([[0], count.cumsum()[:-1]]), len(left) - 1), axis=0)
            centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centre)
        left = left - centre[(left @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)]
        found.append(centre)
    return np.stack(found)


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes by beam search, and the norm of what they add up to."""
    n, (m, words, dim) = len(vectors), books.shape
    codes, left = np.zeros((n, 1, 0), np.uint8), vectors.astype(np.float32)[:, None, :]
    for b in range(m):
        # the squared distance after adding each word, but for the constant |vector|^2
        cost = (left**2).sum(2)[:, :, None] - 2 * left @ books[b].T + (books[b] ** 2).sum(1)
        width = min(beam, cost.shape[1] * words)
        flat = cost.reshape(n, -1)
        pick = np.argpartition(flat, width - 1, axis=1)[:, :width]
        pick = np.take_along_axis(pick, np.argsort(np.take_along_axis(flat, pick, 1), axis=1, kind="stable"), 1)
        way, word = pick // words, pick % words
        codes = np.concatenate([np.take_along_axis(codes, way[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        left = np.take_along_axis(left, way[:, :, None], 1) - books[b][word]
    best = codes[:, 0]
    return best, np.linalg.norm(sum(books[b][best[:, b]] for b in range(m)), axis=1)


def products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each row summed in the same order wherever it stands."""
    return (vectors.astype(np.float64) * query.astype(np.float64)).sum(axis=-1)


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in single precision, and their norms in double. What is quantised are directions, so neither very
    large nor very small components leave the range of single precision; exact scores use the vectors as they are."""
    most = np.abs(vectors).max(axis=1, initial=0, keepdims=True)
    safe = vectors / np.where(most > 0, most, 1)
    length = np.linalg.norm(safe, axis=1, keepdims=True)
    return (safe / np.where(length > 0, length, 1)).astype(np.float32), (length * most)[:, 0]


@dataclass
class Index:
    books: np.ndarray
    table: DataFrame  # rep, ids, vector, codes, norm, approx


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id``, ``v`` of the vectors that take part: not null, not zero, all components finite, and an id."""
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite & F.exists("v", lambda c: c != 0), F.lit(False)))


def build(rows: DataFrame, keep_ids: int) -> Index | None:
    """Index every row; None without a usable one. ``rows`` has ``vec_id`` and ``v``.

    Equal vectors are one entry with their ``keep_ids`` smallest ids, which is all that a search for fewer can return.
    Each task first drops what it can of a vector that repeats, so a very common one is no large group.
    """

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out():
            flat = [(i, k) for k, ids in held.items() for i in ids]
            held.clear()
            for a in range(0, len(flat), 10_000):
                part = flat[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([k for _, k in part], pa.binary())], ["vec_id", "k"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = held.setdefault((np.array(v, "<f8") + 0.0).tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * keep_ids:
                    ids[:] = sorted(set(ids))[:keep_ids]
            if len(held) > 50_000:
                yield from out()
        yield from out()

    order = F.row_number().over(Window.partitionBy("k").orderBy("vec_id"))
    unique = rows.mapInArrow(fewer, "vec_id long, k binary").distinct().withColumn("n", order).filter(F.col("n") <= keep_ids)
    entries = scratch.keep(unique.groupBy("k").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    picked = entries.orderBy(F.xxhash64("k")).limit(SAMPLE).select("k").toArrow().column(0).to_pylist()
    if not picked:
        return None
    books = fit(units(np.frombuffer(b"".join(sorted(picked)), "<f8").reshape(len(picked), -1))[0])
    sent = entries.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                x, norm = units(np.frombuffer(b"".join(part.column(0).to_pylist()), "<f8").reshape(part.num_rows, -1))
                codes, approx = encode(x, sent.value)
                ids = part.column(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i[0] for i in ids.to_pylist()], pa.int64()), ids, part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float64()), pa.array(approx, pa.float32())],
                    ["rep", "ids", "k", "codes", "norm", "approx"])

    coded = entries.select("k", "ids").mapInArrow(code, "rep long, ids array<long>, k binary, codes binary, norm double, approx float")
    return Index(books, scratch.keep(coded, "codes"))


def search(index: Index, queries: DataFrame, k: int, rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """The ``k`` entries with the largest inner product for each row of ``queries`` (``vec_id``, ``v``), but its own id.

    Queries go in blocks of about ``block`` over all entries, one after another; a block is the only thing that is
    broadcast, and is dropped when its results are written. Of each ROWS entries or so a task keeps the best ``rerank``
    by approximate score for each query, scores them exactly and hands on the best ``k`` + 1 of them; so the exactly
    scored share does not fall as the rows of a task grow. Returns ``query_id``, ``rank``, ``vec_id``, ``score``; ties go to the smaller vec_id.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block))
    dealt = scratch.keep(queries.dropDuplicates(["vec_id"]).withColumn("_vd_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "queries")
    out = None
    for b in range(blocks):
        found = one_block(spark, index, dealt.filter(F.col("_vd_block") == b), k, rerank)
        out = found if out is None else out.union(found)
    return out


def one_block(spark: SparkSession, index: Index, queries: DataFrame, k: int, rerank: int) -> DataFrame:
    rows_a_time = ROWS
    rows = queries.select("vec_id", "v").orderBy("vec_id").toArrow()
    ids = np.array(rows.column(0).to_pylist(), np.int64)
    q = np.array(rows.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
    sent = spark.sparkContext.broadcast((ids, q, index.books))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, books = sent.value
        m = books.shape[0]
        tables = np.einsum("qd,mwd->qmw", units(q)[0], books).astype(np.float32)
        none = np.zeros(0), np.zeros(0, np.int64)
        best, seen = [none for _ in ids], 0
        vectors: dict[int, tuple[bytes, list[int]]] = {}

        def scored() -> Iterator[pa.RecordBatch]:
            for i, (s, r) in enumerate(best):
                exact = products(q[i], np.frombuffer(b"".join(vectors[x][0] for x in r.tolist()), "<f8").reshape(len(r), -1)) if len(r) else np.zeros(0)
                # k + 1 entries hold the k best ids: only the query's own can be missing from them
                top = np.lexsort((r, -exact))[: k + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top), ids[i]), pa.int64()), pa.array(exact[top], pa.float64()), pa.array([vectors[x][1] for x in r[top].tolist()], pa.list_(pa.int64()))],
                    ["query_id", "score", "ids"])

        for b in batches:
            if seen and seen + b.num_rows > rows_a_time:
                yield from scored()
                best, vectors, seen = [none for _ in ids], {}, 0
            seen += b.num_rows
            rep = b.column(0).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(rep), m)
            scale = b.column(4).to_numpy(zero_copy_only=False) / np.maximum(b.column(5).to_numpy(zero_copy_only=False), 1e-30)
            columns = [np.ascontiguousarray(codes[:, j]) for j in range(m)]
            new: set[int] = set()
            for i in range(len(ids)):
                score = tables[i, 0].take(columns[0])
                for j in range(1, m):
                    score += tables[i, j].take(columns[j])
                score = score * scale
                s, r = np.concatenate([best[i][0], score]), np.concatenate([best[i][1], rep])
                if len(s) > rerank:
                    floor = np.partition(s, len(s) - rerank)[len(s) - rerank]
                    at = np.flatnonzero(s >= floor)
                    at = at[np.lexsort((r[at], -s[at]))[:rerank]]
                    s, r = s[at], r[at]
                best[i] = s, r
                new.update(r.tolist())
            places = {int(x): n for n, x in enumerate(rep)}
            keys, members = b.column(2), b.column(1)
            vectors = {x: vectors[x] if x in vectors else (keys[places[x]].as_py(), members[places[x]].as_py()) for x in new}
        yield from scored()

    near = index.table.mapInArrow(scan, "query_id long, score double, ids array<long>")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("ids")[0])
    entries = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    each = entries.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    out = scratch.keep(ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    sent.destroy()
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Index ``rows`` and search them with ``queries`` (both ``vec_id``, ``v``, as :func:`usable` gives them).

    Only vectors of the same length have an inner product, so each length is an index of its own.
    """
    out = rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    for (length,) in sorted(rows.select(F.size("v")).distinct().collect()):
        of = F.size("v") == length
        index = build(rows.filter(of), k + 1)
        if index is not None:
            out = out.union(search(index, queries.filter(of), k))
    return out


def op6_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each row whose vec_id 20 divides. Rows that share a vec_id and a vector count once; a
    vec_id with several vectors may be found by each of them, and searches with one of them. Scores are double precision of
    the vectors as they are; vectors of another length are not compared; other columns are ignored."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)
