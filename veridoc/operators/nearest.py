"""Nearest vectors by cells: each vector belongs to the nearest of about sqrt(n) centres of its model and length, and a query looks
at the cells nearest to it only, then scores exactly.

How many cells a query looks at is measured, not set: on a bounded sample, the least number that finds ``RECALL`` of the sample's
true neighbours. Where vectors have groups these are few; where they have none (uniform directions), most neighbours lie in other
cells and a query looks at many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.operators import retrieval
from veridoc.sources import scratch

#: Vectors that the centres are chosen and measured on, queries of the measurement, bytes of centres that are sent to all tasks.
SAMPLE, ASKED, CENTRES = 16_384, 200, 32 << 20
RECALL, ROUNDS = 0.97, 8
#: Vectors of a piece, which a task scores with as many queries at a time, and tasks that pieces are dealt to at most.
PIECE, MOST_TASKS = 4096, 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` directions in the middle of their vectors, from a fixed start."""
    c = x[np.random.default_rng(0).choice(len(x), count, replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.bincount(near, minlength=count)[:, None] > 0, _unit(sums), c)
    return c


def probes(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The least number of cells in which ``recall`` of the true ``k`` neighbours of some of ``x`` lie, on the average."""
    asked = np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-near, 1)[:, : min(k, len(x) - 1)]
    order = np.argsort(np.argsort(-(x[asked] @ c.T), 1), 1)  # place of each cell for each query
    at = order[np.arange(len(asked))[:, None], (x @ c.T).argmax(1)[true]]
    found = [(at < p).mean() if at.size else 1.0 for p in range(1, len(c) + 1)]
    return 1 + next((i for i, f in enumerate(found) if f >= recall), len(c) - 1)


def by_cells(vectors: DataFrame, queries: DataFrame, k: int = retrieval.CHANNEL, recall: float = RECALL) -> DataFrame:
    """The ``k`` vectors of its model and length nearest by cosine to each query: query_id, id, score, rank; ties to the smaller id.

    ``vectors`` has id (long), model, v; ``queries`` has the ids of some of them. A query does not find itself. Vectors that are
    null, empty, zero or have null or non-finite components take no part; a null model is a model. The result is approximate:
    about ``recall`` of the neighbours are found.
    """
    spark = vectors.sparkSession
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = F.col("v").cast("array<double>")
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.coalesce("model", F.lit("")).alias("model"), v.alias("v")).filter(fine).withColumn("d", F.size("v"))
    sizes = {(r.model, r.d): r.n for r in rows.groupBy("model", "d").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(256).collect()}
    total = max(1, sum(sizes.values()))
    part = F.xxhash64("id") / F.lit(2.0**64) + 0.5
    some = rows.filter(part < min(1.0, 1.2 * SAMPLE / total)).limit(SAMPLE).toPandas()
    plan: dict[tuple[str, int], tuple[np.ndarray, int]] = {}
    left = CENTRES
    for key, own in some.groupby(["model", "d"]):
        x = _unit(np.stack(own.sort_values("id")["v"].to_numpy()))
        count = int(min(len(x), max(1, round(sizes.get(key, 0) ** 0.5)), left // (8 * key[1])))
        if count > 1:  # the rest, small groups, are one cell each
            c = centres(x, count)
            plan[key] = (c, probes(x, c, k, recall))
            left -= c.nbytes
    sent = spark.sparkContext.broadcast(plan)

    def placed(batches: Iterator[pa.RecordBatch], many: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            frame = b.to_pandas()
            for key, own in frame.groupby(["model", "d"]):
                c, look = sent.value.get(key, (None, 1))
                near = np.zeros((len(own), 1), int) if c is None else _near(_unit(np.stack(own["v"].to_numpy())) @ c.T, look if many else 1)
                out += [(i, key[0], key[1], cells, x) for i, x, cells in zip(own["id"].tolist(), own["v"], near.tolist(), strict=True)]
            if out:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "model", "d", "cells", "v"])

    rows, kind = rows.select("id", "model", "d", "v"), "id long, model string, d int, cells array<int>, v array<double>"
    held = scratch.keep(rows.mapInArrow(lambda b: placed(b, False), kind), "placed").withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
    asked = scratch.keep(rows.join(queries.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi").mapInArrow(lambda b: placed(b, True), kind), "asked")

    # vectors of neighbouring cells form pieces of about PIECE; a large cell is several of them
    running = F.sum("n").over(Window.partitionBy("model", "d").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    sizes = held.groupBy("model", "d", "cell").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(running, F.lit(0)))
    cells = scratch.keep(sizes, "cells")
    piece = F.floor((F.col("start") + F.pmod(F.xxhash64("id"), F.col("n"))) / PIECE).alias("piece")
    packs = max(1, -(-asked.count() // PIECE))
    every = F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack")
    mine = held.join(cells, ["model", "d", "cell"]).select("model", "d", piece, every, "id", "cell", "v")
    touched = asked.select("id", "model", "d", F.explode("cells").alias("cell")).join(cells, ["model", "d", "cell"])
    spread = F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("start") + F.col("n") - 1) / PIECE))
    touched = touched.select("id", "model", "d", F.explode(spread).alias("piece"), "cell").groupBy("id", "model", "d", "piece").agg(F.collect_list("cell").alias("cells"))
    theirs = touched.join(asked.drop("cells"), ["id", "model", "d"]).select("model", "d", "piece", F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int").alias("pack"), "id", "cells", "v")
    key = ["model", "d", "piece", "pack"]
    tasks = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), packs * -(-total // PIECE)), MOST_TASKS)  # by number: few bytes are much work
    met = theirs.repartition(tasks, *key).groupBy(*key).cogroup(mine.repartition(tasks, *key).groupBy(*key))
    scored = met.applyInArrow(lambda q, x: _best_of(q, x, k), "query_id long, id long, score double")
    found = scratch.keep(retrieval.best(scored, k), "nearest")
    sent.destroy()
    return found


def _near(scores: np.ndarray, look: int) -> np.ndarray:
    """The ``look`` cells with the highest score of each row, in no order."""
    if look >= scores.shape[1]:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return scores.argmax(1)[:, None] if look == 1 else np.argpartition(-scores, look - 1, 1)[:, :look]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _best_of(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of a piece's vectors (id, cell, v) for each query (id, cells, v), among those in the query's cells.

    Products choose whose scores can be among the best; these are then added up row by row, so equal vectors have equal scores wherever they stand."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if asked.num_rows and held.num_rows:
        x, ids = _unit(_matrix(held["v"], held.num_rows)), held["id"].to_numpy()
        names, place = np.unique(held["cell"].to_numpy(), return_inverse=True)
        w, queries, cells = _unit(_matrix(asked["v"], asked.num_rows)), asked["id"].to_numpy(), asked["cells"].to_pylist()
        for a in range(0, len(w), 256):
            s = w[a : a + 256] @ x.T
            for n, row in enumerate(s):
                looked = np.isin(names, cells[a + n])
                fit = ids != queries[a + n] if looked.all() else looked[place] & (ids != queries[a + n])
                row[~fit] = -np.inf
                some = np.flatnonzero(fit) if fit.sum() <= k else np.flatnonzero(fit & (row >= np.partition(row, -k)[-k] - 1e-9))
                exact = (x[some] * w[a + n]).sum(1)
                best = some[(order := np.lexsort((ids[some], -exact))[:k])]
                out.append((np.full(len(best), queries[a + n]), ids[best], exact[order]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(dict(zip(["query_id", "id", "score"], map(pa.array, columns), strict=True)))
