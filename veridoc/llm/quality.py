"""A quality score by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of 512 bytes that overlap by 32 and cover all of it. Learned filters, six
bytes wide, run over every chunk; their largest responses describe the chunk. Over all chunks the largest and the mean
of these make up the document's features, and a logistic unit turns them into the probability of good quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.learning import first_of_each, held_out, texts_of
from veridoc.sources.tables import fresh, table

CHUNK, STEP, WIDTH, FILTERS = 512, 480, 6, 16
#: Bound of the training sample: documents of each label. What is learned from are their whole texts.
SAMPLE = 1500
THRESHOLD = 0.7


def chunks_of(text: bytes) -> np.ndarray:
    """Rows of CHUNK bytes, zero after the end; at least one."""
    n = max(1, -(-max(0, len(text) - (CHUNK - STEP)) // STEP))
    buffer = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    buffer[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(buffer, (n, CHUNK), (STEP, 1))


@dataclass
class Model:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # for the largest and the mean responses
    offset: float
    pairs: np.ndarray | None = None

    def responses(self, chunks: np.ndarray, where: bool = False):
        """Largest response of each filter in each chunk, and where it is if asked for. A window that reaches beyond the
        end of the text has none."""
        if self.pairs is None:  # sums of two neighbouring bytes, for half the lookups
            self.pairs = np.stack([(self.filters[w][:, None] + self.filters[w + 1][None, :]).reshape(65536, FILTERS) for w in range(0, WIDTH, 2)])
        best, at = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int32) if where else None
        last = CHUNK - WIDTH + 1
        for a in range(0, len(chunks), 32):
            code = chunks[a : a + 32, :-1].astype(np.uint16) * np.uint16(256) + chunks[a : a + 32, 1:]
            z = self.pairs[0].take(code[:, :last], axis=0)
            for w in range(2, WIDTH, 2):
                z += self.pairs[w // 2].take(code[:, w : w + last], axis=0)
            best[a : a + 32] = z.max(axis=1)
            if where:
                at[a : a + 32] = z.argmax(axis=1)
        best = np.maximum(best + self.bias, 0)
        return (best, at) if where else best

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * FILTERS), np.float32)
        group: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            got, k = self.responses(np.concatenate(group)), 0
            for i, g in zip(owners, group, strict=True):
                part = got[k : k + len(g)]
                k += len(g)
                out[i, :FILTERS] = np.maximum(out[i, :FILTERS], part.max(axis=0))
                out[i, FILTERS:] += part.sum(axis=0)
            group.clear()
            owners.clear()

        counts = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            rows = chunks_of(t)
            counts[i] = len(rows)
            for a in range(0, len(rows), 256):
                group.append(rows[a : a + 256])
                owners.append(i)
                if sum(map(len, group)) >= 256:
                    flush()
        if group:
            flush()
        out[:, FILTERS:] /= counts[:, None]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.features(texts).astype(np.float64) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def constant(p: float) -> Model:
    return Model(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, seed: int = 0) -> Model:
    """Adam on the log loss. Only the windows with a chunk's largest responses get a gradient,
    so a step costs little more than scoring its documents."""
    if len(texts) == 0 or labels.min() == labels.max():
        return constant(float(labels.mean()) if len(texts) else 0.5)
    rng = np.random.default_rng(seed)
    m = constant(0.5)
    m.filters = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
    m.weights = np.concatenate([np.where(np.arange(FILTERS) % 2, 0.5, -0.5)] * 2).astype(np.float64) * 0.5
    m.filters[:, 0] = -100
    cut = [chunks_of(t) for t in texts]
    state = [[np.zeros_like(p, dtype=np.float64), np.zeros_like(p, dtype=np.float64)] for p in (m.filters, m.bias, m.weights, np.zeros(1))]
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            x = np.concatenate([cut[i] for i in some])
            got, at = m.responses(x, where=True)
            grads = [np.zeros_like(m.filters, dtype=np.float64), np.zeros(FILTERS), np.zeros(2 * FILTERS), np.zeros(1)]
            k, f = 0, np.arange(FILTERS)
            rows, cols, pull = [], [], []
            for i in some:
                part = got[k : k + len(cut[i])]
                top = part.argmax(axis=0)
                feats = np.concatenate([part.max(axis=0), part.mean(axis=0)]).astype(np.float64)
                p = 1 / (1 + np.exp(-np.clip(feats @ m.weights + m.offset, -50, 50)))
                d = (p - labels[i]) / len(some)
                grads[2] += d * feats
                grads[3] += d
                g = np.repeat((d * m.weights[FILTERS:] / len(part))[None, :], len(part), axis=0)
                g[top, f] += d * m.weights[:FILTERS]
                g *= part > 0
                rows.append(np.repeat(np.arange(k, k + len(part)), FILTERS))
                cols.append(np.tile(f, len(part)))
                pull.append(g.ravel())
                k += len(part)
            rows, cols, pull = map(np.concatenate, (rows, cols, pull))
            live = pull != 0
            rows, cols, pull = rows[live], cols[live], pull[live]
            place = at[rows, cols]
            for w in range(WIDTH):
                np.add.at(grads[0][w], (x[rows, place + w], cols), pull)
            np.add.at(grads[1], cols, pull)
            step += 1
            for p, (g, (m1, m2)) in zip((m.filters, m.bias, m.weights, None), zip(grads, state, strict=True), strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
                if p is None:
                    m.offset -= float(move[0])
                else:
                    p -= move.astype(p.dtype)
            m.filters[:, 0] = -100
            m.pairs = None
    return m


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the whole texts of at most SAMPLE labelled documents of each label that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("_vd_label"))
    here = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    got = texts_of(docs, first_of_each(here, "_vd_label", SAMPLE), "_vd_label")
    return fit([t for _, _, t in got], np.array([y for _, y, _ in got]))


def scored(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with a score of every whole text (null as empty) in a new column, and the name of that column."""
    spark, name = docs.sparkSession, fresh(docs, "score")
    model.pairs = None
    sent = spark.sparkContext.broadcast(model)  # 100 KB, whatever the input
    text = fresh(docs, "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            scores = m.scores([t or b"" for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], name])

    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.withColumn(text, F.col("text").cast("binary")).mapInArrow(run, schema), name


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Labels of held-out documents are never read; a text scores alike whatever its row says
    besides. Null and empty texts score as a chunk without any window. Without labels of both kinds the score is constant.
    Repeated rows are scored as often; of labels that differ for one document the larger counts, and of texts that differ the
    least is learned from. A very long text is scored by 256 chunks at a time. Other columns are ignored."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out, score = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns. Null and empty texts, repeated rows and very long
    texts are as in the query; an empty table stays empty, and columns of any name keep their values."""
    out, score = scored(docs, train(docs, labels))
    return out.filter(F.col(score) >= threshold).select(*docs.columns)
