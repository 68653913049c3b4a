"""Language identification with a string kernel.

Two texts are as similar as the n-grams of 2, 3 and 4 bytes they share: the blended-spectrum presence kernel, normalised
by the number of n-grams of each. N-grams are counted as present by hash, in a fixed table. A set of landmark texts
gives every text a Nystroem feature vector, and one kernel ridge regression for each language, against all others,
scores it. Scoring is two matrix products for a batch: presence by landmarks, then kernel values by languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.learning import first_of_each, held_out, texts_of
from veridoc.sources.tables import table

#: Bounds: training documents, whose whole texts are learned from, and landmarks for each language.
SAMPLE, LANDMARKS = 300, 40
ORDERS, TABLE_BITS = (2, 3, 4), 20
RIDGE = 1e-3
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
_PLAIN = bytes(i if i >= 0x80 or chr(i).isalpha() else 32 for i in range(256))


def prepared(text: str) -> bytes:
    """Lower-case UTF-8 in which every ASCII character but a letter is a space; runs of spaces are one."""
    return b" " + b" ".join(text.lower().encode().translate(_PLAIN).split()) + b" "


def grams(data: bytes) -> np.ndarray:
    """Places of all n-grams in the table."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(b) >= n:
            code = np.full(len(b) - n + 1, n, np.uint32)
            for k in range(n):
                code = (code * np.uint32(0x01000193)) ^ b[k : len(b) - n + 1 + k]
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append(code >> np.uint32(32 - TABLE_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    languages: list[str]
    places: np.ndarray  # TABLE -> row of the landmarks' table; the last row, of zeros, is for n-grams that no landmark has
    landmarks: np.ndarray  # n-grams x landmarks, columns of norm 1
    weights: np.ndarray  # landmarks x languages

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts and landmarks: one matrix product over the n-grams that the batch has, all of them."""
        held = [np.unique(grams(prepared(t))) for t in texts]
        column, place = np.unique(np.concatenate(held), return_inverse=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        known = self.places[column] < len(self.landmarks) - 1
        at = np.cumsum(known) - 1
        x = np.zeros((len(texts), int(known.sum())), np.float32)
        owner = np.repeat(np.arange(len(texts)), [len(h) for h in held])
        ok = known[place]
        x[owner[ok], at[place[ok]]] = 1
        norm = np.sqrt(np.maximum(1, np.array([len(h) for h in held], np.float32)))
        return (x @ self.landmarks[self.places[column[known]]]) / norm[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        kernel = np.concatenate([self.kernel([t or "" for t in texts[a : a + 64]]) for a in range(0, len(texts), 64)]) if texts else np.zeros((0, self.landmarks.shape[1]))
        f = kernel.astype(np.float64) @ self.weights
        best = f.argmax(axis=1) if f.shape[1] else np.zeros(len(texts), int)
        score = (np.clip(f.max(axis=1), -1, 1) + 1) / 2 if f.shape[1] else np.zeros(len(texts))
        ok = [bool(t) and f.shape[1] > 0 and LETTER.search(t) is not None for t in texts]
        return [self.languages[b] if o else UNDETERMINED for b, o in zip(best, ok, strict=True)], np.where(ok, score, 0.0)


def fit(texts: list[str], languages: list[str]) -> Model:
    """Landmarks are each language's first LANDMARKS texts."""
    names = sorted(set(languages))
    if not texts:
        return Model([], np.zeros(1 << TABLE_BITS, np.int32), np.zeros((1, 0), np.float32), np.zeros((0, 0)))
    marks = [i for n in names for i in [k for k, g in enumerate(languages) if g == n][:LANDMARKS]]
    held = [np.unique(grams(prepared(texts[i]))) for i in marks]
    every = np.unique(np.concatenate(held))
    places = np.full(1 << TABLE_BITS, len(every), np.int32)
    places[every] = np.arange(len(every))
    table = np.zeros((len(every) + 1, len(marks)), np.float32)
    for j, h in enumerate(held):
        table[places[h], j] = 1 / np.sqrt(max(1, len(h)))
    m = Model(names, places, table, np.zeros((len(marks), len(names))))
    k = np.concatenate([m.kernel(texts[a : a + 64]) for a in range(0, len(texts), 64)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k[marks])
    keep = values > 1e-6 * values.max() if values.max() > 0 else values > 0
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem: features are kernel values times this
    phi = k @ root
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    m.weights = root @ np.linalg.solve(phi.T @ phi + RIDGE * len(texts) * np.eye(phi.shape[1]), phi.T @ y)
    return m


def train(docs: DataFrame) -> Model:
    """Fit on the whole texts of at most SAMPLE documents of each language that are not held out and have a letter."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    known = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("lang").alias("lang"))
    got = texts_of(rows, first_of_each(known, "lang", SAMPLE), "lang")
    got.sort(key=lambda r: (r[1], r[0]))
    return fit([t.decode(errors="ignore") for _, _, t in got], [n for _, n, _ in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of each row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the landmarks' n-grams: bounded by the table, LANDMARKS and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            lang, score = m.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; ``und`` with score 0 for texts that are null or have no letter, and for all if
    there is nothing to learn from. Ties go to the language that sorts first. Repeated rows are answered as often; a document
    with several languages counts for the first of them. A very long text is one set of n-grams. Other columns are ignored."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
