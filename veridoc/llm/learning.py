"""What the two text classifiers share: the held-out split and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.joins import light
from veridoc.sources import scratch


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the doc_ids, which no model sees in training; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def first_of_each(rows: DataFrame, label: str, size: int) -> DataFrame:
    """``size`` rows of each label value, those whose doc_id hashes lowest; ``rows`` has ``doc_id`` and the label, each pair once.

    Rows whose hash is beyond what twice the size needs are dropped first, by the label's count, so about 2 ``size`` rows of
    a label are ordered together however frequent it is. The counts, a row for each label, are sent to all tasks, so the
    rows of a label do not meet before they are dropped.
    """
    counts = light(scratch.keep(rows.groupBy(label).agg(F.count("*").alias("_vd_count")), "counts"))
    part = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    few = rows.join(counts, label).filter(part <= (2.0 * size + 50) / F.col("_vd_count")).drop("_vd_count")
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    return few.withColumn("_vd_n", F.row_number().over(order)).filter(F.col("_vd_n") <= size).drop("_vd_n")


def texts_of(docs: DataFrame, sample: DataFrame, label: str) -> list[tuple[int, object, bytes]]:
    """(doc_id, label, whole text) of the sampled documents, in order. A doc_id that repeats gives its least text, which is
    found before anything is collected."""
    chosen = light(scratch.keep(sample.select("doc_id", label), "sample"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(chosen, "doc_id")
    got = rows.groupBy("doc_id", label).agg(F.min("text").alias("text")).toArrow()
    return sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), (t or b"" for t in got.column(2).to_pylist()), strict=True))
