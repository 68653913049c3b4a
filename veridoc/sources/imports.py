"""Import as a service: files that arrive in a folder become documents, each run of a batch exactly once.

Below a root stand versioned tables (:mod:`veridoc.streaming.versions`): ``documents`` by id, ``files`` with what became of each
file, ``batches`` with a row for each batch, and ``raw`` with the bytes of what was imported. A micro-batch that runs again after
a failure writes its own folders again and looks only at what the batches before it have left, so it comes to the same end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veridoc.functions import text
from veridoc.operators import ingest
from veridoc.sources import files
from veridoc.streaming import versions

DOCUMENT = "id string, space_id string, batch_id string, name string, kind string, content_text string, content_hash string, excerpt string, file_size long, status string"
FILE = ["file_ord", "batch_id", "space_id", "name", "kind", "content_hash", "file_size", "outcome", "error"]


def run_batch(rows: DataFrame, root: str, number: int) -> None:
    """Takes in files (file_ord, original_name, content, space_id, batch_id) as batch ``number``: those that are new or were
    deleted become documents, the others are duplicates or failures. PDF files count as failures here, since nothing reads
    their pages; their text comes as pages (:func:`veridoc.operators.ingest.pages_text`).

    What becomes of a file is decided without its bytes; only those of new documents are shuffled, once."""
    spark = rows.sparkSession
    before = versions.latest(spark, f"{root}/documents", "id", upto=number - 1, empty=DOCUMENT, columns=["space_id", "content_hash", "status"])
    ready = ingest.decoded(rows).withColumn("error", F.coalesce("error", F.when(F.col("kind") == "pdf", "pages are not read")))
    decided = ready.select(*[c for c in FILE if c != "outcome"]).persist()
    got = ingest.classified(decided, before).persist()  # looked at once for each table
    new = got.filter(F.col("outcome").isin("imported", "restored")).join(rows.select("file_ord", "content"), "file_ord").persist()
    try:
        clean = ingest.clean_text(F.col("content"))
        docs = new.withColumns({"id": text.uuid3("document", F.col("space_id"), F.col("content_hash")), "status": F.lit("active"), "content_text": clean, "excerpt": text.excerpt(clean)})
        versions.write(docs.select(*[c.split()[0] for c in DOCUMENT.split(", ")]), f"{root}/documents", number, "id")
        raw = docs.withColumn("file", files.raw_path(F.col("space_id"), F.col("name"), F.col("content_hash")))
        raw.select("id", "file", "content").write.mode("overwrite").parquet(f"{root}/raw/rows-{number:012d}")
        new.unpersist()
        versions.write(got.select(*FILE), f"{root}/files", number, "file_ord", every=0)
        versions.write(ingest.batch_statistics(got), f"{root}/batches", number, "batch_id", every=0)
    finally:
        for kept in (new, got, decided):
            kept.unpersist()


def delete(spark: SparkSession, root: str, ids: DataFrame, number: int) -> None:
    """Marks documents (id) deleted, as a batch of its own; a file with the same bytes restores one later."""
    docs = versions.latest(spark, f"{root}/documents", "id", upto=number - 1, empty=DOCUMENT).join(ids.select("id").distinct(), "id", "left_semi")
    versions.write(docs.withColumn("status", F.lit("deleted")), f"{root}/documents", number, "id")


def stream(spark: SparkSession, path: str, space_id: str, root: str, checkpoint: str, at_most: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """A streaming query that imports the files below ``path``, also those that come later, at most ``at_most`` of them in a
    batch. Each micro-batch is a batch of files, in the order of their paths."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_most).load(path)

    def run(batch: DataFrame, number: int) -> None:
        run_batch(batch.select(F.col("path").alias("file_ord"), F.col("path").alias("original_name"), "content", F.lit(space_id).alias("space_id"), F.lit(f"batch-{number}").alias("batch_id")), root, number)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
