"""Run events: their order, increments, failures and admission. Their text form is in sources.eventlog, their states in machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The events of a run in their order; the last two end it.
EVENTS = ("run_started", "chunk_started", "delta", "chunk_completed", "document_summary_started", "document_summary_completed", "completed", "error")
FIELDS = "run_id string, document_id string, chunk_id string, chunk_index int, delta string, message string, recoverable boolean"


def ended(events: DataFrame) -> DataFrame:
    """Whether each stream has an event that ends it; one without is an error."""
    return events.groupBy("stream_id").agg(F.bool_or(F.col("event").isin("completed", "error")).alias("ended"))


def delta_texts(events: DataFrame) -> DataFrame:
    """The increments of each run and chunk put together in order; those before the chunk's last start do not count."""
    starts = events.filter("event = 'chunk_started'").groupBy("run_id", "chunk_id").agg(F.max("seq").alias("_start"))
    rows = events.filter("event = 'delta' and delta <> ''").join(starts, ["run_id", "chunk_id"], "left").filter("_start is null or seq > _start")
    parts = rows.groupBy("run_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("p"))
    return parts.select("run_id", "chunk_id", F.array_join("p.delta", "").alias("text"))


def produced(chunks: DataFrame) -> DataFrame:
    """The events of a run over the chunks (run_id, chunk_id, chunk_ord) of each document, with their places from 0."""
    step = lambda name, k: F.struct(F.lit(k).alias("k"), F.lit(name).alias("event"))
    each = chunks.select("run_id", F.lit(1).alias("phase"), "chunk_ord", "chunk_id", F.explode(F.array(step("chunk_started", 0), step("chunk_completed", 1))).alias("s"))
    ends = chunks.select("run_id").distinct().select("run_id", F.explode(F.array(*[
        F.struct(F.lit(p).alias("phase"), F.lit(k).alias("k"), F.lit(n).alias("event")) for p, k, n in
        ((0, 0, "run_started"), (2, 0, "document_summary_started"), (2, 1, "document_summary_completed"), (2, 2, "completed"))])).alias("e"))
    rows = each.select("run_id", "phase", "chunk_ord", "chunk_id", "s.*").union(
        ends.select("run_id", "e.phase", F.lit(None).cast("long"), F.lit(None).cast("string"), "e.k", "e.event"))
    order = Window.partitionBy("run_id").orderBy("phase", "chunk_ord", "k")
    return rows.select("run_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "event", "chunk_id")


def failures(events: DataFrame) -> DataFrame:
    """Message of each failed run and whether it may be tried again; ``events`` has message and recoverable besides."""
    first = events.filter(F.col("event").isin("completed", "error")).groupBy("run_id").agg(F.min_by(F.struct("event", "message", "recoverable"), "seq").alias("e"))
    return first.filter("e.event = 'error'").select("run_id", "e.message", F.coalesce("e.recoverable", F.lit(False)).alias("recoverable"))


def admitted(requests: DataFrame, capacity: int = 14, docs: DataFrame | None = None) -> DataFrame:
    """Requests (request_ord, document_id) with ``accepted``: the first ``capacity`` of different documents, in order.
    With ``docs`` (id, status), requests of documents that are not there or not active are never accepted."""
    first = requests.withColumn("document_id", F.trim("document_id")).groupBy("document_id").agg(F.min("request_ord").alias("request_ord"), F.count("*").alias("n"))
    known = first if docs is None else first.join(docs.filter("status = 'active'").select(F.col("id").alias("document_id")), "document_id", "left_semi")
    head = known.orderBy("request_ord").limit(capacity).select("document_id", F.lit(True).alias("_in"))
    return first.join(head, "document_id", "left").select("document_id", "request_ord", (F.col("n") > 1).alias("repeated"), F.coalesce("_in", F.lit(False)).alias("accepted"))
