"""Extraction runs: their life, the document summary, review counts and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import text

# Longest summary, and why a summary failed.
LONGEST = 160
NONE, LONG, FAILED = "AI 未生成有效的全文摘要", "全文摘要超过 160 个字符", "AI 全文摘要生成失败，已保留候选事实"


def applied(started: DataFrame, updates: DataFrame) -> DataFrame:
    """Runs after their updates, in the order of ``seq``.

    ``started`` has id and created_at; a run begins as processing. ``updates`` has id, seq, kind, sections, chunks, summary,
    error and at: "plan" sets the counts, "complete" sets status, counts, summary and time and clears the error, "fail" sets
    status, error and time and keeps the rest. Of each column the last update that sets it counts.
    """
    ends, done = F.col("kind").isin("complete", "fail"), F.col("kind") == "complete"
    last = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    folded = updates.groupBy("id").agg(
        last("kind", ends).alias("_end"), last("sections", F.col("kind") != "fail").alias("section_count"), last("chunks", F.col("kind") != "fail").alias("chunk_count"),
        last("summary", done).alias("document_summary"), last(F.when(~done, F.col("error")), ends).alias("error_message"), last("at", ends).alias("completed_at"))
    status = F.when(F.col("_end") == "complete", "completed").when(F.col("_end") == "fail", "failed").otherwise("processing")
    return started.join(folded, "id", "left").select("id", "created_at", status.alias("status"), "section_count", "chunk_count", "document_summary", "error_message", "completed_at")


def summary_context(chunks: DataFrame) -> DataFrame:
    """One text for each document with a line for each of its chunks (section_path, chunk_id, summary) in their order."""
    line = F.concat(F.lit("- "), "section_path", F.lit("（"), "chunk_id", F.lit("）："), text.collapsed(F.col("summary")), F.lit("\n"))
    lines = chunks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_ord", line.alias("line")))).alias("l"))
    return lines.select("document_id", F.array_join("l.line", "").alias("context"))


def summary_outcome(summary: Column, failed: Column) -> Column:
    """(summary, status, error) of what a model gave for a document; a failure never fails the run."""
    s = F.coalesce(text.collapsed(summary), F.lit(""))
    error = F.when(failed, FAILED).when(s == "", NONE).when(F.length(s) > LONGEST, LONG)
    return F.struct(F.when(error.isNull(), s).alias("summary"), F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error"))


def review_counts(items: DataFrame, by: str) -> DataFrame:
    """Accepted and rejected items of each review request."""
    n = lambda a: F.count_if(F.col("action") == a)
    return items.groupBy(by).agg(n("ACCEPT").alias("accepted"), n("REJECT").alias("rejected"))


def review_panel(relations: DataFrame, states: DataFrame) -> DataFrame:
    """Per document: relations, reviewed, accepted, rejected and pending ones, and whether all are reviewed.
    ``states`` has chunk_id, relation_index, action."""
    j = relations.select("document_id", "chunk_id", F.col("pos").alias("relation_index")).join(states, ["chunk_id", "relation_index"], "left")
    n = F.count_if
    out = j.groupBy("document_id").agg(F.count("*").alias("relations"), F.count("action").alias("reviewed"), n(F.col("action") == "ACCEPT").alias("accepted"), n(F.col("action") == "REJECT").alias("rejected"))
    return out.withColumn("pending", F.col("relations") - F.col("reviewed")).withColumn("complete", F.col("pending") == 0)


def totals(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities and relations of each document's result."""
    each = entities.select("document_id", F.lit(1).alias("e"), F.lit(0).alias("r")).union(relations.select("document_id", F.lit(0), F.lit(1)))
    return each.groupBy("document_id").agg(F.sum("e").alias("entities"), F.sum("r").alias("relations"))


def replaced(chunks: Column, new: Column) -> Column:
    """An array of chunk structs without those of the new one's chunk_id, and the new one at its end."""
    return F.concat(F.filter(chunks, lambda x: x["chunk_id"] != new["chunk_id"]), F.array(new))


def still_open(docs: DataFrame, accepted: DataFrame, latest: DataFrame) -> DataFrame:
    """Documents (id) that a listing has to look at again: their latest run is processing, or they were accepted and have no run."""
    busy = docs.join(latest.filter("latest_status = 'processing'").select(F.col("document_id").alias("id")), "id", "left_semi").select("id")
    waiting = docs.join(accepted.select("id"), "id", "left_semi").join(latest.select(F.col("document_id").alias("id")), "id", "left_anti").select("id")
    return busy.union(waiting).distinct()
