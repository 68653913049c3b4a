"""Ingestion: strict decoding, routing by extension, deduplication in a space, batch statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import text

# Fixed value: what stands before each page of a paged document.
PAGE_MARK = "===== 第 %d 页 ====="


def document_type(c: Column) -> Column:
    """general for blank, general or prd in any case; null for anything else."""
    t = F.lower(text.strip(F.coalesce(c, F.lit(""))))
    return F.when(t == "", "general").when(t.isin("general", "prd"), t)


def pages_text(pages: Column) -> Column:
    """Pages stripped, each after its mark, parted by an empty line; a blank page keeps its mark."""
    marked = F.transform(pages, lambda p, i: F.concat(F.format_string(PAGE_MARK, i + 1), F.when(text.is_blank(p), "").otherwise(F.concat(F.lit("\n"), text.strip(p)))))
    return F.array_join(marked, "\n\n")


def clean_text(content: Column) -> Column:
    """The text of a file's bytes, without a byte order mark."""
    body = content.cast("string")
    return F.when(body.startswith("\ufeff"), F.substring(body, 2, (1 << 31) - 1)).otherwise(body)


def decoded(files: DataFrame) -> DataFrame:
    """Adds name, kind, content_text, content_hash, excerpt, file_size and error to rows of original_name, content."""
    body = F.col("content").cast("string")
    clean = clean_text(F.col("content"))
    named = files.withColumn("name", text.file_name(F.col("original_name"))).withColumn("kind", text.document_kind(F.col("name")))
    size = F.octet_length("content")
    error = (
        F.when(F.col("kind").isNull(), "unsupported type").when(F.coalesce(size, F.lit(0)) == 0, "empty file")
        .when(F.col("kind") == "pdf", F.lit(None).cast("string")).when(~F.is_valid_utf8(body), "not UTF-8").when(text.is_blank(clean), "blank text"))
    return named.select(
        "*", error.alias("error"), size.cast("long").alias("file_size"), F.sha2("content", 256).alias("content_hash"),
        F.when(error.isNull(), clean).alias("content_text"), F.when(error.isNull(), text.excerpt(clean)).alias("excerpt"))


def classified(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``outcome`` (failed, imported, restored or duplicate) to decoded rows, as if taken in ``file_ord`` order.

    ``existing`` has space_id, content_hash, status. The first file of a hash that is stored and active, or that an
    earlier file of the batch has brought in, is a duplicate; a deleted one is restored.
    """
    known = existing.groupBy("space_id", "content_hash").agg(F.min("status").alias("_had"))
    first = files.filter("error is null").groupBy("space_id", "content_hash").agg(F.min("file_ord").alias("_first"))
    rows = files.join(known, ["space_id", "content_hash"], "left").join(first, ["space_id", "content_hash"], "left")
    again = (F.col("file_ord") > F.col("_first")) | (F.col("_had") == "active")
    outcome = F.when(F.col("error").isNotNull(), "failed").when(again, "duplicate").when(F.col("_had") == "deleted", "restored").otherwise("imported")
    return rows.withColumn("outcome", outcome).drop("_first", "_had")


def batch_statistics(results: DataFrame) -> DataFrame:
    """Counts and status for each batch_id; restored files count as imported, duplicates are no failures."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    counted = results.groupBy("batch_id").agg(F.count("*").alias("total"), n("imported", "restored").alias("imported"), n("duplicate").alias("duplicates"), n("failed").alias("failed"))
    return counted.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("failed") == F.col("total"), "failed").otherwise("partial_failed"))


def failure_notice(results: DataFrame) -> DataFrame:
    """Failed files of each batch as "name：error" in file order, joined by a full-width semicolon."""
    failed = results.filter("outcome = 'failed'").groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("file_ord", "name", "error"))).alias("f"))
    return failed.select("batch_id", F.array_join(F.transform("f", lambda x: F.concat(x["name"], F.lit("："), x["error"])), "；").alias("notice"))
