"""Listings: spaces, pages of documents, and the latest of each document's runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import text

PAGE, MOST = 12, 100


def check_page(page: int, size: int) -> None:
    if page < 1 or not 1 <= size <= MOST:
        raise ValueError(f"page must be 1 or more, and its size from 1 to {MOST}")


def active(rows: DataFrame, spaces: DataFrame) -> DataFrame:
    """Rows of spaces that are active. The ids of spaces, which are few and short, go to all tasks: dealt by space, whole rows of the
    largest one would meet in one task."""
    return rows.join(F.broadcast(spaces.filter("status = 'active'").select(F.col("id").alias("space_id")).distinct()), "space_id", "left_semi")


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row a document: its latest run of any outcome, latest completed run, and latest summary that is not blank."""
    when = F.struct("created_at", "id")
    done = F.col("status") == "completed"
    usable = done & F.col("document_summary").isNotNull() & (F.trim("document_summary") != "")
    return runs.groupBy("document_id").agg(F.max_by(F.struct("id", "status"), when).alias("l"), F.max_by("id", F.when(done, when)).alias("completed_run_id"), F.max_by("document_summary", F.when(usable, when)).alias("latest_summary")).select(
        "document_id", F.col("l.id").alias("latest_run_id"), F.col("l.status").alias("latest_status"), "completed_run_id", "latest_summary")


def matching(docs: DataFrame, name: str | None = None) -> DataFrame:
    return docs.filter((F.col("status") == "active") & text.name_contains(F.col("name"), name))


def page_of(rows: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """Rows of one page. Only the rows up to the page's end are sorted together."""
    check_page(page, size)
    return rows.orderBy(*order).limit(page * size).orderBy(*order).offset((page - 1) * size)


def totals(rows: DataFrame, size: int = PAGE) -> DataFrame:
    """How many rows, and how many pages of them."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with their latest status (not_started without a run) and the summary or, without one, their excerpt. A page of them
    is one partition, and a join with it as it is would bring all runs to one task; so documents are dealt by id first."""
    latest = latest_runs(runs).withColumnRenamed("document_id", "id")
    return docs.repartition("id").join(latest, "id", "left").withColumn("latest_status", F.coalesce("latest_status", F.lit("not_started"))).withColumn("excerpt", F.coalesce("latest_summary", "excerpt"))


def merged(old: DataFrame, new: DataFrame, key: str, place: str | None = None) -> DataFrame:
    """Rows of both, once for each key; the new ones win. With ``place``, they take the place of the old ones in its order."""
    fresh = new
    if place:
        first = old.select(key, F.col(place).alias("_place"))
        fresh = new.join(first, key, "left").withColumn(place, F.coalesce("_place", place)).select(*new.columns)
    return fresh.unionByName(old.join(new.select(key), key, "left_anti"))


def loaded(total: Column, page: int, size: int = PAGE) -> Column:
    """How many rows the pages so far have shown."""
    return F.least(total, F.lit(page * size).cast("long"))
