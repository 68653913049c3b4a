"""Files in and out: a folder of documents, the raw bytes of what was imported, tables, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.operators import ingest


def folder(spark: SparkSession, path: str, space_id: str, batch_id: str) -> DataFrame:
    """The files below ``path`` as rows of original_name, content, file_ord, space_id and batch_id. Files
    count in the order of their paths."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("file_ord"), F.col("path").alias("original_name"), "content", F.lit(space_id).alias("space_id"), F.lit(batch_id).alias("batch_id"))


def imported(spark: SparkSession, path: str, space_id: str, batch_id: str, existing: DataFrame) -> DataFrame:
    """What becomes of each file of a folder: decoded, hashed and classified against the documents of the space."""
    return ingest.classified(ingest.decoded(folder(spark, path, space_id, batch_id)), existing)


def raw_path(space: Column, name: Column, content_hash: Column) -> Column:
    """Where a file's bytes belong: <space>/documents/<id>.<extension>. What comes from outside keeps only letters, digits, "-"
    and "_", so no name leads out of the folder."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")
    return F.concat(clean(space), F.lit("/documents/"), text.uuid3("file", space, content_hash), F.lit("."), clean(text.file_extension(name)))


def store_raw(files: DataFrame, path: str) -> None:
    """Adds the bytes of files (space_id, name, content, content_hash), a folder for each space. Spark's commit protocol makes
    a failed write leave nothing behind."""
    out = files.withColumn("file", raw_path(F.col("space_id"), F.col("name"), F.col("content_hash"))).withColumn("space", F.regexp_replace("space_id", "[^A-Za-z0-9_-]", "_"))
    out.select("space", "space_id", "file", "content_hash", "content").write.mode("append").partitionBy("space").parquet(path)


def insert(rows: DataFrame, path: str) -> None:
    """Appends rows to a table; the columns must be those it has, by name and type."""
    rows.write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by its own schema, so nothing is guessed from what is stored."""
    return spark.read.schema(schema).parquet(path)


def wiki_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A line of linked text for each confirmed edge: "[[source]] relation [[target]]"."""
    label = nodes.select("id", "label")
    j = edges.filter("status = 'confirmed'").select("id", "source_node_id", "target_node_id", "relation_type")
    for end in ("source", "target"):
        j = j.join(label.withColumnsRenamed({"id": f"{end}_node_id", "label": f"_{end}"}), f"{end}_node_id")
    return j.select("id", F.format_string("[[%s]] %s [[%s]]", "_source", "relation_type", "_target").alias("line"))


def export(rows: DataFrame, path: str, kind: str) -> None:
    """Rows as JSON lines, or their column ``line`` as Markdown text."""
    if kind == "json":
        rows.write.json(path)
    elif kind == "markdown":
        rows.select("line").write.text(path)
    else:
        raise ValueError(f"json or markdown, not {kind}")
