"""A keyed table that a stream keeps up to date: readers see whole micro-batches or nothing of them.

Each micro-batch writes the rows that changed to a folder of its own. Spark's committer puts ``_SUCCESS`` there after the last
file, and a folder without it does not exist for readers. Of each key the row of the newest batch counts. Every few batches the
folders are merged into one, and folders that the merge before last has replaced are removed, so a reader that has listed them
still finds them for as long as a merge lasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches after which the folders are merged.
EVERY = 20


def _folders(spark: SparkSession, table: str) -> dict[str, list[int]]:
    """Numbers of the complete folders by kind, ``rows`` and ``whole``, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"rows": [], "whole": []}
    if fs.exists(path):
        for s in fs.listStatus(path):
            kind, _, number = s.getPath().getName().partition("-")
            if kind in found and number.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
    return {k: sorted(v) for k, v in found.items()}


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write(rows: DataFrame, table: str, batch: int, key: str, every: int = EVERY) -> None:
    """Adds a micro-batch of rows, at most one of each key; the same batch again takes its own place. Nothing is ever merged if
    ``every`` is 0."""
    spark = rows.sparkSession
    rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{table}/rows-{batch:012d}")
    if every and batch % every == every - 1:
        merged = latest(spark, table, key, keep_batch=True)
        merged.write.mode("overwrite").parquet(f"{table}/whole-{batch:012d}")
        wholes = _folders(spark, table)["whole"]
        if len(wholes) > 1:
            for kind, numbers in _folders(spark, table).items():
                for n in numbers:
                    if n < wholes[-2] or (n == wholes[-2] and kind == "rows"):
                        _remove(spark, f"{table}/{kind}-{n:012d}")


def latest(spark: SparkSession, table: str, key: str, keep_batch: bool = False, upto: int | None = None, empty: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The newest row of each key over all complete micro-batches, or over those up to a number. A table without any is an error,
    or has no rows of the schema ``empty``. With ``columns`` only the key and these are read."""
    found = _folders(spark, table)
    whole = [n for n in found["whole"] if upto is None or n <= upto][-1:]
    paths = [f"{table}/whole-{n:012d}" for n in whole]
    paths += [f"{table}/rows-{n:012d}" for n in found["rows"] if (not whole or n > whole[0]) and (upto is None or n <= upto)]
    if not paths:
        if empty is None:
            raise FileNotFoundError(f"no complete batch in {table}")
        none = spark.createDataFrame([], empty)
        return none.select(key, *columns) if columns else none
    rows = spark.read.parquet(*paths)
    if columns:
        rows = rows.select(key, *columns, "_batch")
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), "_batch").alias("_r")).select(key, "_r.*")
    return best if keep_batch else best.drop("_batch")
