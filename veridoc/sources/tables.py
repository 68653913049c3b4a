"""Access to the input tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory, through Spark's own reader, so any store that Spark reads works.

    Whole texts go to Python in Arrow batches; at the default of 10,000 rows a batch of them is large, so a session that
    has the default gets 1,000."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_vd_{base}"
    while name.lower() in taken:
        name += "_"
    return name
