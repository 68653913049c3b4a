"""Intermediate tables in the folder that driver and executors share.

The cluster names that folder in ``spark.checkpoint.dir``. Tables written there survive the loss of an executor and
cut the lineage of what is read back from them. Only a local session without the setting gets a temporary folder.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder, without a slash at its end."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="veridoc-")
        spark.conf.set("spark.checkpoint.dir", base)
        _made.add(base)
    base = base.rstrip("/")
    return base if ":/" in base else f"file://{base}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses; it is removed when this Python process ends."""
    path = f"{shared_dir(spark)}/veridoc-{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.add(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and return what is read back."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what ``make`` returns and return what is read back; tables that it kept on its way are removed, and so are, once the
    driver's JVM has collected its garbage, the shuffle files behind it. For steps of loops, whose leavings add up."""
    before = set(_made)
    out = make()
    spark, path = out.sparkSession, new_dir(out.sparkSession, name)
    out.write.parquet(path)
    back = spark.read.schema(out.schema).parquet(path)
    del out
    for other in _made - before - {path}:
        if "/veridoc-" in other and other.rpartition("/")[0] == path.rpartition("/")[0]:  # not the shared folder itself
            remove(spark, other)
            _made.discard(other)
    gc.collect()
    spark._jvm.System.gc()
    return back


def drop(df: DataFrame) -> None:
    """Remove the table behind a result of :func:`keep` that is no longer needed."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system, whatever the store is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _made:
        try:
            if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
                remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at this point
            return
