"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Sources share a word budget by weight, none above a multiple of its own words. A source whose target is beyond its words
is taken whole once or more (complete epochs); the rest of the target is a weighted sample without replacement: each
document gets the key -ln(u)/w for a uniform u (a hash of its doc_id) and its quality weight w, documents are taken in
the order of their keys, and a running sum of their words tells where the rest of the target is reached.

Texts do not move: what is sorted is a slim table of sources, keys and sizes, dealt by ranges that Spark cuts at its
quantiles. Sums of the ranges tell in which one a source is cut, and a running sum within that one finds its last row.
Whether a document is taken then depends on its own key and its source's cut only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.sources import scratch
from veridoc.sources.tables import fresh, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
SYMBOLS = "!#$%&*|<>{}[]=_~^@"


def size_of(text):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_of(text):
    """A quality weight in [0.05, 1]: one less five times the share of symbols among the characters."""
    junk = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1.0 - 5.0 * junk / F.when(F.length(text) > 0, F.length(text))), F.lit(1.0))


def ranked(distinct: DataFrame, column: str) -> DataFrame:
    """Adds ``place``, each row's 0-based place in the order of ``column`` (nulls last), without gathering the rows."""
    order = F.col(column).asc_nulls_last()
    dealt = scratch.keep(distinct.repartitionByRange(order).withColumn("_vd_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_vd_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_vd_part").count().select("_vd_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_vd_start"))
    within = F.row_number().over(Window.partitionBy("_vd_part").orderBy(order)) - 1
    return dealt.withColumn("_vd_at", within).join(starts, "_vd_part").withColumn("place", F.col("_vd_start") + F.col("_vd_at")).drop("_vd_part", "_vd_at", "_vd_start")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to a table of ``source`` and ``source_size``.

    Water filling: what sources at their cap leave over is shared by weight among the others until none is above its
    cap. Each round is one aggregation over the sources; only its two sums reach the driver.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = scratch.keep(ranked(sizes, "source").withColumn("weight", cycle).drop("place"), "sources")
    cap = F.col("source_size") * most
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > cap
        total, taken, left, n = placed.agg(
            F.sum("source_size"), F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if n == capped or not left:
            break
        capped, level = n, (share * total - taken) / left
    full = F.lit(left is not None and not left) | (F.col("weight") * level > cap)
    return placed.withColumn("target", F.when(full, cap).otherwise(F.col("weight") * level))


#: What a row's place in its source's order is made of: key, then doc_id (null first), size and text for equal keys. Rows
#: that are still equal are told apart by the slim table's ``row``.
ORDER = "struct<key:double,known:boolean,doc_id:long,size:long,text:long>"


def keyed(docs: DataFrame, seed: int) -> tuple[DataFrame, str, str]:
    """``docs`` with each row's size and its place in the order, and the names of these two columns."""
    size, order = fresh(docs, "size"), fresh(docs, "order")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(2.0**52)
    sized = docs.withColumn(size, size_of(F.col("text")))
    place = F.struct(-F.log(u) / quality_of(F.col("text")), F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col(size), F.xxhash64("text"))
    return sized.withColumn(order, place.cast(ORDER)), size, order


def cuts(slim: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """For each source of ``slim`` (``source``, ``size``, ``order``, ``row``): ``source_size``, ``target``, ``epochs``, and ``cut``
    (``order``, ``row``), the last one that the rest of the target takes once more (null if none).

    A row is taken if its middle is within the rest; that grows along the order, so the rows taken are those up to a last one.
    """
    dealt = scratch.keep(slim.select("source", "size", F.struct("order", "row").alias("at")).repartitionByRange("source", "at").withColumn("part", F.spark_partition_id()), "dealt")
    parts = scratch.keep(dealt.groupBy("source", "part").agg(F.sum("size").alias("words"), F.max(F.when(F.col("size") > 0, F.col("at"))).alias("top")), "parts")
    aims = scratch.keep(targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.select("source", "source_size", "target", epochs.alias("epochs"), F.when(epochs < most, F.col("target") - epochs * F.col("source_size")).alias("rest"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("before", before).join(aims.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s").filter("before <= rest")
    whole = placed.filter("before + words <= rest").groupBy("source").agg(F.max("top").alias("cut"))
    crossed = placed.filter("before + words > rest").select(F.col("source").alias("s"), F.col("part").alias("p"), "before", "rest")
    near = dealt.join(crossed, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    running = F.sum("size").over(Window.partitionBy("source", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    inside = near.withColumn("running", running).filter(F.col("before") + F.col("running") - F.col("size") / 2.0 <= F.col("rest")).filter("size > 0")
    last = whole.union(inside.groupBy("source").agg(F.max("at").alias("cut"))).groupBy(F.col("source").alias("s")).agg(F.max("cut").alias("cut"))
    return aims.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut")


def beside(rows: DataFrame, source: str, found: DataFrame):
    """``rows`` with what is known of their sources, and a function from the names in ``found`` to its columns there.
    Spark sends the few cuts to all tasks if they are small, and sorts both sides otherwise."""
    names = {x: fresh(rows, f"cut_{x}") for x in found.columns}
    joined = rows.join(found.withColumnsRenamed(names), F.col(source).eqNullSafe(F.col(names["source"])))
    return joined, lambda x: F.col(names[x])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """How much the mix takes of each row: ``doc_id``, ``size``, ``source_size``, ``target`` (of the row's source), ``copies``.

    A source is off its target by half of one document at most. Null texts have size 0; null is a source of its own, the
    last one. Rows with the same doc_id draw the same number, and are ordered by size and a hash of the text, so rows that
    trade places are equal and reruns agree. An empty table gives an empty result; other columns are ignored, and a very
    long text is one number like any other.
    """
    rows, size, order = keyed(docs.select("doc_id", "text", "source"), seed)
    slim = scratch.keep(rows.select("source", F.col(size).alias("size"), F.col(order).alias("order"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row")), "slim")
    out, of = beside(slim, "source", scratch.keep(cuts(slim, weights, share, most), "cuts"))
    more = (F.col("size") > 0) & F.coalesce(F.struct("order", "row") <= of("cut"), F.lit(False))
    return out.select("doc_id", "size", of("source_size").alias("source_size"), of("target").alias("target"), (of("epochs") + more.cast("long")).alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """The rows of the mix themselves, with the columns of ``docs``, each row as often as :func:`mix` takes it.

    Sizes and keys are computed once for the slim table and once more where a row is decided on; that is cheaper than to
    send the texts along. Where a source's last row has equals that are not all taken, these rows are grouped and counted,
    so they meet as one row a task. Nulls, repeated rows, empty tables and columns of other names are as in :func:`mix`.
    """
    rows, size, order = keyed(docs, seed)
    slim = scratch.keep(rows.select("source", F.col(size).alias("size"), F.col(order).alias("order"), F.monotonically_increasing_id().alias("row")), "slim")
    found = scratch.keep(cuts(slim, weights, share, most), "cuts")
    at_cut, of = beside(slim, "source", found)
    equal = at_cut.filter(F.col("order") == of("cut")["order"]).groupBy(F.col("source").alias("s")).agg(F.count_if(F.col("row") <= of("cut")["row"]).alias("times"), F.count("*").alias("equal"))
    found = scratch.keep(found.join(equal, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "cuts")
    source, copy, n = (fresh(docs, x) for x in ("source", "copy", "n"))
    known, of = beside(rows.withColumn(source, F.col("source")), source, found)
    at, last, all_equal = F.col(order), of("cut")["order"], of("times") == of("equal")
    copies = of("epochs") + F.coalesce((F.col(size) > 0) & ((at < last) | ((at == last) & all_equal)), F.lit(False)).cast("int")
    repeat = lambda rows: rows.filter(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int")))).select(*docs.columns)
    out = repeat(known.withColumn(copy, copies))
    if not found.filter("times < equal").limit(1).count():
        return out
    some = known.filter((at == last) & ~all_equal).groupBy(*docs.columns, source, of("times").alias(copy)).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(source).orderBy(*docs.columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.union(repeat(some.withColumn(copy, F.least(F.col(n), F.col(copy) - before))))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(greatest(0.05, 1.0::DOUBLE - 5.0::DOUBLE * (length(text) - length(translate(text, '!#$%&*|<>{}[]=_~^@', ''))) / nullif(length(text), 0)), 1.0::DOUBLE) AS w,
         (CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
keyed AS (SELECT *, -ln(u) / w AS key FROM sized),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM keyed GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS wt FROM per),
filled AS (
  SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2.0::DOUBLE * s) OVER lower, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER lower, 0)) AS level
  FROM weighed WINDOW lower AS (ORDER BY 2.0::DOUBLE * s / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT max(level) FILTER (wt * level <= 2.0::DOUBLE * s) AS level FROM filled),
aims AS (SELECT w.source, s, least(wt * f.level, 2.0::DOUBLE * s) AS target FROM weighed w, found f),
epoch AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS e FROM aims),
run AS (SELECT k.doc_id, k.size, e.s, e.target, e.e, sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS r
        FROM keyed k JOIN epoch e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, s AS source_size, target, CAST(size * (e + CASE WHEN size > 0 AND r - size / 2.0::DOUBLE <= target - e * s AND e < 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
