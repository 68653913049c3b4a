"""Covering locality-sensitive hashing of 64-bit fingerprints (Pagh, 2016).

Each bit position i gets a nonzero vector m(i) of r+1 bits, and each nonzero vector v a mask that keeps the positions
with an odd product <m(i), v>. The differing positions of two fingerprints within radius r give at most r equations in
r+1 unknowns, so some nonzero v is orthogonal to all of them: under its mask the two fingerprints are equal. Hence
2^(r+1)-1 tables miss no pair within the radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def masks(radius: int) -> list[int]:
    """The masks as signed 64-bit integers."""
    vectors = 2 ** (radius + 1)
    assigned = [i % (vectors - 1) + 1 for i in range(BITS)]
    found = []
    for v in range(1, vectors):
        bits = sum(1 << i for i, m in enumerate(assigned) if (m & v).bit_count() % 2)
        found.append(bits - (1 << BITS) if bits >> (BITS - 1) else bits)
    return found


def keys(fingerprint: Column, radius: int) -> Column:
    """An array of (table, key) structs: where the fingerprint stands in each table."""
    return F.array(*[
        F.struct(F.lit(t).alias("table"), fingerprint.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])


def links(prints: DataFrame, radius: int, bucket: int = 32) -> DataFrame:
    """Edges ``a``, ``b`` that join the same fingerprints as all pairs within the radius would.

    ``prints`` has distinct longs in ``fp``. Buckets of up to ``bucket`` fingerprints compare all their pairs. The
    fingerprints of larger ones are linked exactly in another way: two fingerprints are within radius 2 if and only
    if some value differs from both in at most one bit. Each is listed under its 65 such values; at most 65 distinct
    fingerprints share one, all within the radius, and a star joins them. So the work is linear in the fingerprints
    whatever the size of a bucket. Radius 0 gives no edge; radius 1 keeps only stars around a value that is present.
    """
    if not 0 <= radius <= 2:
        raise ValueError("links are exact for a radius of 0, 1 or 2")
    if radius == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    placed = prints.select("fp", F.explode(keys(F.col("fp"), radius)).alias("k")).select("fp", "k.table", "k.key")
    sizes = placed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = placed.join(sizes, ["table", "key"])
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    small = (
        crowded.filter(F.col("n") <= bucket).groupBy("table", "key").agg(F.collect_list("fp").alias("m"))
        .select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(
            F.filter("m", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("e"))
        .select("e.a", "e.b"))
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(BITS)])
    stars = (
        crowded.filter(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(flips).alias("z"))
        .groupBy("z").agg(F.collect_list("fp").alias("m")).filter(F.size("m") > 1))
    if radius == 1:
        stars = stars.filter(F.array_contains("m", F.col("z"))).withColumn("hub", F.col("z"))
    else:
        stars = stars.withColumn("hub", F.array_min("m"))
    large = stars.select(F.explode("m").alias("a"), F.col("hub").alias("b")).filter("a <> b")
    return small.union(large)
