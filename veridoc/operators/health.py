"""Health checks of links and tasks: names that could mean several nodes, tasks that nobody has or that have no date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.sources import scratch

#: Share of their letter triples that two names have in common, from which one may mean the other, in percent.
ALIKE = 80
#: Rarest triples that names are to share before they are compared, up to which number of common ones, and from which percentage on.
SHARED, LONG, LEAST = 3, 24, 60


def triples(name: Column) -> Column:
    """The different runs of three characters of a name, already normalised, with a mark before and after it."""
    padded = F.concat(F.lit("^"), name, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - 2)), lambda i: F.substring(padded, i, F.lit(3))))


def _pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs (_norm, _other) of normalised names, each (_norm) once, that are alike enough.

    Of n triples, need = ceil(n * percent / 100) have to be common. The n - need + k rarest of either name then have k in common, so names
    are compared only if they share k of these: SHARED, which tells names of few triples in all apart too; or one, where names
    may have fewer in common or so many that their choices of SHARED are too many. Triples go by number, and a pair is
    checked where it is met."""
    both = left.select("_norm").union(right.select("_norm")).distinct().select("_norm", F.explode(triples(F.col("_norm"))).alias("_g"))
    often = scratch.keep(both.groupBy("_g").agg(F.count("*").alias("_n")).withColumn("_i", F.monotonically_increasing_id()), "triples")
    size, o = F.size("_o"), F.col("_o")
    need = F.ceil(size * percent / F.lit(100)).cast("int")
    p = F.least(size, size - need + SHARED)
    span = lambda a, b, f: F.transform(F.sequence(a, b), f)
    three = F.flatten(span(F.lit(1), p - 2, lambda i: F.flatten(span(i + 1, p - 1, lambda j: span(j + 1, p, lambda k: F.xxhash64(F.element_at(o, i), F.element_at(o, j), F.element_at(o, k)))))))
    one = F.transform(F.slice(o, F.lit(1), size - need + 1), lambda g: F.xxhash64(g))
    many = F.lit(percent >= LEAST) & (size >= SHARED) & (need <= LONG)
    few = F.lit(percent < LEAST) | (need < SHARED) | (size > LONG)
    none = F.array().cast("array<bigint>")

    def heads(rows: DataFrame) -> DataFrame:
        ranked = rows.select("_norm", F.explode(triples(F.col("_norm"))).alias("_g")).join(often, "_g").groupBy("_norm").agg(F.sort_array(F.collect_list(F.struct("_n", "_i")))["_i"].alias("_o"))
        return ranked.select("_norm", "_o", F.explode(F.concat(F.when(many, three).otherwise(none), F.when(few, one).otherwise(none))).alias("_k"))

    met = heads(left).join(heads(right).withColumnsRenamed({"_norm": "_other", "_o": "_u"}), "_k")
    shared = F.size(F.array_intersect("_o", "_u"))
    return met.filter(shared * 100 >= (F.size("_o") + F.size("_u") - shared) * percent).select("_norm", "_other").distinct()


def _alike(names: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names (name, _norm), nodes (id, _other), each once, and the pairs of their normalised names."""
    normal = lambda rows, key, name, to: rows.filter(~text.is_blank(F.col(name))).select(key, text.normalized_name(F.col(name)).alias(to)).distinct()
    left, right = normal(names, "name", "name", "_norm"), normal(nodes, "id", "label", "_other")
    return left, right, _pairs(left.select("_norm").distinct(), right.select(F.col("_other").alias("_norm")).distinct(), percent)


def alike(names: DataFrame, nodes: DataFrame, percent: int = ALIKE) -> DataFrame:
    """Pairs (name, id) of names and nodes (id, label) whose triples overlap by at least ``percent`` of all they have together.

    No pair that is alike enough is missed; names and labels that are equal when normalised are compared once, however often they
    stand there. Null and blank names and labels mean nothing.
    """
    left, right, pairs = _alike(names, nodes, percent)
    return pairs.join(left, "_norm").join(right, "_other").select("name", "id").distinct()


def ambiguous(names: DataFrame, nodes: DataFrame, percent: int = ALIKE) -> DataFrame:
    """name, candidates (how many) and first (the smallest id) of each name that may mean more than one node. Nodes are counted by
    label before they meet a name; only those with several labels, which could count twice, meet it one by one."""
    left, right, pairs = _alike(names, nodes, percent)
    pairs = scratch.keep(pairs, "alike")
    labels = right.groupBy("id").agg(F.collect_set("_other").alias("_l"))
    sums = labels.filter(F.size("_l") == 1).groupBy(F.col("_l")[0].alias("_other")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    once = pairs.join(sums, "_other").select("_norm", "n", "first")
    several = labels.filter(F.size("_l") > 1).select("id", F.explode("_l").alias("_other"))
    more = pairs.join(several, "_other").select("_norm", "id").distinct().select("_norm", F.lit(1).cast("long").alias("n"), F.col("id").alias("first"))
    found = once.union(more).groupBy("_norm").agg(F.sum("n").alias("candidates"), F.min("first").alias("first")).filter("candidates > 1")
    return left.join(found, "_norm").select("name", "candidates", "first")


def open_tasks(tasks: DataFrame, people: DataFrame) -> DataFrame:
    """issue and id of tasks (id, owner, due): ``no owner`` where none of the people (id) is it, ``no due date`` where it is null."""
    known = people.select(F.col("id").alias("owner")).distinct()
    lost = tasks.join(known, "owner", "left_anti").select(F.lit("no owner").alias("issue"), "id")
    return lost.union(tasks.filter("due is null").select(F.lit("no due date").alias("issue"), "id"))
