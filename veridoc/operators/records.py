"""Lookups, public projections, spaces and integrity of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.sources import scratch

# Labels of edge states and relation types, and the label of any other type.
STATUS = {"suggested": "待审核", "confirmed": "已采纳", "rejected": "已拒绝", "stale": "已失效"}
RELATION = {
    "project_contains_feature": "项目包含功能", "feature_contains_requirement": "功能包含需求", "requirement_has_task": "需求包含任务", "requirement_has_risk": "需求存在风险",
    "task_assigned_to_person": "任务分配给人员", "department_responsible_for_project": "部门负责项目", "decision_affects_requirement": "决策影响需求"}
OTHER = "关联"
# The space that takes rows without one.
LEGACY_NAME, LEGACY_TEXT = "历史资料迁移空间", "升级前未归属知识空间的历史资料"
#: Columns that listings do not show.
HIDDEN = ("storage_path", "content_text", "result_json")
NAME_MOST, TEXT_MOST, IDS_MOST = 100, 500, 12


def public(rows: DataFrame) -> DataFrame:
    """The rows without the columns that are not for readers; a scan never reads those then."""
    return rows.drop(*HIDDEN)


def labels(known: dict[str, str], c: Column, other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), c), other)


def document(docs: DataFrame, space: str, doc_id: str) -> DataFrame:
    """The active document of a space by its id."""
    return docs.filter((F.col("space_id") == space) & (F.col("id") == doc_id) & (F.col("status") == "active"))


def run(runs: DataFrame, space: str, doc_id: str, run_id: str) -> DataFrame:
    return runs.filter((F.col("space_id") == space) & (F.col("document_id") == doc_id) & (F.col("id") == run_id))


def in_order(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """The rows with their 1-based place ``n`` within their group; ``order`` must tell all rows of a group apart.

    Rows are sorted by ranges of (group, order), numbered within each range, and the ranges' counts, a short row each, are summed
    up. So a group with most rows is shared by many tasks.
    """
    dealt = scratch.keep(rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "ordered")
    key = [F.col(group).isNull().alias("_null"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_key")]
    dealt = dealt.select("*", *key)
    counts = dealt.groupBy("_null", "_key", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_null", "_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_null", "_key", "_part").orderBy(*order))
    placed = dealt.withColumn("_at", within).join(starts, ["_null", "_key", "_part"])
    return placed.withColumn("n", (F.col("_start") + F.col("_at")).cast("long")).drop("_null", "_key", "_part", "_at", "_start")


def newest_edges(edges: DataFrame) -> DataFrame:
    """One edge for each signature (space, both ends, type), the newest of any status."""
    mark = ["space_id", "source_node_id", "target_node_id", "relation_type"]
    rest = [c for c in edges.columns if c not in mark]
    return edges.groupBy(*mark).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "id")).alias("e")).select(*mark, "e.*")


def nodes_by_keys(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Nodes that are not stale and whose (space_id, normalized_key) is among ``keys``."""
    return nodes.filter("status <> 'stale'").join(keys, ["space_id", "normalized_key"], "left_semi")


def node_sources(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Each source of each node in its place, with the document's name, or its id if there is none; nodes without sources have one null row."""
    each = nodes.select(F.col("id").alias("node_id"), F.posexplode_outer("source_ids").alias("place", "document_id"))
    return each.join(docs.select(F.col("id").alias("document_id"), "name"), "document_id", "left").select("node_id", "place", "document_id", F.coalesce("name", "document_id").alias("label"))


# ---- spaces
def check_space(name: str | None, description: str | None = None) -> None:
    if not name or not name.strip() or len(name) > NAME_MOST or len(description or "") > TEXT_MOST:
        raise ValueError(f"a space needs a name of at most {NAME_MOST} characters, and a description has {TEXT_MOST} at most")


def check_ids(ids: list[str]) -> None:
    if not 1 <= len(ids) <= IDS_MOST or any(not i or not i.strip() for i in ids):
        raise ValueError(f"from 1 to {IDS_MOST} ids, none of them blank")


def guard(spaces: DataFrame, space_id: str | None) -> None:
    """Raises for a blank id and for a space that is missing or deleted."""
    if not space_id or not space_id.strip():
        raise ValueError("no space given")
    if not spaces.filter((F.col("id") == space_id) & (F.col("status") == "active")).limit(1).count():
        raise LookupError(f"no such space: {space_id}")


def created_spaces(spaces: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Requests (ord, id, name, description) with ``accepted``: the name, stripped, is not blank, no active space has it and no
    earlier request; names of deleted spaces are free again. A blank description is null."""
    named = requests.withColumn("name", text.strip(F.col("name"))).withColumn("description", text.or_default(F.col("description"), F.lit(None).cast("string")))
    first = named.groupBy("name").agg(F.min("ord").alias("_first"))
    taken = spaces.filter("status = 'active'").select("name", F.lit(True).alias("_taken")).distinct()
    free = (F.col("name") != "") & F.col("_taken").isNull() & (F.col("ord") == F.col("_first"))
    return named.join(first, "name").join(taken, "name", "left").select("ord", "id", "name", "description", free.alias("accepted"), now.alias("created_at"))


def deleted_spaces(spaces: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Spaces with the active ones among ``ids`` deleted. Documents and graph stay as they are."""
    j = spaces.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    gone = F.col("_hit") & (F.col("status") == "active")
    return j.select(*[F.when(gone, "deleted").otherwise(F.col(c)).alias(c) if c == "status" else F.when(gone, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in spaces.columns])


def ownerless(*tables: DataFrame) -> DataFrame:
    """How many rows of all tables have no space."""
    rows = [t.select("space_id").filter("space_id is null or space_id = ''") for t in tables]
    return reduce(DataFrame.union, rows).agg(F.count("*").alias("n"))


def adopted(rows: DataFrame, space: str) -> DataFrame:
    """The rows, those without a space in ``space``."""
    return rows.withColumn("space_id", F.coalesce(F.nullif("space_id", F.lit("")), F.lit(space)))


# ---- integrity
def broken_keys(tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """``table``, ``key``, ``n`` of every key that its table has more than once, or that is null."""
    out = []
    for name, (rows, key) in tables.items():
        text_key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
        none = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        out.append(rows.groupBy(*key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | none).select(F.lit(name).alias("table"), text_key.alias("key"), "n"))
    return reduce(DataFrame.union, out)


def repeated_names(spaces: DataFrame) -> DataFrame:
    """Names that more than one active space has."""
    return spaces.filter("status = 'active'").groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def lost_quotes(evidences: DataFrame, docs: DataFrame) -> DataFrame:
    """Evidence whose quote does not stand in its document any more, or whose document is gone."""
    j = evidences.join(docs.select(F.col("id").alias("source_document_id"), "content_text"), "source_document_id", "left")
    return j.filter(~F.coalesce(F.contains("content_text", "quote"), F.lit(False))).drop("content_text")
