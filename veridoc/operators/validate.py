"""Rules that extracted candidates must hold, as a table of violations.

Candidates are flat: entities(chunk_id, pos, candidate_id, type, name, summary, evidence_ids), relations(chunk_id, pos,
source_id, target_id, relation_type, confidence, evidence_ids), evidences(chunk_id, pos, evidence_id, document_id,
source_chunk_id, section_path, quote), conflicts(chunk_id, pos, conflict_type, description, evidence_ids), and
chunks(chunk_id, document_id, section_path, content). Ids are unique within a chunk only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions.text import is_blank

# Kinds of entities, pattern of type names.
TYPES = ("project", "person", "organization", "feature", "requirement", "decision", "task", "risk", "document", "term")
NAME = "^[a-z][a-z0-9_]*$"


def _no_ids(ids: Column) -> Column:
    return ids.isNull() | (F.size(ids) < 1) | F.exists(ids, is_blank)


def _broken(rows: DataFrame, order: int, rule: str, item: str, when: Column) -> DataFrame:
    return rows.filter(F.coalesce(when, F.lit(True))).select("chunk_id", F.lit(order).alias("rule_ord"), F.col("pos").cast("int").alias("item_ord"), F.lit(rule).alias("rule"), F.col(item).cast("string").alias("item"))


def constraints(entities: DataFrame, relations: DataFrame, evidences: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Blank or overlong fields, unknown types, confidence outside [0, 1], missing evidence ids."""
    c = F.col
    out = _broken(entities, 10, "entity", "candidate_id", is_blank(c("candidate_id")) | c("type").isNull() | ~c("type").isin(*TYPES) | is_blank(c("name")) | (F.length("name") > 200) | (F.length(F.coalesce("summary", F.lit(""))) > 160) | _no_ids(c("evidence_ids")))
    out = out.union(_broken(relations, 11, "relation", "relation_type", is_blank(c("source_id")) | is_blank(c("target_id")) | ~c("relation_type").rlike(NAME) | ~c("confidence").between(0, 1) | _no_ids(c("evidence_ids"))))
    out = out.union(_broken(evidences, 12, "evidence", "evidence_id", is_blank(c("evidence_id")) | is_blank(c("document_id")) | is_blank(c("source_chunk_id")) | is_blank(c("section_path")) | is_blank(c("quote")) | (F.length("quote") > 1000)))
    if conflicts is not None:
        out = out.union(_broken(conflicts, 13, "conflict", "conflict_type", ~c("conflict_type").rlike(NAME) | is_blank(c("description")) | (F.length("description") > 1000) | _no_ids(c("evidence_ids"))))
    return out


def unique_ids(rows: DataFrame, item: str, order: int, rule: str) -> DataFrame:
    """Ids that a chunk gives twice, at the place where they first come again."""
    again = rows.groupBy("chunk_id", item).agg(F.sort_array(F.collect_list("pos")).alias("p")).filter(F.size("p") > 1).withColumn("pos", F.col("p")[1])
    return _broken(again, order, rule, item, F.lit(True))


def evidence_sources(evidences: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence of another document, chunk or section, or whose quote does not stand in the chunk; the first that fails."""
    own = chunks.select("chunk_id", F.col("document_id").alias("_d"), F.col("section_path").alias("_s"), "content")
    j = evidences.join(own, "chunk_id")
    rule = F.when(F.col("document_id") != F.col("_d"), "evidence document").when(F.col("source_chunk_id") != F.col("chunk_id"), "evidence chunk").when(F.col("section_path") != F.col("_s"), "evidence section").when(~F.contains("content", "quote"), "evidence quote")
    return j.withColumn("rule", rule).filter("rule is not null").select("chunk_id", F.lit(30).alias("rule_ord"), F.col("pos").cast("int").alias("item_ord"), "rule", F.col("evidence_id").alias("item"))


def references(rows: DataFrame, evidences: DataFrame, order: int, rule: str, item: str) -> DataFrame:
    """Evidence ids that the chunk does not have."""
    known = evidences.select("chunk_id", F.col("evidence_id").alias("_e"))
    each = rows.select("chunk_id", "pos", F.col(item).alias("_item"), F.explode("evidence_ids").alias("_e"))
    missing = each.join(known, ["chunk_id", "_e"], "left_anti").groupBy("chunk_id", "pos", "_item").count()
    return _broken(missing.withColumnRenamed("_item", item), order, rule, item, F.lit(True))


def endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations one of whose ends the chunk does not have."""
    ends = relations.select("chunk_id", "pos", "relation_type", F.explode(F.array("source_id", "target_id")).alias("candidate_id"))
    missing = ends.join(entities.select("chunk_id", "candidate_id"), ["chunk_id", "candidate_id"], "left_anti").groupBy("chunk_id", "pos", "relation_type").count()
    return _broken(missing, 40, "relation endpoint", "relation_type", F.lit(True))


def all_violations(chunks: DataFrame, entities: DataFrame, relations: DataFrame, evidences: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Violations of every rule, the later ones of a chunk also where an earlier one is broken."""
    blank = chunks.withColumn("pos", F.lit(0)).filter(is_blank(F.col("content")) | is_blank(F.col("document_id")) | is_blank(F.col("section_path")))
    out = _broken(blank, 1, "request", "chunk_id", F.lit(True)).union(constraints(entities, relations, evidences, conflicts))
    out = out.union(unique_ids(entities, "candidate_id", 20, "entity id twice")).union(unique_ids(evidences, "evidence_id", 21, "evidence id twice"))
    out = out.union(evidence_sources(evidences, chunks)).union(endpoints(relations, entities))
    out = out.union(references(relations, evidences, 41, "relation evidence", "relation_type")).union(references(entities, evidences, 42, "entity evidence", "candidate_id"))
    return out if conflicts is None else out.union(references(conflicts, evidences, 43, "conflict evidence", "conflict_type"))


def request_messages(requests: DataFrame, *fields: str) -> DataFrame:
    """Requests (id) with a blank field: a message for each, in order, joined by "; "."""
    broken = F.array_compact(F.array(*[F.when(is_blank(F.col(f)), F.lit(f"{f} must not be blank")) for f in fields]))
    return requests.select("id", F.array_join(F.array_sort(broken), "; ").alias("message")).filter("message <> ''")


def first_errors(violations: DataFrame, chunks: DataFrame) -> DataFrame:
    """The error that a document's run ends with: first chunk, then first rule, then first item."""
    placed = violations.join(chunks.select("chunk_id", "document_id", "chunk_ord"), "chunk_id")
    return placed.groupBy("document_id").agg(F.min(F.struct("chunk_ord", "rule_ord", "item_ord", "rule", "item")).alias("e")).select("document_id", "e.rule", "e.item", F.col("e.chunk_ord").alias("chunk_ord"))
