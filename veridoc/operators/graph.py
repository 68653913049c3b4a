"""The graph: candidates to nodes, edges and evidence, reviews, invalidation, and reads.

Tables are immutable; each write returns the new version of a table, so writing the same facts twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.sources import scratch


def node_id(space: Column, key: Column) -> Column:
    return text.uuid3("node", space, key)


def edge_id(space: Column, source: Column, relation: Column, target: Column) -> Column:
    return text.uuid3("edge", space, source, relation, target)


def first_entities(entities: DataFrame) -> DataFrame:
    """The first entity of each normalised key in a space, by chunk and place; ``sources`` are the documents of all."""
    keyed = entities.withColumn("normalized_key", text.normalized_key(F.col("type"), F.col("name")))
    at = F.struct("chunk_ord", "pos")
    return keyed.groupBy("space_id", "normalized_key").agg(
        F.min_by(F.struct("type", "name", "summary"), at).alias("e"), F.sort_array(F.collect_set("document_id")).alias("sources")).select("space_id", "normalized_key", "e.*", "sources")


def node_upsert(nodes: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """Nodes after the entities. New ones are active; known ones keep id, type, label and creation, gain sources, get the
    entity's summary where theirs is blank, and are newer only if sources or status changed. Of the known ones only stale
    ones become active; conflicts and orphans stay what they are."""
    found = first_entities(entities).select("space_id", "normalized_key", "type", F.col("name").alias("_name"), F.col("summary").alias("_summary"), F.col("sources").alias("_new"))
    j = nodes.join(found, ["space_id", "normalized_key"], "full")
    new, seen = F.col("id").isNull(), F.col("_new").isNotNull()
    sources = F.when(new, F.col("_new")).when(seen, F.concat("source_ids", F.array_except("_new", "source_ids"))).otherwise(F.col("source_ids"))
    revived = seen & (F.col("status") == "stale")
    status = F.when(new | revived, "active").otherwise(F.col("status"))
    fill = seen & text.is_blank(F.col("summary")) & F.col("_summary").isNotNull()
    summary = F.when(new, text.or_default(F.col("_summary"), text.strip(F.col("_name")))).when(fill, text.strip(F.col("_summary"))).otherwise(F.col("summary"))
    moved = seen & ~new & ((F.size(sources) != F.size("source_ids")) | revived)
    return j.select(
        F.coalesce("id", node_id(F.col("space_id"), F.col("normalized_key"))).alias("id"), "space_id", F.coalesce("node_type", F.lower("type")).alias("node_type"),
        F.coalesce("label", text.strip(F.col("_name"))).alias("label"), summary.alias("summary"), status.alias("status"), "normalized_key", sources.alias("source_ids"),
        F.coalesce("created_at", now).alias("created_at"), F.when(new | moved, now).otherwise(F.col("updated_at")).alias("updated_at"))


def resolved(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the ids of their nodes and edge; candidate ids count within their chunk, the
    last entity of several with one id counts, and a missing end drops the relation."""
    ends = entities.groupBy("chunk_id", "candidate_id").agg(F.max_by(node_id(F.col("space_id"), text.normalized_key(F.col("type"), F.col("name"))), "pos").alias("node"))
    j = relations.join(ends.withColumnsRenamed({"candidate_id": "source_id", "node": "source_node_id"}), ["chunk_id", "source_id"])
    j = j.join(ends.withColumnsRenamed({"candidate_id": "target_id", "node": "target_node_id"}), ["chunk_id", "target_id"])
    return j.withColumn("edge_id", edge_id(F.col("space_id"), F.col("source_node_id"), F.col("relation_type"), F.col("target_node_id")))


def edge_upsert(edges: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Edges after resolved relations: an edge with the same ends and type, whatever its status, stays as it is."""
    mark = ["space_id", "source_node_id", "target_node_id", "relation_type"]
    first = found.groupBy(*mark).agg(F.min_by("confidence", F.struct("chunk_ord", "pos")).alias("confidence"), F.first("edge_id").alias("id"))
    new = first.join(edges.select(*mark), mark, "left_anti").select("id", *mark, F.lit("suggested").alias("status"), "confidence", now.alias("created_at"), now.alias("updated_at"))
    return edges.unionByName(new)


def evidence_upsert(known: DataFrame, found: DataFrame, evidences: DataFrame, now: Column) -> DataFrame:
    """Evidence after resolved relations: one row for an edge, document, section and quote. The first evidence of an id in a
    chunk counts, and only if it is of the relation's document."""
    each = found.select("space_id", "chunk_id", "edge_id", "document_id", F.explode("evidence_ids").alias("evidence_id"))
    quotes = evidences.groupBy("chunk_id", "evidence_id").agg(F.min_by(F.struct("document_id", "section_path", "quote"), "pos").alias("q"))
    j = each.join(quotes, ["chunk_id", "evidence_id"]).filter(F.col("q.document_id") == F.col("document_id")).select("space_id", "edge_id", F.col("document_id").alias("source_document_id"), F.col("q.section_path").alias("locator"), F.col("q.quote").alias("quote"))
    made = j.withColumn("id", text.uuid3("evidence", F.col("edge_id"), F.col("source_document_id"), F.col("locator"), F.col("quote"))).dropDuplicates(["id"])
    new = made.join(known.select("id"), "id", "left_anti").select("id", "space_id", "edge_id", "source_document_id", "quote", "locator", F.lit("ai").alias("extraction_method"), now.alias("created_at"))
    return known.unionByName(new)


def reviewed(edges: DataFrame, items: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Edges after review items (item_ord, chunk_id, relation_index, action); of several for an edge the last one counts."""
    placed = items.join(found.select("chunk_id", F.col("pos").alias("relation_index"), F.col("edge_id").alias("id")), ["chunk_id", "relation_index"])
    last = placed.groupBy("id").agg(F.max_by("action", "item_ord").alias("_action"))
    status = F.when(F.col("_action") == "ACCEPT", "confirmed").when(F.col("_action") == "REJECT", "rejected")
    return edges.join(last, "id", "left").withColumn("updated_at", F.when(status.isNotNull(), now).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce(status, "status")).drop("_action")


def audit_rows(items: DataFrame, found: DataFrame, operator: str | None, now: Column) -> DataFrame:
    """One row for each review item."""
    placed = items.join(found.select("chunk_id", F.col("pos").alias("relation_index"), "edge_id", "space_id"), ["chunk_id", "relation_index"])
    return placed.select("item_ord", "space_id", "edge_id", F.lower("action").alias("action"), text.or_default(F.col("reason"), F.lit(None).cast("string")).alias("reason"), text.or_default(F.lit(operator).cast("string"), F.lit("local-user")).alias("operator_name"), now.alias("created_at"))


def review_states(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Decision on each relation of a stored result; those without one are left out."""
    j = found.join(edges.select(F.col("id").alias("edge_id"), F.col("status").alias("_s")), "edge_id")
    state = F.when(F.col("_s") == "confirmed", "ACCEPT").when(F.col("_s") == "rejected", "REJECT")
    return j.withColumn("action", state).filter("action is not null").select("chunk_id", F.col("pos").alias("relation_index"), "action")


def pending_relations(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Relation candidates of each document whose edge is still only suggested; each candidate counts."""
    open_ = edges.filter("status = 'suggested'").select(F.col("id").alias("edge_id"))
    return found.join(open_, "edge_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("pending"))


def invalidated(nodes: DataFrame, edges: DataFrame, evidences: DataFrame, docs: DataFrame, deleted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the documents of ``deleted`` (id) are gone; ``docs`` (id, status) is as it is after that.

    Nodes that are not stale lose them as sources and are stale without any left. Edges become stale if an end has become
    stale, or if they have evidence of a deleted document and none of an active one. ``updated_at`` of what changes is
    ``now``. Facts without sources or evidence are left alone.
    """
    gone = deleted.select(F.col("id").alias("_d")).distinct()
    hit = nodes.filter("status <> 'stale'").select("id", F.posexplode("source_ids").alias("_p", "_d")).join(gone.withColumn("_gone", F.lit(True)), "_d", "left")
    left = hit.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("_gone").isNull(), F.struct("_p", "_d")))).alias("_left"), F.count("_gone").alias("_lost")).filter("_lost > 0")
    after = nodes.join(left, "id", "left").select(*[
        F.when(F.size("_left") == 0, "stale").otherwise(F.col("status")).alias(c) if c == "status" else F.coalesce(F.col("_left._d"), "source_ids").alias(c) if c == "source_ids"
        else F.when(F.col("_lost") > 0, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in nodes.columns])
    dead = left.filter(F.size("_left") == 0).select(F.col("id").alias("_n"))
    ends = edges.select("id", F.explode(F.array("source_node_id", "target_node_id")).alias("_n")).join(dead, "_n", "left_semi").select("id")
    stale = ends.union(unsupported_edges(edges, evidences, docs, deleted).select("id")).distinct().withColumn("_stale", F.lit(True))
    falls = F.col("_stale") & (F.col("status") != "stale")
    marked = edges.join(stale, "id", "left").select(*[
        F.when(falls, "stale").otherwise(F.col(c)).alias(c) if c == "status" else F.when(falls, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in edges.columns])
    return after, marked


def unsupported_edges(edges: DataFrame, evidences: DataFrame, docs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges with evidence of a deleted document and none of an active one."""
    at = F.col("source_document_id")
    lost = evidences.join(deleted.select(F.col("id").alias("source_document_id")), "source_document_id", "left_semi").select(F.col("edge_id").alias("id")).distinct()
    live = evidences.join(docs.filter("status = 'active'").select(F.col("id").alias("_doc")), at == F.col("_doc"), "left_semi").select(F.col("edge_id").alias("id"))
    return edges.filter("status <> 'stale'").join(lost, "id", "left_semi").join(live, "id", "left_anti")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are not stale, confirmed edges, suggested edges, and a message."""
    n = nodes.agg(F.count_if(F.col("status") != "stale").alias("nodes"))
    e = edges.agg(F.count_if(F.col("status") == "confirmed").alias("edges"), F.count_if(F.col("status") == "suggested").alias("pending"))
    # both sides are one row
    return n.crossJoin(e).withColumn("message", F.when(F.col("nodes") == 0, "empty graph").otherwise("ready"))


def edges_with_evidence(edges: DataFrame, evidences: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges that are not stale, each with its evidence in order, an empty list without any. Evidence of deleted documents stays."""
    named = evidences.join(docs.select(F.col("id").alias("source_document_id"), F.col("name").alias("document_name")), "source_document_id")
    listed = named.groupBy(F.col("edge_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("created_at", F.col("id").alias("evidence_id"), "document_name", "quote"))).alias("evidences"))
    fields = "array<struct<created_at:%s,evidence_id:%s,document_name:string,quote:string>>" % (dict(evidences.dtypes)["created_at"], dict(evidences.dtypes)["id"])
    return edges.filter("status <> 'stale'").join(listed, "id", "left").withColumn("evidences", F.coalesce("evidences", F.array().cast(fields)))


def search_nodes(nodes: DataFrame, keyword: str) -> DataFrame:
    k = keyword.strip().lower()
    return nodes.filter(F.contains(F.lower(F.concat_ws(" ", "label", "summary")), F.lit(k))) if k else nodes


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that are not rejected, both of whose ends are among ``nodes``."""
    shown = nodes.select("id")
    return edges.filter("status <> 'rejected'").join(shown.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi").join(shown.withColumnRenamed("id", "target_node_id"), "target_node_id", "left_semi")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, edge, other end) in both directions, with the other end's label or id."""
    way = lambda a, b: F.struct(F.col(a).alias("node_id"), F.col("id").alias("edge_id"), F.col(b).alias("other_id"))
    there, back = way("source_node_id", "target_node_id"), way("target_node_id", "source_node_id")
    ways = F.when(F.col("source_node_id") != F.col("target_node_id"), F.array(there, back)).otherwise(F.array(there))
    both = edges.select(F.inline(ways))  # edges are made once, not once for each direction
    return both.join(nodes.select(F.col("id").alias("other_id"), "label"), "other_id", "left").select("node_id", "edge_id", "other_id", F.coalesce("label", "other_id").alias("other_label"))


def incident(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).distinct()


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes marked orphan, or that no confirmed edge touches."""
    touched = incident(edges.filter("status = 'confirmed'")).withColumn("_t", F.lit(True))
    return nodes.join(touched, "id", "left").filter((F.col("status") == "orphan") | F.col("_t").isNull()).drop("_t")


def pending_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Suggested edges as "source → target"."""
    label = nodes.select("id", "label")
    j = edges.filter("status = 'suggested'").select(F.col("id").alias("edge_id"), "source_node_id", "target_node_id")
    j = j.join(label.withColumnsRenamed({"id": "source_node_id", "label": "_s"}), "source_node_id", "left").join(label.withColumnsRenamed({"id": "target_node_id", "label": "_t"}), "target_node_id", "left")
    return j.select("edge_id", F.concat(F.coalesce("_s", "source_node_id"), F.lit(" → "), F.coalesce("_t", "target_node_id")).alias("title"))


def issue_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Isolated nodes, conflict nodes and suggested edges, added up."""
    rows = isolated_nodes(nodes, edges).select(F.lit(1).alias("x")).union(nodes.filter("status = 'conflict'").select(F.lit(1))).union(edges.filter("status = 'suggested'").select(F.lit(1)))
    return rows.agg(F.count("*").alias("issues"))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once; a primary or unique key has none. Null keys do not count."""
    return rows.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Rows whose reference has no parent."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col("id").alias(column)), column, "left_anti")


# Which column of which table refers to which other table.
REFERENCES = (
    ("import_batches", "space_id", "knowledge_spaces"), ("source_documents", "space_id", "knowledge_spaces"), ("source_documents", "batch_id", "import_batches"), ("graph_nodes", "space_id", "knowledge_spaces"),
    ("graph_edges", "space_id", "knowledge_spaces"), ("graph_edges", "source_node_id", "graph_nodes"), ("graph_edges", "target_node_id", "graph_nodes"),
    ("evidences", "space_id", "knowledge_spaces"), ("evidences", "edge_id", "graph_edges"), ("evidences", "source_document_id", "source_documents"),
    ("extraction_runs", "space_id", "knowledge_spaces"), ("extraction_runs", "source_document_id", "source_documents"), ("review_records", "space_id", "knowledge_spaces"), ("review_records", "edge_id", "graph_edges"),
)


def broken_references(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, key and rows of all references that have no parent, over those of the schema whose tables are given. What
    is looked for is each different value once, so a value that most rows have is one row of the join. A null refers to nothing."""
    out = None
    for child, column, parent in REFERENCES:
        if child in tables and parent in tables and column in tables[child].columns:
            values = tables[child].filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("rows"))
            lost = values.join(tables[parent].select(F.col("id").cast("string").alias("key")), "key", "left_anti").select(F.lit(child).alias("table"), F.lit(column).alias("column"), "key", "rows")
            out = lost if out is None else out.union(lost)
    return out


def within_hops(edges: DataFrame, start: DataFrame, hops: int, types: tuple[str, ...] | None = None, nodes: int | None = None, fan: int | None = None) -> DataFrame:
    """``id`` and ``hop`` of all nodes that confirmed edges, of the types if given, reach from ``start`` (id) in at most ``hops`` steps.

    ``fan`` keeps of each node's neighbours only the first so many, those with most edges, ties to the smaller id; a hub's are
    chosen before any join, so none is multiplied. ``nodes`` keeps of each hop the first so many new nodes in the same order.
    Both orders depend on the graph only, so reruns agree. The nodes of each hop are written, so a further hop costs one join
    of what the last one added.
    """
    used = edges.filter("status = 'confirmed'")
    used = used.filter(F.col("relation_type").isin(*types)) if types else used
    both = used.select(F.col("source_node_id").alias("id"), F.col("target_node_id").alias("next"))
    both = both.union(both.select(F.col("next").alias("id"), F.col("id").alias("next"))).distinct()
    degree = None
    if nodes is not None or fan is not None:
        both = scratch.keep(both, "neighbours")
        degree = scratch.keep(both.groupBy(F.col("id").alias("next")).agg(F.count("*").alias("degree")), "degrees")
    if fan is not None:
        # heads of random parts first, so that a hub's neighbours do not meet in one task
        order = (F.desc("degree"), "next")
        part = Window.partitionBy("id", F.pmod(F.xxhash64("next"), F.lit(64))).orderBy(*order)
        heads = both.join(degree, "next").withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= fan)
        both = heads.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("_n") <= fan).select("id", "next")
        both = scratch.keep(both, "fans")
    seen = scratch.keep(start.select("id").distinct().withColumn("hop", F.lit(0)), "hops")
    for h in range(1, hops + 1):
        more = seen.filter(F.col("hop") == h - 1).join(both, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
        if nodes is not None:
            ranked = more.join(degree.withColumnRenamed("next", "id"), "id").orderBy(F.desc("degree"), "id")
            more = ranked.limit(nodes)  # each task sends its own first so many
        seen = scratch.keep(seen.union(more.select("id", F.lit(h).alias("hop"))), "hops")
    return seen


def soft_deleted(rows: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Rows with the active ones among ``ids`` marked deleted."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    gone = F.col("_hit") & (F.col("status") == "active")
    return rows.join(hit, "id", "left").withColumn("updated_at", F.when(gone, now).otherwise(F.col("updated_at"))).withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))).drop("_hit")


def fused(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows of query_id, id, rank from several channels."""
    return ranked.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """How each path (path, hash) of two versions changed: added, removed, changed or same."""
    j = old.withColumnRenamed("hash", "_a").join(new.withColumnRenamed("hash", "_b"), "path", "full")
    return j.select("path", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "same").otherwise("changed").alias("change"))


def precision_recall(judged: DataFrame) -> DataFrame:
    """Precision, recall and F1 of ``chosen`` against ``truth``; null without a chosen or a true row."""
    hit = F.count_if(F.col("truth") & F.col("chosen"))
    p, r = hit / F.nullif(F.count_if("chosen"), F.lit(0)), hit / F.nullif(F.count_if("truth"), F.lit(0))
    return judged.agg(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"))
