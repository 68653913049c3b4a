"""More queries by name: lookups, spaces, runs, integrity and retrieval, in both languages as in the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.operators import extract, graph, health, ingest, listing, nearest, records, retrieval, runs, search, segment, validate
from veridoc.plans.catalog import EDGE, KEYED, LATEST, NODE, _found, _reviewed, _reviews, now, query
from veridoc.sources import files, scratch
from veridoc.streaming import events, machines

c = F.col


# ---- lookups and projections
@query("SELECT id, space_id, batch_id, name, content_hash, status, file_size, imported_at, updated_at FROM v_document WHERE space_id = 'en' AND id = '34' AND status = 'active'")
def document_by_id(v):
    return records.public(records.document(v("v_document"), "en", "34"))


@query("SELECT id, space_id, batch_id, name, content_hash, status, file_size, imported_at, updated_at FROM v_document")
def documents_public(v):
    return records.public(v("v_document"))


@query("SELECT r.id, r.document_id, r.status FROM v_run r WHERE id = '1' AND document_id = '46'")
def run_by_key(v):
    return records.run(v("v_run").withColumn("space_id", F.lit("s")), "s", "46", "1").select("id", "document_id", "status")


@query("SELECT id, space_id, row_number() OVER (PARTITION BY space_id ORDER BY imported_at DESC, id DESC) AS n FROM v_document WHERE status = 'active'")
def documents_by_import(v):
    return records.in_order(v("v_document").filter("status = 'active'"), "space_id", F.desc("imported_at"), F.desc("id")).select("id", "space_id", "n")


@query("SELECT id, node_type, row_number() OVER (PARTITION BY node_type ORDER BY normalized_key, id) AS n FROM v_node WHERE status <> 'stale'")
def graph_nodes_scan(v):
    return records.in_order(v("v_node").filter("status <> 'stale'"), "node_type", c("normalized_key"), c("id")).select("id", "node_type", "n")


@query("SELECT source_node_id, target_node_id, arg_max(id, struct_pack(a := updated_at, b := id)) AS id FROM (SELECT concat('s', CAST(l_suppkey AS STRING)) AS source_node_id, concat('p', CAST(l_partkey AS STRING)) AS target_node_id, l_shipdate AS updated_at, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id FROM lineitem) GROUP BY 1, 2")
def edge_by_signature(v):
    rows = v("lineitem").select(
        F.lit("x").alias("space_id"), F.concat(F.lit("s"), c("l_suppkey").cast("string")).alias("source_node_id"), F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("target_node_id"),
        F.lit("supplies").alias("relation_type"), c("l_shipdate").alias("updated_at"), F.concat(c("l_orderkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string")).alias("id"))
    return records.newest_edges(rows).select("source_node_id", "target_node_id", "id")


@query("SELECT id, status FROM v_node WHERE status <> 'stale' AND normalized_key IN (SELECT lower(concat('feature:', p_name)) FROM part WHERE p_size > 25)")
def nodes_by_keys(v):
    keys = v("part").filter("p_size > 25").select(F.lit("x").alias("space_id"), F.lower(F.concat(F.lit("feature:"), "p_name")).alias("normalized_key"))
    return records.nodes_by_keys(v("v_node").withColumn("space_id", F.lit("x")), keys).select("id", "status")


@query("SELECT id, CASE status WHEN 'confirmed' THEN '已采纳' WHEN 'suggested' THEN '待审核' WHEN 'rejected' THEN '已拒绝' ELSE '已失效' END AS state, '关联' AS relation FROM v_edge")
def edge_labels(v):
    state, relation = records.labels(records.STATUS, c("status"), c("status")), records.labels(records.RELATION, c("relation_type"), F.lit(records.OTHER))
    return v("v_edge").select("id", state.alias("state"), relation.alias("relation"))


@query("SELECT n.id AS node_id, s.document_id, coalesce(d.name, s.document_id) AS label FROM v_node n LEFT JOIN v_source s ON s.id = n.id LEFT JOIN (SELECT * FROM v_evdoc WHERE status <> 'deleted') d ON d.id = s.document_id")
def node_source_names(v):
    lists = v("v_source").groupBy("id").agg(F.sort_array(F.collect_list("document_id")).alias("source_ids"))
    nodes = v("v_node").join(lists, "id", "left")
    return records.node_sources(nodes, v("v_evdoc").filter("status <> 'deleted'")).select("node_id", "document_id", "label")


@query("SELECT id, CASE WHEN status = 'deleted' THEN 'old' ELSE 'new' END AS origin, imported_at AS place FROM v_document")
def pages_merged_in_order(v):
    docs = v("v_document")
    old = docs.select("id", F.lit("old").alias("origin"), c("imported_at").alias("place"))
    return listing.merged(old, docs.filter("status = 'active'").select("id", F.lit("new").alias("origin"), F.lit(-1).cast("long").alias("place")), "id", "place")


@query("SELECT space_id, least(count(*), 36) AS loaded FROM v_document WHERE status = 'active' GROUP BY space_id")
def loaded_count(v):
    return v("v_document").filter("status = 'active'").groupBy("space_id").agg(F.count("*").alias("t")).select("space_id", listing.loaded(c("t"), 3).alias("loaded"))


@query("SELECT id, CASE WHEN space_id = 'en' THEN 'prd' WHEN space_id = 'de' THEN 'general' END AS kind FROM v_document")
def document_type(v):
    given = F.when(c("space_id") == "en", " PRD ").when(c("space_id") == "de", "  ").otherwise("letter")
    return v("v_document").select("id", ingest.document_type(given).alias("kind"))


# ---- spaces and migration
@query("WITH r AS (SELECT doc_id AS ord, CASE WHEN source = 'src1' THEN 'space es' WHEN source = 'src2' THEN 'space en' ELSE source END AS name FROM documents) SELECT ord, name, ord = min(ord) OVER (PARTITION BY name) AND name NOT IN (SELECT name FROM v_space WHERE status = 'active') AS accepted FROM r")
def space_create(v):
    name = F.when(c("source") == "src1", "space es").when(c("source") == "src2", "space en").otherwise(c("source"))
    asked = v("documents").select(c("doc_id").alias("ord"), F.lit("new").alias("id"), F.concat(F.lit("  "), name, F.lit(" ")).alias("name"), F.lit(" ").alias("description"))
    return records.created_spaces(v("v_space"), asked, now()).filter("description is null").select("ord", "name", "accepted")


@query("SELECT id, CASE WHEN id = 'fr' OR status = 'deleted' THEN 'deleted' ELSE 'active' END AS status, id = 'fr' AS moved FROM v_space")
def space_delete(v):
    spaces = v("v_space").withColumn("updated_at", F.timestamp_seconds(F.lit(0)))
    gone = spaces.filter("id in ('fr', 'es')")
    return records.deleted_spaces(spaces, gone, now()).select("id", "status", (c("updated_at") == now()).alias("moved"))


def _ownerless(v):
    return v("v_document").withColumn("space_id", F.when(c("space_id") == "fr", F.lit(None)).when(c("space_id") == "es", "").otherwise(c("space_id")))


@query("SELECT (SELECT count(*) FROM v_document WHERE space_id IN ('fr', 'es')) + (SELECT count(DISTINCT batch_id) FROM v_document WHERE space_id IN ('fr', 'es')) AS n")
def legacy_count(v):
    docs = _ownerless(v)
    return records.ownerless(docs, docs.select("batch_id", F.coalesce("space_id", F.lit("")).alias("space_id")).distinct())


@query("SELECT id, CASE WHEN space_id IN ('fr', 'es') THEN 'legacy' ELSE space_id END AS space_id FROM v_document")
def legacy_adopted(v):
    return records.adopted(_ownerless(v), "legacy").select("id", "space_id")


# ---- runs, reviews, summaries
@query("""WITH u AS (SELECT CAST(user_id AS STRING) AS id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'plan' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END AS kind, ts FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
 l AS (SELECT id, arg_max(kind, seq) FILTER (kind <> 'plan') AS e, max(seq) FILTER (kind <> 'fail') AS n, max(seq) FILTER (kind = 'complete') AS d, max(seq) FILTER (kind <> 'plan') AS z FROM u GROUP BY id)
SELECT id, CASE e WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'processing' END AS status, n AS section_count, n * 2 AS chunk_count, CASE WHEN d IS NOT NULL THEN concat('summary ', CAST(d AS STRING)) END AS document_summary,
 CASE WHEN e = 'fail' THEN concat('error ', CAST(z AS STRING)) END AS error_message FROM l""")
def run_lifecycle(v):
    e = v("events").filter("event_type in ('signup', 'purchase', 'error')")
    kind = F.when(c("event_type") == "signup", "plan").when(c("event_type") == "purchase", "complete").otherwise("fail")
    said = lambda what, k: F.when(kind == k, F.concat(F.lit(what), c("event_id").cast("string")))
    updates = e.select(c("user_id").cast("string").alias("id"), c("event_id").alias("seq"), kind.alias("kind"), c("event_id").alias("sections"), (c("event_id") * 2).alias("chunks"), said("summary ", "complete").alias("summary"), said("error ", "fail").alias("error"), c("ts").alias("at"))
    started = updates.groupBy("id").agg(F.min("at").alias("created_at"))
    return runs.applied(started, updates).drop("created_at", "completed_at")


@query("SELECT document_id, string_agg(concat('- ', section_path, '（', chunk_id, '）：', trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), chr(10)), '' ORDER BY chunk_ord) AS context FROM v_chunk GROUP BY document_id")
def summary_context(v):
    return runs.summary_context(v("v_chunk").withColumn("summary", c("content")))


@query("""WITH s AS (SELECT chunk_id, section_path, CASE WHEN section_path = 'system' THEN ' ' ELSE trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) END AS x FROM v_chunk), e AS (SELECT *, CASE WHEN conv_failed THEN 'AI 全文摘要生成失败，已保留候选事实' WHEN trim(x) = '' THEN 'AI 未生成有效的全文摘要' WHEN length(x) > 160 THEN '全文摘要超过 160 个字符' END AS error FROM (SELECT *, contains(x, 'le') AS conv_failed FROM s))
SELECT chunk_id, CASE WHEN error IS NULL THEN x END AS summary, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error FROM e""")
def summary_outcome(v):
    x = F.when(c("section_path") == "system", " ").otherwise(c("content"))
    failed = F.contains(text.collapsed(x), F.lit("le"))
    return v("v_chunk").select("chunk_id", runs.summary_outcome(x, failed).alias("o")).select("chunk_id", "o.*")


@query("SELECT document_id, count(*) FILTER (conv_id % 2 = 0) AS accepted, count(*) FILTER (conv_id % 2 <> 0) AS rejected FROM v_chunk WHERE section_path = 'assistant' GROUP BY document_id")
def review_counts(v):
    items = _reviews(v).join(v("v_chunk").select("chunk_id", "document_id"), "chunk_id")
    return runs.review_counts(items, "document_id")


@query(KEYED + """, item AS (SELECT e.edge_id, k.chunk_ord, CASE WHEN k.conv_id % 2 = 0 THEN 'ACCEPT' ELSE 'REJECT' END AS s, row_number() OVER (PARTITION BY edge_id ORDER BY k.chunk_ord DESC) AS r FROM e JOIN v_chunk k ON k.chunk_id = e.chunk_id WHERE k.section_path = 'assistant'),
 st AS (SELECT v_relation.document_id, s FROM v_relation LEFT JOIN e ON e.chunk_id = v_relation.chunk_id AND e.pos = v_relation.pos LEFT JOIN item ON item.edge_id = e.edge_id AND r = 1)
SELECT document_id, count(*) AS relations, count(s) AS reviewed, count(*) FILTER (s = 'ACCEPT') AS accepted, count(*) FILTER (s = 'REJECT') AS rejected, count(*) - count(s) AS pending, count(*) = count(s) AS complete FROM st GROUP BY document_id""")
def review_panel(v):
    return runs.review_panel(v("v_relation"), graph.review_states(_reviewed(v), _found(v)[0]))


@query("SELECT document_id, CAST(sum(e) AS BIGINT) AS entities, CAST(sum(r) AS BIGINT) AS relations FROM (SELECT document_id, 1 AS e, 0 AS r FROM v_entity UNION ALL SELECT document_id, 0, 1 FROM v_relation) GROUP BY 1")
def result_totals(v):
    return runs.totals(v("v_entity"), v("v_relation"))


@query("SELECT document_id, string_agg(CASE WHEN conv_id = last_ THEN concat('new ', chunk_id) ELSE chunk_id END, ',' ORDER BY (chunk_id = last_chunk), chunk_ord) AS listed FROM (SELECT *, NULL AS last_, max_by(chunk_id, chunk_ord) OVER (PARTITION BY document_id) AS last_chunk FROM v_chunk) GROUP BY 1".replace("CASE WHEN conv_id = last_ THEN concat('new ', chunk_id) ELSE chunk_id END", "CASE WHEN chunk_id = first_chunk THEN concat('new ', chunk_id) ELSE chunk_id END").replace("(chunk_id = last_chunk)", "(chunk_id = first_chunk)").replace("NULL AS last_, max_by(chunk_id, chunk_ord)", "min_by(chunk_id, chunk_ord)").replace("AS last_chunk", "AS first_chunk"))
def chunk_replacement(v):
    held = v("v_chunk").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_ord", "chunk_id"))).alias("l")).select("document_id", F.transform("l", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["chunk_id"].alias("shown"))).alias("chunks"))
    new = F.struct(c("chunks")[0]["chunk_id"].alias("chunk_id"), F.concat(F.lit("new "), c("chunks")[0]["chunk_id"]).alias("shown"))
    return held.select("document_id", F.array_join(runs.replaced(c("chunks"), new)["shown"], ",").alias("listed"))


@query(f"WITH latest AS ({LATEST}) SELECT d.id FROM v_document d LEFT JOIN latest ON d.id = document_id WHERE latest_status = 'processing' OR (document_id IS NULL AND batch_id = 'src3')")
def polling_open(v):
    docs = v("v_document")
    return runs.still_open(docs, docs.filter("batch_id = 'src3'"), listing.latest_runs(v("v_run")))


# ---- requests, context, functions
@query("SELECT chunk_id AS id, concat_ws('; ', CASE WHEN section_path = 'system' THEN 'content must not be blank' END, CASE WHEN conv_id < 5 THEN 'document_id must not be blank' END) AS message FROM v_chunk WHERE section_path = 'system' OR conv_id < 5")
def request_messages(v):
    rows = v("v_chunk").select(c("chunk_id").alias("id"), F.when(c("conv_id") < 5, " ").otherwise(c("document_id")).alias("document_id"), F.when(c("section_path") == "system", "\t").otherwise(c("content")).alias("content"))
    return validate.request_messages(rows, "document_id", "content")


@query("""SELECT chunk_id, concat('promptVersion: v1', chr(10), 'schemaVersion: 2', chr(10), 'sourceDocumentId: ', document_id, chr(10), 'documentName: ', coalesce(d.name, 'null'), chr(10), 'documentType: ', coalesce(d.batch_id, 'null'), chr(10), 'chunkId: ', chunk_id, chr(10), 'sectionPath: ', section_path, chr(10), chr(10),
 '原文开始：', chr(10), content, chr(10), '原文结束。', chr(10)) AS context FROM v_chunk k LEFT JOIN (SELECT DISTINCT id, name, batch_id FROM v_document) d ON d.id = k.document_id""")
def prompt_context(v):
    docs = v("v_document").select(c("id").alias("document_id"), c("name").alias("document_name"), c("batch_id").alias("document_type")).distinct()
    parts = v("v_chunk").withColumn("content_text", c("content")).join(docs, "document_id", "left")
    return segment.prompt_context(parts, "v1", "2").select("chunk_id", "context")


@query("SELECT id, list_aggregate(list_sort(ids), 'string_agg', ',') AS listed, len(ids) AS n FROM (SELECT id, CASE WHEN list_contains(d, 'x') THEN d ELSE list_append(d, 'x') END AS ids FROM (SELECT chunk_id AS id, list_filter([document_id, section_path, 'x'], lambda y: y <> CASE WHEN conv_id < 50 THEN 'x' ELSE 'user' END) AS d FROM v_chunk))")
def array_and_json_round_trip(v):
    ids = F.array_remove(F.array(c("document_id"), c("section_path"), F.lit("x")), F.when(c("conv_id") < 50, "x").otherwise("user"))
    back = text.from_json_list(text.to_json_list(text.appended(ids, F.lit("x"))))
    return v("v_chunk").select(c("chunk_id").alias("id"), F.array_join(F.array_sort(back), ",").alias("listed"), F.size(back).cast("long").alias("n"))


@query("SELECT event_id AS id, strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events")
def iso_times(v):
    made = text.iso(c("ts"))
    return v("events").select(c("event_id").alias("id"), made.alias("iso"), F.unix_millis(text.from_iso(made)).alias("ms"))


@query("SELECT id, content_hash AS hash, updated_at FROM v_document WHERE space_id = 'de'")
def document_hashes_of_space(v):
    return v("v_document").filter("space_id = 'de'").select("id", F.sha2(c("content_text").cast("binary"), 256).alias("hash"), "updated_at")


@query("SELECT e.id, concat('[[', s.label, ']] ', relation_type, ' [[', t.label, ']]') AS line FROM v_edge e JOIN v_node s ON s.id = source_node_id JOIN v_node t ON t.id = target_node_id WHERE e.status = 'confirmed'")
def wiki_export(v):
    return files.wiki_lines(v("v_node"), v("v_edge"))


@query("""WITH f AS (SELECT chunk_id, section_path, length(section_path) + length(chunk_id) AS n, chunk_id AS c, section_path AS p, conv_id FROM v_chunk), x AS (SELECT chunk_id AS document_id, p AS title, 1 AS level, p AS section_path, 0 AS start_offset FROM f
 UNION ALL SELECT chunk_id, c, 2, concat(p, ' > ', c), length(p) + 3 + 17 FROM f UNION ALL SELECT chunk_id, 'deep', 6, concat(p, ' > ', c, ' > deep'), length(p) + 3 + 17 + 3 + length(c) + 4 FROM f UNION ALL SELECT chunk_id, 'next', 2, concat(p, ' > next'), length(p) + 3 + 17 + 3 + length(c) + 4 + 12 FROM f)
SELECT document_id, title, CAST(level AS INTEGER) AS level, section_path, CAST(start_offset AS INTEGER) AS start_offset FROM x""")
def fenced_sections(v):
    """Headings in fences do not count, one fence does not close the other, and an open fence hides all that follows."""
    body = F.concat(F.lit("# "), "section_path", F.lit("\n```\n# hidden\n```\n## "), "chunk_id", F.lit(" ##\n###### deep\n## next\n~~~\n# no\n```\n# no\n"), "content")
    return segment.sections(v("v_chunk").select(c("chunk_id").alias("id"), body.alias("content_text"))).select("document_id", "title", "level", "section_path", "start_offset")


# ---- events
@query("""WITH x AS (SELECT document_id AS run_id, 1 AS phase, chunk_ord, 0 AS k, 'chunk_started' AS event, chunk_id FROM v_chunk UNION ALL SELECT document_id, 1, chunk_ord, 1, 'chunk_completed', chunk_id FROM v_chunk
 UNION ALL SELECT DISTINCT document_id, 0, 0, 0, 'run_started', NULL FROM v_chunk UNION ALL SELECT DISTINCT document_id, 2, 0, 0, 'document_summary_started', NULL FROM v_chunk UNION ALL SELECT DISTINCT document_id, 2, 0, 1, 'document_summary_completed', NULL FROM v_chunk UNION ALL SELECT DISTINCT document_id, 2, 0, 2, 'completed', NULL FROM v_chunk)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY phase, chunk_ord, k) - 1 AS seq, event, chunk_id FROM x""")
def event_sequence(v):
    return events.produced(v("v_chunk").select(c("document_id").alias("run_id"), "chunk_id", "chunk_ord"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM v_event WHERE event IN ('completed', 'error')) SELECT run_id, concat('at ', CAST(seq AS STRING)) AS message, delta = '' AS recoverable FROM f WHERE n = 1 AND event = 'error'""")
def run_failures(v):
    return events.failures(v("v_event").withColumn("message", F.concat(F.lit("at "), c("seq").cast("string"))).withColumn("recoverable", c("delta") == ""))


# The rows of SQL walk a workflow's events one by one; a step's machine is named by it, a workflow's by ''.
_MOVES = ", ".join(f"('{k}', '{a}', '{b}')" for k, table in machines.MOVES.items() for a, to in table.items() for b in to)
WALKED = f"""WITH RECURSIVE moves(kind, a, b) AS (VALUES {_MOVES}),
 s AS (SELECT user_id AS workflow_id, props AS key, event_id AS seq, CASE WHEN event_type <> 'click' THEN event_type END AS step,
   CASE WHEN event_type = 'click' THEN CASE WHEN value > 30 THEN 'COMPLETED' WHEN value > 20 THEN 'WAITING_HUMAN' WHEN value > 15 THEN 'RETRY_SCHEDULED' ELSE 'RUNNING' END
     ELSE CASE WHEN value > 20 THEN 'FAILED' WHEN value > 5 THEN 'RUNNING' WHEN value > 1 THEN 'SUCCEEDED' ELSE 'SKIPPED' END END AS status FROM events),
 o AS (SELECT *, coalesce(step, '') AS machine, CASE WHEN step IS NULL THEN 'run' ELSE 'step' END AS kind FROM s QUALIFY row_number() OVER (PARTITION BY workflow_id, key ORDER BY seq) = 1),
 n AS (SELECT *, row_number() OVER (PARTITION BY workflow_id, machine ORDER BY seq) AS n FROM o),
 w AS (SELECT workflow_id, machine, step, kind, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS status, '' AS state_before, CASE kind WHEN 'run' THEN 'CREATED' ELSE 'PENDING' END AS state_after, true AS legal FROM n WHERE n = 1
   UNION ALL SELECT n.workflow_id, n.machine, n.step, n.kind, n.n, n.seq, n.status, w.state_after, CASE WHEN m.b IS NULL THEN w.state_after ELSE n.status END, m.b IS NOT NULL
     FROM w JOIN n ON n.workflow_id = w.workflow_id AND n.machine = w.machine AND n.n = w.n + 1 LEFT JOIN moves m ON m.kind = n.kind AND m.a = w.state_after AND m.b = n.status)
"""
STEPS = ("signup", "view", "purchase", "error")


def _walked(v):
    to = F.when(c("event_type") == "click", F.when(c("value") > 30, "COMPLETED").when(c("value") > 20, "WAITING_HUMAN").when(c("value") > 15, "RETRY_SCHEDULED").otherwise("RUNNING")).otherwise(
        F.when(c("value") > 20, "FAILED").when(c("value") > 5, "RUNNING").when(c("value") > 1, "SUCCEEDED").otherwise("SKIPPED"))
    return machines.walked(v("events").select(c("user_id").alias("workflow_id"), c("props").alias("key"), c("event_id").alias("seq"), F.when(c("event_type") != "click", c("event_type")).alias("step"), to.alias("status")))


@query(WALKED + "SELECT workflow_id, step, seq, status, state_before FROM w WHERE NOT legal")
def workflow_refused(v):
    """Events that their workflow's or step's state did not allow."""
    return _walked(v).filter("not legal").select("workflow_id", "step", "seq", "status", "state_before")


@query(WALKED + """, l AS (SELECT workflow_id, machine, arg_max(state_after, n) AS state, count(*) FILTER (NOT legal) AS refused FROM w GROUP BY 1, 2),
 g AS (SELECT workflow_id, coalesce(max(state) FILTER (machine = ''), 'CREATED') AS state, count(*) FILTER (machine <> '' AND state IN ('SUCCEEDED', 'SKIPPED')) AS done, CAST(sum(refused) AS BIGINT) AS refused,
   coalesce(list(machine) FILTER (state IN ('SUCCEEDED', 'SKIPPED')), []) AS d FROM l GROUP BY 1)
SELECT workflow_id, state, done, refused, CASE WHEN state NOT IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN list_filter(['signup', 'view', 'purchase', 'error'], lambda x: NOT list_contains(d, x))[1] END AS resume_at FROM g""")
def workflow_states(v):
    return machines.workflow_states(_walked(v), STEPS)


@query("SELECT document_id, min(chunk_ord) AS request_ord, count(*) > 1 AS repeated, document_id IN (SELECT document_id FROM (SELECT document_id, min(chunk_ord) AS o FROM v_chunk WHERE document_id IN (SELECT id FROM v_document WHERE status = 'active') GROUP BY 1 ORDER BY o LIMIT 14)) AS accepted FROM v_chunk GROUP BY document_id")
def batch_admission_of_known(v):
    return events.admitted(v("v_chunk").select(c("chunk_ord").alias("request_ord"), "document_id"), docs=v("v_document"))


TERMS = r"""WITH w AS (SELECT chunk_id, document_id, space_id, unnest(list_distinct(regexp_extract_all(content, '[a-z]{8,}'))) AS name FROM v_chunk)"""


def _extracted(v):
    chunks = v("v_chunk").select("chunk_id", "document_id", "space_id", "chunk_ord", "section_path", "content")
    answered = scratch.keep(extract.answers(chunks, extract.Rules), "answers")
    return extract.accepted(extract.candidates(answered, chunks), chunks)


@query(TERMS + " SELECT space_id, concat('term:', name) AS normalized_key, CAST(count(DISTINCT document_id) AS BIGINT) AS sources, 'active' AS status FROM w GROUP BY 1, 2")
def extract_to_nodes(v):
    """Nodes of a new graph from all chunks: answers of a model of rules, their validation, and the upsert."""
    good, _ = _extracted(v)
    nodes = graph.node_upsert(v.spark.createDataFrame([], NODE), good["entities"], now())
    return nodes.select("space_id", "normalized_key", F.size("source_ids").cast("long").alias("sources"), "status")


@query(r"""WITH w AS (SELECT chunk_id, space_id, regexp_extract_all(content, '[a-z]{8,}') AS a FROM v_chunk), e AS (SELECT DISTINCT space_id, a[1] AS s, unnest(list_distinct(a[2:])) AS t FROM w WHERE len(a) > 1)
SELECT space_id, concat('term:', s) AS source_key, concat('term:', t) AS target_key, 'relates_to' AS relation_type, 'suggested' AS status FROM e WHERE s <> t""")
def extract_to_edges(v):
    """Edges of that graph."""
    good, _ = _extracted(v)
    empty = v.spark.createDataFrame
    nodes = graph.node_upsert(empty([], NODE), good["entities"], now()).select("id", "normalized_key")
    edges = graph.edge_upsert(empty([], EDGE), graph.resolved(good["relations"], good["entities"]), now())
    ends = edges.join(nodes.withColumnsRenamed({"id": "source_node_id", "normalized_key": "source_key"}), "source_node_id").join(nodes.withColumnsRenamed({"id": "target_node_id", "normalized_key": "target_key"}), "target_node_id")
    return ends.select("space_id", "source_key", "target_key", "relation_type", "status")


# ---- integrity and health
@query("""SELECT 'document' AS "table", id AS key, count(*) AS n FROM v_document GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'chunk', chunk_id, count(*) FROM v_chunk GROUP BY chunk_id HAVING count(*) > 1
 UNION ALL SELECT 'entity', concat(chunk_id, '|', candidate_id), count(*) FROM v_entity GROUP BY chunk_id, candidate_id HAVING count(*) > 1 UNION ALL SELECT 'node', id, count(*) FROM v_node GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 'edge', id, count(*) FROM v_edge GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'evidence', id, count(*) FROM v_evidence GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'run', id, count(*) FROM v_run GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 'node key', normalized_key, count(*) FROM v_node GROUP BY normalized_key HAVING count(*) > 1""")
def integrity_keys(v):
    ids = {n: (v(f"v_{n}"), ("id",)) for n in ("document", "node", "edge", "evidence", "run")}
    return records.broken_keys(ids | {"chunk": (v("v_chunk"), ("chunk_id",)), "entity": (v("v_entity"), ("chunk_id", "candidate_id")), "node key": (v("v_node").dropna(subset=["normalized_key"]), ("normalized_key",))})


@query("SELECT name, count(*) AS n FROM (SELECT CASE WHEN lang = 'de' THEN 'space en' ELSE concat('space ', lang) END AS name FROM (SELECT DISTINCT lang FROM documents) WHERE lang <> 'es') GROUP BY 1 HAVING count(*) > 1")
def integrity_space_names(v):
    return records.repeated_names(v("v_space").withColumn("name", F.when(c("id") == "de", "space en").otherwise(c("name"))))


@query("SELECT p.chunk_id, p.evidence_id FROM v_proof p LEFT JOIN v_chunk k ON k.chunk_id = p.source_chunk_id WHERE k.chunk_id IS NULL OR NOT contains(k.content, p.quote)")
def integrity_quotes(v):
    docs = v("v_chunk").select(c("chunk_id").alias("id"), c("content").alias("content_text"))
    return records.lost_quotes(v("v_proof").withColumn("source_document_id", c("source_chunk_id")), docs).select("chunk_id", "evidence_id")


@query("SELECT 'source without document' AS issue, s.id AS id, count(*) AS n FROM v_source s WHERE document_id NOT IN (SELECT id FROM v_evdoc WHERE status <> 'deleted') GROUP BY s.id UNION ALL SELECT 'no tags', id, 1 FROM v_document WHERE id NOT IN (SELECT CAST(doc_id AS STRING) FROM labels)")
def health_more(v):
    lost = graph.dangling(v("v_source"), "document_id", v("v_evdoc").filter("status <> 'deleted'")).groupBy("id").agg(F.count("*").alias("n")).select(F.lit("source without document").alias("issue"), "id", "n")
    untagged = v("v_document").join(v("labels").select(c("doc_id").cast("string").alias("id")), "id", "left_anti").select(F.lit("no tags").alias("issue"), "id", F.lit(1).cast("long"))
    return lost.union(untagged)


@query("""WITH n AS (SELECT DISTINCT s_name AS name FROM supplier), t AS (SELECT name, list_distinct(list_transform(range(1, length(name) + 1), lambda i: substr(concat('^', lower(name), '$'), i, 3))) AS t FROM n),
 u AS (SELECT id, list_distinct(list_transform(range(1, length(label) + 1), lambda i: substr(concat('^', lower(label), '$'), i, 3))) AS u FROM v_node),
 p AS (SELECT name, id, len(list_intersect(t, u)) AS b, len(t) + len(u) AS s FROM t, u)
SELECT name, count(*) AS candidates, min(id) AS "first" FROM p WHERE b * 100 >= (s - b) * 80 GROUP BY name HAVING count(*) > 1""")
def health_ambiguous_names(v):
    """Suppliers' names that could mean more than one node."""
    return health.ambiguous(v("supplier").select(c("s_name").alias("name")), v("v_node").select("id", "label"))


@query("""WITH d AS (SELECT o.o_orderkey AS id, o.o_custkey AS owner, min(l_shipdate) AS due FROM orders o LEFT JOIN lineitem l ON l_orderkey = o_orderkey AND l_returnflag = 'N' GROUP BY 1, 2)
SELECT 'no owner' AS issue, id FROM d WHERE owner NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) UNION ALL SELECT 'no due date', id FROM d WHERE due IS NULL""")
def health_open_tasks(v):
    """Orders as tasks: without an owner in good standing, or without a date to come."""
    due = v("lineitem").filter("l_returnflag = 'N'").groupBy(c("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("due"))
    tasks = v("orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("owner")).join(due, "id", "left")
    return health.open_tasks(tasks, v("customer").filter("c_acctbal >= 0").select(c("c_custkey").alias("id")))


REFERRED = """WITH d AS (SELECT CAST(o_orderkey AS STRING) AS id FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT id FROM v_node WHERE id NOT LIKE '%7'), e AS (SELECT * FROM v_edge WHERE status <> 'rejected')"""


@query(REFERRED + """ SELECT 'graph_edges' AS "table", 'source_node_id' AS "column", source_node_id AS key, count(*) AS rows FROM e WHERE source_node_id NOT IN (SELECT id FROM n) GROUP BY 3
 UNION ALL SELECT 'graph_edges', 'target_node_id', target_node_id, count(*) FROM e WHERE target_node_id NOT IN (SELECT id FROM n) GROUP BY 3 UNION ALL SELECT 'evidences', 'edge_id', edge_id, count(*) FROM v_evidence WHERE edge_id NOT IN (SELECT id FROM e) GROUP BY 3
 UNION ALL SELECT 'evidences', 'source_document_id', source_document_id, count(*) FROM v_evidence WHERE source_document_id NOT IN (SELECT id FROM d) GROUP BY 3 UNION ALL SELECT 'extraction_runs', 'source_document_id', document_id, count(*) FROM v_run WHERE document_id NOT IN (SELECT id FROM d) GROUP BY 3""")
def integrity_references(v):
    """References of edges, evidence and runs without a parent, where some nodes, edges and documents are gone."""
    docs = v("orders").filter("o_orderstatus <> 'P'").select(c("o_orderkey").cast("string").alias("id"))
    runs_ = v("v_run").withColumnRenamed("document_id", "source_document_id")
    return graph.broken_references({"graph_nodes": v("v_node").filter("id not like '%7'"), "graph_edges": v("v_edge").filter("status <> 'rejected'"), "evidences": v("v_evidence"), "source_documents": docs, "extraction_runs": runs_})


@query("SELECT id, relation_type, row_number() OVER (PARTITION BY relation_type ORDER BY created_at, id) AS n FROM (SELECT e.id, relation_type, min(v.created_at) AS created_at FROM v_edge e JOIN v_evidence v ON v.edge_id = e.id WHERE e.status <> 'stale' GROUP BY 1, 2)")
def graph_edges_scan(v):
    """Edges that are not stale by the time of their first evidence and id."""
    first = v("v_evidence").groupBy(c("edge_id").alias("id")).agg(F.min("created_at").alias("created_at"))
    return records.in_order(v("v_edge").filter("status <> 'stale'").join(first, "id").select("id", "relation_type", "created_at"), "relation_type", c("created_at"), c("id")).select("id", "relation_type", "n")


# ---- retrieval (specified, not part of the checked behaviour)
@query("""WITH a AS (SELECT space_id AS query_id, id, row_number() OVER (PARTITION BY space_id ORDER BY file_size DESC, id) AS r FROM v_document), b AS (SELECT space_id AS query_id, id, row_number() OVER (PARTITION BY space_id ORDER BY updated_at, id) AS r FROM v_document),
 f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM a WHERE r <= 8 UNION ALL SELECT * FROM b WHERE r <= 8) GROUP BY 1, 2),
 n AS (SELECT query_id, id FROM (SELECT space_id AS query_id, id, row_number() OVER (PARTITION BY space_id ORDER BY id) AS r FROM (SELECT DISTINCT space_id, id FROM v_document WHERE batch_id = 'src7' OR file_size > 20000)) WHERE r <= 8),
 x AS (SELECT query_id, coalesce(n.id, f.id) AS id, n.id IS NOT NULL AS named, CASE WHEN n.id IS NULL THEN score END AS score FROM n FULL JOIN f USING (query_id, id))
SELECT query_id, id, CAST(place AS INTEGER) AS place, named FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY named DESC, score DESC NULLS LAST, id) AS place FROM x) WHERE place <= 12""")
def candidates_to_compare(v):
    docs = v("v_document").withColumn("query_id", c("space_id"))
    rows = lambda *o: graph.top_k(docs, 8, *o).select("query_id", "id", "rank")
    found = graph.fused(rows(F.desc("file_size"), c("id")).union(rows(c("updated_at"), c("id"))))
    return retrieval.to_compare(docs.filter("batch_id = 'src7' or file_size > 20000"), found)


REFERRING = """WITH t AS (SELECT a.id AS query_id, concat(a.content_text, ' see "', upper(b.name), '", not x', c.name, ' (', d.name, ').') AS text FROM v_document a LEFT JOIN v_document b ON b.imported_at = a.imported_at + 1 LEFT JOIN v_document c ON c.imported_at = a.imported_at + 3 LEFT JOIN v_document d ON d.imported_at = a.imported_at + 7),
 n AS (SELECT id, name FROM v_document UNION SELECT id, substr(content_text, 1, instr(concat(content_text, '.'), '.') - 1) FROM v_document WHERE instr(content_text, '.') BETWEEN 20 AND 200)
"""


@query(REFERRING + r"""SELECT DISTINCT query_id, id FROM t JOIN n ON contains(lower(text), lower(name)) WHERE name IS NOT NULL AND regexp_matches(name, '[\p{L}\p{N}]')
 AND regexp_matches(concat(' ', lower(text), ' '), concat('[^\p{L}\p{N}]', regexp_escape(lower(name)), '[^\p{L}\p{N}]'))""")
def recall_by_name(v):
    """Documents whose file name or title, the first sentence, stands in another text, in any case and beside any mark."""
    docs = v("v_document").select("id", "name", "imported_at", "content_text")
    at = lambda n: docs.select((c("imported_at") - n).alias("imported_at"), c("name").alias(f"n{n}"))
    said = F.concat_ws("", "content_text", F.lit(' see "'), F.upper("n1"), F.lit('", not x'), "n3", F.lit(" ("), "n7", F.lit(")."))
    # names meet without the texts, which are dealt once, by id
    beside = docs.select("id", "imported_at").join(at(1), "imported_at", "left").join(at(3), "imported_at", "left").join(at(7), "imported_at", "left").drop("imported_at")
    texts = docs.select("id", "content_text").join(beside, "id", "left").select(c("id").alias("query_id"), said.alias("text"))
    dot = F.instr("content_text", ".")
    titles = docs.filter(dot.between(20, 200)).select("id", F.substring_index("content_text", ".", 1).alias("name"))
    return search.by_name(texts, docs.select("id", "name").union(titles))


@query(r"""WITH t AS (SELECT id, list_filter(regexp_split_to_array(lower(content_text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM v_document),
 tf AS (SELECT id, term, count(*) AS tf, max(n) AS n FROM (SELECT id, unnest(t) AS term, len(t) AS n FROM t) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT count(*)::DOUBLE AS docs, avg(len(t)) AS mean FROM t),
 w AS (SELECT id, tf.term, CAST(floor(1000000.0::DOUBLE * (ln(1.0::DOUBLE + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)))) AS BIGINT) AS w FROM tf JOIN df USING (term), s),
 q AS (SELECT DISTINCT CAST(item_id AS STRING) AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM benchmark),
 r AS (SELECT query_id, id, sum(w) / 1000000.0::DOUBLE AS score FROM q JOIN w USING (term) GROUP BY 1, 2)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 8""")
def recall_by_words(v):
    """The eight documents nearest to each benchmark item by BM25 over all words."""
    found = search.index(v("v_document").select("id", c("content_text").alias("text")))
    return search.by_words(v("benchmark").select(c("item_id").cast("string").alias("query_id"), "text"), found).select("query_id", "id", "score", "rank")


TAGGED = r"""WITH k AS (SELECT document_id, lower(trim(regexp_replace(name, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS tag, count(*) AS n FROM v_entity GROUP BY 1, 2), t AS (SELECT document_id, tag, n, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, tag) AS place, count(*) OVER (PARTITION BY document_id) >= 3 AS enough FROM k WHERE tag <> '')"""


@query(TAGGED + " SELECT document_id, tag, CAST(place AS INTEGER) AS place, enough FROM t WHERE place <= 8")
def document_tags(v):
    return retrieval.tags(v("v_entity")).select("document_id", "tag", "place", "enough")


@query(TAGGED + " SELECT a.document_id AS query_id, b.document_id AS id, CAST(count(*) AS DOUBLE) AS score FROM t a JOIN t b ON a.tag = b.tag AND a.document_id <> b.document_id WHERE a.place <= 8 AND b.place <= 8 GROUP BY 1, 2")
def recall_by_tags(v):
    return retrieval.by_tags(retrieval.tags(v("v_entity")))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT label, min(vec_id) AS query_id FROM e GROUP BY 1), s AS (SELECT q.query_id, c.vec_id AS id, list_cosine_similarity(a.v, c.v) AS score FROM q JOIN e a ON a.vec_id = q.query_id JOIN e c ON c.label = q.label AND c.vec_id <> q.query_id)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5 AND score >= 0.25""")
def recall_by_vectors(v):
    e = v("embeddings").select(c("vec_id").alias("id"), c("label").alias("model"), F.col("embedding").alias("v"))
    first = e.groupBy("model").agg(F.min_by(F.struct("id", "v"), "id").alias("q")).select("model", c("q.id").alias("query_id"), c("q.v").alias("v"))
    return retrieval.best(retrieval.by_vectors(first, e), retrieval.TOP, 0.25).select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def recall_by_cells(v):
    """The eight vectors nearest to each whose id is divisible by 100, by cells; what is not found of them a test measures."""
    e = v("embeddings").select(c("vec_id").alias("id"), F.lit("m").alias("model"), c("embedding").alias("v"))
    return nearest.by_cells(e, e.filter("id % 100 = 0").select("id")).select("query_id", "id", "score", "rank")


@query("SELECT a.id AS query_id, b.id AS id FROM v_document a JOIN v_document b ON a.batch_id = b.batch_id AND a.space_id = b.space_id AND b.status = 'active' AND a.id <> b.id")
def recall_eligible(v):
    docs = v("v_document").select("id", "batch_id", "space_id", "status")
    return retrieval.eligible(docs, docs, ["batch_id", "space_id"])


@query("SELECT document_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY length(content) DESC, chunk_id) AS rank FROM v_chunk WHERE document_id IN (SELECT id FROM v_document WHERE status = 'active')) WHERE rank <= 3")
def capped_chunks(v):
    rows = v("v_chunk").withColumn("score", F.length("content"))
    return retrieval.capped_chunks(rows, v("v_document").filter("status = 'active'").select("id")).select("document_id", "chunk_id", "rank")


@query("""WITH r AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), t AS (SELECT DISTINCT d.source AS query_id, d.doc_id AS id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1)
SELECT t.query_id, round(count(r.id)::DOUBLE / count(*), 9) AS recall, round(count(r.id) / 5.0::DOUBLE, 9) AS precision FROM t LEFT JOIN r ON r.query_id = t.query_id AND r.id = t.id AND rank <= 5 GROUP BY 1""")
def recall_at_five(v):
    ranked = records.in_order(v("documents"), "source", F.desc("n_chars"), c("doc_id")).select(c("source").alias("query_id"), c("doc_id").alias("id"), c("n").alias("rank"))
    good = v("documents").join(v("labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select(c("source").alias("query_id"), c("doc_id").alias("id"))
    return retrieval.at_k(ranked, good, 5).select("query_id", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS a, l_partkey % 100 + 1 AS b, l_returnflag AS t, l_quantity AS q, l_shipmode AS s FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'x' ELSE 'y' END AS l_shipmode FROM lineitem)),
 f AS (SELECT *, min(id) OVER (PARTITION BY least(a, b), greatest(a, b), t) AS f FROM l)
SELECT id, CASE WHEN s = 'x' THEN 'space' WHEN a = b THEN 'self' WHEN t NOT IN ('A') THEN 'type' WHEN q < 5 THEN 'evidence' ELSE 'twice' END AS rule FROM f WHERE s = 'x' OR a = b OR t NOT IN ('A') OR q < 5 OR id <> f""")
def link_rules(v):
    rows = v("lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).cast("long").alias("id"), c("l_suppkey").cast("long").alias("source_id"), (c("l_partkey") % 100 + 1).cast("long").alias("target_id"), c("l_returnflag").alias("relation_type"),
        F.lit("y").alias("source_space"), F.when(c("l_returnflag") == "R", "x").otherwise("y").alias("target_space"), F.when(c("l_quantity") < 5, 0).otherwise(1).alias("source_evidence"), F.lit(1).alias("target_evidence"))
    return retrieval.link_violations(rows, ("A",))


@query("SELECT id, status, source_node_id IN (SELECT id FROM v_node WHERE status = 'conflict') OR target_node_id IN (SELECT id FROM v_node WHERE status = 'conflict') AS check_again FROM v_edge")
def links_to_check_again(v):
    links = v("v_edge").withColumnsRenamed({"source_node_id": "source_id", "target_node_id": "target_id"})
    return retrieval.to_check_again(links, v("v_node").filter("status = 'conflict'").select("id")).select("id", "status", "check_again")
