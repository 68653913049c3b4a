import pytest
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.operators import graph, records, runs, validate
from veridoc.plans import catalog
from veridoc.plans import records as queries  # noqa: F401
from veridoc.sources import files


def test_space_rules(spark):
    spaces = spark.createDataFrame([("a", "active"), ("b", "deleted")], "id string, status string")
    records.guard(spaces, "a")
    for bad, error in ((" ", ValueError), (None, ValueError), ("b", LookupError), ("c", LookupError)):
        with pytest.raises(error):
            records.guard(spaces, bad)
    records.check_space("x", "d")
    for name, about in ((" ", None), (None, None), ("x" * 101, None), ("x", "d" * 501)):
        with pytest.raises(ValueError):
            records.check_space(name, about)
    for ids in ([], ["a"] * 13, [" "]):
        with pytest.raises(ValueError):
            records.check_ids(ids)


def test_known_nodes_keep_their_state(spark):
    at = F.timestamp_seconds(F.lit(0))
    nodes = spark.createDataFrame([(s, "s", "person", s, " " if s == "orphan" else "kept ", s, f"person:{s}", ["d0"]) for s in ("conflict", "orphan", "stale", "active")], "id string, space_id string, node_type string, label string, summary string, status string, normalized_key string, source_ids array<string>")
    found = spark.createDataFrame([("s", "d0", i, 0, "PERSON", n, " new ") for i, n in enumerate(("Conflict", "orphan ", "stale", "active", "other"))], "space_id string, document_id string, chunk_ord long, pos int, type string, name string, summary string")
    out = {r.label: r for r in graph.node_upsert(nodes.withColumn("created_at", at).withColumn("updated_at", at), found, F.timestamp_seconds(F.lit(5))).collect()}
    assert {k: r.status for k, r in out.items()} == {"conflict": "conflict", "orphan": "orphan", "stale": "active", "active": "active", "other": "active"}
    assert {k: r.summary for k, r in out.items()} == {"conflict": "kept ", "orphan": "new", "stale": "kept ", "active": "kept ", "other": "new"}
    assert {k for k, r in out.items() if r.updated_at.timestamp() == 5} == {"stale", "other"}


def test_last_candidate_and_own_evidence_count(spark):
    entities = spark.createDataFrame([("c", "s", 0, "e", "term", "one"), ("c", "s", 1, "e", "term", "two"), ("c", "s", 2, "f", "term", "three")], "chunk_id string, space_id string, pos int, candidate_id string, type string, name string")
    relations = spark.createDataFrame([("c", "s", "d", 0, 0, "e", "f", "knows", 0.5, ["v", "w", "v"])], "chunk_id string, space_id string, document_id string, chunk_ord int, pos int, source_id string, target_id string, relation_type string, confidence double, evidence_ids array<string>")
    found = graph.resolved(relations, entities)
    two = spark.range(1).select(graph.node_id(F.lit("s"), F.lit("term:two")).alias("i")).first().i
    assert [r.source_node_id for r in found.collect()] == [two]
    proofs = spark.createDataFrame([("c", 0, "v", "other", "p", "q"), ("c", 1, "v", "d", "p", "q"), ("c", 2, "w", "d", "p", "q")], "chunk_id string, pos int, evidence_id string, document_id string, section_path string, quote string")
    known = spark.createDataFrame([], catalog.PROOF)
    assert [r.source_document_id for r in graph.evidence_upsert(known, found, proofs, catalog.now()).collect()] == ["d"]


def test_edge_id_joins_source_relation_target(spark):
    import hashlib
    import uuid

    h = bytearray(hashlib.md5(b"edge:s|a|rel|b").digest())
    h[6], h[8] = h[6] & 0x0F | 0x30, h[8] & 0x3F | 0x80
    assert spark.range(1).select(graph.edge_id(*map(F.lit, ("s", "a", "rel", "b"))).alias("i")).first().i == f"edge-{uuid.UUID(bytes=bytes(h))}"


def test_folder_import_raw_bytes_and_inserts(spark, tmp_path):
    for name, data in (("a.md", b"# x"), ("b/c.txt", b"# x"), ("d.txt", b"\xff"), ("e.bin", b"z")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    none = spark.createDataFrame([], "space_id string, content_hash string, status string")
    got = files.imported(spark, f"{tmp_path}/in", "s/../1", "b", none)
    assert {r.name: (r.outcome, r.kind) for r in got.collect()} == {"a.md": ("imported", "markdown"), "c.txt": ("duplicate", "txt"), "d.txt": ("failed", "txt"), "e.bin": ("failed", None)}
    files.store_raw(got.filter("outcome = 'imported'"), f"{tmp_path}/raw")
    r = spark.read.parquet(f"{tmp_path}/raw").first()
    assert bytes(r.content) == b"# x" and r.file.startswith("s____1/documents/file-") and r.file.endswith(".md") and ".." not in r.file
    rows = spark.createDataFrame([("001", 1)], "space_id string, n int")
    files.insert(rows, f"{tmp_path}/t")
    files.insert(rows, f"{tmp_path}/t")
    assert [tuple(r) for r in files.stored(spark, f"{tmp_path}/t", "space_id string, n int").collect()] == [("001", 1)] * 2


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("[[a]] b [[c]]",)], "line string")
    files.export(rows, f"{tmp_path}/m", "markdown")
    files.export(rows, f"{tmp_path}/j", "json")
    assert spark.read.text(f"{tmp_path}/m").first().value == spark.read.json(f"{tmp_path}/j").first().line == "[[a]] b [[c]]"
    with pytest.raises(ValueError):
        files.export(rows, f"{tmp_path}/x", "docx")


def test_failed_run_keeps_its_plan(spark):
    started = spark.createDataFrame([("r", 0), ("q", 0)], "id string, created_at int")
    updates = [("r", 1, "plan", 3, 9, None, None, 1), ("r", 2, "fail", None, None, None, "broken", 2)]
    got = {r.id: r for r in runs.applied(started, spark.createDataFrame(updates, "id string, seq int, kind string, sections int, chunks int, summary string, error string, at int")).collect()}
    assert (got["r"].status, got["r"].section_count, got["r"].error_message, got["r"].completed_at, got["q"].status) == ("failed", 3, "broken", 2, "processing")


def test_conflict_evidence_is_checked(spark):
    conflicts = spark.createDataFrame([("c", 0, "Bad", "d", ["x"])], "chunk_id string, pos int, conflict_type string, description string, evidence_ids array<string>")
    chunks = spark.createDataFrame([("c", "d", "p", "text")], "chunk_id string, document_id string, section_path string, content string")
    e = spark.createDataFrame([], "chunk_id string, pos int, candidate_id string, type string, name string, summary string, evidence_ids array<string>")
    r = spark.createDataFrame([], "chunk_id string, pos int, source_id string, target_id string, relation_type string, confidence double, evidence_ids array<string>")
    p = spark.createDataFrame([], "chunk_id string, pos int, evidence_id string, document_id string, source_chunk_id string, section_path string, quote string")
    assert sorted(x.rule for x in validate.all_violations(chunks, e, r, p, conflicts).collect()) == ["conflict", "conflict evidence"]


def test_random_ids_and_lists(spark):
    df = spark.range(50).select(text.random_id().alias("i"))
    assert df.distinct().count() == 50
    row = spark.createDataFrame([(None, "x"), ("[1", "y"), ('["a", "b"]', "z")], "j string, k string").select(text.from_json_list(F.col("j")).alias("l")).collect()
    assert [r.l for r in row] == [[], [], ["a", "b"]]


def test_every_query_has_sql():
    assert len(catalog.QUERIES) >= 105 and set(catalog.QUERIES) - set(catalog.SQL) == {"recall_by_cells"}


def test_places_within_groups(spark):
    rows = [(g, i * 7 % 101, i) for i in range(300) for g in ("big",)] + [("small", 1, 1), (None, 2, 2), (None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, a int, id int").repartition(5)
    got = {(r.g, r.id): r.n for r in records.in_order(df, "g", F.desc("a"), F.col("id")).collect()}
    want = {(g, i): n for k in {r[0] for r in rows} for n, (g, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1)}
    assert got == want
    assert records.in_order(df.limit(0), "g", F.col("id")).count() == 0


def test_references_of_the_schema(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "knowledge_spaces": t([("s",)], "id string"), "import_batches": t([("b", "s"), ("c", "gone")], "id string, space_id string"), "source_documents": t([("d", "s", "b"), ("e", "s", "lost"), ("f", None, "lost")], "id string, space_id string, batch_id string"),
        "graph_nodes": t([("n", "s")], "id string, space_id string"), "graph_edges": t([("x", "s", "n", "m")], "id string, space_id string, source_node_id string, target_node_id string"), "review_records": t([("r", "s", "y")], "id string, space_id string, edge_id string")}
    got = sorted(map(tuple, graph.broken_references(tables).collect()))
    assert got == [("graph_edges", "target_node_id", "m", 1), ("import_batches", "space_id", "gone", 1), ("review_records", "edge_id", "y", 1), ("source_documents", "batch_id", "lost", 2)]
