from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.operators import graph, ingest, listing
from veridoc.plans import catalog


def test_same_bytes_twice_bad_utf8_and_restore(spark):
    files = [(1, "a.txt", b"same", "s", "b"), (2, "b.MD", b"same", "s", "b"), (3, "c.txt", b"\xc3\x28", "s", "b"), (4, "d.txt", b"same", "t", "b"), (5, "e.exe", b"x", "s", "b"), (6, "f.txt", b"", "s", "b"), (7, "dir\\g.txt", b"\xef\xbb\xbfold", "s", "b")]
    df = spark.createDataFrame(files, "file_ord int, original_name string, content binary, space_id string, batch_id string")
    old = ingest.decoded(df.filter("file_ord = 7")).select("space_id", "content_hash", F.lit("deleted").alias("status"))
    got = {r.file_ord: (r.outcome, r.error, r.name, r.content_text) for r in ingest.classified(ingest.decoded(df), old).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["imported", "duplicate", "failed", "imported", "failed", "failed", "restored"]
    assert got[3][1] == "not UTF-8" and got[7][2:] == ("g.txt", "old")


def test_like_signs_are_literal_and_only_ascii_folds(spark):
    df = spark.createDataFrame([("Alpha%",), ("al_pha",), ("ÄLPHA",)], "name string")
    find = lambda q: [r.name for r in df.filter(text.name_contains(F.col("name"), q)).collect()]
    assert find("%") == ["Alpha%"] and find("_") == ["al_pha"] and find("ä") == [] and find("LPHA") == ["Alpha%", "ÄLPHA"] and len(find(" ")) == 3


def test_strip_keeps_no_break_spaces(spark):
    r = spark.createDataFrame([("　 x \t",)], "s string").select(text.strip(F.col("s")).alias("s")).first()
    assert r.s == " x"


def test_paging(spark):
    df = spark.range(13)
    assert [r.id for r in listing.page_of(df, 2, 12, F.asc("id")).collect()] == [12]
    assert listing.page_of(df, 3, 12, F.asc("id")).count() == 0
    assert listing.totals(df).first().asDict() == {"total": 13, "pages": 2}


def test_newer_failed_run_does_not_hide_a_summary(spark):
    runs = [("1", "d", 1, "completed", "good"), ("2", "d", 2, "completed", " "), ("3", "d", 3, "failed", None)]
    r = listing.latest_runs(spark.createDataFrame(runs, "id string, document_id string, created_at int, status string, document_summary string")).first()
    assert (r.latest_run_id, r.latest_status, r.completed_run_id, r.latest_summary) == ("3", "failed", "2", "good")


def test_invalidation(spark):
    nodes = spark.createDataFrame([("a", "active", ["1"]), ("b", "active", ["1", "2"]), ("c", "active", []), ("d", "active", ["2"])], "id string, status string, source_ids array<string>")
    edges = spark.createDataFrame([("ab", "a", "b", "confirmed"), ("bd", "b", "d", "suggested"), ("cd", "c", "d", "confirmed"), ("bb", "b", "b", "confirmed")], "id string, source_node_id string, target_node_id string, status string")
    proof = spark.createDataFrame([("1", "bd"), ("2", "bd"), ("1", "bb")], "source_document_id string, edge_id string")
    docs = spark.createDataFrame([("1", "deleted"), ("2", "active")], "id string, status string")
    then, now = F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(9))
    n, e = graph.invalidated(nodes.withColumn("updated_at", then), edges.withColumn("updated_at", then), proof, docs, docs.filter("id = '1'"), now)
    assert {r.id for r in n.filter(F.col("updated_at") == now).collect()} == {"a", "b"} and {r.id for r in e.filter(F.col("updated_at") == now).collect()} == {"ab", "bb"}
    assert {r.id: (r.status, r.source_ids) for r in n.collect()} == {"a": ("stale", []), "b": ("active", ["2"]), "c": ("active", []), "d": ("active", ["2"])}
    assert {r.id: r.status for r in e.collect()} == {"ab": "stale", "bd": "suggested", "cd": "confirmed", "bb": "stale"}


def test_hops_with_caps_at_a_hub(spark):
    hub = [("hub", f"n{i:03d}") for i in range(300)] + [(f"n{i:03d}", f"m{i % 7}") for i in range(0, 300, 3)] + [("x", "hub")]
    edges = spark.createDataFrame([(a, b, "confirmed", "t") for a, b in hub] + [("x", "no", "suggested", "t"), ("x", "other", "confirmed", "u")], "source_node_id string, target_node_id string, status string, relation_type string")
    start = spark.createDataFrame([("x",)], "id string")
    plain = {}
    for a, b in hub:
        plain.setdefault(a, set()).add(b)
        plain.setdefault(b, set()).add(a)
    order = lambda ids: sorted(ids, key=lambda n: (-len(plain[n]), n))
    fan = {n: set(order(x)[:20]) for n, x in plain.items()}
    want, last = {"x": 0}, ["x"]
    for h in (1, 2, 3):
        last = order({m for n in last for m in fan[n]} - set(want))[:15]
        want |= dict.fromkeys(last, h)
    for _ in range(2):
        got = graph.within_hops(edges.repartition(3), start, 3, ("t",), nodes=15, fan=20)
        assert {r.id: r.hop for r in got.collect()} == want
    assert graph.within_hops(edges, start, 1).filter("hop = 1").count() == 2


def test_every_query_has_columns_of_its_own_names():
    assert len(catalog.QUERIES) >= 60 and set(catalog.SQL) <= set(catalog.QUERIES)


def test_leavings_of_a_step_are_removed(spark):
    import os

    from veridoc.sources import scratch

    inner = []

    def step():
        inner.append(scratch.keep(spark.range(5), "inner"))
        return inner[0].filter("id > 2")

    kept = scratch.keep(spark.range(3), "before")
    out = scratch.alone(step, "out")
    there = lambda df: all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())
    assert out.count() == 2 and there(kept) and there(out) and not there(inner[0])


def test_a_page_does_not_bring_all_runs_to_one_task(spark):
    docs = spark.range(40).selectExpr("cast(id as string) id", "cast(null as string) excerpt")
    runs = spark.range(2000).selectExpr("cast(id as string) id", "cast(id % 37 as string) document_id", "id created_at", "'completed' status", "'s' document_summary")
    with_plan = listing.with_runs(listing.page_of(docs, 1, 12, F.desc("id")), runs)
    assert "Exchange SinglePartition" not in with_plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in with_plan.collect()) == sorted(sorted(map(str, range(40)))[-12:])


def test_rows_are_not_dealt_by_their_space(spark):
    rows = spark.createDataFrame([(i, "big" if i % 9 else "small") for i in range(90)], "id int, space_id string")
    spaces = spark.range(0, 90).selectExpr("if(id % 2 = 0, 'big', 'gone') id", "'active' status").repartition(8).distinct()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")  # as for a list of spaces that is taken from a large table
    try:
        found = listing.active(rows, spaces)
        assert found.count() == 80 and "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_neighbours_make_edges_once(spark):
    rows = [("e1", "a", "b"), ("e1", "a", "b"), ("loop", "c", "c"), ("half", "a", None), ("none", None, None)]
    edges = spark.createDataFrame(rows, "id string, source_node_id string, target_node_id string").groupBy("id").agg(F.max("source_node_id").alias("source_node_id"), F.max("target_node_id").alias("target_node_id"))
    found = graph.neighbours(edges, spark.createDataFrame([("a", "A"), ("c", None)], "id string, label string"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", "e1", "b", "b"), ("b", "e1", "a", "A"), ("c", "loop", "c", "c"), ("a", "half", None, None), (None, "none", None, None)]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [id") == 1
