import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.operators import nearest, search


def slow_words(queries, docs, k):
    cut = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    words = {i: cut(t) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for q, t in queries:
        scores = []
        for i, w in words.items():
            s = 0
            for x in set(cut(t)) & set(w):
                tf = float(w.count(x))
                idf = math.log(1.0 + (float(len(words)) - df[x] + 0.5) / (df[x] + 0.5))
                s += math.floor(1e6 * (idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))))
            if set(cut(t)) & set(w):
                scores.append((-s / 1e6, i))
        out += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 7])
def test_words_equal_plain_loops(spark, monkeypatch, block):
    """With small blocks most of them are left out by what they can give at most."""
    monkeypatch.setattr(search, "BLOCK", block)
    r = random.Random(block)
    names = ["the", "a", "Ünion", "x1", *[f"w{i}" for i in range(150)]]
    text = lambda n: " ".join(r.choice(names[:4] if r.random() < 0.5 else names) for _ in range(n))
    docs = [(f"d{i:03d}", text(r.randint(0, 60))) for i in range(200)] + [("same1", "the w1, w2"), ("same2", "THE w1 w2"), ("none", None), ("long", "the " * 5000 + "w3")]
    queries = [(f"q{i}", text(5)) for i in range(25)] + [("all", "the"), ("absent", "zzz"), ("empty", ""), ("null", None), ("rare", "w3 w1")]
    found = search.index(spark.createDataFrame(docs, "id string, text string"))
    got = search.by_words(spark.createDataFrame(queries, "query_id string, text string"), found, 5)
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got.collect()) == slow_words(queries, docs, 5)
    assert found.postings.filter("term = 'the'").select("block").distinct().count() > (1 if block == 7 else 0)


def test_index_of_no_documents(spark):
    found = search.index(spark.createDataFrame([], "id string, text string"))
    assert search.by_words(spark.createDataFrame([("q", "a")], "query_id string, text string"), found).count() == 0


def test_names_stand_in_texts(spark):
    names = [("1", "plan.md"), ("2", "Annual Report (2024)"), ("3", "C++"), ("4", "???"), ("5", None), ("6", "x\\Ey.z"), ("7", "plan"), ("8", "Größe"), ("1", "PLAN-7")]
    texts = [
        ("a", "see plan.md, and my plan.md (budget)."), ("b", "the annual report (2024)"), ("c", "myplan.md or plan.mdx"), ("d", "In c++, GRÖSSE and größe"), ("e", "x\\ey.z!"), ("f", None), ("g", ""), ("h", "annual report 2024"), ("i", "plan-7"), ("j", "???"), ("k", "plan" * 9000 + " plan.md")]
    got = search.by_name(spark.createDataFrame(texts, "query_id string, text string"), spark.createDataFrame(names, "id string, name string"))
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("a", "7"), ("b", "2"), ("c", "7"), ("d", "3"), ("d", "8"), ("e", "6"), ("i", "1"), ("i", "7"), ("k", "1"), ("k", "7")]


def test_names_of_nothing(spark):
    none = spark.createDataFrame([], "id string, name string")
    assert search.by_name(none.select(F.col("id").alias("query_id"), F.col("name").alias("text")), none).count() == 0


def brute(ids, x, asked, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = x @ x[ids.index(q)]
        out[q] = [ids[i] for i in np.lexsort([ids, -s]) if ids[i] != q][:k]
    return out


@pytest.mark.parametrize("kind", ["uniform", "groups"])
def test_cells_find_most_neighbours(spark, kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 32))
    if kind == "groups":
        x = np.repeat(r.normal(size=(60, 32)), 50, 0) * 3 + x
    rows = [(i, "m", v.tolist()) for i, v in enumerate(x)] + [(9000, "m", None), (9001, "m", [0.0] * 32), (9002, "m", [float("nan")] * 32), (9003, None, [1.0, 2.0]), (9004, None, [2.0, 1.0]), (9005, "alone", [1.0]), (9006, "m", [])]
    df = spark.createDataFrame(rows, "id long, model string, v array<double>")
    got = {}
    for a in nearest.by_cells(df, df.filter("id % 100 = 0 or id > 8000").select("id")).collect():
        got.setdefault(a.query_id, []).append((a["rank"], a.id, a.score))
    want = brute(list(range(3000)), x, range(0, 3000, 100), 8)
    assert set(got) == set(want) | {9003, 9004} and [i for _, i, _ in got[9003]] == [9004]
    share = np.mean([len({i for _, i, _ in got[q]} & set(w)) / 8 for q, w in want.items()])
    assert share >= 0.9 and all([n for n, _, _ in sorted(g)] == list(range(1, len(g) + 1)) for g in got.values())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(s - unit[q] @ unit[i]) < 1e-9 for q, g in got.items() if q < 3000 for _, i, s in g)
    c = nearest.centres(unit, 55)
    if kind == "groups":
        assert nearest.probes(unit, c, 8, 0.97) <= 12  # of 55 cells
    assert nearest.probes(unit, c, 8, 1.0) <= 55


def test_cells_of_no_vectors(spark):
    none = spark.createDataFrame([], "id long, model string, v array<float>")
    assert nearest.by_cells(none, none.select("id")).count() == 0


def test_names_that_are_alike_equal_all_pairs(spark):
    from veridoc.operators import health

    r = random.Random(8)
    words = ["Anna Berg", "anna  berg", "Ana Berg", "Berg, Anna", "Supplier#000001", "Supplier#000002", "x", "xy", "", None, *("".join(r.choice("abcd ") for _ in range(r.randint(1, 14))) for _ in range(150))]
    nodes = [(f"n{i}", w) for i, w in enumerate(words)]
    got = {tuple(x) for x in health.alike(spark.createDataFrame([(w,) for w in words], "name string"), spark.createDataFrame(nodes, "id string, label string")).collect()}

    def grams(w):
        p = "^" + " ".join(w.split()).lower() + "$"
        return {p[i : i + 3] for i in range(max(1, len(p) - 2))}

    want = {(w, i) for w in words if (w or "").strip() for i, x in nodes if (x or "").strip() and 100 * len(grams(w) & grams(x)) >= 80 * len(grams(w) | grams(x))}
    assert got == want


def test_equal_titles_are_found_without_a_text_for_each(spark, monkeypatch):
    """Copies share a title; no plan may hold a text for each name it may have, and each pair comes once."""
    monkeypatch.setattr(search, "CELL", 50)
    texts = [(f"t{i}", f"The same title of all, see file_{i % 7}.md") for i in range(40)] + [("one", "file_1"), ("two", "all the same title of")]
    names = [(f"d{i}", "the SAME title of all") for i in range(30)] + [(f"d{i}", f"file_{i}.MD") for i in range(30)] + [("d3", "see")]
    before = search._owners
    seen = {}
    monkeypatch.setattr(search, "_owners", lambda found, named: before(seen.setdefault("found", found), named))
    got = [tuple(r) for r in search.by_name(spark.createDataFrame(texts, "query_id string, text string"), spark.createDataFrame(names, "id string, name string")).collect()]
    assert sorted(got) == sorted((f"t{i}", f"d{k}") for i in range(40) for k in range(30))
    assert seen["found"].count() == 40 * 3  # a title, a file name and a word of each text, whatever the number of owners


def test_ambiguous_names_meet_labels_not_nodes(spark, monkeypatch):
    from veridoc.operators import health

    labels = [f"Supplier#{i:09d}" for i in range(400)]
    nodes = [(f"n{k}-{i:03d}", w) for i, w in enumerate(labels) for k in range(5)] + [("n0-000", "supplier#000000001"), ("z", "SUPPLIER#000000399 ")]
    seen, before = [], health._pairs
    monkeypatch.setattr(health, "_pairs", lambda a, b, percent: seen.append((a.count(), b.count())) or before(a, b, percent))
    got = {tuple(r) for r in health.ambiguous(spark.createDataFrame([(w,) for w in labels], "name string"), spark.createDataFrame(nodes, "id string, label string")).collect()}
    grams = lambda w: {f"^{w}$"[i : i + 3] for i in range(len(w))}
    of = {w: grams(w.strip().lower()) for _, w in nodes}
    want = set()
    for w in labels:
        ids = {i for i, x in nodes if 100 * len(of[w] & of[x]) >= 80 * len(of[w] | of[x])}
        want |= {(w, len(ids), min(ids))} if len(ids) > 1 else set()
    assert got == want and seen == [(400, 400)]


def test_eligible_pairs_of_a_large_group_are_dealt_to_many_tasks(spark, monkeypatch):
    """One group of most rows, ids that repeat, nulls; no task makes more than a small part of the pairs."""
    from veridoc.operators import retrieval

    monkeypatch.setattr(retrieval, "TILE", 20)
    rows = [(f"d{i % 380}", "s", "b", "deleted" if i % 7 == 0 else "active") for i in range(400)] + [(f"e{i}", "t", None if i == 3 else "b", "active") for i in range(6)]
    rows += [(None, "s", "b", "active"), ("n", None, "b", "active"), ("x", "s", "b", None), ("alone", "u", "b", "active")]
    df = spark.createDataFrame(rows, "id string, space_id string, batch_id string, status string")
    got = retrieval.eligible(df, df, ["batch_id", "space_id"])
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] and b[0] and a[0] != b[0] and a[1] and a[1:3] == b[1:3] and a[2] and b[3] == "active")
    assert sorted(map(tuple, got.collect())) == want
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) > 100 and max(parts) < len(want) / 20
    assert retrieval.eligible(df.limit(0), df, ["batch_id", "space_id"]).count() == 0


def test_words_are_indexed_and_scored_where_the_documents_are(spark):
    """A document's postings stay in one row, and no plan shuffles by term: what is sent grows with documents, not with words."""
    docs = [(f"d{i:03d}", " ".join(f"w{(i * k) % 90}" for k in range(1, 200)) + " rare" * (i == 7)) for i in range(300)]
    found = search.index(spark.createDataFrame(docs, "id string, text string"))
    assert found.documents.count() == 300
    for i, t in docs[:20]:
        want = {w: t.split().count(w) for w in t.split()}
        assert {r.term: r.tf for r in found.postings.filter(F.col("id") == i).collect()} == want
    asked = spark.createDataFrame([("q", "w1", 1), ("q", "w2", 1)], "query_id string, term string, df long")
    scored = search._scored(asked, found.blocks.select(F.lit("q").alias("query_id"), "block").distinct(), found)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len([x for x in sent if "query_id" in x and "id#" in x]) >= 1 and not any("hashpartitioning(term" in x for x in sent)


def test_a_cell_of_copies_is_dealt_to_pieces(spark, monkeypatch):
    """Most vectors are equal and so in one cell; equal scores go to the smaller ids, and no group holds more than a piece of them."""
    monkeypatch.setattr(nearest, "PIECE", 64)
    r = np.random.default_rng(2)
    x = np.concatenate([np.tile(r.normal(size=(1, 16)), (1500, 1)), r.normal(size=(500, 16))])
    df = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(x)], "id long, model string, v array<double>").repartition(7)
    seen, before = spark.sparkContext.accumulator(0), nearest._best_of

    def counted(q, v, k):
        seen.add(int(v.num_rows > 128))
        return before(q, v, k)

    monkeypatch.setattr(nearest, "_best_of", counted)
    got = {}
    for a in nearest.by_cells(df, df.filter("id % 100 = 0").select("id")).collect():
        got.setdefault(a.query_id, []).append((a["rank"], a.id))
    assert seen.value == 0
    assert all([i for _, i in sorted(got[q])] == [i for i in range(9) if i != q][:8] for q in range(0, 1500, 100))
    want = brute(list(range(2000)), x, range(1500, 2000, 100), 8)
    assert np.mean([len({i for _, i in got[q]} & set(w)) / 8 for q, w in want.items()]) >= 0.9


def test_eligible_pairs_take_few_bytes(spark, tmp_path):
    """The result is a square by nature; ids follow each other in one order, so that a file has less than half a byte for a pair."""
    from veridoc.operators import retrieval

    df = spark.range(3000).selectExpr("concat('document ', id * 7919) AS id", "concat('s', id % 3) AS space_id", "'b' AS batch_id", "'active' AS status")
    retrieval.eligible(df, df, ["batch_id", "space_id"]).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 3 * 1000 * 999
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 3 * 1000 * 999 / 2


def shuffled_rows(spark, df):
    """Rows that all stages of counting ``df`` send, and the count."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = {(s.stageId(), s.attemptId()) for s in map(stages().apply, range(stages().size()))}
    n, after = df.count(), stages()
    return sum(s.shuffleWriteRecords() for s in map(after.apply, range(after.size())) if (s.stageId(), s.attemptId()) not in before), n


def test_owners_of_a_title_are_not_sent_for_each_part_of_its_texts(spark, monkeypatch):
    """A title of 1,000 texts and 1,000 documents: 100 parts of the texts, and the documents must not be sent 100 times."""
    monkeypatch.setattr(search, "CELL", 10_000)
    n = 1000
    found = spark.range(n).selectExpr("concat('t', id) AS query_id", "'a title' AS name")
    named = spark.range(n).selectExpr("concat('d', id) AS id", "'a title' AS name")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with owners that are too many to be sent to all tasks
    try:
        rows, pairs = shuffled_rows(spark, search._owners(found, named))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert pairs == n * n and rows < 60_000


@pytest.mark.parametrize("sent", [1, 1 << 20])
def test_runs_that_no_name_has_are_left_out_before_the_join(spark, monkeypatch, sent):
    """Many words and few names: what meets the names is little, and no name is missed, with one row of marks too."""
    monkeypatch.setattr(search, "SENT", sent)
    names = [(f"d{i}", f"File_{i}.md") for i in range(3)] + [("t", "one two THREE four")]
    texts = [(f"q{i}", " ".join(f"w{i}x{k}" for k in range(300)) + (f" file_{i}.MD" if i < 3 else " One two three four")) for i in range(5)]
    before, seen = search._marked, []
    monkeypatch.setattr(search, "_marked", lambda held, anchors: seen.append((held, out := before(held, anchors))) or out)
    got = search.by_name(spark.createDataFrame(texts, "query_id string, text string"), spark.createDataFrame(names, "id string, name string"))
    assert sorted(map(tuple, got.collect())) == [("q0", "d0"), ("q1", "d1"), ("q2", "d2"), ("q3", "t"), ("q4", "t")]
    held, kept = seen[0]
    assert held.count() > 1500 and kept.count() < held.count() / 10
