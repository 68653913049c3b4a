import json

from veridoc.operators import extract, graph
from veridoc.plans import catalog

CHUNK = "chunk_id string, document_id string, space_id string, chunk_ord long, section_path string, content string"


def test_errors_are_rows(spark):
    from veridoc.operators.extract import LISTS, Busy

    class Moody:
        """Answers as the chunk says; busy until it is asked for the third time."""

        def __init__(self):
            self.asked = {}

        def answer(self, request):
            n = self.asked[request["chunk_id"]] = self.asked.get(request["chunk_id"], 0) + 1
            kind = request["content"]
            if kind == "busy" or (kind == "slow" and n < 3):
                raise Busy("too many requests")
            if kind == "broken":
                raise RuntimeError("no route")
            empty = {"summary": "s", **dict.fromkeys(LISTS, [])}
            return {"text": "I think", "list": "[]", "short": json.dumps({"entities": []}), "slow": json.dumps(empty)}.get(kind, json.dumps(empty))

    kinds = ["busy", "slow", "broken", "text", "list", "short", "fine", " ", None]
    df = spark.createDataFrame([(f"c{i}", "d", "s", i, "p", k) for i, k in enumerate(kinds)], CHUNK)
    got = {r.chunk_id: (r.error, r.attempts, r.answer is None) for r in extract.answers(df, Moody, 3, 0.01).collect()}
    assert got == {"c0": ("busy", 3, True), "c1": (None, 3, False), "c2": ("failed", 1, True), "c3": ("no json", 1, True), "c4": ("no object", 1, True), "c5": ("wrong form", 1, True), "c6": (None, 1, False), "c7": ("empty", 0, True), "c8": ("empty", 0, True)}


def test_from_chunks_to_the_graph(spark):
    rows = [("c1", "d1", "s", 1, "p", "alphabets and\nbetamaxes, alphabets"), ("c2", "d2", "s", 2, "p", "gammaglobulin betamaxes"), ("c3", "d2", "s", 3, "p", "no long one"), ("c4", "d3", "s", 4, " ", "deltawinged things")]
    chunks = spark.createDataFrame(rows, CHUNK)
    found = extract.candidates(extract.answers(chunks, extract.Rules), chunks)
    good, bad = extract.accepted(found, chunks)
    assert {r.chunk_id for r in bad.collect()} == {"c4"}  # its section is blank
    nodes = {r.normalized_key: r.source_ids for r in graph.node_upsert(spark.createDataFrame([], catalog.NODE), good["entities"], catalog.now()).collect()}
    assert nodes == {"term:alphabets": ["d1"], "term:betamaxes": ["d1", "d2"], "term:gammaglobulin": ["d2"]}
    edges = graph.edge_upsert(spark.createDataFrame([], catalog.EDGE), graph.resolved(good["relations"], good["entities"]), catalog.now())
    proofs = graph.evidence_upsert(spark.createDataFrame([], catalog.PROOF), graph.resolved(good["relations"], good["entities"]), good["evidences"], catalog.now())
    assert edges.count() == 2 and {r.quote for r in proofs.collect()} == {"betamaxes, alphabets", "gammaglobulin betamaxes"}
    assert {r.chunk_id for r in good["summaries"].collect()} == {"c1", "c2", "c3"}
