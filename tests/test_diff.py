import itertools
import random

from veridoc.operators import diff

SCHEMA = "document_id string, ordinal int, section_path string, content_text string"


def changes(spark, old, new):
    rows = lambda parts: spark.createDataFrame([(d, i, p, t) for d, x in parts.items() for i, (p, t) in enumerate(x, 1)], SCHEMA)
    return {(r.document_id, r.old_ordinal, r.new_ordinal, r.change) for r in diff.section_changes(rows(old), rows(new)).collect()}


def test_each_kind_of_change(spark):
    old = {"d": [("A", "# A\none"), ("B", "# B\ntwo"), ("C", "# C\nthree"), ("D", "# D\nfour"), ("E", "# E\nfive"), ("F > G", "# G\nsix")], "same": [("A", "x"), ("A", "x"), ("B", "y")], "gone": [("A", None)]}
    new = {"d": [("B", "# B\ntwo"), ("C", "# C\nthree"), ("A", "# A\none"), ("D", "# D\nother"), ("E2", "# E2\nfive"), ("H > G", "# G\nsix"), ("N", "# N")], "same": [("A", "x"), ("A", "x"), ("B", "y")], "come": [("A", "")]}
    assert changes(spark, old, new) == {
        ("d", 2, 1, "same"), ("d", 3, 2, "same"), ("d", 1, 3, "moved"), ("d", 4, 4, "changed"), ("d", 5, 5, "renamed"), ("d", 6, 6, "moved"), ("d", None, 7, "added"),
        ("same", 1, 1, "same"), ("same", 2, 2, "same"), ("same", 3, 3, "same"), ("gone", 1, None, "removed"), ("come", None, 1, "added")}


def test_longest_rise_is_a_longest_one():
    r = random.Random(1)
    for n in range(9):
        for _ in range(20):
            p = r.sample(range(100), n)
            keep = [x for x, k in zip(p, diff.longest_rise(p), strict=True) if k]
            best = max((len(c) for k in range(n + 1) for c in itertools.combinations(p, k) if list(c) == sorted(c)), default=0)
            assert keep == sorted(keep) and len(keep) == best


def test_repeated_paths_and_empty_versions(spark):
    old = {"d": [("P", f"t{i}") for i in range(5)]}
    new = {"d": [("P", f"t{i}" if i != 2 else "new") for i in range(5)]}
    assert changes(spark, old, new) == {("d", i + 1, i + 1, "same" if i != 2 else "changed") for i in range(5)}
    assert changes(spark, old, {}) == {("d", i, None, "removed") for i in range(1, 6)} and changes(spark, {}, {}) == set()
