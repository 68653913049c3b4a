"""What became of each section of a document between two versions."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.sources import scratch


def longest_rise(places: list[int]) -> list[bool]:
    """Which elements of a sequence of different numbers belong to a longest rising part of it, by patience sorting."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    keep = [False] * len(places)
    i = at[-1] if at else -1
    while i >= 0:
        keep[i], i = True, back[i]
    return keep


def _stay(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("old_ordinal")
    return rows.assign(stays=longest_rise(rows["new_ordinal"].tolist()))


def _matched(old: DataFrame, new: DataFrame, key: list[Column]) -> DataFrame:
    """Pairs of ordinals of sections that agree in the key; the k-th of a document with the k-th."""
    names = [f"_k{i}" for i in range(len(key))]

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select("document_id", F.col("ordinal").alias(name), *[k.alias(n) for k, n in zip(key, names, strict=True)]).dropna(subset=names)
        return rows.withColumn("_occurrence", F.row_number().over(Window.partitionBy("document_id", *names).orderBy(name)))

    return keyed(old, "old_ordinal").join(keyed(new, "new_ordinal"), ["document_id", *names, "_occurrence"]).select("document_id", "old_ordinal", "new_ordinal")


def section_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """document_id, old_ordinal, new_ordinal and change of each section of either version (document_id, ordinal, section_path,
    content_text).

    Sections with the same text are the same one, equal ones in their order. Of these a largest set that is in one order in
    both versions is ``same``; the others, and those under another path, are ``moved``. What is left is ``changed`` where the
    path is the same, ``renamed`` where only the heading line differs, else ``removed`` or ``added``. Ordinals differ within a
    document; null texts equal nothing.
    """
    text, path = F.sha2(F.col("content_text").cast("binary"), 256), F.col("section_path")
    body = F.nullif(F.regexp_replace("content_text", r"(?s)^[^\n]*\n?", ""), F.lit(""))
    slim = lambda rows: scratch.keep(rows.select("document_id", "ordinal", path.alias("section_path"), text.alias("text"), F.sha2(body.cast("binary"), 256).alias("body")), "sections")
    old, new = slim(before), slim(after)
    rest = lambda rows, found, name: rows.join(found.select("document_id", F.col(name).alias("ordinal")), ["document_id", "ordinal"], "left_anti")

    same = _matched(old, new, [F.col("text")])
    paths = lambda rows, name, as_: rows.select("document_id", F.col("ordinal").alias(name), F.col("section_path").alias(as_))
    same = scratch.keep(same.join(paths(old, "old_ordinal", "_p"), ["document_id", "old_ordinal"]).join(paths(new, "new_ordinal", "_q"), ["document_id", "new_ordinal"]), "same")
    # only documents in which something has gone backwards need the longest rise; others keep all
    back = same.withColumn("_last", F.lag("new_ordinal").over(Window.partitionBy("document_id").orderBy("old_ordinal"))).filter("_last > new_ordinal").select("document_id").distinct()
    turned = same.join(back, "document_id", "left_semi").select("document_id", "old_ordinal", "new_ordinal")
    stays = turned.groupBy("document_id").applyInPandas(_stay, "document_id string, old_ordinal int, new_ordinal int, stays boolean")
    placed = same.join(stays, ["document_id", "old_ordinal", "new_ordinal"], "left")
    kept = placed.select("document_id", "old_ordinal", "new_ordinal", F.when(F.coalesce("stays", F.lit(True)) & F.col("_p").eqNullSafe(F.col("_q")), "same").otherwise("moved").alias("change"))

    old, new = rest(old, same, "old_ordinal"), rest(new, same, "new_ordinal")
    changed = scratch.keep(_matched(old, new, [F.col("section_path")]), "changed")
    old, new = rest(old, changed, "old_ordinal"), rest(new, changed, "new_ordinal")
    renamed = scratch.keep(_matched(old, new, [F.col("body")]), "renamed")
    old, new = rest(old, renamed, "old_ordinal"), rest(new, renamed, "new_ordinal")
    none = F.lit(None).cast("int")
    return (
        kept.union(changed.withColumn("change", F.lit("changed"))).union(renamed.withColumn("change", F.lit("renamed")))
        .union(old.select("document_id", F.col("ordinal").alias("old_ordinal"), none.alias("new_ordinal"), F.lit("removed").alias("change")))
        .union(new.select("document_id", none.alias("old_ordinal"), F.col("ordinal").alias("new_ordinal"), F.lit("added").alias("change"))))
