"""Views that read the sample tables as a knowledge workspace: one SQL text each, for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from veridoc.sources.tables import table

VIEWS = {
    "v_space": "SELECT DISTINCT lang AS id, concat('space ', lang) AS name, CASE WHEN lang = 'es' THEN 'deleted' ELSE 'active' END AS status FROM documents",
    "v_document": """SELECT CAST(doc_id AS STRING) AS id, lang AS space_id, source AS batch_id, concat(source, '_', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' ELSE '.pdf' END) AS name,
        text AS content_text, @sha(text) AS content_hash, CASE WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'active' END AS status, n_chars AS file_size, doc_id AS imported_at, doc_id % 97 AS updated_at FROM documents""",
    "v_run": """SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS document_id, ts AS created_at,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'completed' END AS status, CASE event_type WHEN 'purchase' THEN props WHEN 'click' THEN '  ' END AS document_summary FROM events""",
    "v_node": """SELECT concat('s', CAST(s_suppkey AS STRING)) AS id, 'organization' AS node_type, s_name AS label, CAST(s_nationkey AS STRING) AS summary, CASE WHEN s_suppkey % 11 = 0 THEN 'conflict' WHEN s_suppkey % 13 = 0 THEN 'orphan' ELSE 'active' END AS status, lower(concat('organization:', s_name)) AS normalized_key FROM supplier
        UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 'feature', p_name, p_brand, CASE WHEN p_partkey % 17 = 0 THEN 'stale' ELSE 'active' END, lower(concat('feature:', p_name)) FROM part""",
    "v_edge": """SELECT concat('e', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS id, concat('s', CAST(l_suppkey AS STRING)) AS source_node_id, concat('p', CAST(l_partkey AS STRING)) AS target_node_id, 'supplies' AS relation_type,
        CASE max(l_returnflag) WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'suggested' ELSE 'rejected' END AS status FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "v_evidence": """SELECT concat('v', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, concat('e', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS edge_id,
        CAST(l_orderkey AS STRING) AS source_document_id, l_shipdate AS created_at, concat(l_returnflag, l_linestatus) AS quote FROM lineitem""",
    "v_evdoc": "SELECT CAST(o_orderkey AS STRING) AS id, concat('order ', CAST(o_orderkey AS STRING)) AS name, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice > 250000 THEN 'active' WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' AND o_totalprice > 490000 THEN 'deleted' ELSE 'leaving' END AS status FROM orders",
    "v_source": "SELECT DISTINCT concat('p', CAST(l_partkey AS STRING)) AS id, CAST(l_orderkey AS STRING) AS document_id FROM lineitem",
    "v_chunk": """SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS chunk_id, CAST(conv_id % 50 AS STRING) AS document_id, concat('sp', CAST(conv_id % 3 AS STRING)) AS space_id, conv_id * 1000 + turn AS chunk_ord, role AS section_path, text AS content, conv_id, turn FROM conversations""",
    "v_entity": """SELECT chunk_id, document_id, space_id, chunk_ord, 0 AS pos, 'e0' AS candidate_id, 'project' AS type, regexp_extract(content, '^([^ ]+)', 1) AS name, section_path AS summary, CASE WHEN turn % 7 = 3 THEN 'v9' ELSE 'v0' END AS evidence_id FROM v_chunk
        UNION ALL SELECT chunk_id, document_id, space_id, chunk_ord, 1, CASE WHEN conv_id % 19 = 4 THEN 'e0' ELSE 'e1' END, CASE WHEN conv_id % 23 = 5 THEN 'gadget' ELSE 'feature' END, regexp_extract(content, '^[^ ]+ ([^ ]+)', 1), '', 'v0' FROM v_chunk""",
    "v_proof": """SELECT chunk_id, 0 AS pos, 'v0' AS evidence_id, CASE WHEN turn % 8 = 6 THEN 'x' ELSE document_id END AS document_id, CASE WHEN turn % 11 = 5 THEN 'x' ELSE chunk_id END AS source_chunk_id, section_path, CASE WHEN conv_id % 5 = 0 THEN concat(substr(content, 1, 30), '#') ELSE substr(content, 1, 30) END AS quote FROM v_chunk""",
    "v_relation": """SELECT chunk_id, document_id, space_id, chunk_ord, 0 AS pos, 'e0' AS source_id, CASE WHEN turn % 13 = 7 THEN 'e7' ELSE 'e1' END AS target_id, CASE WHEN conv_id % 17 = 3 THEN 'Bad Type' ELSE 'project_contains_feature' END AS relation_type, CAST(conv_id % 12 AS DOUBLE) / 10.0D AS confidence, CASE WHEN turn % 7 = 4 THEN 'v9' ELSE 'v0' END AS evidence_id FROM v_chunk""",
    "v_event": """SELECT CAST(user_id AS STRING) AS run_id, concat('c', CAST(event_id % 3 AS STRING)) AS chunk_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'delta' WHEN 'click' THEN 'chunk_started' WHEN 'signup' THEN 'chunk_completed' WHEN 'error' THEN CASE WHEN event_id % 50 = 0 THEN 'error' ELSE 'delta' END ELSE CASE WHEN event_id % 40 = 0 THEN 'completed' ELSE 'delta' END END AS event,
        CASE WHEN event_id % 10 = 0 THEN '' ELSE CAST(event_id % 100 AS STRING) END AS delta FROM events""",
}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_WORD = re.compile(r"\b(v_\w+)\b")


def needed(text: str) -> list[str]:
    """Names of the views that a text uses, those first on which others rest."""
    out: list[str] = []
    for name in dict.fromkeys(_WORD.findall(text)):
        if name in VIEWS:
            out += [x for x in [*needed(VIEWS[name]), name] if x not in out]
    return list(dict.fromkeys(out))


def duckdb(body: str) -> str:
    """A query over the views as one statement for DuckDB."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed(body))
    text = (f"WITH {views} " + (", " + body[5:] if body.startswith("WITH ") else body)) if views else body
    return re.sub(r"@sha\((\w+)\)", r"sha256(\1)", text).replace("10.0D", "CAST(10 AS DOUBLE)")


class Workspace:
    """The views over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return table(self.spark, self.sf_dir, name)
        text = re.sub(r"@sha\((\w+)\)", r"sha2(\1, 256)", VIEWS[name])
        inner = [n for n in needed(text)] + [b for b in BASE if re.search(rf"\bFROM {b}\b", text)]
        for n in inner:
            text = re.sub(rf"\bFROM {n}\b", f"FROM {{{n}}}", text)
        return self.spark.sql(text, **{n: self(n) for n in inner})
