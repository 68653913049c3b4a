"""From chunks to candidates through a model, whatever it is, and from there into the graph.

A model is an object with ``answer(request) -> str``: the request is a dict of the chunk and its context, the answer a JSON object.
Each task makes one, so a client and its connections are made once for many chunks. An answer that does not come is asked for
again where the model says that this can help; what fails in the end is a row with its kind of error, so a bad answer neither
stops the job nor is lost.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.operators import validate

# The fields of an answer.
ENTITY = "candidateId string, type string, name string, summary string, evidenceIds array<string>"
RELATION = "sourceId string, targetId string, relationType string, confidence double, evidenceIds array<string>"
EVIDENCE = "evidenceId string, sourceDocumentId string, sourceChunkId string, sectionPath string, quote string"
CONFLICT = "conflictType string, description string, evidenceIds array<string>"
_list = lambda fields: f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>"
ANSWER = f"summary string, entities {_list(ENTITY)}, relations {_list(RELATION)}, evidences {_list(EVIDENCE)}, conflicts {_list(CONFLICT)}"
LISTS = ("entities", "relations", "evidences", "conflicts")
_OUT = "chunk_id string, answer string, attempts int, error string, message string"


class Model(Protocol):
    def answer(self, request: dict) -> str: ...


class Busy(Exception):
    """The model could not answer now (a limit, a lost connection); the same request may be answered later."""


def _checked(answer: str) -> tuple[str | None, str | None]:
    """Kind of error and message of an answer that is not of the form asked for."""
    try:
        body = json.loads(answer)
    except (TypeError, ValueError) as e:
        return "no json", str(e)
    if not isinstance(body, dict):
        return "no object", f"the answer is of type {type(body).__name__}"
    wrong = [n for n in LISTS if not isinstance(body.get(n), list) or any(not isinstance(x, dict) for x in body[n])]
    return ("wrong form", f"no lists of objects: {', '.join(wrong)}") if wrong else (None, None)


def answers(chunks: DataFrame, make: Callable[[], Model], attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """chunk_id, answer, attempts, error and message for each chunk; all columns of ``chunks`` are the model's request. A null or
    blank ``content`` is not asked for: its error is ``empty``. Waits double from ``wait`` seconds on."""

    def one(model: Model, request: dict) -> tuple:
        if not (request.get("content") or "").strip():
            return request["chunk_id"], None, 0, "empty", None
        for n in range(1, attempts + 1):
            try:
                answer = model.answer(request)
            except Busy as e:
                if n < attempts:
                    time.sleep(wait * 2 ** (n - 1))
                    continue
                return request["chunk_id"], None, n, "busy", str(e)
            except Exception as e:  # noqa: BLE001  whatever a client raises belongs to its chunk
                return request["chunk_id"], None, n, "failed", f"{type(e).__name__}: {e}"
            error, message = _checked(answer)
            return request["chunk_id"], None if error else answer, n, error, message
        raise ValueError("at least one attempt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        for b in batches:
            for at in range(0, b.num_rows, 50):
                rows = [one(model, r) for r in b.slice(at, 50).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])

    return chunks.mapInArrow(run, _OUT)


def candidates(answered: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The answers' summaries, entities, relations, evidences and conflicts as flat rows, as the rules of validation take them,
    with the chunk's document_id, space_id and chunk_ord."""
    body = answered.filter("error is null").select("chunk_id", F.from_json("answer", ANSWER).alias("b"))
    own = chunks.select("chunk_id", F.col("document_id"), "space_id", "chunk_ord")
    each = lambda name: body.select("chunk_id", F.posexplode(f"b.{name}").alias("pos", "x"))
    x = lambda n, as_: F.col(f"x.{n}").alias(as_)
    return {
        "summaries": body.select("chunk_id", "b.summary"),
        "entities": each("entities").join(own, "chunk_id").select("chunk_id", "document_id", "space_id", "chunk_ord", "pos", x("candidateId", "candidate_id"), x("type", "type"), x("name", "name"), x("summary", "summary"), x("evidenceIds", "evidence_ids")),
        "relations": each("relations").join(own, "chunk_id").select("chunk_id", "document_id", "space_id", "chunk_ord", "pos", x("sourceId", "source_id"), x("targetId", "target_id"), x("relationType", "relation_type"), x("confidence", "confidence"), x("evidenceIds", "evidence_ids")),
        "evidences": each("evidences").select("chunk_id", "pos", x("evidenceId", "evidence_id"), x("sourceDocumentId", "document_id"), x("sourceChunkId", "source_chunk_id"), x("sectionPath", "section_path"), x("quote", "quote")),
        "conflicts": each("conflicts").select("chunk_id", "pos", x("conflictType", "conflict_type"), x("description", "description"), x("evidenceIds", "evidence_ids")),
    }


def accepted(found: dict[str, DataFrame], chunks: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The candidates of chunks that break no rule, and the violations of the others: a chunk's result counts whole or not."""
    bad = validate.all_violations(chunks, found["entities"], found["relations"], found["evidences"], found["conflicts"])
    out = bad.select("chunk_id").distinct()
    return {n: rows.join(out, "chunk_id", "left_anti") for n, rows in found.items()}, bad


class Rules:
    """A model without a network, for tests and trials: each different word of at least eight letters a-z is a term, the first is
    related to each other one, and the line in which a word first stands is its evidence. The same chunk always gives the same answer."""

    WORD = re.compile(r"[a-z]{8,}")

    def answer(self, request: dict) -> str:
        entities, evidences = [], []
        for line in request["content"].split("\n"):
            for word in self.WORD.findall(line):
                if word not in {e["name"] for e in entities}:
                    k = len(entities)
                    entities.append({"candidateId": f"e{k}", "type": "term", "name": word, "summary": "", "evidenceIds": [f"v{k}"]})
                    at = line.index(word)
                    quote = line[max(0, at - 100) : at + 900]
                    evidences.append({"evidenceId": f"v{k}", "sourceDocumentId": request["document_id"], "sourceChunkId": request["chunk_id"], "sectionPath": request["section_path"], "quote": quote})
        relations = [{"sourceId": "e0", "targetId": e["candidateId"], "relationType": "relates_to", "confidence": 0.5, "evidenceIds": e["evidenceIds"]} for e in entities[1:]]
        return json.dumps({"summary": request["content"].strip()[:160], "entities": entities, "relations": relations, "evidences": evidences, "conflicts": []})
