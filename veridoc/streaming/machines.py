"""State machines of runs and workflows: transitions as data, the fold of a batch, and stateful streams.

Runs: processing, then completed or failed. The first ending event decides, and nothing after it counts.

Workflows: events move a workflow or one of its steps from state to state where the transition table allows it; an event that it
does not allow changes nothing and is a row of its own. What an event does is a map of states to states, and such maps can be put
together in any grouping. So the batch fold cuts each machine's events into blocks of sequence numbers, makes one map of a block,
finds each block's first state from the maps before it, and then walks each block: no machine's events meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from veridoc.streaming import versions

# States of workflows and steps, the first of each is where one starts, and which may follow which.
RUN_MOVES = {
    "CREATED": ("RUNNING", "CANCELLED"),
    "RUNNING": ("WAITING_HUMAN", "WAITING_EVENT", "RETRY_SCHEDULED", "COMPLETED", "FAILED", "CANCELLED"),
    "WAITING_HUMAN": ("RUNNING", "FAILED", "CANCELLED"),
    "WAITING_EVENT": ("RUNNING", "FAILED", "CANCELLED"),
    "RETRY_SCHEDULED": ("RUNNING", "FAILED", "CANCELLED"),
    "COMPLETED": (), "FAILED": (), "CANCELLED": (),
}
STEP_MOVES = {"PENDING": ("RUNNING", "SKIPPED", "CANCELLED"), "RUNNING": ("SUCCEEDED", "FAILED", "CANCELLED"), "FAILED": ("RUNNING",), "SUCCEEDED": (), "SKIPPED": (), "CANCELLED": ()}
MOVES = {"run": RUN_MOVES, "step": STEP_MOVES}
DONE = ("SUCCEEDED", "SKIPPED")
ENDS = ("completed", "error")
#: Sequence numbers of a block, seconds without an event after which a run has failed, and for which an ended run is remembered.
BLOCK, TIMEOUT, LINGER = 4096, 900, 3600
_STATE = "status string, chunks_started long, chunks_completed long, ended_at long"
_NAMES = {kind: list(moves) for kind, moves in MOVES.items()}


# ---- the transition tables as columns
def _numbers(kind: str, names: Column) -> Column:
    """The state's number in its kind's list, from 1; 0 for a name that is no state."""
    return F.array_position(F.array(*map(F.lit, _NAMES[kind])), names).cast("int")


def _allowed(kind: str) -> Column:
    """For each state a text of 0 and 1: whether the state of that number may follow."""
    return F.array(*[F.lit("".join("01"[t in to] for t in _NAMES[kind])) for to in MOVES[kind].values()])


def _step(kind: str, state: Column, target: Column) -> Column:
    """The state after an event that asks for ``target``: the target where it may follow, else the same state."""
    return F.when((target > 0) & (F.substring(F.element_at(_allowed(kind), state), target, F.lit(1)) == "1"), target).otherwise(state)


def _walked(rows: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Rows (keys, seq, status) of one kind with ``state_before`` and ``legal``."""
    blocks = rows.withColumn("_b", F.floor(F.col("seq") / BLOCK)).groupBy(*keys, "_b").agg(
        F.sort_array(F.collect_list(F.struct("seq", "status", _numbers(kind, F.col("status")).alias("to")))).alias("_e"))
    count = len(_NAMES[kind])
    start = F.array(*[F.lit(i) for i in range(1, count + 1)])
    maps = blocks.withColumn("_map", F.aggregate("_e", start, lambda m, e: F.transform(m, lambda s: _step(kind, s, e["to"]))))
    # one short row for each block: the states in which the blocks of a machine begin
    order = F.sort_array(F.collect_list(F.struct("_b", "_map")))
    begin = F.aggregate(
        order, F.array(F.struct(F.lit(None).cast("long").alias("_b"), F.lit(1).alias("_s"))),
        lambda done, x: F.array_append(done, F.struct(x["_b"].alias("_b"), F.element_at(x["_map"], F.element_at(done, -1)["_s"]).alias("_s"))))
    firsts = maps.groupBy(*keys).agg(begin.alias("_done")).select(*keys, F.posexplode(F.zip_with(
        F.slice("_done", 1, F.size("_done") - 1), F.slice("_done", 2, F.size("_done")), lambda a, b: F.struct(b["_b"].alias("_b"), a["_s"].alias("_s"))))).select(*keys, "col._b", "col._s")
    walked = F.aggregate(
        "_e", F.array(F.struct(F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("before"), F.col("_s").alias("after"))),
        lambda done, e: F.array_append(done, F.struct(e["seq"].alias("seq"), e["status"].alias("status"), F.element_at(done, -1)["after"].alias("before"), _step(kind, F.element_at(done, -1)["after"], e["to"]).alias("after"))))
    names = F.array(*map(F.lit, _NAMES[kind]))
    out = blocks.join(firsts, [*keys, "_b"]).select(*keys, F.explode(walked).alias("w")).filter("w.seq is not null")
    return out.select(*keys, "w.seq", "w.status", F.element_at(names, F.col("w.before")).alias("state_before"), F.element_at(names, F.col("w.after")).alias("state_after"), (F.col("w.before") != F.col("w.after")).alias("legal"))


def once(events: DataFrame) -> DataFrame:
    """Events with an idempotency key of their workflow that was there before count once; the first by ``seq`` stays."""
    return events.groupBy("workflow_id", "key").agg(F.min_by(F.struct("step", "seq", "status"), "seq").alias("e")).select("workflow_id", "key", "e.*")


def walked(events: DataFrame) -> DataFrame:
    """Each event (workflow_id, key, seq, step, status) once, with the state before and after it and whether it was ``legal``.
    A null step speaks of the workflow itself. ``seq`` differs within a workflow."""
    rows = once(events)
    of_run = _walked(rows.filter("step is null"), "run", ["workflow_id"]).withColumn("step", F.lit(None).cast("string"))
    return of_run.unionByName(_walked(rows.filter("step is not null"), "step", ["workflow_id", "step"]))


def workflow_states(moves: DataFrame, steps: Sequence[str]) -> DataFrame:
    """State of each workflow of :func:`walked` rows: its own last state, how many of its steps are done, how many events were
    not allowed, and where it resumes: the first of ``steps``, the definition's order, that is not done; null after the end."""
    last = moves.groupBy("workflow_id", "step").agg(F.max_by("state_after", "seq").alias("state"), F.count_if(~F.col("legal")).alias("refused"))
    whole = last.groupBy("workflow_id").agg(
        F.coalesce(F.max(F.when(F.col("step").isNull(), F.col("state"))), F.lit("CREATED")).alias("state"),
        F.count_if(F.col("step").isNotNull() & F.col("state").isin(*DONE)).alias("done"), F.sum("refused").alias("refused"),
        F.collect_list(F.when(F.col("state").isin(*DONE), F.col("step"))).alias("_done"))
    left = F.filter(F.array(*map(F.lit, steps)), lambda s: ~F.array_contains(F.col("_done"), s))
    ended = F.col("state").isin(*[s for s, to in RUN_MOVES.items() if not to])
    return whole.select("workflow_id", "state", "done", "refused", F.when(~ended & (F.size(left) > 0), F.element_at(left, 1)).alias("resume_at"))


def run_states(events: DataFrame) -> DataFrame:
    """Status of each run and its chunks up to the first ending event, which decides; ``ended_at`` is its seq."""
    end = F.min(F.when(F.col("event").isin(*ENDS), F.col("seq"))).alias("ended_at")
    ends = events.groupBy("run_id").agg(end, F.min_by("event", F.when(F.col("event").isin(*ENDS), F.col("seq"))).alias("_last"))
    counts = events.filter(F.col("event").isin("chunk_started", "chunk_completed")).join(ends, "run_id").filter("ended_at is null or seq < ended_at")
    n = lambda e: F.count_if(F.col("event") == e)
    counts = counts.groupBy("run_id").agg(n("chunk_started").alias("chunks_started"), n("chunk_completed").alias("chunks_completed"))
    status = F.when(F.col("_last") == "completed", "completed").when(F.col("_last") == "error", "failed").otherwise("processing")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return ends.join(counts, "run_id", "left").select("run_id", status.alias("status"), zero("chunks_started"), zero("chunks_completed"), "ended_at")


# ---- streams
class RunMachine(StatefulProcessor):
    """A run's status and counts as value state. A run without events for ``timeout`` seconds has failed. After its end only a
    mark stays, so that what comes later counts for nothing, and the mark goes after ``linger`` seconds."""

    def __init__(self, timeout: float, linger: float):
        self.timeout, self.linger = timeout, linger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", _STATE)

    def _timer(self, at: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        old = self.state.get() if self.state.exists() else ("processing", 0, 0, None)
        if old[0] != "processing":
            return iter(())
        parts = [p[["seq", "event"]] for p in rows]
        events = pd.concat(parts)
        ends = events[events["event"].isin(ENDS)]
        status, end = old[0], None
        if len(ends):
            first = ends.loc[ends["seq"].to_numpy().argmin() == range(len(ends))].iloc[0]
            status, end = ("completed" if first["event"] == "completed" else "failed"), int(first["seq"])
            events = events[events["seq"] < end]
        new = (status, old[1] + int((events["event"] == "chunk_started").sum()), old[2] + int((events["event"] == "chunk_completed").sum()), end)
        self.state.update(new)
        self._timer(now + 1000 * (self.timeout if status == "processing" else self.linger))
        return iter([self._row(key, new, None)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        if old is None or old[0] != "processing":
            self.state.clear()
            return iter(())
        new = ("failed", old[1], old[2], None)
        self.state.update(new)
        self._timer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.linger)
        return iter([self._row(key, new, "no event within the time allowed")])

    @staticmethod
    def _row(key: tuple, state: tuple, message: str | None) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "status": [state[0]], "chunks_started": [state[1]], "chunks_completed": [state[2]], "ended_at": pd.array([state[3]], "Int64"), "message": pd.array([message], object)})

    def close(self) -> None:
        pass


class WorkflowMachine(StatefulProcessor):
    """The states of a workflow and its steps as map state; each event gives a row with the state before and after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("states", "name string", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, step, status in zip(events["seq"].tolist(), events["step"].tolist(), events["status"].tolist(), strict=True):
            step = step if isinstance(step, str) else None
            kind, name = ("run", ("",)) if step is None else ("step", (f"s{step}",))
            before = self.states.getValue(name)[0] if self.states.containsKey(name) else _NAMES[kind][0]
            legal = status in MOVES[kind][before]
            if legal:
                self.states.updateValue(name, (status,))
            out.append((key[0], step, seq, status, before, status if legal else before, legal))
        return iter([pd.DataFrame(out, columns=["workflow_id", "step", "seq", "status", "state_before", "state_after", "legal"]).astype({"step": object})])

    def close(self) -> None:
        pass


def _stateful(spark: SparkSession) -> SparkSession:
    """A session of its own for a stateful stream, since the settings it needs hold for a whole session."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if value := spark.conf.get(name, None):
            own.conf.set(name, value)
    return own


def stream_runs(spark: SparkSession, events, checkpoint: str, table: str, timeout: float = TIMEOUT, linger: float = LINGER, trigger: dict | None = None) -> StreamingQuery:
    """A streaming query that keeps the states of runs up to date in the versioned table at ``table`` (:mod:`.versions`).

    ``events`` makes the streaming DataFrame (run_id, seq, event, ...) from a session. Only runs that moved are written, with
    each micro-batch. State lives in the executors' state store; a stop and a start from the checkpoint lose and repeat
    nothing. Events of a run within one micro-batch may come in any order; across them, an end that came first stays. The
    query runs until it is stopped, also without events, since time ends runs too.
    """
    out = "run_id string, status string, chunks_started long, chunks_completed long, ended_at long, message string"
    rows = events(_stateful(spark)).select("run_id", "seq", "event").groupBy("run_id")
    states = rows.transformWithStateInPandas(RunMachine(timeout, linger), out, "Update", "ProcessingTime")
    query = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: versions.write(df, table, n, "run_id"))
    return query.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def stream_workflows(spark: SparkSession, events, checkpoint: str, table: str, late: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """A streaming query that appends a row for each workflow event (workflow_id, key, seq, step, status, at) to the Parquet
    table at ``table``: the state before and after it, and whether it was legal. An event whose key was there within ``late``
    counts once."""
    out = "workflow_id string, step string, seq long, status string, state_before string, state_after string, legal boolean"
    rows = events(_stateful(spark)).withWatermark("at", late).dropDuplicatesWithinWatermark(["workflow_id", "key"])
    moves = rows.select("workflow_id", "seq", "step", "status").groupBy("workflow_id").transformWithStateInPandas(WorkflowMachine(), out, "Append", "None")
    return moves.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
