import random
import time

import pytest
from pyspark.sql import functions as F

from veridoc.plans import catalog
from veridoc.plans import records as queries  # noqa: F401
from veridoc.sources import eventlog
from veridoc.streaming import machines, versions

RUNS = [("r1", "chunk_started", 1), ("r1", "chunk_completed", 2), ("r1", "completed", 4), ("r1", "chunk_started", 5), ("r1", "error", 9), ("r2", "delta", 2), ("r3", "error", 3), ("r3", "completed", 7), ("r4", "chunk_started", 8)]
SCHEMA = "run_id string, event string, seq long"


def test_ends_absorb(spark):
    got = {r.run_id: tuple(r)[1:] for r in machines.run_states(spark.createDataFrame(RUNS, SCHEMA)).collect()}
    assert got == {"r1": ("completed", 1, 1, 4), "r2": ("processing", 0, 0, None), "r3": ("failed", 0, 0, 3), "r4": ("processing", 1, 0, None)}


def until(query, ready, seconds=100):
    """Waits for what the query should write, and stops it."""
    try:
        end = time.time() + seconds
        while time.time() < end and not ready(query):
            time.sleep(0.5)
        assert ready(query)
    finally:
        query.stop()


def latest(spark, path):
    try:
        return {r.run_id: r for r in versions.latest(spark, path, "run_id").collect()}
    except FileNotFoundError:
        return {}


def runs_of(spark, tmp_path, timeout, linger):
    return machines.stream_runs(spark, lambda s: s.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/out", timeout, linger, {"processingTime": "1 second"})


def test_stream_of_runs_goes_on_after_a_stop(spark, tmp_path):
    df = spark.createDataFrame(RUNS, SCHEMA)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for last in (2, 4, 9):  # each query starts from the checkpoint of the one before it
        df.filter(F.col("seq") <= last).join(df.filter(F.col("seq") <= {2: 0, 4: 2, 9: 4}[last]), ["run_id", "event", "seq"], "left_anti").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        want = {r.run_id: tuple(r) for r in machines.run_states(df.filter(F.col("seq") <= last)).collect()}
        until(runs_of(spark, tmp_path, 3600, 3600), lambda q: {k: tuple(r)[:5] for k, r in latest(spark, f"{tmp_path}/out").items()} == want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_a_run_without_events_fails_and_state_goes(spark, tmp_path):
    spark.createDataFrame([("quiet", "chunk_started", 1), ("done", "completed", 2)], SCHEMA).write.parquet(f"{tmp_path}/in")

    def ready(query):
        got = {k: (r.status, r.message) for k, r in latest(spark, f"{tmp_path}/out").items()}
        p = query.lastProgress
        return got == {"quiet": ("failed", "no event within the time allowed"), "done": ("completed", None)} and p and p["stateOperators"] and p["stateOperators"][0]["numRowsTotal"] == 0

    until(runs_of(spark, tmp_path, 1, 1), ready)


def test_readers_see_whole_batches_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(x, "k string, n int")
    with pytest.raises(FileNotFoundError):
        versions.latest(spark, path, "k")
    for batch in range(9):
        versions.write(rows(("a", batch), (f"b{batch}", 0)), path, batch, "k", every=3)
    (tmp_path / "t" / "rows-000000000008" / "_SUCCESS").unlink()  # as while its files are on their way
    assert {tuple(r) for r in versions.latest(spark, path, "k").collect()} >= {("a", 8)}  # the merge holds it
    versions.write(rows(("a", 9)), path, 9, "k", every=3)
    (tmp_path / "t" / "rows-000000000009" / "_SUCCESS").unlink()
    got = dict(tuple(r) for r in versions.latest(spark, path, "k").collect())
    assert got == {"a": 8} | {f"b{i}": 0 for i in range(9)} and len(list((tmp_path / "t").iterdir())) < 9


def slow_walk(events):
    """Moves by a plain loop."""
    seen, state, out = set(), {}, []
    for w, key, seq, step, status in sorted(events, key=lambda e: e[2]):
        if (w, key) in seen:
            continue
        seen.add((w, key))
        table = machines.RUN_MOVES if step is None else machines.STEP_MOVES
        before = state.get((w, step), next(iter(table)))
        legal = status in table[before]
        state[w, step] = status if legal else before
        out.append((w, step, seq, status, before, state[w, step], legal))
    return out


def moves(seed, n):
    r = random.Random(seed)
    names = [*machines.RUN_MOVES, *machines.STEP_MOVES, "UNKNOWN"]
    return [(r.choice("xyz"), f"k{r.randint(0, n)}", i, r.choice([None, "parse", "review", "apply"]), r.choice(names)) for i in range(n)]


EVENT = "workflow_id string, key string, seq long, step string, status string"


@pytest.mark.parametrize("block", [4096, 3])
def test_moves_equal_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(machines, "BLOCK", block)
    events = moves(block, 400)
    got = machines.walked(spark.createDataFrame(events, EVENT)).select("workflow_id", "step", "seq", "status", "state_before", "state_after", "legal").collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == slow_walk(events)


def test_a_workflow_resumes_in_the_order_of_its_definition(spark):
    e = [("w", "1", 1, None, "RUNNING"), ("w", "2", 2, "parse", "RUNNING"), ("w", "3", 3, "parse", "SUCCEEDED"), ("w", "3", 4, "review", "SKIPPED"), ("v", "1", 1, None, "CANCELLED"), ("u", "1", 1, "parse", "SKIPPED"), ("u", "2", 2, "review", "SKIPPED"), ("u", "3", 3, "apply", "SUCCEEDED")]
    got = {r.workflow_id: tuple(r)[1:] for r in machines.workflow_states(machines.walked(spark.createDataFrame(e, EVENT)), ["parse", "review", "apply"]).collect()}
    assert got == {"w": ("RUNNING", 1, 0, "review"), "v": ("CANCELLED", 0, 0, None), "u": ("CREATED", 2, 1, "apply")}


def test_stream_of_workflows_equals_the_batch(spark, tmp_path):
    events = moves(7, 120)
    df = spark.createDataFrame(events, EVENT).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    for k in range(3):
        df.filter(f"seq div 40 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        machines.stream_workflows(spark, lambda s: s.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/out").awaitTermination(180)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("workflow_id", "step", "seq", "status", "state_before", "state_after", "legal").collect()]
    assert sorted(got, key=lambda r: r[2]) == slow_walk(events)


def log_of(path, streams, cuts, seed=0):
    """Streams of bytes cut into parts at random places, dealt over batches."""
    r = random.Random(seed)
    for s, data in streams.items():
        at = sorted({0, len(data), *(r.randint(0, len(data)) for _ in range(cuts))})
        for n, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            (path / f"{n:012d}").mkdir(parents=True, exist_ok=True)
            (path / f"{n:012d}" / f"{s}.00000").write_bytes(data[a:b])
            (path / f"{n:012d}" / "_COMMITTED").touch()


STREAMS = {
    "one": 'event:run_started\ndata:{"run_id":"é日本"}\n\nevent: delta \ndata: {"delta":\ndata:  "x\\ny"}\n\n\n\nevent:delta\n\nnoise\n\nevent:completed\ndata:{"run_id":"r"}\n\n'.encode(),
    "two": b'\r\n\r\nevent:run_started\r\ndata:{"chunk_index":3}\r\n\r\nevent:delta\r\ndata:not json\r\n\r\nevent:delta\r\ndata:{"delta":"t"}',
    "none": b"\n\n\n",
}


@pytest.mark.parametrize("cuts, size", [(0, 8 << 20), (5, 8 << 20), (40, 7), (200, 1)])
def test_any_cut_gives_the_same_events(tmp_path, monkeypatch, cuts, size):
    monkeypatch.setattr(eventlog, "RANGE", size)
    monkeypatch.setattr(eventlog, "BACK", 5)
    log_of(tmp_path, STREAMS, cuts, cuts)
    reader = eventlog.BatchReader(str(tmp_path))
    rows = sorted(r for p in reader.partitions() for r in reader.read(p))
    got = [(r[0], r[2], dict(zip([n for n, _ in eventlog._FIELDS], r[3:], strict=True))) for r in rows]
    plain = [(s, e, {k: x for k, x in f.items() if x is not None}) for s, e, f in got]
    assert plain == [
        ("one", "run_started", {"run_id": "é日本"}), ("one", "delta", {"delta": "x\ny"}), ("one", "completed", {"run_id": "r"}),
        ("two", "run_started", {"chunk_index": 3}), ("two", "error", {"message": "the data of delta is no JSON object", "recoverable": False}), ("two", "delta", {"delta": "t"})]
    # batch by batch, each event comes once; only what has no empty line after it is still awaited
    stream, seen = eventlog.StreamReader(str(tmp_path)), []
    last = stream.latestOffset()["batch"]
    for n in range(-1, last):
        seen += [r for p in stream.partitions({"batch": n}, {"batch": n + 1}) for r in stream.read(p)]
    assert sorted(seen) == [r for r in rows if not (r[0] == "two" and r[2] == "delta")]


def test_log_through_spark(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = [("a/b", i, "delta" if i else "run_started", "r", None, i, f"é{i}\n\n", None, None) for i in range(50)] + [("c", 0, "completed", "r", "x", None, None, "m", True)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, event string, run_id string, chunk_id string, chunk_index int, delta string, message string, recoverable boolean")
    eventlog.write(df.filter("seq < 20"), path)
    query = eventlog.read_stream(spark, path).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    query.start().awaitTermination(180)
    eventlog.write(df.filter("seq >= 20"), path)
    query.start().awaitTermination(180)
    want = sorted(map(str, df.drop("document_id").collect()))
    columns = df.columns
    assert sorted(map(str, eventlog.numbered(eventlog.read(spark, path)).select(columns).collect())) == want
    assert sorted(map(str, eventlog.numbered(spark.read.parquet(f"{tmp_path}/out")).select(columns).collect())) == want
    broken = eventlog.with_broken(eventlog.read(spark, path)).filter(F.col("message") == eventlog.BROKEN_OFF).collect()
    assert [(r.stream_id, r.event) for r in broken] == [("a/b", "error")]


def test_unmarked_batches_do_not_exist(spark, tmp_path):
    log_of(tmp_path, STREAMS, 0)
    (tmp_path / "000000000000" / "_COMMITTED").unlink()
    assert eventlog.read(spark, str(tmp_path)).count() == 0


def test_queries_of_events_have_sql():
    assert {"run_state_fold", "workflow_states", "workflow_refused", "event_text_round_trip", "event_streams_broken"} <= set(catalog.SQL)


def test_files_and_tasks_do_not_grow_with_streams(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/log"
    rows = [(f"s{i:04d}", k, "delta", f"{i}-{k}") for i in range(600) for k in range(3)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, event string, delta string")
    eventlog.write(df.filter("seq < 2"), path)
    eventlog.write(df.filter("seq = 2"), path)
    assert len(list((tmp_path / "log" / "000000000000").iterdir())) <= 5 and len(eventlog.BatchReader(path).partitions()) <= 8
    # a stream that another service goes on with, and a cut part of a segment
    (tmp_path / "log" / "000000000002").mkdir()
    (tmp_path / "log" / "000000000002" / "s0007.00000").write_bytes(b'event:delta\ndata:{"delta":"7-3"}\n\n')
    (tmp_path / "log" / "000000000002" / "_COMMITTED").touch()
    want = sorted([(s, d) for s, _, _, d in rows] + [("s0007", "7-3")], key=lambda r: (r[0], int(r[1].split("-")[1])))
    for size in (8 << 20, 50):
        monkeypatch.setattr(eventlog, "RANGE", size)
        reader = eventlog.BatchReader(path)
        got = sorted(r for p in reader.partitions() for r in reader.read(p))
        names = [n for n, _ in eventlog._FIELDS]
        assert [(r[0], r[3 + names.index("delta")]) for r in got] == want
        stream, seen = eventlog.StreamReader(path), []
        for n in range(-1, 2):
            seen += [r for p in stream.partitions({"batch": n}, {"batch": n + 1}) for r in stream.read(p)]
        assert sorted(seen) == got
