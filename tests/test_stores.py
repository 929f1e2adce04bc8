"""The vector store, keyed streams cut into many files, and log sinks that get a batch twice."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import search as S
from folio.operators import vector_store as V
from folio.streaming import sinks, state
from folio.streaming import trace as X


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id string, doc_id long, embedding array<double>, list string")


def vectors(n=3000, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 3, (20, 8))
    return centres[draw.integers(0, 20, n)] + draw.normal(0, 0.5, (n, 8))


def plain(rows, asked, top):
    out = {}
    for q, v in asked:
        near = sorted((round(float(((np.array(e) - v) ** 2).sum()), 9), i) for i, _, e, _ in rows)
        out[q] = [i for _, i in near[:top]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.record_id)
    return out


def test_lists_find_neighbours_and_all_lists_all(spark):
    data = vectors()
    rows = [(f"r{i}", i % 7, v.tolist(), "clash") for i, v in enumerate(data)]
    rows += [(f"copy{i}", 1, data[0].tolist(), "clash") for i in range(1500)]  # a third of all in one list
    store = V.build(frame(spark, rows), dims=8)
    assert len(store.centroids) > 10 and store.probes < len(store.centroids)
    asked = [(f"q{i}", data[i * 31]) for i in range(40)]
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in asked], "query_id string, vector array<double>")
    want = plain(rows, asked, 10)
    got = found(V.search(store, queries, 10))
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert found(V.search(store, queries, 10, probes=len(store.centroids))) == want
    some = [r for r in rows if r[1] in (2, 5)]
    assert found(V.search(store, queries, 4, probes=len(store.centroids), doc_ids=[2, 5])) == plain(some, asked, 4)
    plan = V.search(store, queries, 4, doc_ids=[2, 5])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [2,5])]" in plan


def test_records_that_fail_alone(spark):
    good = [(f"r{i}", 1, [float(i), 0.0], None) for i in range(5)]
    bad = [(None, 1, [1.0, 2.0], None), ("a", 1, None, None), ("b", 2, [1.0], None), ("c", 2, [1.0, None], None), ("d", None, [float("inf"), 1.0], None), ("e", 3, [float("nan"), 1.0], None), ("r1", 1, [1.0, 0.0], None)]
    store = V.build(frame(spark, good + bad), dims=2)
    assert {(r.record_id, r.reason) for r in store.failures.collect()} == {(None, "no id"), ("a", "no vector"), ("b", "other length"), ("c", "not finite"), ("d", "not finite"), ("e", "not finite")}
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("short", [1.0]), ("none", None)], "query_id string, vector array<double>")
    assert found(V.search(store, queries, 3)) == {"q": ["r1", "r1", "r0"]}
    empty = V.build(frame(spark, []), dims=2)
    assert V.search(empty, queries).count() == 0 and empty.failures.count() == 0


def test_recall_on_the_tables(spark):
    from folio.plans import stores

    rows = stores.QUERIES["vector_store_recall"](spark, "/root/testdata/sf0.1").collect()
    assert sum(r.found for r in rows) >= 0.9 * sum(r.due for r in rows)


def events(n=400, seed=1):
    draw = random.Random(seed)
    kinds = ["start", "done", "broken", "click", None]
    return [(draw.choice([1, 2, 3, None]), i, 1_000_000 * (i // 2), draw.choice(kinds)) for i in range(n)]


SCHEMA = "run_id long, event_id long, at long, event string"


def write_in_turn(spark, rows, path, parts):
    os.makedirs(path, exist_ok=True)
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def run(spark, df, path):
    spark.conf.set(*state.PROVIDER)
    try:
        df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(state.PROVIDER[0])
    return sorted(map(tuple, spark.read.schema(df.schema).parquet(f"{path}/rows").collect()), key=repr)


@pytest.fixture
def log(spark, tmp_path):
    rows = events()
    write_in_turn(spark, rows, str(tmp_path / "log"), 6)
    return rows, str(tmp_path / "log"), tmp_path


def streamed(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_steps_outlive_their_batch(spark, log):
    rows, path, tmp = log
    got = run(spark, state.steps(streamed(spark, path), "start", ("done", "broken"), ("broken",)), str(tmp / "steps"))
    want, opened = [], {}
    for run_id, event_id, at, event in sorted(rows, key=lambda r: (r[2], r[1])):
        if event == "start":
            opened[run_id] = (event_id, at)
        elif event in ("done", "broken") and run_id in opened:
            begun = opened.pop(run_id)
            want.append((run_id, begun[0], event, (at - begun[1]) // 1000, event == "broken"))
    assert got == sorted(want, key=repr)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("at"))
    pairs = X.step_durations(batch, "start", ("done", "broken")).collect()
    assert sorted((r.run_id, r.event_id, r.ended_by, r.duration_ms) for r in pairs if r.run_id) == sorted(r[:4] for r in got if r[0])


def test_status_goes_on_over_batches(spark, log):
    rows, path, tmp = log
    got = run(spark, state.status_changes(streamed(spark, path), "done", "broken"), str(tmp / "status"))
    want, last = [], {}
    for run_id, event_id, _, event in sorted(rows, key=lambda r: (r[2], r[1])):
        if event is not None:
            status, n = last.get(run_id, ("not_started", 0))
            now = {"done": "completed", "broken": "failed"}.get(event, "running")
            last[run_id] = (now, n + 1)
            if now != status:
                want.append((run_id, event_id, now, n + 1))
    assert got == sorted(want, key=repr)


def messages(spark, first, n):
    rows = [(f"run{i % 2}", 1_000_000 * i, '{"event": "hit", "component": "search_index", "n": 1}' if i % 3 == 0 else "plain") for i in range(first, first + n)]
    return spark.createDataFrame(rows, "run_id string, at long, message string").withColumn("at", F.timestamp_micros("at"))


def test_a_batch_sent_twice_is_there_once(spark, tmp_path):
    folder = str(tmp_path)
    updates = lambda batch: batch.select(F.col("run_id").alias("key"), F.col("message").alias("value"), F.unix_micros("at").alias("at"))
    write = sinks.log_sink(folder, X.recorded, updates)
    assert sinks.read_summary(spark, f"{folder}/summary").count() == 0
    for number, batch in ((0, messages(spark, 0, 6)), (1, messages(spark, 6, 3)), (1, messages(spark, 6, 3)), (1, messages(spark, 6, 3))):
        write(batch, number)
    n = {log: sinks.read_log(spark, f"{folder}/logs", log).groupBy("batch").agg(F.count("*").alias("n")) for log in sinks.LOGS}
    assert {log: {r.batch: r.n for r in rows.collect()} for log, rows in n.items()} == {"events": {0: 6, 1: 3}, "search": {0: 2, 1: 1}}
    summary = {r.key: (r.value, r.at) for r in sinks.read_summary(spark, f"{folder}/summary").collect()}
    assert summary == {"run0": ("plain", 8_000_000), "run1": ("plain", 7_000_000)}
    # A batch that fails on its way leaves nothing that a reader sees.
    broken = X.recorded(messages(spark, 9, 3)).withColumn("event", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_logs(broken, f"{folder}/logs", 2)
    assert sinks.read_log(spark, f"{folder}/logs", "events").count() == 9
    # Updates that come late don't undo newer ones.
    sinks.merge_summary(updates(messages(spark, 0, 2)), f"{folder}/summary", 2)
    assert {r.key: (r.value, r.at) for r in sinks.read_summary(spark, f"{folder}/summary").collect()} == summary
