"""Streams over files that arrive: restarts, repeats, late rows; readers and writers."""

import csv
import datetime
import glob
import json
import random

from pyspark.sql import functions as F

from docfields.sources import io
from docfields.streaming import streams

EVENTS = "job_id long, state string, ts timestamp, event_id long"


def at(minutes):
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=minutes)


def arrive(spark, folder, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema=EVENTS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_upsert_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "MERGED_EVERY", 3)
    rng = random.Random(1)
    rows = [(rng.randrange(12), f"s{rng.randrange(9)}", at(rng.randrange(500)), k) for k in range(200)]
    seen = []
    for part in (rows[:50], rows[50:60], rows[60:180], rows[180:]):
        for k in range(0, len(part), 20):
            arrive(spark, tmp_path / "events", part[k : k + 20])
        seen += part
        found = streams.upsert_stream(stream(spark, tmp_path / "events"), f"file://{tmp_path}/kept")
        latest = {}
        for job, state, ts, event in seen:
            latest[job] = max(latest.get(job, (datetime.datetime.min, -1, "")), (ts, event, state))
        assert sorted(map(tuple, found.collect())) == sorted((job, state, ts) for job, (ts, _, state) in latest.items())
    assert glob.glob(f"{tmp_path}/kept/state/base=*") and len(glob.glob(f"{tmp_path}/kept/state/*=*")) <= 4


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    state = streams.BatchState(spark, f"file://{tmp_path}/state", streams.JOBS, streams._latest_jobs)
    batch = spark.createDataFrame([(1, "a", at(1), 1), (1, "b", at(2), 2)], EVENTS)
    for k in (0, 0, 1, 1):
        state.add(batch, k)
    assert [tuple(r) for r in state.table().collect()] == [(1, "b", at(2), 2)]
    assert streams.BatchState(spark, f"file://{tmp_path}/none", streams.JOBS, streams._latest_jobs).table().count() == 0


def run(df, spark, folder, mode="append"):
    rows = []
    df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: rows.extend(map(tuple, batch.collect()))).option("checkpointLocation", f"file://{folder}").trigger(availableNow=True).start().awaitTermination()
    return rows


def test_fresh_stream_drops_repeats_and_done_jobs(spark, tmp_path):
    done = spark.createDataFrame([(2,)], "job_id long")
    for part in ([(1, "pending", at(0), 1), (2, "pending", at(1), 2)], [(1, "pending", at(5), 3), (1, "failed", at(6), 4), (3, "pending", at(7), 5)], [(3, "pending", at(60 * 30), 6)]):
        arrive(spark, tmp_path / "events", part)
    found = run(streams.fresh_stream(stream(spark, tmp_path / "events"), done, "1 hour"), spark, tmp_path / "checkpoint")
    assert {(r[0], r[1]) for r in found} == {(1, "pending"), (1, "failed"), (3, "pending")} and not any(r[0] == 2 for r in found)
    assert len([r for r in found if r[0] == 1]) == 2


def test_windows_drop_late_rows(spark, tmp_path):
    for part in ([(1, "pending", at(10), 1), (1, "pending", at(20), 2)], [(1, "pending", at(300), 3)], [(1, "pending", at(301), 7)], [(1, "pending", at(15), 4), (1, "pending", at(310), 5)], [(1, "pending", at(900), 6)]):
        arrive(spark, tmp_path / "events", part)
    found = run(streams.kpi_windows(stream(spark, tmp_path / "events"), "1 hour", late="30 minutes").select("state", "start", "n"), spark, tmp_path / "checkpoint")
    # the row of minute 15 came after its window had closed
    assert ("pending", at(0), 2) in found and ("pending", at(300), 3) in found and len(found) == 2


def test_readers_and_writers(spark, tmp_path):
    pages = [(1, 1, "a, b", "digital", 0.9), (1, 2, None, "ocr", 0.5)]
    spark.createDataFrame(pages, "doc_id long, page long, text string, source string, confidence double").write.parquet(f"{tmp_path}/pages")
    assert sorted(map(tuple, io.read_pages(spark, f"file://{tmp_path}/pages").collect())) == pages
    rows = spark.createDataFrame([("x", ["a", "", "b"], None, "['p', 'q']"), ("y, z", [], "1", "plain [1]")], "b string, l array<string>, a string, t string")
    io.write_csv(rows.coalesce(1), f"file://{tmp_path}/csv", ["a", "b", "l", "t"])
    (name,) = glob.glob(f"{tmp_path}/csv/part-*.csv")
    with open(name, encoding="utf-8", newline="") as f:
        assert list(csv.reader(f)) == [["a", "b", "l", "t"], ["", "x", "a|b", "p|q"], ["1", "y, z", "", "plain [1]"]]
    io.write_json(rows.select("b").coalesce(1), f"file://{tmp_path}/json")
    (name,) = glob.glob(f"{tmp_path}/json/part-*.json")
    with open(name, encoding="utf-8") as f:
        assert [json.loads(line) for line in f] == [{"b": "x"}, {"b": "y, z"}]
    occurrences = spark.createDataFrame([(1, "tender_value", "5", 1, 9, 80, 0)], "tender_id long, field_name string, value_raw string, page long, total_pages long, conf_pct long, ord long")
    io.write_evidence(occurrences.withColumn("zone", F.lit("COVER")).withColumn("score", F.lit(240)), f"file://{tmp_path}/evidence")
    (name,) = glob.glob(f"{tmp_path}/evidence/bucket=*/part-*.csv")
    with open(name, encoding="utf-8", newline="") as f:
        assert list(csv.reader(f)) == [["tender_id", "field_name", "value", "page", "zone", "confidence", "score", "ord"], ["1", "tender_value", "5", "1", "COVER", "80", "240", "0"]]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain_transitions(events, table=streams.TRANSITIONS):
    at, out = {}, []
    for job, state, ts, event in sorted(events, key=lambda e: (e[0], e[2], e[3])):
        if state == "edited":
            continue
        before, legal = at.get(job), state in table[at.get(job)]
        out.append((job, event, ts, before, state, legal, None if legal else "no state" if state is None else "repeated" if state == before else f"a job does not begin {state}" if before is None else f"{before} does not become {state}"))
        if legal:
            at[job] = state
    return sorted(out, key=str)


def job_events(seed, n, jobs=8):
    rng = random.Random(seed)
    return [(rng.randrange(jobs), rng.choice(["pending", "processing", "processing", "completed", "failed", "edited", "lost", None]), at(k), k) for k in range(n)]


def test_transitions(spark):
    rows = job_events(4, 300) + [(99, "pending", at(1), 7), (99, "pending", at(1), 7)]
    assert sorted(map(tuple, streams.transitions(spark.createDataFrame(rows, EVENTS).repartition(3)).collect()), key=str) == plain_transitions(rows)
    assert streams.transitions(spark.createDataFrame([], EVENTS)).count() == 0


def test_a_stream_of_transitions_goes_on_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows, found = job_events(5, 120), []
    for k in range(0, 120, 60):
        for j in range(k, k + 60, 30):
            arrive(spark, tmp_path / "events", rows[j : j + 30])
        found += run(streams.transition_stream(stream(spark, tmp_path / "events")), spark, tmp_path / "checkpoint")
    assert sorted(found, key=str) == plain_transitions(rows)


def test_stuck_jobs_as_a_stream(spark, tmp_path):
    """A job is told of once its timeout passes without an event of its own, also after a restart; repeats, later and late events change nothing but what they should."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    parts = [
        [(1, "pending", at(0), 1), (2, "processing", at(5), 2), (3, "pending", at(10), 3)],
        [(1, "pending", at(0), 1), (3, "completed", at(50), 4), (4, "pending", at(55), 5)],  # a repeat; job 3 is done
        [(5, "completed", at(70), 6)],  # time passes 60 minutes after job 1 and 2
        [(2, "processing", at(90), 7), (5, "edited", at(91), 8)],
        [(6, "failed", at(400), 9)],  # and after 4 and 2 again
        [(6, "failed", at(401), 10)],
    ]
    found = []
    for part in parts:
        arrive(spark, tmp_path / "events", part)
        found += run(streams.stuck_stream(stream(spark, tmp_path / "events"), 3600), spark, tmp_path / "checkpoint")
    assert sorted((r[0], r[1], r[2]) for r in found) == [(1, "pending", at(0)), (2, "processing", at(5)), (2, "processing", at(90)), (4, "pending", at(55))]
    # what the batch form says of the same events, but for jobs that went on later
    batch = streams.stuck_jobs(spark.createDataFrame([e for p in parts for e in p], EVENTS), "1 hour")
    assert {tuple(r) for r in batch.collect()} == {(1, "pending", at(0)), (2, "processing", at(90)), (4, "pending", at(55))}
