import random

import pandas as pd
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators.sync import run_sync
from ledgerline.storage import scratch_path
from ledgerline.streaming import limiter, tasks
from ledgerline.streaming.chunks import ChunkedSync, expire_stream


def test_limiter(spark):
    cases = {"a": "L", "b": "LL", "c": "LL" + "o" * 10, "d": "L" * 9, "e": "o" * 40, "f": ""}
    rows = [(c, k, x == "L") for c, s in cases.items() for k, x in enumerate(s)]
    got = {r.client: r.delay for r in limiter.delays(spark.createDataFrame(rows, "client string, seq int, limited boolean")).collect()}
    assert got == {"a": 100.0, "b": 200.0, "c": 160.0, "d": 5000.0, "e": 50.0}
    assert limiter.retry_delays() == [1000, 2000, 4000] and limiter.retry_delays(3, 500, True) == [1000, 2000] and limiter.retry_delays(2, 500, True, 7) == [7]


def test_limiter_as_a_stream(spark):
    rng = random.Random(1)
    rows = [(f"c{k % 3}", k, rng.random() < 0.2) for k in range(120)]
    path = scratch_path(spark, "limiter")
    schema = "client string, seq int, limited boolean"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = limiter.streaming_delays(events).writeStream.outputMode("update").format("memory").queryName("limiter").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = pd.DataFrame([r.asDict() for r in spark.table("limiter").collect()]).groupby("client").last()
    expected = {r.client: (r.delay, r.streak) for r in limiter.delays(spark.createDataFrame(rows, schema)).collect()}
    assert {c: (r.delay, r.streak) for c, r in seen.iterrows()} == expected


def test_task_states(spark):
    cases = {1: ["start", "chunk_done", "start", "finish"], 2: ["finish", "start", "cancel", "start"], 3: ["start", "start", None], 4: ["cancel"], 5: ["start", "expire", "cancel"]}
    rows = [(t, k, e) for t, events in cases.items() for k, e in enumerate(events)]
    got = {r.task: (r.state, r.rejected) for r in tasks.final_states(spark.createDataFrame(rows, "task int, seq int, event string"), "task", ["seq"], "event").collect()}
    assert got == {1: ("completed", 0), 2: ("cancelled", 2), 3: ("running", 2), 4: ("cancelled", 0), 5: ("interrupted", 1)}


def test_chunks_write_each_target_once_and_go_on(spark):
    target = spark.createDataFrame([(k, f"Song number {k} {'abcdefghij'[k % 10] * 4}", f"Artist {k % 3}", "Album", 100_000, f"C{k}") for k in range(12)], schemas.TARGET_TRACKS)
    favorites = spark.createDataFrame([(1, 3, "C3")], schemas.FAVORITES)
    tracks = spark.createDataFrame([(k + 1, f"s{k}", f"Song number {k % 12} {'abcdefghij'[k % 12 % 10] * 4}", f"Artist {k % 3}", [], "Album", 100_000, f"C{k % 12}" if k % 2 else None) for k in range(18)], schemas.SOURCE_TRACKS)
    folder = scratch_path(spark, "chunks")
    tracks.where("position <= 9").coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(tracks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    engine = ChunkedSync(spark, folder, target, favorites)
    engine.run(stream, f"{folder}/checkpoint")
    first = engine.written().count()
    tracks.where("position > 9").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    engine.run(stream, f"{folder}/checkpoint")
    ids = [r.target_id for r in engine.written().collect()]
    once = run_sync(tracks, target, spark.createDataFrame([], "source_id string"), favorites)
    assert 0 < first < len(ids) == len(set(ids)) and set(ids) == {r.target_id for r in once.writes.collect()}
    engine.take(tracks.where("position > 9"), 1)  # a batch that runs again
    assert sorted(r.target_id for r in engine.written().collect()) == sorted(ids)
    assert engine.reports().agg(F.sum("tracks_matched")).first()[0] == once.report.first().tracks_matched


def test_spells_end_with_a_gap(spark):
    path = scratch_path(spark, "spells")
    schema = "k string, ts timestamp"
    rows = [("a", f"2024-01-01 00:0{m}:00") for m in range(5)] + [("a", "2024-01-01 01:00:00"), ("b", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "k string, ts string").select("k", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(path)
    out = expire_stream(spark.readStream.schema(schema).parquet(path), "k", "ts")
    query = out.writeStream.outputMode("append").format("memory").queryName("spells").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.k, r.n) for r in spark.table("spells").collect()} >= {("a", 5), ("a", 1)}


def _library(spark, n=12):
    target = spark.createDataFrame([(k, f"Song number {k} {'abcdefghij'[k % 10] * 4}", f"Artist {k % 3}", "Album", 100_000, f"C{k}") for k in range(n)], schemas.TARGET_TRACKS)
    tracks = spark.createDataFrame([(k + 1, f"s{k}", "x", f"Artist {k % 3}", [], "Album", 100_000, f"C{k}") for k in range(n)], schemas.SOURCE_TRACKS)
    return tracks, target, spark.createDataFrame([], schemas.FAVORITES)


def test_failed_batches_are_errors_and_stay_out_of_the_ledger(spark, monkeypatch):
    from ledgerline.operators import sync

    tracks, target, favorites = _library(spark)

    def sink(ids):
        if 3 in ids:
            raise OSError("no")

    monkeypatch.setattr(sync.write_batches, "__defaults__", (4,))
    done = sync.run_sync(tracks, target, spark.createDataFrame([("s11",)], "source_id string"), favorites, sink=sink)
    assert sorted(r.target_id for r in done.writes.collect()) == [4, 5, 6, 7, 8, 9, 10]
    assert {r.source_id for r in done.ledger.collect()} == {"s11", *(f"s{k}" for k in range(4, 11))}
    assert [(r.chunk, r.batch, r.error) for r in done.errors.collect()] == [(0, 0, "batch of 4 failed: no")]
    assert sync.run_sync(tracks, target, spark.createDataFrame([], "source_id string"), favorites, dry_run=True, sink=sink).writes.isEmpty()


def test_a_cancelled_stream_goes_on_later_and_tells_its_progress(spark):
    tracks, target, favorites = _library(spark)
    folder, told = scratch_path(spark, "cancelled"), []
    for k in range(3):
        tracks.where(f"position % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(tracks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    engine = ChunkedSync(spark, folder, target, favorites, ledger_ids=spark.createDataFrame([("s2",)], "source_id string"))
    assert engine.run(stream, f"{folder}/checkpoint", cancelled=lambda: True) is False
    assert engine.run(stream, f"{folder}/checkpoint", tell=told.append) is True
    assert sorted(r.target_id for r in engine.written().collect()) == [0, 1, *range(3, 12)]
    totals = engine.totals().first()
    assert (totals.tracks_matched, totals.tracks_skipped) == (11, 1) and engine.errors().isEmpty()
