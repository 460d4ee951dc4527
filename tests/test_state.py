from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import compare, state
from ledgerline.sources import library
from ledgerline.storage import scratch_path

NOW = datetime(2024, 1, 1, 12)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keep_last_and_upsert(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), (None, 3, "n")], "k string, v int, s string")
    new = spark.createDataFrame([("a", 9, None), ("c", 4, "z"), (None, 5, "m")], "k string, v int, s string")
    assert rows(state.upsert(base, new, ["k"])) == sorted([("a", 9, None), ("b", 2, None), ("c", 4, "z"), (None, 5, "m")], key=repr)
    assert rows(state.upsert(base, new, ["k"], {"s": "keep"})) == sorted([("a", 9, "x"), ("b", 2, None), ("c", 4, "z"), (None, 5, "n")], key=repr)
    assert rows(state.upsert(base, new.limit(0), ["k"])) == rows(base) and rows(state.upsert(base.limit(0), new, ["k"])) == rows(new)
    twice = base.unionByName(base.withColumn("v", F.col("v") + 10))
    assert rows(state.keep_last(twice, ["k"], ["v"])) == sorted([("a", 11, "x"), ("b", 12, None), (None, 13, "n")], key=repr)
    assert state.removed_count(twice, ["k"]).first()[0] == 3


def test_updates(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, s string")
    new = spark.createDataFrame([("a", None, "q"), ("zz", 5, "w")], "k string, v int, s string")
    assert rows(state.update(base, new, ["k"])) == [("a", 1, "q"), ("b", 2, "y")]
    assert rows(state.update(base, new, ["k"], null_keeps=False)) == [("a", None, "q"), ("b", 2, "y")]
    assert rows(state.delete(base, new, ["k"])) == [("b", 2, "y")]
    more = state.append_with_ids(spark.createDataFrame([(4, "m")], "id bigint, s string"), spark.createDataFrame([("p",), ("o",)], "s string"), "id", ["s"])
    assert rows(more) == [(4, "m"), (5, "o"), (6, "p")]


def test_queue(spark):
    queue = [("u", f"{k:022d}", f"t{k}", "a", "b", "favorites", "[]", "dismissed" if k == 1 else "pending", None, NOW, NOW) for k in range(5)]
    unmatched = spark.createDataFrame(queue, schemas.UNMATCHED)
    again = state.save_unmatched(unmatched, unmatched.where("source_id LIKE '%1' OR source_id LIKE '%2'").withColumn("status", F.lit("pending")).withColumn("title", F.lit("new")))
    got = {r.source_id[-1]: (r.status, r.title) for r in again.collect()}
    assert got["1"] == ("dismissed", "new") and got["2"] == ("pending", "new") and len(got) == 5
    ledger = library.empty(spark, "ledger")
    chosen = spark.createDataFrame([("u", f"{0:022d}", "12", "favorites", NOW), ("u", f"{2:022d}", "no", "favorites", NOW)], schemas.LEDGER)
    ledger, left = state.resolve(ledger, unmatched, chosen)
    assert ledger.count() == 1 and left.count() == 4
    page = state.review_page(left, [F.col("source_id")], limit=2, offset=1).collect()
    assert [r.source_id[-1] for r in page] == ["3", "4"] and page[0].total == 3
    assert state.dismiss(left, left).where("status != 'dismissed'").count() == 0


def test_tasks_expire_with_their_runs(spark):
    old, new = NOW - timedelta(minutes=11), NOW - timedelta(minutes=9)
    tasks = spark.createDataFrame([(str(k), "u", k, "favorites", s, False, p, None, None, None, t, t) for k, (s, t, p) in enumerate([("running", old, None), ("running", new, '{"tracks_matched": 3}'), ("completed", old, "bad"), ("starting", old, None)])], schemas.ACTIVE_TASKS)
    runs = spark.createDataFrame([(k, "u", NOW, None, "running" if k < 3 else "completed", "favorites", False, 1, 2, 0, 0, None) for k in range(4)], schemas.RUNS)
    got, ended = state.expire_tasks(tasks, runs, F.lit(NOW))
    assert [r.status for r in got.orderBy("id").collect()] == ["interrupted", "running", "completed", "interrupted"]
    assert [r.status for r in ended.orderBy("id").collect()] == ["interrupted", "running", "running", "completed"]
    assert state.running_task(got).first().id == "1"
    merged = {r.id: (r.tracks_matched, r.tracks_not_matched) for r in state.merge_status(tasks, runs).collect()}
    assert merged == {"0": (1, 2), "1": (3, 0), "2": (1, 2), "3": (1, 2)}  # a running task that tells something is taken at its word


def test_migrations_and_publication(spark):
    versions = spark.createDataFrame([(1, "first", NOW)], schemas.SCHEMA_VERSIONS)
    steps = [(2, "second"), (1, "first"), (3, "third")]
    after = state.migrate(spark, versions, steps, F.lit(NOW))
    assert [r.version for r in after.orderBy("version").collect()] == [1, 2, 3] and state.migrate(spark, after, steps, F.lit(NOW)).count() == 3
    path = scratch_path(spark, "table")
    state.publish(after, path)
    state.publish(spark.read.parquet(path).where("version > 1"), path)
    assert spark.read.parquet(path).count() == 2


def test_lists(spark):
    source = spark.createDataFrame([("1", "Mix", 5, "s"), ("2", "Gone", 3, "s")], schemas.SOURCE_PLAYLISTS)
    target = spark.createDataFrame([("a", "mix (from X)", 2), ("b", "MIX", 4), ("c", "New", 9)], schemas.TARGET_PLAYLISTS)
    compared = compare.compare_playlists(source, target, "X")
    assert rows(compared.select("id", "target_id", "track_diff")) == [("1", "b", 1), ("2", None, 3)]
    assert tuple(compare.compare_totals(compared, target).first()) == (2, 1, 8, 15)
    tracks = "playlist_key string, title string, artist string, code string"
    have = spark.createDataFrame([("p", "Söng!", "Bänd", None), ("p", "x", "y", "us-1")], tracks)
    want = spark.createDataFrame([("p", "song", "BAND", "zz"), ("p", "other", "o", "US1"), ("p", "none", "n", ""), ("q", "song", "band", None)], tracks)
    assert [r.present for r in compare.diff_tracks(want, have).orderBy("playlist_key", "title").collect()] == [False, True, True, False]


def test_sinks(spark):
    tracks = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], schemas.PLAYLIST_TRACKS)
    added = library.add_to_playlist(tracks, spark.createDataFrame([("p", 1, "b"), ("p", 2, "c"), ("p", 3, "c"), ("q", 1, "a")], schemas.PLAYLIST_TRACKS))
    assert rows(added) == [("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c"), ("q", 1, "a")]
    favorites = spark.createDataFrame([(1, 5, "x")], schemas.FAVORITES)
    more = library.add_favorites(favorites, spark.createDataFrame([(5,), (6,), (6,), (None,)], "id bigint"))
    assert rows(more) == rows(library.add_favorites(more, spark.createDataFrame([(6,)], "id bigint"))) and more.count() == 2
    lists = spark.createDataFrame([("1", "M", 0), ("0", "M", 2)], schemas.TARGET_PLAYLISTS)
    assert library.playlist_named(lists, "M").first().id == "0" and library.new_playlist(lists, lists).count() == 2
    found = library.find_by_code(spark.createDataFrame([(3, "A-1"), (2, "a1")], "id bigint, code string"), spark.createDataFrame([("a 1",), ("b",)], "code string"))
    assert rows(found) == [("a 1", 2)]


def test_formats(spark):
    df = spark.createDataFrame([("1", "M", 3, "s")], schemas.SOURCE_PLAYLISTS)
    for kind in ("parquet", "orc", "json", "csv"):
        path = scratch_path(spark, kind)
        df.write.format(kind).save(path)
        assert library.read(spark, path, schemas.SOURCE_PLAYLISTS, kind).collect() == df.collect()
