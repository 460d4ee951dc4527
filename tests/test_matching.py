import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import albums, matching, sync
from ledgerline.operators.blocking import top_candidates

TARGET = [
    (1, "Blue Moon", "Ella Ray", "Night", 200_000, "USAA1"), (2, "Red Sun Rising", "Ella Ray", "Day", 200_000, "USAA2"), (3, "Green Field Song", "The Larks", "Fields", 180_000, None),
    (4, "Green Field Song", "The Larks", "Greatest Hits", 300_000, None), (5, "Winter Tale", "Nora Vale", "Snow", 240_000, "USAA5"), (6, "Song of Autumn Leaves", "Nora Vale", "Snow", 100_000, "USAA6"), (7, "Пeсня", "Хор", "", 100_000, None),
    (8, "Quiet River Stone", "Simon & Garfunkel", "Water", 150_000, None), (9, None, None, None, None, None),
]
SOURCE = [
    (1, "s1", "Blue Moon", "Ella Ray", [], "Night", 200_000, None),  # in the ledger
    (2, "s2", "Other Name", "Nobody", [], "None", 1_000, "USAA5"),  # raw code of a favorite
    (3, "s3", "Some Name", "Nobody", [], "None", 1_000, "us-aa-5"),  # the same, hyphenated
    (4, "s4", "Any", "Nobody", None, None, 1_000, "USAA2"),  # code of the catalog
    (5, "s5", "Green Field Song (Remastered 2011)", "Larks", ["Larks"], "Fields", 181_000, ""),
    (6, "s6", "Blue Moon", "Ella Ray", ["Ella Ray"], "Night", 260_000, None),  # too long: no match, a suggestion
    (7, "s7", "Blue Moon!", "Ella Ray", ["Ella Ray"], "Night", 200_500, None),
    (8, "s8", "Blue Moon", "Ella Ray", ["Ella Ray"], "Night", 200_000, None),  # as s7: one is written
    (9, "s9", "Completely Different", "Ella Ray", ["Ella Ray"], "Else", 10_000, None),
    (10, "s10", "Quiet River Stone", "Simon & Garfunkel", ["Simon & Garfunkel"], "", 150_000, None),
    (11, "s11", "Пeсня", "Хор", ["Хор"], None, 100_000, None),
    (12, "s12", None, None, None, None, None, None),
    (13, "s13", "Winter Tale", "Nora Vale feat. Ella Ray", ["Nora Vale", "Ella Ray"], "Elsewhere", 241_000, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    source = spark.createDataFrame(SOURCE, schemas.SOURCE_TRACKS)
    target = spark.createDataFrame(TARGET, schemas.TARGET_TRACKS)
    favorites = spark.createDataFrame([(1, 50, "USAA5"), (2, 5, "USAA5"), (3, 3, None), (4, None, "X")], schemas.FAVORITES)
    ledger = spark.createDataFrame([("s1",)], "source_id string")
    return source, target, favorites, ledger


@pytest.fixture(scope="module")
def result(tables):
    return sync.run_sync(*[tables[k] for k in (0, 1, 3, 2)], chunk=5)


def test_scenario(result):
    got = {r.source_id: r for r in result.classified.collect()}
    assert len(got) == len(SOURCE)
    assert got["s1"].status == "skipped" and got["s2"].status == "already" and got["s2"].match_type == "code"
    assert (got["s3"].status, got["s3"].target_id, got["s3"].match_type, got["s3"].pending) == ("matched", 5, "code", False)
    assert (got["s4"].target_id, got["s4"].match_type, got["s4"].pending) == (2, "code", True)
    assert (got["s5"].target_id, got["s5"].match_type) == (3, "fuzzy")
    assert got["s6"].status == "missing" and got["s9"].status == "missing" and got["s12"].status == "missing"
    assert (got["s7"].target_id, got["s7"].pending, got["s8"].target_id, got["s8"].pending) == (1, True, 1, False)
    assert got["s10"].target_id == 8 and got["s11"].target_id == 7
    assert got["s13"].target_id == 5 and not got["s13"].pending
    report = result.report.first()
    assert (report.tracks_matched, report.tracks_not_matched, report.tracks_skipped, report.already_in_target) == (9, 3, 1, 1)
    assert report.code_matches == 3 and report.code_matches + report.fuzzy_matches == report.tracks_matched


def test_suggestions(result):
    got = {}
    for r in result.suggestions.orderBy("source_id", "place").collect():
        got.setdefault(r.source_id, []).append(r.target_id)
    assert got["s6"][0] == 1 and "s9" not in got and "s12" not in got


def test_second_run_adds_nothing_and_dry_run_writes_nothing(tables, result):
    source, target, favorites, _ = tables
    again = sync.run_sync(source, target, result.ledger, favorites)
    there = {r.target_id for r in result.writes.collect()}
    assert not {r.target_id for r in again.writes.collect()} & there or {r.source_id for r in again.writes.collect()} <= {"s8"}
    dry = sync.run_sync(source, target, tables[3], favorites, dry_run=True)
    assert dry.writes.count() == 0 and dry.ledger.count() == 1 and dry.report.collect() == result.report.collect()


def test_chunks_add_up(result):
    chunks = sync.chunk_reports(result.classified).orderBy("chunk").collect()
    report = result.report.first().asDict()
    for name, n in report.items():
        assert sum(r[name] for r in chunks) == n == chunks[-1][f"total_{name}"]
    assert [r.chunk for r in chunks] == [0, 1, 2]


def test_candidates_against_all_pairs(spark):
    queries = spark.createDataFrame([(f"q{k}", f"b{k % 3}", f"name {k % 5} {'x' * (k % 4)}") for k in range(40)] + [("e", "", "t"), ("f", None, "t"), ("g", "b0", "")], "query_id string, block string, title string")
    targets = spark.createDataFrame([(k, f"b{k % 4}", f"name {k % 6} {'xy' * (k % 3)}") for k in range(150)], "target_id int, block string, title string")
    from pyspark.sql import Window

    from ledgerline.functions.similarity import best_ratio

    pairs = queries.where("block != '' AND title != ''").join(targets.withColumnRenamed("title", "t"), "block").withColumn("s", best_ratio("title", "t"))
    naive = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "target_id"))).where("rank <= 7").select("query_id", "target_id", "rank")
    assert sorted(map(tuple, top_candidates(queries, targets, 7).collect())) == sorted(map(tuple, naive.collect()))


def test_copies_of_a_song_are_searched_and_scored_once(tables):
    source, target, _, _ = tables
    copies = source.unionByName(source.withColumns({"id": F.concat(F.lit("copy-"), "id"), "position": F.col("position") + 100}))
    later = target.unionByName(target.withColumns({"id": F.col("id") + 100, "code": F.lit(None).cast("string")}))
    once, twice = matching.Matches(source, later), matching.Matches(copies, later)
    assert 0 < once.scored.count() == twice.scored.count()
    for rows in (lambda m: m.decisions().drop("position"), lambda m: m.suggestions()):
        want, got = (sorted(map(repr, rows(m).collect())) for m in (once, twice))
        assert len(got) == 2 * len(want) and [r for r in got if "copy-" not in r] == want == sorted(r.replace("copy-", "") for r in got if "copy-" in r)


def test_tracks_of_one_song_have_their_own_durations_and_codes(spark):
    target = spark.createDataFrame([(1, "Blue Moon", "Ella Ray", "Night", 200_000, None), (2, "Blue Moon", "Ella Ray", "Night", 300_000, "C2")], schemas.TARGET_TRACKS)
    rows = [(k, f"s{k}", "Blue Moon", "Ella Ray", ["Ella Ray"], "Night", ms, code) for k, (ms, code) in enumerate([(200_000, None), (300_000, None), (None, None), (200_000, "c-2"), (500_000, None)])]
    got = {r.source_id: (r.target_id, r.match_type) for r in matching.Matches(spark.createDataFrame(rows, schemas.SOURCE_TRACKS), target).decisions().collect()}
    assert got == {"s0": (1, "fuzzy"), "s1": (2, "fuzzy_album"), "s2": (None, "none"), "s3": (2, "code"), "s4": (None, "none")}


def test_empty_tables(spark, tables):
    none = [spark.createDataFrame([], df.schema) for df in tables]
    empty = sync.run_sync(none[0], none[1], none[3], none[2])
    assert empty.classified.count() == 0 and empty.report.first().tracks_matched == 0
    assert sync.run_sync(tables[0], none[1], none[3], none[2]).report.first().tracks_not_matched == len(SOURCE)


def test_albums(spark):
    source = spark.createDataFrame([(1, "a", "The Wall - Live", "Pink", None, "1980", 10), (2, "b", "Other", "Pink", "U9", None, 0), (3, "c", "Unknown", "Nobody", None, None, 0), (4, "d", None, None, "", None, None)], schemas.SOURCE_ALBUMS)
    target = spark.createDataFrame([("x", "Wall", "Pink", "1980", 10, None), ("y", "Walls", "Pink", "1999", 3, "U9"), ("z", "Far", "Else", None, None, "")], schemas.TARGET_ALBUMS)
    got = {r.source_id: (r.target_id, r.match_type, r.score) for r in albums.match_albums(source, target).collect()}
    assert got == {"a": ("x", "fuzzy", 115.0), "b": ("y", "code", 100.0)}
    assert {(r.source_id, r.place) for r in albums.album_suggestions(source, target).collect()} >= {("a", 1)}


def test_copies_of_an_album_are_scored_once(spark, monkeypatch):
    source = spark.createDataFrame([(k, f"a{k}", "The Wall - Live", "Pink", "U9" if k == 5 else None, "1980" if k % 2 else None, 10) for k in range(8)], schemas.SOURCE_ALBUMS)
    target = spark.createDataFrame([(f"x{k:02}", "Wall", "Pink", "1980" if k == 3 else None, 10, "U9" if k == 12 else None) for k in range(20)], schemas.TARGET_ALBUMS)
    pairs, score = [], albums.score_albums
    monkeypatch.setattr(albums, "score_albums", lambda p: pairs.append(p.count()) or score(p))
    got = {r.source_id: (r.target_id, r.match_type) for r in albums.match_albums(source, target).collect()}
    assert got == {f"a{k}": ("x12", "code") if k == 5 else ("x03" if k % 2 else "x00", "fuzzy") for k in range(8)}
    assert pairs == [2 * 10]  # two kinds with ten candidates
    assert sorted((r.source_id, r.place, r.target_id) for r in albums.album_suggestions(source, target).collect()) == [(f"a{k}", p + 1, f"x{p:02}") for k in range(8) for p in range(5)]


def test_code_map_keeps_the_last(spark):
    rows = spark.createDataFrame([(1, 10, "A-1"), (2, 11, "a1"), (3, 12, None), (4, None, "a1"), (5, 13, "")], schemas.FAVORITES)
    assert [tuple(r) for r in matching.favorites_map(rows).collect()] == [("A1", 11)]


def test_lists_dont_wait_for_their_tracks(spark, tables, monkeypatch):
    playlists = spark.createDataFrame([("p", 1, "Mine", 2, "x"), ("q", 2, "Empty", 0, "x")], "id string, position bigint, name string, tracks_count int, snapshot_id string")
    tracks = tables[0].where("id IN ('s5', 's7')").withColumn("playlist_id", F.lit("p"))
    there = spark.createDataFrame([], "id string, name string")
    there_tracks = spark.createDataFrame([], "playlist_id string, position bigint, track_id bigint")
    ledger = spark.createDataFrame([], "playlist_id string, snapshot_id string, synced_at int")
    runs, whole = [], sync.Matches
    monkeypatch.setattr(sync, "Matches", lambda *a: runs.append(1) or whole(*a))
    done = sync.run_playlist_sync(playlists, tracks, tables[1], there, there_tracks, ledger, "m")
    assert {(r.id, r.target_id, r.created) for r in done.playlists.collect()} == {("p", "new-p", True), ("q", None, False)} and not runs
    assert {(r.source_id, r.track_id, r.position) for r in done.additions.collect()} == {("s5", 3, 1), ("s7", 1, 2)}
    assert done.reports.first().tracks_matched == 2 and len(runs) == 1
