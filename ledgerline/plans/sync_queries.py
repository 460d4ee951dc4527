"""Album and playlist syncs, sinks that fail, chunk states, and the smaller scans and writes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import scoring as C
from ledgerline.operators import matching, state, sync
from ledgerline.plans import duck as D
from ledgerline.plans import match_queries as Q
from ledgerline.plans import music as M
from ledgerline.plans.music import table
from ledgerline.sources import library
from ledgerline.storage import cut
from ledgerline.streaming import limiter

MARK = "from Elsewhere"
FAVORITE_ALBUMS = "SELECT p_partkey AS position, CAST(p_partkey AS VARCHAR(20)) AS id, CASE WHEN p_partkey % 8 != 0 THEN 'U' || CAST(p_partkey AS VARCHAR(20)) END AS code FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 = 2"
ALBUM_LEDGER = "SELECT CAST(p_partkey AS VARCHAR(20)) AS source_id FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 13 = 0"


def _albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = (M.SOURCE_ALBUMS, M.TARGET_ALBUMS, ALBUM_LEDGER, FAVORITE_ALBUMS)
    return cut(sync.classify_albums(*(M.view(spark, sf_dir, v) for v in views)))


def album_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _albums(spark, sf_dir).select("source_id", "chunk", "status", "target_id", "pending")


def album_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An album report under a track report's names."""
    own = sync.report(_albums(spark, sf_dir)).withColumnsRenamed({"tracks_matched": "albums_matched", "tracks_not_matched": "albums_not_matched", "code_matches": "upc_matches"})
    return sync.album_counters(own)


def refuse(ids: list) -> None:
    """A sink that doesn't take batches whose ids add up to a multiple of three."""
    if sum(ids) % 3 == 0:
        raise ValueError("refused")


def flush_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By batch: what a sink that fails at times took, what entered the ledger, and the error."""
    writes = cut(sync.write_batches(Q._classified(spark, sf_dir).where("pending")))
    taken, errors = sync.settle(writes, sync.send_batches(writes, refuse))
    return taken.groupBy("chunk", "batch").agg(F.count("*").alias("n")).join(errors, ["chunk", "batch"], "full").select("chunk", "batch", F.coalesce("n", F.lit(0)).alias("n"), F.col("error"))


def chunk_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.chunk_states(Q._classified(spark, sf_dir)).select("chunk", "status", "offset", "total_items", "processed_in_chunk", "has_more", "total_tracks_matched", "total_tracks_not_matched", "total_code_matches", "total_fuzzy_matches")


def chunk_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a run that the third and the fourth chunk stop."""
    errors = spark.createDataFrame([(3, "late"), (2, "lost")], "chunk bigint, error string")
    return sync.chunk_states(Q._classified(spark, sf_dir), errors).select("chunk", "status", "offset", "has_more", "error", "total_tracks_matched", "total_tracks_not_matched")


def _members(spark: SparkSession, sf_dir: str, source: bool) -> DataFrame:
    """(custkey, partkey) of early orders and odd parts, or of later ones and even parts."""
    early = F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp")
    orders = table(spark, sf_dir, "orders").where(early if source else ~early).select("o_orderkey", F.col("o_custkey").alias("custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("partkey")).where(F.col("partkey") % 2 == (1 if source else 0))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("custkey", "partkey").distinct()


def _playlist_sync(spark: SparkSession, sf_dir: str) -> sync.PlaylistResult:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    playlists = customers.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("position"), F.col("c_name").alias("name"), F.lit(9).alias("tracks_count"), F.lit("s").alias("snapshot_id"))
    ids = playlists.where("position % 4 != 0")
    tracks = _members(spark, sf_dir, True).select(F.col("custkey").cast("string").alias("playlist_id"), F.col("partkey").cast("string").alias("id")).join(M.source_tracks(spark, sf_dir), "id")
    there = customers.where("c_custkey % 3 = 0").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("id"), F.concat("c_name", F.lit(f" ({MARK})")).alias("name"))
    there_tracks = _members(spark, sf_dir, False).where("custkey % 3 = 0").select(F.concat(F.lit("t"), F.col("custkey").cast("string")).alias("playlist_id"), F.col("partkey").alias("position"), F.col("partkey").alias("track_id"))
    ledger = playlists.where("position % 7 < 2").select(F.col("id").alias("playlist_id"), F.when(F.col("position") % 7 == 0, "s").otherwise("old").alias("snapshot_id"), F.lit(0).alias("synced_at"))
    return sync.run_playlist_sync(playlists, tracks, M.view(spark, sf_dir, M.TARGET), there, there_tracks, ledger, MARK, ids)


def playlist_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is added to which list, and where."""
    return _playlist_sync(spark, sf_dir).additions.select("playlist_id", "target_id", "position", "track_id")


def playlist_sync_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _playlist_sync(spark, sf_dir).playlists.select("id", "chunk", "skipped", "target_id", "created")


def playlist_sync_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _playlist_sync(spark, sf_dir).reports.select("chunk", "playlists", "playlists_skipped", "tracks_matched", "tracks_not_matched", "code_matches", "fuzzy_matches")


def selected_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name")
    listed = sync.selected(customers, ["1", "5", "nobody"]).select("id", F.lit("list").alias("by"))
    joined = sync.selected(customers, table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id")))
    return listed.unionByName(joined.select("id", F.lit("table").alias("by"))).unionByName(sync.selected(customers, None).select("id", F.lit("all").alias("by")))


def display_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2001 / 20).alias("score"), (F.col("event_id") * 7 % 5001).alias("ms"))
    return rows.select("event_id", C.shown_percent(F.col("score")).alias("percent"), C.shown_delay(F.col("ms")).alias("seconds"))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events are the outcomes of a request."""
    status = F.expr("CASE event_type WHEN 'click' THEN 500 WHEN 'view' THEN 429 WHEN 'purchase' THEN 200 WHEN 'error' THEN 503 ELSE IF(event_id % 2 = 0, 404, NULL) END")
    told = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 7).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("request"), F.struct(F.col("event_id").alias("o"), status.alias("status"), told.alias("retry_after_s")).alias("x"))
    outcomes = rows.groupBy("request").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return outcomes.select("request", limiter.retries(F.col("xs")).alias("r")).select("request", "r.state", "r.attempts", "r.waited_ms")


def playlist_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists created where they aren't there, tracks put at the ends of lists."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    lists = library.new_playlist(nations.where("CAST(id AS INT) < 10"), nations.where("CAST(id AS INT) >= 5").withColumn("name", F.lower("name")))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("playlist_id"), F.col("s_suppkey").alias("track_id"))
    there = suppliers.where("track_id % 3 = 0").withColumn("position", F.col("track_id"))
    added = suppliers.where("track_id % 2 = 0").withColumn("position", F.col("track_id"))
    return library.add_to_playlist(there, added).join(lists.select(F.col("id").alias("playlist_id"), "name"), "playlist_id").select("playlist_id", "name", "position", "track_id")


def favorites_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adding a favorite twice, or one that is there, changes nothing."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    more = library.add_favorites(M.view(spark, sf_dir, M.FAVORITES), parts.where("id % 4 = 0").union(parts.where("id % 8 = 0")))
    return more.select("id", "code")


def inserted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    regions = table(spark, sf_dir, "region").select(F.lit(None).cast("bigint").alias("id"), F.col("r_name").alias("name"))
    return state.append_with_ids(runs, regions, "id", ["name"])


def pending_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps 1 to 9 of a schema; those up to the number of regions are done, and of another schema none."""
    done = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("int").alias("version"), F.concat(F.lit("step "), F.col("r_regionkey") + 1).alias("name"), F.lit(_APPLIED).cast("timestamp").alias("applied_at"))
    steps = [(k, f"step {k}") for k in range(9, 0, -1)]
    now = F.lit("2024-02-01").cast("timestamp")
    both = [state.migrate(spark, versions, steps, now).withColumn("schema", F.lit(s)) for s, versions in (("old", done), ("new", done.where("false")))]
    return both[0].unionByName(both[1]).select("schema", "version", "name", (F.col("applied_at") == now).alias("pending"))


_APPLIED = "2024-01-01"


def task_status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with their runs' counters, by precedence."""
    progress = F.expr("CASE event_id % 4 WHEN 0 THEN '{\"tracks_matched\": 7}' WHEN 1 THEN '{\"tracks_matched\": 3, \"tracks_not_matched\": 4}' WHEN 2 THEN 'bad' END")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "click", "running").otherwise("completed").alias("status"), progress.alias("progress_json"))
    runs = rows.groupBy("run_id").agg(F.lit("running").alias("status")).where("run_id % 5 != 0").select(F.col("run_id").alias("id"), "status", F.expr("CAST(run_id % 3 AS INT)").alias("tracks_matched"), F.expr("IF(run_id % 2 = 0, NULL, 2)").alias("tracks_not_matched"))
    return state.merge_status(rows, runs).select("id", "run_status", "tracks_matched", "tracks_not_matched")


def saved_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All saved albums, and those after an offset; some without an album, artist or date."""
    p = table(spark, sf_dir, "part")
    artists = F.when(F.col("p_partkey") % 4 == 0, F.array()).otherwise(F.array("p_brand")).cast("array<string>")
    date = F.expr("CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CAST(1990 + p_partkey % 20 AS STRING) || '-05' END")
    album = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), artists.alias("artists"), F.lit("").alias("code"), date.alias("release_date"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("total_tracks"))
    every = library.source_albums(p.select(F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 7 != 0, album).alias("album")))
    after = library.resume(every, 120, 50).select("id", F.lit(True).alias("next"))
    return every.join(after, "id", "left").select("id", "artist", "release_year", "total_tracks", F.coalesce("next", F.lit(False)).alias("next"))


def target_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of the target's lists, with what isn't known named so; some tracks aren't in the catalog."""
    p = table(spark, sf_dir, "part").where("p_partkey % 5 != 0")
    tracks = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("artist"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_type")).alias("album"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("duration"), F.lit(None).cast("string").alias("code"))
    members = _members(spark, sf_dir, False).select(F.col("custkey").alias("playlist_id"), F.col("partkey").alias("position"), F.col("partkey").alias("track_id"))
    return library.tracks_of(members, tracks).select("playlist_id", "position", "id", "artist", "album", "duration_ms")


def target_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one list, of a page of favorites of either kind, and of a page of lists; the list of a name."""
    favorites, albums = (M.view(spark, sf_dir, v) for v in (M.FAVORITES, FAVORITE_ALBUMS))
    members = _members(spark, sf_dir, False).where("custkey = 4").select(F.col("partkey").cast("string").alias("id"))
    lists = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    named = library.playlist_named(lists, "Customer#000000009")
    parts = {"list": library.ids_of(members), "favorites": library.ids_of(favorites, 5000), "albums": library.ids_of(albums, 40), "lists": library.ids_of(library.page(lists, 500)), "named": named.select("id")}
    out = None
    for kind, df in parts.items():
        df = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
        out = df if out is None else out.unionByName(df)
    return out


def favorite_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product codes of favorite albums; of two with one code the last counts."""
    both = M.view(spark, sf_dir, FAVORITE_ALBUMS).unionByName(M.view(spark, sf_dir, FAVORITE_ALBUMS).where("position % 3 = 0").selectExpr("position + 1000000 AS position", "'x' || id AS id", "code"))
    return matching.favorites_map(both, F.col("code"))


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of a search for title and artist."""
    source, target = matching.prepare_source(M.source_tracks(spark, sf_dir)), matching.prepare_target(M.view(spark, sf_dir, M.TARGET))
    return matching.candidates(source, target, 1).select("source_id", "target_id")


def synced_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists synced again replace their rows; progress of a kind of run is put over the last one's."""
    customers = table(spark, sf_dir, "customer")
    rows = [customers.where(w).select(F.lit("u").alias("user_id"), F.col("c_custkey").cast("string").alias("playlist_id"), F.lit(s).alias("snapshot_id"), F.col("c_nationkey").cast("int").alias("track_count"), F.lit(_APPLIED).cast("timestamp").alias("synced_at")) for w, s in (("c_custkey % 2 = 0", "a"), ("c_custkey % 3 = 0", "b"))]
    return state.upsert(*rows, ["user_id", "playlist_id"]).select("playlist_id", "snapshot_id", "track_count")


def sync_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's runs of each kind go on: the last offset that was saved, until a run that ends clears it."""
    saved = table(spark, sf_dir, "events").selectExpr("user_id", "event_type AS sync_type", "event_id AS last_offset", "event_id + 50 AS total")
    old, new = (state.keep_last(saved.where(f"last_offset % 2 = {k}"), ["user_id", "sync_type"], ["last_offset"]) for k in (0, 1))
    return state.delete(state.upsert(old, new, ["user_id", "sync_type"]), new.where("last_offset % 5 = 0"), ["user_id", "sync_type"])


QUERIES = {f.__name__: f for f in (album_sync, album_report, flush_failures, chunk_state, chunk_failure, playlist_sync, playlist_sync_lists, playlist_sync_reports, selected_playlists, display_rounding, retry_schedule, playlist_writes, favorites_added, inserted_ids, pending_versions, task_status_merge, saved_albums, target_details, target_ids, favorite_albums, first_hits, synced_playlists, sync_progress)}

_RUN = "(sum({c}) OVER (ORDER BY chunk))::BIGINT AS total_{c}"
_STATES = f"{Q._SYNC}, r AS (SELECT chunk, count(*) AS n, {Q._COUNTS} FROM cl GROUP BY chunk), s AS (SELECT chunk, n, (sum(n) OVER (ORDER BY chunk))::BIGINT AS upto, (sum(n) OVER ())::BIGINT AS total, {', '.join(_RUN.format(c=c) for c in ('tracks_matched', 'tracks_not_matched', 'code_matches', 'fuzzy_matches'))}, tracks_matched, tracks_not_matched FROM r)"
# albums: what is in the ledger or has a favorite's code is out before matching
_ALBUMS = Q.ORACLES["album_match"].replace("sa AS (SELECT", f"{M.duck('fa', FAVORITE_ALBUMS)}, {M.duck('al', ALBUM_LEDGER)}, sa AS (SELECT", 1).replace("AS vs FROM sa1)", "AS vs FROM sa1 WHERE id NOT IN (SELECT source_id FROM al) AND coalesce(code, '') NOT IN (SELECT code FROM fa WHERE code IS NOT NULL))", 1)
_ALBUM_HEAD, _, _ALBUM_TAIL = _ALBUMS.rpartition("\nSELECT id AS source_id")
_ALBUM_SYNC = (
    f"{_ALBUM_HEAD}, m AS (SELECT id AS source_id{_ALBUM_TAIL}), st AS (SELECT position, id AS source_id, (position - 1) // 50 AS chunk, CASE WHEN id IN (SELECT source_id FROM al) THEN 'skipped' WHEN code IN (SELECT code FROM fa WHERE code IS NOT NULL) THEN 'already' END AS status FROM sa0), "
    "cl AS (SELECT st.source_id, st.chunk, coalesce(st.status, CASE WHEN m.target_id IS NOT NULL THEN 'matched' ELSE 'missing' END) AS status, m.target_id, CASE WHEN st.status = 'already' THEN 'code' ELSE m.match_type END AS kind, "
    "m.target_id IS NOT NULL AND row_number() OVER (PARTITION BY m.target_id ORDER BY st.position, st.source_id) = 1 AND m.target_id NOT IN (SELECT id FROM fa WHERE code IS NOT NULL) AS pending FROM st LEFT JOIN m USING (source_id))"
)


def _member_sql(source: bool) -> str:
    return f"SELECT DISTINCT o_custkey AS k, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate {'<' if source else '>='} TIMESTAMP '1998-07-01' AND l_partkey % 2 = {int(source)}"


_LISTS = (
    f"{Q._cascade()}, mem AS ({_member_sql(True)}), late AS ({_member_sql(False)}), "
    f"pl AS (SELECT c_custkey AS k, (c_custkey - 1) // 10 AS chunk, c_custkey % 7 = 0 AS skipped, c_custkey % 3 = 0 AS there FROM customer WHERE c_custkey % 4 != 0), "
    "dec AS (SELECT mem.k, mem.p, m.tid, m.kind FROM mem JOIN pl ON pl.k = mem.k AND NOT pl.skipped LEFT JOIN matched m ON m.sid = mem.p::VARCHAR), "
    "lists AS (SELECT pl.*, k IN (SELECT k FROM mem) AND NOT skipped AND NOT there AS created FROM pl), "
    # a row of the source's list is placed by its track's place in the library
    "want AS (SELECT k, tid, min((p + 1) // 2) AS pos FROM dec WHERE tid IS NOT NULL GROUP BY 1, 2), ends AS (SELECT k, max(p) AS e FROM late WHERE k % 3 = 0 GROUP BY 1)"
)
_SCORE, _MS = "(event_id % 2001 / 20)", "(event_id * 7 % 5001)"
ORACLES = {
    "album_sync": f"{_ALBUM_SYNC} SELECT source_id, chunk, status, target_id, pending FROM cl",
    "album_report": f"{_ALBUM_SYNC} SELECT count(*) FILTER (status IN ('matched', 'already')) AS tracks_matched, count(*) FILTER (status = 'missing') AS tracks_not_matched, count(*) FILTER (status IN ('matched', 'already') AND kind = 'code') AS code_matches FROM cl",
    "flush_failures": f"{Q._SYNC}, w AS (SELECT target_id, chunk, (row_number() OVER (PARTITION BY chunk ORDER BY position) - 1) // 25 AS batch FROM cl WHERE pending), b AS (SELECT chunk, batch, count(*) AS c, sum(target_id) % 3 = 0 AS bad FROM w GROUP BY 1, 2) SELECT chunk, batch, CASE WHEN bad THEN 0 ELSE c END AS n, CASE WHEN bad THEN 'batch of ' || c || ' failed: refused' END AS error FROM b",
    "chunk_state": f"{_STATES} SELECT chunk, CASE WHEN upto < total THEN 'chunk_complete' ELSE 'completed' END AS status, upto AS \"offset\", total AS total_items, n AS processed_in_chunk, upto < total AS has_more, total_tracks_matched, total_tracks_not_matched, total_code_matches, total_fuzzy_matches FROM s",
    "chunk_failure": f"{_STATES} SELECT chunk, CASE WHEN chunk = 2 THEN 'failed' WHEN upto < total THEN 'chunk_complete' ELSE 'completed' END AS status, CASE WHEN chunk = 2 THEN upto - n ELSE upto END AS \"offset\", chunk = 2 OR upto < total AS has_more, CASE WHEN chunk = 2 THEN 'lost' END AS error, total_tracks_matched - CASE WHEN chunk = 2 THEN tracks_matched ELSE 0 END AS total_tracks_matched, total_tracks_not_matched - CASE WHEN chunk = 2 THEN tracks_not_matched ELSE 0 END AS total_tracks_not_matched FROM s WHERE chunk <= 2",
    "playlist_sync": f"{_LISTS} SELECT w.k::VARCHAR AS playlist_id, CASE WHEN w.k % 3 = 0 THEN 't' ELSE 'new-' END || w.k AS target_id, coalesce(e, 0) + row_number() OVER (PARTITION BY w.k ORDER BY pos, tid) AS position, tid AS track_id FROM want w LEFT JOIN ends USING (k) WHERE NOT EXISTS (SELECT 1 FROM late l WHERE l.k = w.k AND l.p = w.tid AND w.k % 3 = 0)",
    "playlist_sync_lists": f"{_LISTS} SELECT k::VARCHAR AS id, chunk, skipped, CASE WHEN created THEN 'new-' || k WHEN there THEN 't' || k END AS target_id, created FROM lists",
    "playlist_sync_reports": f"{_LISTS}, d AS (SELECT (k - 1) // 10 AS chunk, count(tid) AS a, count(*) - count(tid) AS b, count(*) FILTER (kind = 'code') AS c, count(*) FILTER (kind != 'code') AS f FROM dec GROUP BY 1) SELECT chunk, count(*) AS playlists, count(*) FILTER (skipped) AS playlists_skipped, coalesce(any_value(a), 0) AS tracks_matched, coalesce(any_value(b), 0) AS tracks_not_matched, coalesce(any_value(c), 0) AS code_matches, coalesce(any_value(f), 0) AS fuzzy_matches FROM lists LEFT JOIN d USING (chunk) GROUP BY chunk",
    "selected_playlists": "SELECT c_custkey::VARCHAR AS id, 'list' AS \"by\" FROM customer WHERE c_custkey IN (1, 5) UNION ALL SELECT c_custkey::VARCHAR, 'table' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey::VARCHAR, 'all' FROM customer",
    "display_rounding": f"SELECT event_id, floor({_SCORE} + 0.5)::INTEGER AS percent, CASE WHEN {_MS} > 500 THEN {D.half_up(f'{_MS}::DOUBLE / 1000', 1)} END AS seconds FROM events",
    "retry_schedule": "WITH RECURSIVE o AS (SELECT event_id // 5 AS request, CASE event_type WHEN 'click' THEN 500 WHEN 'view' THEN 429 WHEN 'purchase' THEN 200 WHEN 'error' THEN 503 WHEN NULL THEN NULL ELSE CASE WHEN event_id % 2 = 0 THEN 404 ELSE 599 END END AS s, CASE WHEN event_id % 3 = 0 THEN event_id % 7 * 1000 END AS told, row_number() OVER (PARTITION BY event_id // 5 ORDER BY event_id) AS n FROM events), "
    "f(request, n, state, attempts, waited, delay) AS (SELECT DISTINCT request, 0::BIGINT, 'open', 0, 0::BIGINT, 1000::BIGINT FROM o UNION ALL SELECT f.request, o.n, CASE WHEN s < 400 THEN 'ok' WHEN attempts + 1 >= 4 OR (s < 500 AND s != 429) THEN 'failed' ELSE 'open' END, attempts + 1, waited + CASE WHEN s < 400 THEN 0 WHEN s = 429 THEN coalesce(told, delay * 2) WHEN s < 500 OR attempts + 1 >= 4 THEN 0 ELSE delay END, CASE WHEN s = 429 THEN coalesce(told, delay * 2) WHEN s >= 500 THEN delay * 2 ELSE delay END FROM f JOIN o ON o.request = f.request AND o.n = f.n + 1 WHERE f.state = 'open') "
    "SELECT request, state, attempts, waited AS waited_ms FROM f QUALIFY row_number() OVER (PARTITION BY request ORDER BY n DESC) = 1",
    "playlist_writes": "WITH s AS (SELECT s_nationkey AS k, s_suppkey AS t FROM supplier), there AS (SELECT k, t, t AS position FROM s WHERE t % 3 = 0), ends AS (SELECT k, max(position) AS e FROM there GROUP BY 1), fresh AS (SELECT k, t, coalesce(e, 0) + row_number() OVER (PARTITION BY k ORDER BY t) AS position FROM s LEFT JOIN ends USING (k) WHERE t % 2 = 0 AND t % 3 != 0), every AS (SELECT k, t, position FROM there UNION ALL SELECT k, t, position FROM fresh) SELECT k::VARCHAR AS playlist_id, CASE WHEN n_nationkey < 10 THEN n_name ELSE lower(n_name) END AS name, position, t AS track_id FROM every JOIN nation ON n_nationkey = k",
    "favorites_added": f"WITH {M.duck('fav', M.FAVORITES)} SELECT id, code FROM fav UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 4 = 0 AND p_partkey NOT IN (SELECT id FROM fav)",
    "inserted_ids": "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name), r_name FROM region",
    "pending_versions": "SELECT x.s AS schema, v.range::INTEGER AS version, 'step ' || v.range AS name, x.s = 'new' OR v.range > (SELECT max(r_regionkey) + 1 FROM region) AS pending FROM range(1, 10) v, (VALUES ('old'), ('new')) x(s)",
    "task_status_merge": "WITH r AS (SELECT DISTINCT user_id AS run_id, user_id % 3 AS m, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 2 END AS n FROM events WHERE user_id % 5 != 0), t AS (SELECT event_id, user_id, event_type = 'click' AS running, CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 3 END AS pm, CASE WHEN event_id % 4 = 1 THEN 4 END AS pn FROM events) SELECT event_id::VARCHAR AS id, CASE WHEN r.run_id IS NOT NULL THEN 'running' END AS run_status, (CASE WHEN r.run_id IS NOT NULL AND (NOT running OR (pm IS NULL AND (m > 0 OR n > 0))) THEN m ELSE coalesce(pm, 0) END)::INTEGER AS tracks_matched, (CASE WHEN r.run_id IS NOT NULL AND (NOT running OR (pm IS NULL AND (m > 0 OR n > 0))) THEN n ELSE coalesce(pn, 0) END)::INTEGER AS tracks_not_matched FROM t LEFT JOIN r ON r.run_id = t.user_id",
    "saved_albums": "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 4 = 0 THEN 'Unknown' ELSE p_brand END AS artist, CASE WHEN p_partkey % 5 > 1 THEN (1990 + p_partkey % 20)::VARCHAR END AS release_year, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS total_tracks, p_partkey > 120 AND p_partkey <= 170 AS next FROM part WHERE p_partkey % 7 != 0",
    "target_details": f"WITH late AS ({_member_sql(False)}) SELECT k AS playlist_id, p AS position, p AS id, CASE WHEN p % 3 = 0 THEN 'Unknown' ELSE p_brand END AS artist, CASE WHEN p % 7 = 0 THEN 'Unknown' ELSE p_type END AS album, CASE WHEN p % 4 = 0 THEN 0 ELSE p_size * 1000 END::BIGINT AS duration_ms FROM late JOIN part ON p_partkey = p WHERE p % 5 != 0",
    "target_ids": f"WITH late AS ({_member_sql(False)}), {M.duck('fav', M.FAVORITES)}, {M.duck('fa', FAVORITE_ALBUMS)} SELECT 'list' AS kind, p::VARCHAR AS id FROM late WHERE k = 4 UNION ALL SELECT 'favorites', id::VARCHAR FROM (SELECT id FROM fav ORDER BY position LIMIT 5000) UNION ALL SELECT 'albums', id FROM (SELECT id FROM fa ORDER BY position LIMIT 40) UNION ALL SELECT 'lists', k::VARCHAR FROM (SELECT c_custkey AS k FROM customer ORDER BY 1 LIMIT 500) UNION ALL SELECT 'named', c_custkey::VARCHAR FROM customer WHERE c_name = 'Customer#000000009'",
    "favorite_albums": f"WITH {M.duck('fa', FAVORITE_ALBUMS)} SELECT code AS code_key, CASE WHEN position % 3 = 0 THEN 'x' || id ELSE id END AS target_id FROM fa WHERE code IS NOT NULL",
    "first_hits": f"{Q.ORACLES['candidates'].replace('rank <= 15', 'rank <= 1').replace(', rank::INTEGER AS rank', '')}",
    "synced_playlists": "SELECT c_custkey::VARCHAR AS playlist_id, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' END AS snapshot_id, c_nationkey::INTEGER AS track_count FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "sync_progress": "WITH h AS (SELECT user_id, event_type AS sync_type, event_id % 2 AS half, max(event_id) AS o FROM events GROUP BY 1, 2, 3), b AS (SELECT user_id, sync_type, arg_max(o, half) AS last_offset, max(half) AS half FROM h GROUP BY 1, 2) SELECT user_id, sync_type, last_offset, last_offset + 50 AS total FROM b WHERE NOT (half = 1 AND last_offset % 5 = 0)",
}
