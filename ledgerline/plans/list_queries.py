"""Comparing two libraries: orders before a date are the source's, later ones the target's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import compare
from ledgerline.operators.sync import unchanged_playlists
from ledgerline.plans import duck as D
from ledgerline.plans.music import table
from ledgerline.sources import library

CUTOFF = "1998-07-01"
_SERVICE = "Elsewhere"


def _orders(spark: SparkSession, sf_dir: str, source: bool) -> DataFrame:
    early = F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp")
    return table(spark, sf_dir, "orders").where(early if source else ~early).select("o_orderkey", "o_custkey")


def _playlists(spark: SparkSession, sf_dir: str, source: bool) -> DataFrame:
    """A list for each customer with lines on that side; one in three of the target's has a mark in its name."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    counts = _orders(spark, sf_dir, source).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").cast("int").alias("tracks_count"))
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    mark = F.when(F.col("o_custkey") % 3 == 0, f" (from {_SERVICE})").otherwise("")
    name = F.upper("c_name") if source else F.concat("c_name", mark)
    return counts.join(names, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").cast("string").alias("id"), name.alias("name"), "tracks_count", F.col("o_custkey").alias("position"))


def _lists_sql(sign: str, name: str) -> str:
    return f"SELECT o_custkey::VARCHAR AS id, {name} AS name, count(*)::INTEGER AS tracks_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderdate {sign} TIMESTAMP '{CUTOFF}' GROUP BY o_custkey, c_name"


_LISTS = f"s AS ({_lists_sql('<', 'upper(c_name)')}), t AS ({_lists_sql('>=', f'c_name || CASE WHEN o_custkey % 3 = 0 THEN {chr(39)} (from {_SERVICE}){chr(39)} ELSE {chr(39) * 2} END')})"


def playlist_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_playlists(_playlists(spark, sf_dir, True), _playlists(spark, sf_dir, False), _SERVICE)


def playlist_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_totals(playlist_compare(spark, sf_dir), _playlists(spark, sf_dir, False))


def marked_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.marked_playlists(_playlists(spark, sf_dir, False), f"(from {_SERVICE})")


def _tracks(spark: SparkSession, sf_dir: str, source: bool) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    pairs = _orders(spark, sf_dir, source).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("us-" if source else "US"), F.col("p_partkey").cast("string")))
    title = F.concat(F.initcap("p_name"), F.lit("!")) if source else F.col("p_name")
    return pairs.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("playlist_key"), F.col("p_partkey").alias("track_id"), title.alias("title"), F.col("p_brand").alias("artist"), code.alias("code"))


def track_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff_tracks(_tracks(spark, sf_dir, True), _tracks(spark, sf_dir, False)).select("playlist_key", "track_id", "present")


def library_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = []
    for source in (True, False):
        orders = _orders(spark, sf_dir, source)
        lines = orders.join(table(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        sides.append(compare.library_stats(playlists=orders.select("o_custkey").distinct(), albums=orders, tracks=lines))
    return compare.library_deltas(*sides)


def skip_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of customers' orders at a date and now; unchanged where no order came after it."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")

    def snapshot(df: DataFrame) -> DataFrame:
        ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
        return df.groupBy("o_custkey").agg(F.md5(ids).alias("snapshot_id"))

    now = snapshot(orders).select(F.col("o_custkey").alias("id"), "snapshot_id")
    then = snapshot(orders.where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp")))
    ledger = then.select(F.col("o_custkey").alias("playlist_id"), "snapshot_id", F.lit(0).alias("synced_at"))
    return unchanged_playlists(now, ledger).select("id", "skipped")


def saved_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults and resumption of a scan: lines as saved rows, some without a track, artist or album."""
    p = table(spark, sf_dir, "part")
    artists = F.when(F.col("p_partkey") % 5 == 0, F.array()).when(F.col("p_partkey") % 5 == 1, F.array(F.lit(""), F.col("p_brand"))).otherwise(F.array("p_brand", F.lit("Other"))).cast("array<string>")
    track = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), artists.alias("artists"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("album"), (F.col("p_size") * 1000).alias("duration_ms"), F.lit("").alias("code"))
    raw = p.select(F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 7 != 0, track).alias("track"))
    return library.resume(library.source_tracks(raw), 100).select("position", "id", "artist", "album", "duration_ms", F.col("code").isNull().alias("no_code"))


QUERIES = {f.__name__: f for f in (playlist_compare, playlist_totals, marked_playlists, track_diff, library_deltas, skip_unchanged, saved_tracks)}


def _side(sign: str, code: str, title: str) -> str:
    return f"SELECT DISTINCT o_custkey AS k, p_partkey AS track_id, {D.code_key(code)} AS code, {D.comparison_key(title)} || '|' || {D.comparison_key('p_brand')} AS name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderdate {sign} TIMESTAMP '{CUTOFF}'"


def _counts(sign: str) -> str:
    where = f"o_orderdate {sign} TIMESTAMP '{CUTOFF}'"
    return f"SELECT 'playlists' AS metric, count(DISTINCT o_custkey) AS n FROM orders WHERE {where} UNION ALL SELECT 'albums', count(*) FROM orders WHERE {where} UNION ALL SELECT 'tracks', count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {where}"


_COMPARED = f"WITH {_LISTS}, c AS (SELECT s.id, s.name, s.tracks_count, t.id AS target_id, t.tracks_count AS target_count, s.tracks_count - coalesce(t.tracks_count, 0) AS track_diff FROM s LEFT JOIN t ON {D.playlist_key('s.name', _SERVICE)} = {D.playlist_key('t.name', _SERVICE)})"
_code = "CASE WHEN p_partkey % 2 = 0 THEN '{p}' || p_partkey::VARCHAR END"
ORACLES = {
    "playlist_compare": f"{_COMPARED} SELECT * FROM c",
    "playlist_totals": f"{_COMPARED} SELECT count(*) AS playlists, count(target_id) AS matched, coalesce(sum(tracks_count), 0)::BIGINT AS source_tracks, (SELECT coalesce(sum(tracks_count), 0)::BIGINT FROM t) AS target_tracks FROM c",
    "marked_playlists": f"WITH {_LISTS} SELECT count(*) AS playlists, coalesce(sum(tracks_count), 0)::BIGINT AS tracks, count(*) FILTER (contains(name, '(from {_SERVICE})')) AS marked FROM t",
    "track_diff": f"WITH s AS ({_side('<', _code.format(p='us-'), 'p_name')}), t AS ({_side('>=', _code.format(p='US'), 'p_name')}) SELECT k AS playlist_key, track_id, EXISTS (SELECT 1 FROM t WHERE t.k = s.k AND t.code = s.code) OR EXISTS (SELECT 1 FROM t WHERE t.k = s.k AND t.name = s.name) AS present FROM s",
    "library_deltas": f"WITH s AS ({_counts('<')}), t AS ({_counts('>=')}) SELECT metric, s.n AS source, t.n AS target, s.n - t.n AS delta FROM s JOIN t USING (metric)",
    "skip_unchanged": "WITH n AS (SELECT o_custkey AS id, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS s FROM orders GROUP BY 1), b AS (SELECT o_custkey AS id, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS s FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1) SELECT n.id, coalesce(n.s = b.s, false) AS skipped FROM n LEFT JOIN b USING (id)",
    "saved_tracks": "SELECT p_partkey AS position, p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 5 <= 1 THEN 'Unknown' ELSE p_brand END AS artist, CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE p_type END AS album, p_size::BIGINT * 1000 AS duration_ms, true AS no_code FROM part WHERE p_partkey % 7 != 0 AND p_partkey > 100",
}
