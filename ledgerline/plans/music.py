"""The driver's tables seen as a music library: parts are tracks, brands artists, types albums.

Odd parts are the source's, under titles spoiled in ways that go by the key, even ones the target's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TITLE = """CASE p_partkey % 16 WHEN 1 THEN p_name WHEN 3 THEN p_name || ' (Remastered 2011)' WHEN 5 THEN p_name || ' feat. Someone'
WHEN 7 THEN substring(p_name, 2) WHEN 9 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
WHEN 11 THEN upper(p_name) || ' [Live]' WHEN 13 THEN 'The ' || p_name || 's' ELSE substring(p_name, 1, 3) || 'zz qq' END"""
ARTIST = "CASE p_partkey % 12 WHEN 5 THEN p_brand || ' feat. Other' WHEN 7 THEN 'The ' || p_brand WHEN 9 THEN upper(p_brand) ELSE p_brand END"
CODE = "CASE WHEN p_partkey % 20 = 1 THEN 'US-A-' || CAST(p_partkey + 1 AS VARCHAR(20)) WHEN p_partkey % 20 = 3 THEN 'USA' || CAST(p_partkey + 1 AS VARCHAR(20)) WHEN p_partkey % 20 = 5 THEN 'NONE' || CAST(p_partkey AS VARCHAR(20)) END"
SOURCE = f"SELECT CAST((p_partkey + 1) / 2 AS BIGINT) AS position, CAST(p_partkey AS VARCHAR(20)) AS id, {TITLE} AS title, {ARTIST} AS artist, p_type AS album, CAST(p_size AS BIGINT) * 15000 + (p_partkey % 7) * 900 AS duration_ms, {CODE} AS code FROM part WHERE p_partkey % 2 = 1"
TARGET = "SELECT p_partkey AS id, p_name AS title, p_brand AS artist, CASE WHEN p_partkey % 10 = 0 THEN 'Best of ' || p_type ELSE p_type END AS album, CAST(p_size AS BIGINT) * 15000 AS duration_ms, 'USA' || CAST(p_partkey AS VARCHAR(20)) AS code FROM part WHERE p_partkey % 2 = 0"
FAVORITES = "SELECT p_partkey AS position, p_partkey AS id, CASE WHEN p_partkey % 7 != 0 THEN 'USA' || CAST(p_partkey AS VARCHAR(20)) END AS code FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 1"
LEDGER = "SELECT CAST(p_partkey AS VARCHAR(20)) AS source_id FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 11 = 0"
ALBUM_TITLE = "CASE p_partkey % 10 WHEN 1 THEN p_name || ' (Deluxe Edition)' WHEN 3 THEN 'The ' || p_name WHEN 5 THEN p_name || ' - Live' WHEN 7 THEN substring(p_name, 2) ELSE p_name || ' [2011 Remaster]' END"
SOURCE_ALBUMS = f"SELECT p_partkey AS position, CAST(p_partkey AS VARCHAR(20)) AS id, {ALBUM_TITLE} AS title, p_brand AS artist, CASE WHEN p_partkey % 30 = 1 THEN 'U' || CAST(p_partkey + 1 AS VARCHAR(20)) END AS code, CAST(1990 + p_partkey % 20 AS VARCHAR(4)) AS release_year, CAST(p_size AS INT) AS total_tracks FROM part WHERE p_partkey % 2 = 1"
TARGET_ALBUMS = "SELECT CAST(p_partkey AS VARCHAR(20)) AS id, p_name AS title, p_brand AS artist, CAST(1990 + p_partkey % 20 AS VARCHAR(4)) AS release_year, CAST(p_size AS INT) AS tracks_count, 'U' || CAST(p_partkey AS VARCHAR(20)) AS code FROM part WHERE p_partkey % 2 = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the selections above over the part table, without a name in the session's catalog."""
    head, _, rest = sql.partition(" FROM part WHERE ")
    fields, depth, start = [], 0, len("SELECT ")
    for k, c in enumerate(head):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and depth == 0:
            fields.append(head[start:k])
            start = k + 1
    fields.append(head[start:])
    return table(spark, sf_dir, "part").where(rest).selectExpr(*fields)


def source_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SOURCE).selectExpr("position", "id", "title", "artist", "array(artist) AS all_artists", "album", "duration_ms", "code")


def duck(name: str, sql: str) -> str:
    """A common table expression of a selection; DuckDB's / would give a fraction."""
    return f"{name} AS ({sql.replace('(p_partkey + 1) / 2', '(p_partkey + 1) // 2')})"
