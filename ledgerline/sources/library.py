"""Reading and writing libraries: tables of tracks, albums, playlists and favorites in any Spark format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import schemas


def read(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """A table with its schema given, so that no file is read to infer it; JSON, CSV and ORC too."""
    return spark.read.schema(schema).format(format).load(path)


def first_artist(names: Column | str) -> Column:
    """The first of an array of artists; "Unknown" for none, null or empty."""
    names = F.col(names) if isinstance(names, str) else names
    return F.coalesce(F.nullif(F.get(names, 0), F.lit("")), F.lit("Unknown"))


def release_year(date: Column | str) -> Column:
    """The first four characters; null for none."""
    date = F.col(date) if isinstance(date, str) else date
    return F.nullif(F.substring(date.cast("string"), 1, 4), F.lit(""))


def source_tracks(raw: DataFrame) -> DataFrame:
    """(position, id, title, artist, all_artists, album, duration_ms, code) of raw rows with a track.

    raw: position and track, a struct with artists as an array of names. Null tracks go, and keep no
    position of the rest from being as read.
    """
    t = raw.where("track IS NOT NULL")
    return t.select(
        "position",
        "track.id",
        "track.title",
        first_artist("track.artists").alias("artist"),
        F.coalesce("track.artists", F.array().cast("array<string>")).alias("all_artists"),
        F.coalesce(F.nullif("track.album", F.lit("")), F.lit("Unknown")).alias("album"),
        F.coalesce("track.duration_ms", F.lit(0)).cast("bigint").alias("duration_ms"),
        F.nullif("track.code", F.lit("")).alias("code"),
    )


def source_albums(raw: DataFrame) -> DataFrame:
    return raw.where("album IS NOT NULL").select("position", "album.id", "album.title", first_artist("album.artists").alias("artist"), F.nullif("album.code", F.lit("")).alias("code"), release_year("album.release_date").alias("release_year"), F.coalesce("album.total_tracks", F.lit(0)).alias("total_tracks"))


def resume(saved: DataFrame, offset: int, chunk: int | None = None) -> DataFrame:
    """Rows after the first offset by position, all or the next chunk; a filter on position, not a sort."""
    after = saved.where(F.col("position") > offset)
    return after if chunk is None else after.where(F.col("position") <= offset + chunk)


def page(rows: DataFrame, limit: int, order: str = "position") -> DataFrame:
    """The first rows by order, as one page of a service holds them."""
    return rows.orderBy(order).limit(limit)


def ids_of(rows: DataFrame, limit: int | None = None, order: str = "position") -> DataFrame:
    """The ids that rows have, of all or of one page by order."""
    return (rows if limit is None else page(rows, limit, order)).where("id IS NOT NULL").select("id")


def tracks_of(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """(playlist_id, position, id, title, artist, album, duration_ms, code) of each list; what isn't known is "Unknown"."""

    def known(c: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown")).alias(c)

    joined = members.join(tracks, members["track_id"] == tracks["id"])
    return joined.select("playlist_id", "position", "id", "title", known("artist"), known("album"), (F.coalesce("duration", F.lit(0)) * 1000).cast("bigint").alias("duration_ms"), "code")


def playlist_named(playlists: DataFrame, name: str) -> DataFrame:
    """The first playlist of exactly that name."""
    return playlists.where(F.col("name") == name).orderBy("id").limit(1)


def find_by_code(tracks: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, id): for each code asked for, the first track by id with an equal normalised code."""
    from ledgerline.functions.text import code_key

    have = tracks.select(code_key("code").alias("__key"), "id").where("__key != ''").groupBy("__key").agg(F.min("id").alias("id"))
    return codes.select("code", code_key("code").alias("__key")).distinct().join(have, "__key").select("code", "id")


def new_playlist(playlists: DataFrame, rows: DataFrame) -> DataFrame:
    """playlists and those of rows whose id isn't there."""
    return playlists.unionByName(rows.join(playlists.select("id"), "id", "left_anti").select(*playlists.columns))


def add_to_playlist(tracks: DataFrame, added: DataFrame) -> DataFrame:
    """(playlist_id, position, track_id) with added tracks at the ends of their lists, those there already left out."""
    from pyspark.sql import Window

    fresh = added.dropDuplicates(["playlist_id", "track_id"]).join(tracks, ["playlist_id", "track_id"], "left_anti")
    ends = tracks.groupBy("playlist_id").agg(F.max("position").alias("__end"))
    n = F.row_number().over(Window.partitionBy("playlist_id").orderBy("position", "track_id"))
    placed = fresh.withColumn("__n", n).join(ends, "playlist_id", "left").select("playlist_id", (F.coalesce("__end", F.lit(0)) + F.col("__n")).cast("bigint").alias("position"), "track_id")
    return tracks.select("playlist_id", "position", "track_id").unionByName(placed)


def add_favorites(favorites: DataFrame, ids: DataFrame) -> DataFrame:
    """favorites and the ids that aren't there: adding one twice changes nothing."""
    fresh = ids.select("id").where("id IS NOT NULL").distinct().join(favorites, "id", "left_anti")
    return favorites.unionByName(fresh.select(F.lit(None).cast("bigint").alias("position"), "id", F.lit(None).cast("string").alias("code")))


EMPTY = {"favorites": schemas.FAVORITES, "ledger": schemas.LEDGER, "unmatched": schemas.UNMATCHED, "runs": schemas.RUNS}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], EMPTY[table])
