"""Comparing lists: which playlists exist on both sides, and which tracks one side lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T


def compare_playlists(source: DataFrame, target: DataFrame, service: str = "source") -> DataFrame:
    """(id, name, tracks_count, target_id, target_count, track_diff) for each source playlist.

    Names are compared by playlist_key; of target playlists with one key the last by position (or id)
    counts. track_diff is the source's count where there is no such playlist.
    """
    order = F.col("position") if "position" in target.columns else F.col("id")
    keyed = target.groupBy(T.playlist_key("name", service).alias("__key")).agg(F.max_by(F.struct("id", "tracks_count"), F.struct(order, "id")).alias("t"))
    joined = source.withColumn("__key", T.playlist_key("name", service)).join(keyed, "__key", "left")
    return joined.select("id", "name", "tracks_count", F.col("t.id").alias("target_id"), F.col("t.tracks_count").alias("target_count"), (F.col("tracks_count") - F.coalesce("t.tracks_count", F.lit(0))).alias("track_diff"))


def compare_totals(compared: DataFrame, target: DataFrame) -> DataFrame:
    """One row: playlists, matched playlists and tracks of both sides."""
    totals = target.agg(F.coalesce(F.sum("tracks_count"), F.lit(0)).alias("target_tracks"))
    own = compared.agg(F.count("*").alias("playlists"), F.count_if(F.col("target_id").isNotNull()).alias("matched"), F.coalesce(F.sum("tracks_count"), F.lit(0)).alias("source_tracks"))
    return own.crossJoin(totals)


def title_artist_key(title: Column | str, artist: Column | str) -> Column:
    return F.concat(T.comparison_key(title), F.lit("|"), T.comparison_key(artist))


def diff_tracks(source: DataFrame, target: DataFrame) -> DataFrame:
    """source tracks with present: whether the same list of the target has its code or its title and artist.

    Both sides: playlist_key, title, artist, code; all lists at once. Tracks of a list without a
    counterpart are absent. Either condition is an equi-join with the target's distinct keys.
    """
    codes = target.where("code IS NOT NULL AND code != ''").select("playlist_key", T.code_key("code").alias("__code")).distinct().withColumn("__by_code", F.lit(True))
    names = target.select("playlist_key", title_artist_key("title", "artist").alias("__name")).distinct().withColumn("__by_name", F.lit(True))
    keyed = source.withColumn("__code", F.nullif(T.code_key("code"), F.lit(""))).withColumn("__name", title_artist_key("title", "artist"))
    joined = keyed.join(codes, ["playlist_key", "__code"], "left").join(names, ["playlist_key", "__name"], "left")
    return joined.withColumn("present", F.coalesce("__by_code", "__by_name", F.lit(False))).select(*source.columns, "present")


def library_stats(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table given."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def library_deltas(source: DataFrame, target: DataFrame) -> DataFrame:
    """(metric, source, target, delta) of two one-row tables of counts with the same columns."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias(name)) for c in df.columns))).alias("x")).select("x.*")

    return long(source, "source").join(long(target, "target"), "metric").select("metric", "source", "target", (F.col("source") - F.col("target")).alias("delta"))


def marked_playlists(playlists: DataFrame, mark: str) -> DataFrame:
    """One row: playlists, their tracks, and how many carry the mark of an earlier run in their name."""
    return playlists.agg(F.count("*").alias("playlists"), F.coalesce(F.sum("tracks_count"), F.lit(0)).alias("tracks"), F.count_if(F.contains("name", F.lit(mark))).alias("marked"))
