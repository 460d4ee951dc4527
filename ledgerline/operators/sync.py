"""Incremental sync: what is skipped, matched, written and missing, in one run or chunk by chunk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.albums import album_suggestions, match_albums
from ledgerline.operators.matching import Matches, Prepared, favorites_map
from ledgerline.operators.state import keep_last
from ledgerline.storage import cut

WRITE_BATCH, CHUNK, PLAYLIST_CHUNK, RECENT = 25, 50, 10, 20
#: Chunks whose running totals one task sums.
BLOCK = 4096


def chunk_no(position: Column | str, size: int = CHUNK) -> Column:
    """The chunk of a position from 1."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor((position - 1) / size).cast("bigint")


def unchanged_playlists(playlists: DataFrame, ledger: DataFrame) -> DataFrame:
    """playlists with skipped: whether the ledger has them with the same snapshot."""
    known = keep_last(ledger, ["playlist_id"], ["synced_at"]).select(F.col("playlist_id").alias("id"), F.col("snapshot_id").alias("__s"), F.lit(True).alias("__hit"))
    return playlists.join(known, "id", "left").withColumn("skipped", F.coalesce(F.col("__hit") & F.col("snapshot_id").eqNullSafe(F.col("__s")), F.lit(False))).drop("__s", "__hit")


def first_targets(matched: DataFrame, existing: DataFrame) -> DataFrame:
    """matched with pending: the first source by position of each target that isn't there already."""
    there = existing.select(F.col("id").alias("target_id")).where("target_id IS NOT NULL").distinct().withColumn("__there", F.lit(True))
    first = F.row_number().over(Window.partitionBy("target_id").orderBy("position", "source_id"))
    return matched.withColumn("__k", first).join(there, "target_id", "left").withColumn("pending", (F.col("__k") == 1) & F.col("__there").isNull()).drop("__k", "__there")


def write_batches(pending: DataFrame, size: int = WRITE_BATCH) -> DataFrame:
    """pending with its batch, in order of position, within each chunk: a sink takes a batch or fails it whole."""
    n = F.row_number().over(Window.partitionBy("chunk").orderBy("position"))
    return pending.withColumn("batch", F.floor((n - 1) / size).cast("bigint"))


def send_batches(writes: DataFrame, sink: Callable[[list], None]) -> DataFrame:
    """(chunk, batch, n, error): the outcome of handing each batch's target ids to the sink, null where it took them.

    A batch is handed over whole, by one task; what the sink raises is its error and stops no other batch.
    The outcomes are kept in the shared folder. A task that runs again hands its batches over again, so
    adding an id twice has to change nothing.
    """

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        rows, error = rows.sort_values("position"), None
        try:
            sink(rows["target_id"].tolist())
        except Exception as e:  # whatever a sink raises is the outcome of its batch
            error = f"batch of {len(rows)} failed: {e}"
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "batch": rows["batch"].iloc[:1], "n": len(rows), "error": error})

    return cut(writes.select("chunk", "batch", "position", "target_id").groupBy("chunk", "batch").applyInPandas(send, "chunk bigint, batch bigint, n bigint, error string"))


def settle(writes: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows of writes whose batch was taken, the errors): only the first may enter the ledger."""
    taken = outcomes.where("error IS NULL").select("chunk", "batch")
    return writes.join(taken, ["chunk", "batch"], "left_semi"), outcomes.where("error IS NOT NULL").select("chunk", "batch", "error")


def _open_state(source: DataFrame, ledger_ids: DataFrame, favorites: DataFrame, chunk: int) -> DataFrame:
    """(position, source_id, code, chunk, status): "skipped", "already", or null for what is to be matched."""
    rows = source.select("position", F.col("id").alias("source_id"), "code", chunk_no("position", chunk).alias("chunk"))
    done = ledger_ids.select("source_id").distinct().withColumn("__done", F.lit(True))
    raw = favorites_map(favorites, F.col("code")).select(F.col("code_key").alias("code"), F.lit(True).alias("__raw"))
    return cut(rows.join(done, "source_id", "left").join(raw, "code", "left").withColumn("status", F.when(F.col("__done"), "skipped").when(F.col("__raw"), "already")).drop("__done", "__raw"))


def _decided(state: DataFrame, matched: DataFrame, favorites: DataFrame) -> DataFrame:
    existing = favorites.where("code IS NOT NULL AND code != ''")
    chosen = first_targets(matched.join(state.select("source_id", "position"), "source_id"), existing).drop("position")
    return state.join(chosen, "source_id", "left").select(
        "position", "source_id", "chunk", F.coalesce("status", F.when(F.col("target_id").isNotNull(), "matched").otherwise("missing")).alias("status"), "target_id", F.when(F.col("status") == "already", F.lit("code")).otherwise(F.col("match_type")).alias("match_type"), "score", F.coalesce("pending", F.lit(False)).alias("pending")
    )


def classify(source: DataFrame, target: DataFrame | Prepared, ledger_ids: DataFrame, favorites: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, Matches]:
    """(position, source_id, chunk, status, target_id, match_type, score, pending) of every source track.

    status: "skipped" for ids of the ledger; "already" where the raw code, as it stands, is a favorite's;
    "matched"; "missing". pending marks what has to be written. Favorites without a code aren't known to
    be there. The target may have been through prepare_target already.
    """
    state = _open_state(source, ledger_ids, favorites, chunk)
    open_ = source.join(state.where("status IS NULL").select(F.col("source_id").alias("id")), "id", "left_semi")
    matches = Matches(open_, target, favorites)
    return _decided(state, matches.matched, favorites), matches


def classify_albums(albums: DataFrame, catalog: DataFrame, ledger_ids: DataFrame, favorites: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The same of every saved album: codes are product codes, compared as they stand."""
    state = _open_state(albums, ledger_ids, favorites, chunk)
    open_ = albums.join(state.where("status IS NULL").select(F.col("source_id").alias("id")), "id", "left_semi")
    return _decided(state, match_albums(open_, catalog), favorites)


def _counters() -> list[Column]:
    status, kind = F.col("status"), F.col("match_type")
    found = status.isin("matched", "already")
    return [
        F.count_if(found).alias("tracks_matched"),
        F.count_if(status == "missing").alias("tracks_not_matched"),
        F.count_if(status == "skipped").alias("tracks_skipped"),
        F.count_if(status == "already").alias("already_in_target"),
        F.count_if(found & (kind == "code")).alias("code_matches"),
        F.count_if(found & (kind != "code")).alias("fuzzy_matches"),
    ]


def report(classified: DataFrame) -> DataFrame:
    """One row with the counters of a run."""
    return classified.agg(*_counters())


def chunk_reports(classified: DataFrame) -> DataFrame:
    """A row for each chunk: its counters, and running totals as total_*."""
    each = classified.groupBy("chunk").agg(*_counters())
    return running_totals(each, "chunk", [c for c in each.columns if c != "chunk"])


def running_totals(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """rows with running sums of columns, by a whole number, as total_*.

    Sums run inside blocks of that number, each a task's; only a row for each block is put in one order.
    """
    block = F.floor(F.col(order) / BLOCK)
    sums = rows.groupBy(block.alias("__block")).agg(*(F.sum(c).alias(c) for c in columns))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("__block", block).join(sums, "__block")
    return joined.select(*rows.columns, *((F.sum(c).over(inside) + F.col(f"__{c}")).alias(f"total_{c}") for c in columns))


def chunk_states(classified: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(chunk, status, offset, total_items, processed_in_chunk, has_more, error, total_*): the state row each chunk leaves.

    "chunk_complete" while items follow, then "completed". errors (chunk, error) are what stopped a chunk:
    the first one is "failed", at the offset that it began from, and none follows it.
    """
    each = classified.groupBy("chunk").agg(F.count("*").alias("processed_in_chunk"), *_counters())
    columns = [c for c in each.columns if c != "chunk"]
    rows = running_totals(each, "chunk", columns).crossJoin(F.broadcast(classified.agg(F.count("*").alias("total_items"))))
    more = F.col("total_processed_in_chunk") < F.col("total_items")
    out = rows.select("chunk", F.when(more, "chunk_complete").otherwise("completed").alias("status"), F.col("total_processed_in_chunk").alias("offset"), "total_items", "processed_in_chunk", more.alias("has_more"), F.lit(None).cast("string").alias("error"), *(f"total_{c}" for c in columns[1:]))
    if errors is None:
        return out
    first = errors.agg(F.min(F.struct("chunk", "error")).alias("e")).select(F.col("e.chunk").alias("__at"), F.col("e.error").alias("__error"))
    hit = F.col("chunk") == F.col("__at")
    stopped = out.crossJoin(F.broadcast(first)).where("__at IS NULL OR chunk <= __at")
    changed = {"status": F.lit("failed"), "offset": F.col("offset") - F.col("processed_in_chunk"), "has_more": F.lit(True), "error": F.col("__error")}
    lost = {f"total_{c}": F.col(f"total_{c}") - F.col(f"__own_{c}") for c in columns[1:]}
    own = each.select(F.col("chunk").alias("__chunk"), *(F.col(c).alias(f"__own_{c}") for c in columns[1:]))
    joined = stopped.join(own, F.col("chunk") == F.col("__chunk"))
    return joined.select(*(F.when(hit, (changed | lost)[c]).otherwise(F.col(c)).alias(c) if c in changed or c in lost else F.col(c) for c in out.columns))


def album_counters(report_: DataFrame) -> DataFrame:
    """An album report under the names of a track report; what it has under either name counts."""
    pairs = {"tracks_matched": "albums_matched", "tracks_not_matched": "albums_not_matched", "code_matches": "upc_matches"}

    def value(name: str, other: str) -> Column:
        have = [F.col(c) for c in (other, name) if c in report_.columns]
        return F.coalesce(*have, F.lit(0)).alias(name)

    return report_.select(*(value(k, v) for k, v in pairs.items()))


def merge_reports(reports: DataFrame, lists: list[str] = ()) -> DataFrame:
    """One report of many: numbers add up, lists are concatenated by chunk."""
    numbers = [c for c, t in reports.dtypes if c != "chunk" and c not in lists and t in ("int", "bigint", "double")]

    def by_chunk(c: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct("chunk", F.col(c).alias("list"))))
        return F.flatten(F.transform(rows, lambda x: x["list"])).alias(c)

    return reports.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers), *map(by_chunk, lists))


def final_report(reports: DataFrame, lists: list[str]) -> DataFrame:
    """merge_reports, but of lists the last chunk's only, as a run that reports chunk by chunk ends with."""
    numbers = [c for c, t in reports.dtypes if c != "chunk" and c not in lists and t in ("int", "bigint", "double")]
    return reports.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers), *(F.max_by(c, "chunk").alias(c) for c in lists))


def recent_missing(classified: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n missing tracks by position, the latest first."""
    return classified.where("status = 'missing'").orderBy(F.desc("position")).limit(n).select("position", "source_id")


@dataclass
class SyncResult:
    classified: DataFrame
    writes: DataFrame  # (target_id, source_id, position, chunk, batch): what a sink took, or would take; empty in a dry run
    ledger: DataFrame  # ledger ids, those of what was taken among them
    report: DataFrame
    suggestions: DataFrame  # for what is missing
    errors: DataFrame  # (chunk, batch, error) of the batches that a sink didn't take


def _finished(classified: DataFrame, ledger_ids: DataFrame, suggestions: DataFrame, dry_run: bool, sink: Callable[[list], None] | None) -> SyncResult:
    writes = write_batches(classified.where(F.col("pending") & F.lit(not dry_run))).select("target_id", "source_id", "position", "chunk", "batch")
    errors = classified.sparkSession.createDataFrame([], "chunk bigint, batch bigint, error string")
    if sink is not None and not dry_run:
        writes = cut(writes)
        writes, errors = settle(writes, send_batches(writes, sink))
    ledger = ledger_ids.select("source_id").union(writes.select("source_id")).distinct()
    return SyncResult(classified, writes, ledger, report(classified), suggestions, errors)


def run_sync(source: DataFrame, target: DataFrame | Prepared, ledger_ids: DataFrame, favorites: DataFrame, chunk: int = CHUNK, dry_run: bool = False, sink: Callable[[list], None] | None = None) -> SyncResult:
    """A whole run. A dry run decides and reports alike, but writes nothing and adds nothing to the ledger.

    A batch that the sink fails on becomes an error, and its tracks stay out of the ledger.
    """
    classified, matches = classify(source, target, ledger_ids, favorites, chunk)
    return _finished(cut(classified), ledger_ids, matches.suggestions(), dry_run, sink)


def run_album_sync(albums: DataFrame, catalog: DataFrame, ledger_ids: DataFrame, favorites: DataFrame, chunk: int = CHUNK, dry_run: bool = False, sink: Callable[[list], None] | None = None) -> SyncResult:
    """The same for saved albums; the report has the albums' names for its counters."""
    classified = cut(classify_albums(albums, catalog, ledger_ids, favorites, chunk))
    missing = classified.where("status = 'missing'").select(F.col("source_id").alias("id"))
    done = _finished(classified, ledger_ids, album_suggestions(albums.join(missing, "id", "left_semi"), catalog), dry_run, sink)
    names = {"tracks_matched": "albums_matched", "tracks_not_matched": "albums_not_matched", "tracks_skipped": "albums_skipped", "code_matches": "upc_matches"}
    done.report = done.report.withColumnsRenamed(names)
    return done


def selected(playlists: DataFrame, ids: DataFrame | list[str] | None) -> DataFrame:
    """The playlists with those ids, from a list or a column of any length; all for none."""
    if ids is None:
        return playlists
    if isinstance(ids, list):
        return playlists.where(F.col("id").isin(ids))
    return playlists.join(ids.select("id"), "id", "left_semi")


@dataclass
class PlaylistResult:
    playlists: DataFrame  # (id, chunk, skipped, target_name, target_id, created)
    ledger: DataFrame  # (playlist_id, snapshot_id, track_count) of what is synced now
    _decide: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]

    @cached_property
    def _decided(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self._decide()  # tracks are matched when first asked for: the lists don't depend on it

    @property
    def decisions(self) -> DataFrame:
        """(playlist_id, position, source_id, track_id, match_type)"""
        return self._decided[0]

    @property
    def additions(self) -> DataFrame:
        """(target_id, position, track_id, playlist_id, source_id)"""
        return self._decided[1]

    @property
    def reports(self) -> DataFrame:
        """A row for each chunk of playlists."""
        return self._decided[2]


def run_playlist_sync(playlists: DataFrame, tracks: DataFrame, catalog: DataFrame, there: DataFrame, there_tracks: DataFrame, ledger: DataFrame, mark: str, ids: DataFrame | list[str] | None = None, skip_unchanged: bool = True, chunk: int = PLAYLIST_CHUNK) -> PlaylistResult:
    """All playlists at once: what is new in each goes to the end of the target's list of the same name and mark.

    playlists: (id, position, name, tracks_count, snapshot_id); tracks: source tracks with playlist_id;
    there and there_tracks: the target's (id, name) and (playlist_id, position, track_id). A track that is
    in many lists is matched once. A list without tracks is synced, but none is created for it. Of the
    target's lists with one name the first by id counts.
    """
    chosen = unchanged_playlists(selected(playlists, ids), ledger) if skip_unchanged else selected(playlists, ids).withColumn("skipped", F.lit(False))
    own = cut(tracks.select("playlist_id", "position", "id").join(chosen.where("NOT skipped").select(F.col("id").alias("playlist_id")), "playlist_id", "left_semi"))
    full = own.select(F.col("playlist_id").alias("id")).distinct().withColumn("__full", F.lit(True))
    named = there.groupBy(F.col("name").alias("target_name")).agg(F.min("id").alias("__there"))
    rows = chosen.withColumn("target_name", F.concat("name", F.lit(f" ({mark})"))).join(named, "target_name", "left").join(full, "id", "left")
    fresh = F.col("__full") & F.col("__there").isNull()
    lists = cut(rows.select("id", chunk_no("position", chunk).alias("chunk"), "skipped", "target_name", F.when(fresh, F.concat(F.lit("new-"), "id")).otherwise(F.col("__there")).alias("target_id"), F.coalesce(fresh, F.lit(False)).alias("created"), "snapshot_id", "tracks_count"))

    def decide() -> tuple[DataFrame, DataFrame, DataFrame]:
        # distinct rows hash where the tracks are, and only the ids of the chosen lists meet them: rows of lists aren't sorted to find a track's first
        known = tracks.drop("playlist_id", "position").distinct().join(own.select("id").distinct(), "id", "left_semi")
        once = cut(known.dropDuplicates(["id"]).withColumn("position", F.lit(None).cast("bigint")))
        matched = Matches(once, catalog).matched.select("source_id", F.col("target_id").alias("track_id"), "match_type")
        decisions = cut(own.select("playlist_id", "position", F.col("id").alias("source_id")).join(matched, "source_id", "left"))
        of = lists.where("NOT skipped").select(F.col("id").alias("playlist_id"), "target_id", "chunk")
        wanted = decisions.where("track_id IS NOT NULL").groupBy("playlist_id", "track_id").agg(F.min(F.struct("position", "source_id")).alias("f")).join(of, "playlist_id")
        missing_there = wanted.join(there_tracks.select(F.col("playlist_id").alias("target_id"), "track_id"), ["target_id", "track_id"], "left_anti")
        ends = there_tracks.groupBy(F.col("playlist_id").alias("target_id")).agg(F.max("position").alias("__end"))
        n = F.row_number().over(Window.partitionBy("target_id").orderBy("f.position", "track_id"))
        additions = missing_there.withColumn("__n", n).join(ends, "target_id", "left").select("target_id", (F.coalesce("__end", F.lit(0)) + F.col("__n")).cast("bigint").alias("position"), "track_id", "playlist_id", F.col("f.source_id").alias("source_id"))
        found = F.col("track_id").isNotNull()
        counts = decisions.join(of.select("playlist_id", "chunk"), "playlist_id").groupBy("chunk").agg(F.count_if(found).alias("tracks_matched"), F.count_if(~found).alias("tracks_not_matched"), F.count_if(F.col("match_type") == "code").alias("code_matches"), F.count_if(found & (F.col("match_type") != "code")).alias("fuzzy_matches"))
        per_chunk = lists.groupBy("chunk").agg(F.count("*").alias("playlists"), F.count_if("skipped").alias("playlists_skipped"))
        reports = per_chunk.join(counts, "chunk", "left").na.fill(0)
        return decisions, additions, reports

    synced = lists.where("NOT skipped").select(F.col("id").alias("playlist_id"), "snapshot_id", F.col("tracks_count").alias("track_count"))
    return PlaylistResult(lists.drop("snapshot_id", "tracks_count"), synced, decide)
