"""Gates, weighted scores and progress arithmetic as Column functions. Scores are doubles throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.similarity import best_ratio, partial_ratio

MIN_COMBINED, MIN_FALLBACK = 78, 65
SUGGESTION_COMBINED, SUGGESTION_ARTIST, SUGGESTION_TITLE, SUGGESTION_SURE_ARTIST = 40, 60, 50, 85
MIN_ALBUM, ALBUM_TITLE, ALBUM_ARTIST = 70, 50, 60


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def duration_tolerance(ms: Column | str) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.when(ms < 120_000, 3_000).when(ms < 240_000, 5_000).when(ms < 480_000, 10_000).otherwise(30_000)


def artist_score(artist: Column, every: Column, primary: Column, t_artist: Column, t_primary: Column, t_every: Column) -> Column:
    """The best of: whole names, each source artist with the whole name, primaries, and pairs of artists over 80. All normalised."""
    each = F.transform(every, lambda a: best_ratio(a, t_artist))
    cross = F.flatten(F.transform(every, lambda a: F.transform(t_every, lambda b: best_ratio(a, b))))
    whole = F.array(best_ratio(artist, t_artist), best_ratio(primary, t_primary))
    return F.array_max(F.concat(whole, each, F.filter(cross, lambda x: x > 80)))


def artist_in_title(every: Column, t_title: Column) -> Column:
    """The best partial ratio of a source artist in the target's title, if over 70, else null."""
    return F.array_max(F.filter(F.transform(every, lambda a: partial_ratio(a, t_title)), lambda x: x > 70))


def combined_score(title: Column, artist: Column, album_sort: Column, albums_known: Column, only_target_compiles: Column) -> Column:
    """Half title, half artist, then a bonus for like albums or a malus for a compilation on the target's side only."""
    base = title * F.lit(0.5) + artist * F.lit(0.5)
    return (
        F.when(albums_known & (album_sort > 85), F.least(F.lit(100.0), base + 8))
        .when(albums_known & (album_sort > 70), F.least(F.lit(100.0), base + 4))
        .when(albums_known & only_target_compiles, F.greatest(F.lit(0.0), base - 5))
        .otherwise(base)
    )


def album_score(title: Column, artist: Column, year: Column, t_year: Column, tracks: Column, t_tracks: Column) -> Column:
    """0.6 title and 0.4 artist, with bonuses for an equal year and a near number of tracks; may pass 100."""
    diff = F.abs(tracks - t_tracks)
    known = (tracks != 0) & (t_tracks != 0)
    bonus = F.when(known & (diff == 0), 5).when(known & (diff <= 2), 2).when(known & (diff <= 4), 1).otherwise(0)
    same_year = F.when((year == t_year) & (year != ""), 10).otherwise(0)
    return title * F.lit(0.6) + artist * F.lit(0.4) + same_year + bonus


def percent_complete(lists: Column, current: Column, done: Column, total: Column) -> Column:
    """Of a run over some lists, the current one (from 1) at done of total items; at most 100."""
    part = F.when(total > 0, done / total).otherwise(F.lit(0.0))
    share = F.when(lists == 1, part * 100).otherwise(((current - 1) / lists + part / lists) * 100)
    return F.when(lists == 0, F.lit(0.0)).otherwise(F.least(share, F.lit(100.0)))


def chunk_percent(offset: Column, total: Column, otherwise: Column) -> Column:
    return F.coalesce(F.when(total > 0, offset / total * 100), otherwise)


def shown_percent(score: Column) -> Column:
    """A score as a reviewer sees it: whole percents."""
    return half_up(score).cast("int")


def shown_delay(ms: Column) -> Column:
    """Seconds to a tenth of a delay worth telling, over half a second; null for others."""
    return F.when(ms > 500, half_up(ms / 1000, 1))
