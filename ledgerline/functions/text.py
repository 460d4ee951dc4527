"""Text normalisers and validators as Column functions; nulls are taken as empty unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import patterns as P


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Letters of the basic plane and what is left of them when marks U+0300 to U+036F go."""
    plain = {}
    for code in [*range(0xC0, 0xAC00), *range(0xF900, 0xFFFE)]:
        letter = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFD", letter) if not 0x300 <= ord(c) <= 0x36F)
        if len(bare) == 1 and bare != letter:
            plain[letter] = bare
    return "".join(plain), "".join(plain.values())


def _all(s: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(s, F.lit(pattern), F.lit(by))


def _text(s: Column | str) -> Column:
    return F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit(""))


def trim(s: Column) -> Column:
    return _all(s, P.TRIM)


def tokens(s: Column) -> Column:
    """Split on runs of white space; a text with none at its ends gives no empty token."""
    return F.split(s, P.MANY_SPACES)


def strip_accents(s: Column) -> Column:
    marked, bare = accent_table()
    return _all(F.translate(s, marked, bare), P.COMBINING)


def code_key(s: Column | str) -> Column:
    """A recording or product code in upper case, without hyphens and spaces; null stays null."""
    s = F.col(s) if isinstance(s, str) else s
    return _all(F.upper(s), rf"[-{P.spaces()}]")


def normalize(s: Column | str) -> Column:
    """Lower case without accents, guests, editions, a leading "the" and repeated spaces."""
    out = strip_accents(trim(F.lower(_text(s))))
    for pattern, by in P.SPELLINGS:
        out = _all(out, pattern, by)
    for pattern in (P.GUEST_BRACKET, P.EDITION_BRACKET, P.GUEST_TAIL):
        out = _all(out, pattern)
    out = _all(out, P.FIRST_AMPERSAND, "$1 and ")
    return trim(_all(_all(out, P.LEADING_THE), P.MANY_SPACES, " "))


def normalize_hard(s: Column | str) -> Column:
    """normalize without anything in brackets and with ASCII word characters only."""
    return trim(_all(_all(_all(normalize(s), P.ANY_BRACKET), P.NOT_WORD, " "), P.MANY_SPACES, " "))


def comparison_key(s: Column | str) -> Column:
    """Lower case letters and numbers of any script without accents, single spaces between."""
    return trim(_all(_all(strip_accents(F.lower(_text(s))), P.NOT_LETTER_NUMBER), P.MANY_SPACES, " "))


def playlist_key(s: Column | str, service: str) -> Column:
    """A playlist's name without the marks "(from SERVICE)" and "[SERVICE]", trimmed, in lower case."""
    return F.lower(trim(_all(_all(_text(s), rf"(?i)\s*\(from {service}\)\s*"), rf"(?i)\s*\[{service}\]\s*")))


def artists(s: Column | str) -> Column:
    """struct<primary, featured>: guests after "feat." and the like; acts known as one artist aren't split."""
    s = _text(s)
    acts = F.array(*map(F.lit, P.ONE_ARTIST))
    # bound by a lambda: an expression inside exists() is evaluated for each act
    one = F.get(F.transform(F.array(trim(F.lower(s))), lambda low: F.exists(acts, lambda a: F.contains(low, a) | F.contains(a, low))), 0)
    none = F.array().cast("array<string>")

    def split(pattern: str) -> Column:
        others = F.transform(F.split(F.regexp_extract(s, pattern, 2), P.ARTIST_SEPARATOR), trim)
        return F.struct(trim(F.regexp_extract(s, pattern, 1)).alias("primary"), F.filter(others, lambda a: a != "").alias("featured"))

    whole = F.struct(s.alias("primary"), none.alias("featured"))
    return F.when((s == "") | one, whole).when(F.rlike(s, F.lit(P.GUEST_AFTER)), split(P.GUEST_AFTER)).when(F.rlike(s, F.lit(P.GUEST_BRACKETED)), split(P.GUEST_BRACKETED)).otherwise(whole)


def strip_edition(s: Column | str) -> Column:
    """An album's title without marks of its edition."""
    out = _all(_text(s), P.ALBUM_EDITION)
    for pattern in (*P.HYPHEN_EDITIONS, *P.EMPTY_BRACKETS):
        out = _all(out, pattern)
    return trim(_all(trim(_all(out, P.MANY_SPACES, " ")), P.DANGLING))


def title_variants(s: Column | str) -> Column:
    """An album's title and its shorter forms, distinct, the most specific first."""
    s = _text(s)
    stripped, flat = strip_edition(s), trim(_all(s, P.FLAT_BRACKETS))

    def without_the(x: Column) -> Column:
        return F.substring(x, 5, 1 << 30)

    the = F.lower(s).startswith("the ")
    return F.array_distinct(
        F.array_compact(
            F.array(
                s,
                stripped,
                F.when(flat != "", flat),
                F.when(the, without_the(s)),
                F.when(the & F.lower(stripped).startswith("the "), without_the(stripped)),
            )
        )
    )


def partial_title(s: Column | str) -> Column:
    """The first two words of more than two characters."""
    return F.array_join(F.slice(F.filter(tokens(_text(s)), lambda w: F.length(w) > 2), 1, 2), " ")


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """How many distinct words of more than one character two texts share, case aside."""

    def words(s: Column | str) -> Column:
        return F.filter(tokens(F.lower(_text(s))), lambda w: F.length(w) > 1)

    return F.size(F.array_intersect(words(a), words(b)))


def is_compilation(album: Column | str) -> Column:
    return F.rlike(F.lower(_text(album)), F.lit("|".join(P.COMPILATION_WORDS)))


def is_source_id(s: Column) -> Column:
    """22 ASCII letters and digits."""
    return F.coalesce(F.rlike(s, F.lit(r"\A[0-9A-Za-z]{22}\z")), F.lit(False))


def is_target_track_id(s: Column) -> Column:
    """Begins with a positive whole number."""
    return F.coalesce(F.regexp_extract(s.cast("string"), r"^\s*([+-]?[0-9]+)", 1).try_cast("decimal(38,0)") > 0, F.lit(False))


def is_target_album_id(s: Column) -> Column:
    """Digits alone, not all of them 0."""
    return F.coalesce(F.rlike(s, F.lit(r"\A[0-9]*[1-9][0-9]*\z")), F.lit(False))


def clamp(s: Column, low: int, high: int | None, default: int) -> Column:
    """A request's number within its bounds; what isn't a number gives the default."""
    n = F.coalesce(F.regexp_extract(F.coalesce(s.cast("string"), F.lit("")), r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(default))
    n = F.greatest(n, F.lit(low))
    return n if high is None else F.least(n, F.lit(high))
