"""The column functions once more as DuckDB SQL text, to hold the engine against. For ASCII texts."""

from __future__ import annotations

from ledgerline.functions import patterns as P


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by.replace('$1', chr(92) + '1'))}, 'g')"


def trim(x: str) -> str:
    return sub(x, P.TRIM)


def text(x: str) -> str:
    return f"coalesce({x}, '')"


def code_key(x: str) -> str:
    return sub(f"upper({x})", rf"[-{P.spaces()}]")


def normalize(x: str) -> str:
    out = f"strip_accents({trim(f'lower({text(x)})')})"
    for pattern, by in P.SPELLINGS:
        out = sub(out, pattern, by)
    for pattern in (P.GUEST_BRACKET, P.EDITION_BRACKET, P.GUEST_TAIL):
        out = sub(out, pattern)
    out = sub(out, P.FIRST_AMPERSAND, "$1 and ")
    return trim(sub(sub(out, P.LEADING_THE), P.MANY_SPACES, " "))


def normalize_hard(x: str, normalized: bool = False) -> str:
    return trim(sub(sub(sub(x if normalized else normalize(x), P.ANY_BRACKET), P.NOT_WORD, " "), P.MANY_SPACES, " "))


def comparison_key(x: str) -> str:
    return trim(sub(sub(f"strip_accents(lower({text(x)}))", P.NOT_LETTER_NUMBER), P.MANY_SPACES, " "))


def playlist_key(x: str, service: str) -> str:
    return f"lower({trim(sub(sub(text(x), rf'(?i)\s*\(from {service}\)\s*'), rf'(?i)\s*\[{service}\]\s*'))})"


def tokens(x: str) -> str:
    return f"string_split_regex({x}, {lit(P.MANY_SPACES)})"


def one_artist(x: str) -> str:
    low = trim(f"lower({text(x)})")
    acts = "[" + ", ".join(map(lit, P.ONE_ARTIST)) + "]"
    return f"len(list_filter({acts}, lambda act: contains({low}, act) OR contains(act, {low}))) > 0"


def primary(x: str) -> str:
    out = f"CASE WHEN {text(x)} = '' OR {one_artist(x)} THEN {text(x)}"
    for p in (P.GUEST_AFTER, P.GUEST_BRACKETED):
        out += f" WHEN regexp_matches({text(x)}, {lit(p)}) THEN {trim(f'regexp_extract({text(x)}, {lit(p)}, 1)')}"
    return f"({out} ELSE {text(x)} END)"


def featured(x: str) -> str:
    out = f"CASE WHEN {text(x)} = '' OR {one_artist(x)} THEN []::VARCHAR[]"
    for p in (P.GUEST_AFTER, P.GUEST_BRACKETED):
        parts = f"string_split_regex(regexp_extract({text(x)}, {lit(p)}, 2), {lit(P.ARTIST_SEPARATOR)})"
        out += f" WHEN regexp_matches({text(x)}, {lit(p)}) THEN list_filter(list_transform({parts}, lambda g: {trim('g')}), lambda g: g != '')"
    return f"({out} ELSE []::VARCHAR[] END)"


def strip_edition(x: str) -> str:
    out = sub(text(x), P.ALBUM_EDITION)
    for pattern in (*P.HYPHEN_EDITIONS, *P.EMPTY_BRACKETS):
        out = sub(out, pattern)
    return trim(sub(trim(sub(out, P.MANY_SPACES, " ")), P.DANGLING))


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 100 ELSE CAST(floor((1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) * 100 + 0.5) AS INTEGER) END)"


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


def token_sort_ratio(a: str, b: str) -> str:
    return ratio(_sorted(tokens(a)), _sorted(tokens(b)))


def token_set_ratio(a: str, b: str) -> str:
    shared = _sorted(f"list_intersect({tokens(a)}, {tokens(b)})")
    a, b = (_sorted(f"list_distinct({tokens(x)})") for x in (a, b))
    return f"greatest({ratio(shared, a)}, {ratio(shared, b)}, {ratio(a, b)})"


def partial_ratio(a: str, b: str) -> str:
    short, long = (f"(CASE WHEN length({a}) {sign} length({b}) THEN {a} ELSE {b} END)" for sign in ("<=", ">"))
    window = f"substring({long}, i::INTEGER, length({short})::INTEGER)"
    return f"(CASE WHEN {short} = '' THEN 0 ELSE list_max(list_transform(range(1, length({long}) - length({short}) + 2), lambda i: {ratio(short, window)})) END)"


def best_ratio(a: str, b: str) -> str:
    return f"greatest({ratio(a, b)}, {token_sort_ratio(a, b)}, {token_set_ratio(a, b)}, {partial_ratio(a, b)})"


def is_compilation(x: str) -> str:
    return f"regexp_matches(lower({text(x)}), {lit('|'.join(P.COMPILATION_WORDS))})"


def duration_tolerance(x: str) -> str:
    return f"(CASE WHEN {x} < 120000 THEN 3000 WHEN {x} < 240000 THEN 5000 WHEN {x} < 480000 THEN 10000 ELSE 30000 END)"


def half_up(x: str, digits: int = 0) -> str:
    return f"(floor(({x}) * {10**digits} + 0.5) / {10**digits})"
