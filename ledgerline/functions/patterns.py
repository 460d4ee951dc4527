"""Patterns of the text normalisers, in the common part of the Java and RE2 dialects.

SPACE stands for every Unicode white space: a plain \\s is ASCII only in both. Texts are lower case
where a pattern has no (?i).
"""

from __future__ import annotations

_UNICODE_SPACES = ["00A0", "1680", "2000-200A", "2028", "2029", "202F", "205F", "3000", "FEFF"]


def spaces(ranges: list[str] = _UNICODE_SPACES) -> str:
    return r"\s\x0B" + "".join("-".join(rf"\x{{{end}}}" for end in r.split("-")) for r in ranges)


SPACE = f"[{spaces()}]"
_NOT_WORD = f"[^0-9A-Za-z_{spaces()}]"

#: (pattern, replacement with $1): British spellings to American ones.
SPELLINGS = [
    (r"(behavi|col|fav|hon|neighb)our", "$1or"),
    (r"(cent|theat)re", "$1er"),
    (r"(defen|licen)ce", "$1se"),
    (r"grey", "gray"),
    (r"(catalog|dialog)ue", "$1"),
    (r"travelling", "traveling"),
    (r"cancelled", "canceled"),
]

# a keyword is followed by anything up to the bracket, so that its beginning is enough
GUEST_BRACKET = rf"{SPACE}*[(\[](?:feat|ft|prod|with)[^\])]*[\])]"
EDITION_BRACKET = rf"{SPACE}*[(\[].*?(?:[0-9]{{4}}|acoustic|album|anniversary|bonus|deluxe|edit|extended|live|mix|original|radio|remaster|single|version).*?[\])]"
GUEST_TAIL = rf"{SPACE}+(?:featuring|feat\.?|ft\.?|with){SPACE}+.+\z"
FIRST_AMPERSAND = r"(?s)^(.*?) & "
LEADING_THE = rf"^the{SPACE}+"
ANY_BRACKET = rf"{SPACE}*[(\[].*?[\])]"
NOT_WORD = _NOT_WORD
MANY_SPACES = f"{SPACE}+"
TRIM = rf"\A{SPACE}+|{SPACE}+\z"
COMBINING = r"[\x{0300}-\x{036F}]"
NOT_LETTER_NUMBER = rf"[^\p{{L}}\p{{N}}{spaces()}]"

GUEST_AFTER = rf"(?i)^(.+?){SPACE}+(?:featuring|feat\.?|ft\.?){SPACE}+(.+)\z"
GUEST_BRACKETED = rf"(?i)^(.+?){SPACE}*[(\[](?:featuring|feat\.?|ft\.?){SPACE}+([^\])]+)[\])]"
ARTIST_SEPARATOR = rf"(?i){SPACE}*[,&]{SPACE}*|{SPACE}+and{SPACE}+"

_ORDINAL = r"[0-9]+(?:nd|rd|st|th)?"
_EDITIONS = [
    rf"{_ORDINAL}\s*anniversary", r"[0-9]{4} (?:mix|remaster|version)", "acoustic", "anniversary", "atmos", "b-sides", "bonus (?:disc|track)", "cd",
    "censored", "clean", "collector's edition", "complete edition", "deluxe", "demo", "digital", "dolby atmos", "edited", "expanded", "explicit",
    "extra tracks", "film score", "hi-res", "high resolution", "import", "in concert", "instrumental", "international", "japan(?:ese)? edition",
    "karaoke", "limited edition", "live", "mono", "motion picture", "mtv unplugged", "original (?:motion picture )?soundtrack", "ost", "outtakes",
    "premium edition", "radio edit", "re-recorded", "redux", "reimagined", "remaster", "remix", "revisited", "reworked", "sessions",
    "single version", "spatial", "special edition", "stereo", "streaming", "stripped", "super deluxe", "the sessions", "u[ks] edition",
    "ultimate edition", "uncensored", "unplugged", "vinyl", "with bonus",
]
ALBUM_EDITION = rf"(?i)\s*[(\[](?:{'|'.join(_EDITIONS)})[^\])]*[\])]"
_AFTER_HYPHEN = "deluxe; remaster(?:ed)?; remastered\\s+[0-9]{4}; [0-9]{4}\\s+remaster(?:ed)?; live; acoustic; unplugged; mono; stereo; expanded; anniversary\\s*edition?"
_AFTER_HYPHEN += f"; {_ORDINAL}\\s*anniversary[^-]*; special\\s*edition?; single; ep"
#: One after the other: what follows a hyphen at the end. The last also takes a tail with hyphens of its own.
HYPHEN_EDITIONS = [rf"(?i)\s+-\s*{body}\s*\z" for body in _AFTER_HYPHEN.split("; ")] + [rf"(?i)\s+-\s+{_ORDINAL}\s+anniversary[^()\[\]]*\z"]
EMPTY_BRACKETS = [r"\s*\(\s*\)\s*", r"\s*\[\s*\]\s*"]
DANGLING = r"\s*[-:]\s*\z"
FLAT_BRACKETS = r"\s*[(\[][^\]()]*[\])]"

#: Acts that are one artist, whatever their names hold; "&" stands for "and" too.
_ACTS = ["belle & sebastian", "hall & oates", "simon & garfunkel", "tegan & sara", "peter, paul & mary"]
ONE_ARTIST = sorted(
    [*_ACTS, *(a.replace("&", "and") for a in _ACTS)]
    + "blood, sweat & tears|brooks & dunn|crosby, stills & nash|crosby, stills, nash & young|emerson, lake & palmer|penn & teller".split("|")
    + "earth wind & fire|earth, wind & fire|florence + the machine|florence and the machine|mamas and papas|the mamas & the papas".split("|")
    + ["tears for fears", "three dog night", "tony! toni! toné!"]
)
COMPILATION_WORDS = sorted("hits|greatest hits|singles|classics|best of|legend|gold|platinum|essential|definitive|complete|ultimate|anthology|collection|compilation|ost|soundtrack|various artists|now that's what i call".split("|"))
