"""Queries of single functions over strings of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import scoring as C
from ledgerline.functions import similarity as S
from ledgerline.functions import text as T
from ledgerline.plans import duck as D
from ledgerline.plans.music import table

_MEASURES = ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "best_ratio")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct()


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names in one block, a shared word, so that no pair needs a nested loop; and all pairs of like first letters."""
    words = _names(spark, sf_dir).select("p_name", F.explode(F.split("p_name", " ")).alias("w"))
    left, right = words.select(F.col("p_name").alias("a"), "w"), words.select(F.col("p_name").alias("b"), "w")
    initial = F.substring("p_name", 1, 1)
    first, second = (_names(spark, sf_dir).select(F.col("p_name").alias(c), initial.alias("w")) for c in "ab")
    return left.join(right, "w").select("a", "b").union(first.join(second, "w").select("a", "b")).distinct()


_PAIRS = """names AS (SELECT DISTINCT p_name FROM part), words AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM names),
pairs AS (SELECT a.p_name AS a, b.p_name AS b FROM words a JOIN words b USING (w) UNION SELECT a.p_name, b.p_name FROM names a JOIN names b ON substring(a.p_name, 1, 1) = substring(b.p_name, 1, 1))"""


def similarity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("a", "b", *(getattr(S, m)("a", "b").alias(m) for m in _MEASURES))


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("a", "b", T.token_overlap("a", "b").alias("overlap"))


_SUFFIX = "CASE doc_id % 9 WHEN 0 THEN ' (feat. Some One)' WHEN 1 THEN ' [2011 Remaster]' WHEN 2 THEN ' & more & more' WHEN 3 THEN ' ft. another' WHEN 4 THEN ' (Part 2)' WHEN 5 THEN '  Colour of Grey!' WHEN 6 THEN ' (Oliver)' WHEN 7 THEN '' ELSE ' with you all' END"
_PREFIX = "CASE WHEN doc_id % 4 = 0 THEN 'The ' ELSE '' END"


def normalize_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PREFIX} || substring(text, 1, 60) || {_SUFFIX} AS title")
    return docs.select("doc_id", T.normalize("title").alias("plain"), T.normalize_hard("title").alias("hard"), T.comparison_key("title").alias("compared"))


_EDITIONS = ["", " (Deluxe Edition)", " [Remastered 2009]", " - Live", " - 25th Anniversary Edition", " (Live at Home) - EP", " [Explicit]", " (1989)", " - 2011 Remaster", " ()", " : ", " (Original Motion Picture Soundtrack)", " - 10th anniversary - box", " (Part 2)"]
_EDITION = "CASE p_partkey % {n} {when} END".format(n=len(_EDITIONS), when=" ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_EDITIONS)))
_EDITION = f"CASE WHEN p_partkey % 3 = 0 THEN 'The ' ELSE '' END || p_name || {_EDITION}"


def edition_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_EDITION} AS title")
    return titles.select("p_partkey", T.strip_edition("title").alias("base"), F.array_join(T.title_variants("title"), "|").alias("variants"))


_GUESTS = "CASE c_custkey % 8 WHEN 0 THEN ' feat. ' || 'A, B & C' WHEN 1 THEN ' (ft. D and E)' WHEN 2 THEN ' featuring F' WHEN 3 THEN ' & G' WHEN 4 THEN '' WHEN 5 THEN ' [feat. H]' WHEN 6 THEN ' Hall & Oates feat. I' ELSE ' Feat J , K' END"


def featured_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"c_name || {_GUESTS} AS artist")
    return names.select("c_custkey", T.artists("artist").alias("x")).select("c_custkey", F.col("x.primary").alias("primary_artist"), F.array_join("x.featured", "|").alias("guests"))


_ID = "CASE o_orderkey % 7 WHEN 0 THEN CAST(o_orderkey AS VARCHAR(20)) WHEN 1 THEN CAST(o_orderkey AS VARCHAR(20)) || 'abc' WHEN 2 THEN 'x' || CAST(o_orderkey AS VARCHAR(20)) WHEN 3 THEN '0' WHEN 4 THEN '-' || CAST(o_orderkey AS VARCHAR(20)) WHEN 5 THEN lpad(CAST(o_orderkey AS VARCHAR(20)), 22, 'aB3') END"


def code_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_ID} AS id")
    x = F.col("id")
    return ids.select("o_orderkey", T.is_source_id(x).alias("source_id"), T.is_target_track_id(x).alias("track_id"), T.is_target_album_id(x).alias("album_id"), T.clamp(x, 1, 100, 20).alias("page"), T.clamp(x, 0, None, 0).alias("skip"), T.code_key(F.concat(F.lit("us-rc "), x)).alias("code"))


_NUMBER = r"coalesce(try_cast(regexp_extract(coalesce(id, ''), '^\s*([+-]?[0-9]+)', 1) AS BIGINT), {d})"


def duration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("p_size").cast("bigint") * 15000
    return table(spark, sf_dir, "part").select("p_partkey", ms.alias("duration_ms"), C.duration_tolerance(ms).alias("tolerance"), T.is_compilation(F.concat(F.when(F.col("p_partkey") % 3 == 0, "Greatest Hits of ").otherwise(""), "p_name")).alias("compilation"))


def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("event_id") % 5, F.col("event_id")
    part = C.percent_complete(n, k % 3 + 1, k % 21, (k % 4) * 7)
    return table(spark, sf_dir, "events").select("event_id", C.half_up(part, 6).alias("percent"), C.half_up(C.chunk_percent(k % 50, (k % 3) * 25, part), 6).alias("chunk_percent"))


QUERIES = {f.__name__: f for f in (similarity_metrics, token_overlap, normalize_titles, edition_strip, featured_artists, code_validation, duration_gate, progress_percent)}


def _variants(t: str) -> str:
    """title_variants as text: the strings in the order of adding, each where it first occurs."""
    stripped, flat = D.strip_edition(t), D.trim(D.sub(t, r"\s*[(\[][^\]()]*[\])]"))
    the = f"starts_with(lower({t}), 'the ')"
    every = f"[{t}, {stripped}, CASE WHEN {flat} != '' THEN {flat} END, CASE WHEN {the} THEN substring({t}, 5) END, CASE WHEN {the} AND starts_with(lower({stripped}), 'the ') THEN substring({stripped}, 5) END]"
    return f"list_filter({every}, lambda v: v IS NOT NULL)", "list_filter(every, lambda v, i: list_position(every, v) = i)"


def _oracles() -> dict[str, str]:
    every, distinct = _variants("title")
    normal = D.normalize("title")
    part = "CASE WHEN total > 0 THEN done::DOUBLE / total ELSE 0.0::DOUBLE END"
    percent = f"CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(CASE WHEN n = 1 THEN ({part}) * 100 ELSE ((i - 1)::DOUBLE / n + ({part}) / n) * 100 END, 100.0::DOUBLE) END"
    return {
        "similarity_metrics": f"WITH {_PAIRS} SELECT a, b, " + ", ".join(f"{getattr(D, m)('a', 'b')} AS {m}" for m in _MEASURES) + " FROM pairs",
        "token_overlap": f"WITH {_PAIRS} SELECT a, b, len(list_distinct(list_intersect(list_filter({D.tokens('lower(a)')}, lambda w: length(w) > 1), list_filter({D.tokens('lower(b)')}, lambda w: length(w) > 1))))::INTEGER AS overlap FROM pairs",
        "normalize_titles": f"WITH t AS (SELECT doc_id, {_PREFIX} || substring(text, 1, 60) || {_SUFFIX} AS title FROM documents), n AS (SELECT doc_id, title, {normal} AS plain FROM t) SELECT doc_id, plain, {D.normalize_hard('plain', True)} AS hard, {D.comparison_key('title')} AS compared FROM n",
        "edition_strip": f"WITH t AS (SELECT p_partkey, {_EDITION} AS title FROM part), v AS (SELECT p_partkey, {D.strip_edition('title')} AS base, {every} AS every FROM t) SELECT p_partkey, base, array_to_string({distinct}, '|') AS variants FROM v",
        "featured_artists": f"WITH t AS (SELECT c_custkey, c_name || {_GUESTS} AS artist FROM customer) SELECT c_custkey, {D.primary('artist')} AS primary_artist, array_to_string({D.featured('artist')}, '|') AS guests FROM t",
        "code_validation": f"WITH t AS (SELECT o_orderkey, {_ID} AS id FROM orders) SELECT o_orderkey, coalesce(regexp_full_match(id, '[0-9A-Za-z]{{22}}'), false) AS source_id, coalesce({_NUMBER.format(d='NULL')} > 0, false) AS track_id, coalesce(regexp_full_match(id, '[0-9]*[1-9][0-9]*'), false) AS album_id, least(greatest({_NUMBER.format(d=20)}, 1), 100) AS page, greatest({_NUMBER.format(d=0)}, 0) AS skip, {D.code_key(chr(39) + 'us-rc ' + chr(39) + ' || id')} AS code FROM t",
        "duration_gate": f"SELECT p_partkey, p_size::BIGINT * 15000 AS duration_ms, {D.duration_tolerance('p_size::BIGINT * 15000')} AS tolerance, {D.is_compilation('CASE WHEN p_partkey % 3 = 0 THEN ' + chr(39) + 'Greatest Hits of ' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END || p_name')} AS compilation FROM part",
        "progress_percent": f"WITH t AS (SELECT event_id, event_id % 5 AS n, event_id % 3 + 1 AS i, event_id % 21 AS done, (event_id % 4) * 7 AS total, event_id % 50 AS o, (event_id % 3) * 25 AS items FROM events), p AS (SELECT *, {percent} AS p FROM t) SELECT event_id, {D.half_up('p', 6)} AS percent, {D.half_up('coalesce(CASE WHEN items > 0 THEN o::DOUBLE / items * 100 END, p)', 6)} AS chunk_percent FROM p",
    }


ORACLES = _oracles()
