"""Token counts by section: a document is encoded once, and its tokens are given to sections by their spans.

Sections are the lines of a text, each with the line feed that ends it; they tile the text, so that the
sections' counts add up to the document's. Byte-level tokens concatenate to the text's bytes, so running
sums of their sizes are their spans; the interval join of token spans to sections is a binary search in
the sections' starts. A token that crosses a boundary goes to one section by an explicit rule:

start     the section of the token's first byte
end       the section of its last byte
majority  the section with most of its bytes, the first among equals
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.tokenizer import DEFAULT_PATH, encoding, token_bytes
from ledgerline.llm.words import blocks, text_buffer

RULES = ("start", "end", "majority")
_NAMES = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"]
_SCHEMA = "doc_id bigint, section int, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint"


def owners(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token span the section it is given to, and whether it crosses a boundary; bounds are section starts."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = first != last
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    out = first.copy()
    which = np.flatnonzero(crossing)
    if len(which):
        n = (last - first)[which] + 1  # sections that each of these tokens lies in, one after another
        begin = np.cumsum(n) - n
        token = np.repeat(which, n)
        section = np.repeat(first[which], n) + np.arange(n.sum()) - np.repeat(begin, n)
        stop = np.append(bounds[1:], np.iinfo(np.int64).max)
        shared = np.minimum(ends[token], stop[section]) - np.maximum(starts[token], bounds[section])
        most = np.flatnonzero(shared == np.repeat(np.maximum.reduceat(shared, begin), n))
        _, earliest = np.unique(token[most], return_index=True)
        out[which] = section[most[earliest]]
    return out, crossing


def section_counts(texts: list[str], rule: str, path: str) -> tuple[np.ndarray, ...]:
    """(row, section, char_start, char_end, n_tokens, n_crossing) of all sections of all texts."""
    enc, sizes = encoding(path), token_bytes(path)
    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    ids = [enc.encode_ordinary(t) for t in texts]
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.empty(n.sum(), np.int64)
    at = 0
    for x in ids:
        flat[at : at + len(x)] = x
        at += len(x)
    ends = np.cumsum(sizes[flat])
    starts = ends - sizes[flat]
    full = np.flatnonzero(np.diff(offsets))
    breaks = np.flatnonzero(raw == 10) + 1
    bounds = np.union1d(offsets[:-1][full], breaks[breaks < len(raw)])
    given, crossing = owners(starts, ends, bounds, rule)
    row = np.searchsorted(offsets, bounds, side="right") - 1
    head = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before each byte
    first = np.searchsorted(bounds, offsets[row], side="left")
    stop = np.append(bounds[1:], len(raw))
    return row, np.arange(len(bounds)) - first, head[bounds] - head[offsets[row]], head[stop] - head[offsets[row]], np.bincount(given, minlength=len(bounds)), np.bincount(given[crossing], minlength=len(bounds))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", tokenizer_path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, n_crossing), a row for each line of each text.

    char_start .. char_end is the line with its line feed, in characters; n_crossing of its n_tokens
    tokens reach into another line. A null or empty text gives one row with section 0 and zeros. Rows
    that repeat, and rows with a null id, are counted each. An empty table gives no rows; other columns
    are ignored, whatever their names. Texts of any length are encoded whole.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            empty = np.flatnonzero(np.diff(offsets) == 0)
            if len(empty):
                zero = np.zeros(len(empty), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(empty)), pa.array(zero, pa.int32()), *(pa.array(zero) for _ in range(4))], _NAMES)
            for first, last in blocks(offsets, 1 << 22):
                texts = batch.column(1).slice(first, last - first).fill_null("").to_pylist()
                row, section, *rest = section_counts(texts, rule, tokenizer_path)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row)), pa.array(section, pa.int32()), *(pa.array(x, pa.int64()) for x in rest)], _NAMES)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)
