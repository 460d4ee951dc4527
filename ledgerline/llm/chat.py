"""Chat formatting by columnar byte assembly.

A conversation is the concatenation, by turn, of
<|im_start|>ROLE<line feed>CONTENT<|im_end|><line feed>
For a batch of turns, the lengths of all segments give their offsets in the result; one gather with
indices computed in numpy copies headers and contents into a buffer of the final size, which is the
value buffer of the resulting Arrow column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import text_buffer

MARK, BROKEN_MARK = "<|im_", "< |im_"
_PIECES = [b"<|im_start|>", b"\n", b"<|im_end|>\n"]
_FIXED = np.frombuffer(b"".join(_PIECES), np.uint8)
_FIXED_AT = np.cumsum([0, *map(len, _PIECES)])
#: Bytes assembled at once; index arrays take eight bytes for each of them.
_BLOCK = 1 << 23
#: Bytes of the conversations of one batch of results; a longer conversation is a batch of its own.
_EMITTED = 1 << 28


def assemble(roles: pa.Array, contents: pa.Array, bounds: np.ndarray) -> pa.Array:
    """One string for each range bounds[k] .. bounds[k + 1] of turns."""
    role, role_at = text_buffer(roles)
    text, text_at = text_buffer(contents)
    n = len(role_at) - 1
    source = np.concatenate([_FIXED, role, text])
    lengths, begins = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, piece in ((0, 0), (2, 1), (4, 2)):
        lengths[:, k], begins[:, k] = len(_PIECES[piece]), _FIXED_AT[piece]
    lengths[:, 1], begins[:, 1] = np.diff(role_at), len(_FIXED) + role_at[:-1]
    lengths[:, 3], begins[:, 3] = np.diff(text_at), len(_FIXED) + len(role) + text_at[:-1]
    ends = np.cumsum(lengths.ravel())
    out = np.empty(ends[-1] if n else 0, np.uint8)
    turn_ends = np.concatenate([[0], ends[4::5]])
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(turn_ends, turn_ends[first] + _BLOCK, side="right")) - 1)
        own = slice(5 * first, 5 * last)
        size = lengths.ravel()[own]
        shift = begins.ravel()[own] - (ends[own] - size)
        span = slice(turn_ends[first], turn_ends[last])
        out[span] = source[np.repeat(shift, size) + np.arange(span.start, span.stop)]
        first = last
    offsets = turn_ends[bounds]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns come in order; those of the last conversation of a batch wait for the next one."""
    waiting: list[pa.RecordBatch] = []

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        wide = pa.schema([("conv_id", pa.int64()), ("role", pa.large_string()), ("text", pa.large_string())])
        rows = rows.cast(wide).combine_chunks()  # all turns together may be longer than a string column holds
        ids = rows.column(0).to_numpy()
        bounds = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
        size = sum(np.diff(text_buffer(rows.column(k))[1]) for k in (1, 2)) + _FIXED_AT[-1]
        ends = np.concatenate([[0], np.cumsum(size)])[bounds]
        first = 0
        while first < len(bounds) - 1:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + _EMITTED, side="right")) - 1)
            part = rows.slice(bounds[first], bounds[last] - bounds[first])
            text = assemble(part.column(1), part.column(2), bounds[first : last + 1] - bounds[first])
            yield pa.RecordBatch.from_arrays([pa.array(ids[bounds[first:last]]), pa.array(np.diff(bounds[first : last + 1]), pa.int64()), text.cast(pa.string())], ["conv_id", "n_turns", "text"])
            first = last

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        if waiting and waiting[-1].column(0)[0].as_py() != ids[0]:
            yield from emit(pa.Table.from_batches(waiting))
            waiting = []
        other = np.flatnonzero(ids != ids[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from emit(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield from emit(pa.Table.from_batches(waiting))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, text), a row for each non-null conversation id.

    Turns are ordered by turn, nulls first; ties by role, then by content; rows that repeat are all kept.
    A null role is "unknown", a null content is empty. The sign "<|im_" in a role or content is broken to
    "< |im_", so that no text can end or open a turn. Turns with a null conversation id belong to none
    and are left out. An empty table gives no rows; other columns are ignored, whatever their names. Very
    long turns are copied whole; a conversation of over 2 GiB, which no row can hold, fails the job.
    """

    def safe(c, default: str):
        return F.replace(F.coalesce(c.cast("string"), F.lit(default)), F.lit(MARK), F.lit(BROKEN_MARK))

    rows = turns.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), safe(F.col(role_col), "unknown").alias("role"), safe(F.col(text_col), "").alias("text")).where("conv_id IS NOT NULL")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format, "conv_id bigint, n_turns bigint, text string")


ORACLE = """
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|im_', '< |im_') || chr(10)
                  || replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10), ''
                  ORDER BY turn NULLS FIRST, replace(coalesce(role, 'unknown'), '<|im_', '< |im_'), replace(coalesce(text, ''), '<|im_', '< |im_')) AS text
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
"""
