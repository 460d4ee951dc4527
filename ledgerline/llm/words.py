"""Word spans and hashes of Arrow text batches, computed over whole byte buffers in numpy.

A word is a maximal run of ASCII letters, digits and bytes above 0x7F; case is folded for ASCII and
for the Latin-1 letters of UTF-8. Null texts have no words. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.default_rng(20240117)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)

IS_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_lo:_hi] = True
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; another salt gives another hash."""
    h = h + _U((salt * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, max_bytes: int = 1 << 20, max_docs: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about max_bytes; a longer document is a range of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), first + max_docs, n)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of the documents first .. last of a batch; starts and ends are bytes from the first one's start."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc_bounds: np.ndarray  # word ranges: document k has words doc_bounds[k] .. doc_bounds[k + 1]

    @property
    def doc_index(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_bounds) - 1), np.diff(self.doc_bounds))


def fold_case(raw: np.ndarray) -> np.ndarray:
    low = FOLD[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    if len(lead):
        b = low[lead]
        low[lead] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 0x20, b)
    return low


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run never crosses a document's bounds."""
    before = np.empty(len(member), bool)
    before[:1] = False
    before[1:] = member[:-1]
    after = np.empty(len(member), bool)
    after[-1:] = False
    after[:-1] = member[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]
    before[inner] = False
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    after[ends] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the spans from one running sum, then mixed."""
    up, down = _power_tables(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(raw: np.ndarray, offsets: np.ndarray, first: int, last: int, fold: bool = True) -> Words:
    at = offsets[first : last + 1] - offsets[first]
    part = raw[offsets[first] : offsets[last]]
    if fold:
        part = fold_case(part)
    starts, ends = runs(IS_WORD[part], at)
    return Words(starts, ends, span_hashes(part, starts, ends), np.searchsorted(starts, at))
