"""Memory of the Python workers, which Spark uses again for task after task."""

from __future__ import annotations

import ctypes

import pyarrow as pa

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns to the system what this process has freed and its allocators still hold."""
    pa.default_memory_pool().release_unused()
    if _trim:  # glibc alone has it
        _trim(0)
