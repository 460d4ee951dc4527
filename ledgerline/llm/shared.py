"""Small tables in the shared folder, written by one job and read whole by the Python workers of a later one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs


def batches(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of the Parquet files under a URI, few at a time."""
    system, at = pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    yield from pa.dataset.dataset(at, filesystem=system, format="parquet").to_batches(columns=columns, batch_size=4, batch_readahead=1, fragment_readahead=1)
