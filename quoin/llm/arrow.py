"""Arrow batches in Python workers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

SPACE = re.compile(rb"[ \t-\r]")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few texts at once become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """data in pieces of about `size` bytes, cut at white space, so that a very long text is never held as a list of words."""
    at = 0
    while len(data) - at > size:
        end = SPACE.search(data, at + size)
        if not end:
            break
        yield data[at : end.end()]
        at = end.end()
    yield data[at:]
