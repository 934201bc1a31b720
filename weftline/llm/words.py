"""Words and worker-local caches used by several operators."""

from __future__ import annotations

import sys
import types

#: Maps A-Z to a-z and all other ASCII but digits and a-z to a space, so that
#: ``text.translate(WORD_BYTES).split()`` are the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased UTF-8 text.
WORD_BYTES = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, which serves many tasks."""
    name = "_weftline_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def utf8(column) -> list:
    """An Arrow string column as a list of bytes or None."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def slices(batches, rows: int = 512):
    """Arrow batches cut small, so that what is made from one at a time stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
