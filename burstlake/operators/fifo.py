"""A cache of bounded entries and bytes per key, replayed over rows in order.

A put of more than the bytes allowed is refused and leaves all as it was.  Any other put first drops an entry of the same name, then the
oldest entries until it fits, and becomes the youngest.  The rows of a key stream through one pass that holds the cache only, so memory is
bounded by ``max_entries``, whatever the number of rows; the puts of one key are one sequence in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fifo_cache(rows: DataFrame, key: str, order: Sequence[str], entry: str, size: str, max_entries: int, max_bytes: int) -> DataFrame:
    """rows with stored, evicted (names, oldest first), entries and bytes (after the put) added; null sizes count as 0."""
    ordered = rows.repartition(key).sortWithinPartitions(key, *order)
    names = T.ArrayType(rows.schema[entry].dataType)
    out = T.StructType([*rows.schema.fields]).add("stored", "boolean").add("evicted", names).add("entries", "integer").add("bytes", "long")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cache, used = object(), {}, 0
        for batch in batches:
            stored, evicted, entries, total = [], [], [], []
            for k, name, n in zip(*(batch.column(c).to_pylist() for c in (key, entry, size)), strict=True):
                if k != current:
                    current, cache, used = k, {}, 0
                n, gone = n or 0, []
                if n <= max_bytes:
                    used -= cache.pop(name, 0)
                    while cache and (len(cache) >= max_entries or used + n > max_bytes):
                        oldest = next(iter(cache))
                        used -= cache.pop(oldest)
                        gone.append(oldest)
                    cache[name] = n
                    used += n
                stored.append(n <= max_bytes)
                evicted.append(gone)
                entries.append(len(cache))
                total.append(used)
            columns = [pa.array(stored), pa.array(evicted, pa.list_(batch.schema.field(entry).type)), pa.array(entries, pa.int32()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=out.names)

    return ordered.mapInArrow(replay, out)
