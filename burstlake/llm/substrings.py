"""Suffix-array dedup by distributed prefix doubling, over the bytes of all texts.

The rank of a position at length h is a 64-bit name of the h bytes that start there.  Names double inside a
text (1, 2, 4, 8, 16, 32 bytes): the name at 2h is made of the pair (name at p, name at p + h), so equal prefixes
have equal names everywhere and ranks need no lookup across tasks.  Spark sorts at growing lengths:

1. Length 16.  Every 50-byte string holds 35 positions of full length 16; its *anchor* is the first of those with the
   smallest name.  Neighbouring strings mostly share their anchor, so one row stands for a run of positions: the
   pair (name at the anchor, name of the whole run's bytes).  Sorted by that pair, equal runs meet and all but
   those of the smallest document are settled as repeats; a run whose anchor name is unique is dropped.
2. Length 50.  Runs that share only their anchor are sorted by its name and document with their bytes, and each of
   their 50-byte strings is settled by the smallest document.  The runs of an anchor that more than ``GROUP`` runs
   share are instead laid out position by position as pairs (name32 at p, name32 at p + 18), so that no anchor has
   to fit in one task; the pairs are sorted and settled like those of the first round.

An anchor that very many runs share (found in a sample of documents, which decides nothing but this) is dealt by the
whole pair in the first sort, so that its runs spread over tasks; they all go on to the second.

Strings are the same if their 128-bit names are, in every round; where bytes are at hand they are compared.  Each task settles repeats among its own rows first and
passes on only those of its smallest document, so a passage held by a third of all documents reaches a task
about once per task.  Covered runs are removed from the texts in one last pass.

Defined results: null counts as empty; texts of less than ``length`` bytes have no strings and stay whole; copies
of a text keep only the one of smallest id; rows of one id never cover each other (no id is smaller); null ids
come after all others; a text of 2^30 bytes or more is an error; columns of the input may have any name, those that
clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, drop_scratch, materialise, own_columns, parts_for, unboxed

LENGTH, ANCHOR, CHUNK_BYTES, CHUNK_ROWS, GROUP = 50, 16, 1 << 18, 1_500_000, 20_000
SAMPLE, HOT_ROWS = 128, 50
LAST = (1 << 63) - 1
TAG_BITS, START_BITS, RUN_BITS = 27, 30, 6
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
BYTE_NAMES = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)


def pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit name for each pair of names."""
    h = a * A
    h ^= h >> np.uint64(29)
    h += b
    h *= B
    h ^= h >> np.uint64(32)
    h *= C
    h ^= h >> np.uint64(31)
    return h


def doubled(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Names of the h-byte strings at each place, for h = 1, 2, 4, ... upto; h's array is h - 1 shorter than data."""
    names = {1: BYTE_NAMES[data]}
    h = 1
    while 2 * h <= upto:
        n = names[h]
        names[2 * h] = pair_names(n[:-h], n[h:]) if len(n) > h else n[:0]
        h *= 2
    return names


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, where the first smallest one is."""
    v, i, w = values, np.arange(len(values), dtype=np.int32), 1

    def joined(v: np.ndarray, i: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        right = v[by:] < v[:-by]
        return np.where(right, v[by:], v[:-by]), np.where(right, i[by:], i[:-by])

    while 2 * w <= width:
        v, i = joined(v, i, w)
        w *= 2
    return joined(v, i, width - w)[1] if width > w else i


def runs_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, positions, anchor name, run name) of runs of strings with one anchor, in texts laid end to end."""
    names = doubled(data, 32)
    n16, n32 = names[ANCHOR], names[32]
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    at = first_smallest(n16, length - ANCHOR + 1)
    places = np.arange(len(at))
    text = np.searchsorted(ends, places, "right")
    whole = places + length <= ends[text]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~whole[:-1] | (text[1:] != text[:-1])
    new &= whole
    start = np.flatnonzero(new)
    stop = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True)) + 1
    n = stop - start
    size = n + length - 1
    name = pair_names(pair_names(n32[start], n32[start + (size - 32) // 2]), n32[start + size - 32])
    name = pair_names(name, (size * 64 + at[start] - start).astype(np.uint64))
    return start, n, n16[at[start]], name


def tag_of(text: Column) -> Column:
    """Some bits of the text's hash, to tell rows of one id apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - TAG_BITS)


def _placed(tag: np.ndarray | int, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return (tag << (START_BITS + RUN_BITS)) | (start << RUN_BITS) | (n - 1)


def _settled(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows (k1, k2, doc, place) sorted, and which of them a smaller document of the same key covers."""
    k1, k2, doc, place = rows
    order = np.lexsort((doc, k2, k1))
    k1, k2, doc, place = (x[order] for x in (k1, k2, doc, place))
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    return [k1, k2, doc, place], doc > doc[first]


ROWS = "k1 long, k2 long, doc long, place long, kind byte"
OPEN, COVERED, SHARED, HOT = 0, 1, 2, 3


def _batch(rows: list[np.ndarray], kind: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in rows]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(kind.astype(np.int8))], names=["k1", "k2", "doc", "place", "kind"])


class _Gather:
    """Collects rows and gives them back settled, a bounded number at a time."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, *rows: np.ndarray) -> None:
        self.parts.append(rows)
        self.n += len(rows[0])

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.n and self.n >= least:
            rows, covered = _settled([np.concatenate(x) for x in zip(*self.parts, strict=True)])
            self.parts, self.n = [], 0
            doc, place = _merged(rows[2][covered], rows[3][covered])
            # Settled rows only need to be spread evenly.
            yield from _batches([pair_names(doc.view(np.uint64), place.view(np.uint64)), np.zeros_like(place), doc, place], COVERED)
            yield from _batches([x[~covered] for x in rows], OPEN)


def _merged(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of positions with neighbours of one text joined, as long as a packed run can be."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    size = (place & ((1 << RUN_BITS) - 1)) + 1
    start = place >> RUN_BITS  # with the tag above it
    apart = np.ones(len(doc), bool)
    apart[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + size[:-1])
    begin = np.flatnonzero(apart)
    total = np.add.reduceat(size, begin) if len(begin) else size
    pieces = -(-total // (1 << RUN_BITS))
    which = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    offset = nth << RUN_BITS
    length = np.minimum(1 << RUN_BITS, total[which] - offset)
    return doc[begin][which], ((start[begin][which] + offset) << RUN_BITS) | (length - 1)


def _batches(rows: list[np.ndarray], kind: int, most: int = 250_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows[0]), most):
        part = [x[i : i + most] for x in rows]
        yield _batch(part, np.full(len(part[0]), kind))


def _anchored(length: int, hot: list[int]):
    """Runs of all texts; those of a hot anchor (a sorted list) are marked."""
    hot_names = np.array(hot, np.int64)

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = batch.column(4).to_numpy(zero_copy_only=False)
        k1 = batch.column(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(hot_names, k1), len(hot_names) - 1)
        kind = np.where((kind == OPEN) & (hot_names[at] == k1), HOT, kind).astype(np.int8)
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kind)], names=batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gather()

        def take(texts: list[bytes], docs: list[int], tags: list[int], offsets: list[int]) -> None:
            data = np.frombuffer(b"".join(texts), np.uint8)
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            start, n, anchor, name = runs_of(data, ends, length)
            text = np.searchsorted(ends, start, "right")
            out.add(anchor, name, np.array(docs)[text], _placed(np.array(tags)[text], start - (ends - sizes - offsets)[text], n))

        held: tuple[list, ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            for doc, tag, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = body.as_py()
                if len(body) >= 1 << START_BITS:
                    raise ValueError("a text has 2^30 bytes or more")
                # A long text goes piece by piece; pieces overlap, so that each string is in one of them.
                for at in range(0, len(body) - length + 1, CHUNK_BYTES):
                    for column, x in zip(held, (body[at : at + CHUNK_BYTES + length - 1], doc, tag, at), strict=True):
                        column.append(x)
                    size += len(held[0][-1])
                    if size >= CHUNK_BYTES:
                        take(*held)
                        held, size = ([], [], [], []), 0
                        yield from out.flush(CHUNK_ROWS)
        if held[0]:
            take(*held)
        yield from out.flush(1)

    return (lambda batches: map(marked, run(batches))) if hot else run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (k1, k2, doc): COVERED rows as they are met or found, and as SHARED the first document's rows of each pair whose k1
    other pairs of other documents share, or that is marked HOT.  Holds at most one document's rows of one k1."""
    last_pair, least, known = None, 0, None
    held = [np.zeros(0, np.int64)] * 5
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        done = rows[4] == COVERED
        if done.any():
            yield from _batches([x[done] for x in rows[:4]], COVERED)
            rows = [x[~done] for x in rows]
        k1, k2, doc, _, _ = rows
        if not len(k1):
            continue
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        new[0] = last_pair != (k1[0], k2[0])
        starts = np.flatnonzero(new)
        base = doc[starts]
        group = np.cumsum(new) - 1
        smallest = np.where(group >= 0, base[np.maximum(group, 0)] if len(base) else least, least)
        last_pair, least = (k1[-1], k2[-1]), smallest[-1]
        covered = doc > smallest
        if covered.any():
            gone, place = _merged(doc[covered], rows[3][covered])
            yield from _batches([gone, place, gone, place], COVERED)
        mine = [np.concatenate([h, x[~covered]]) for h, x in zip(held, rows, strict=True)]
        held = [x[:0] for x in mine]
        if not len(mine[0]):
            continue
        a, b, d, _, kind = mine
        edge = np.append(0, np.flatnonzero(a[1:] != a[:-1]) + 1)
        stop = np.append(edge[1:], len(a))
        shared = (b[edge] != b[stop - 1]) & (np.minimum.reduceat(d, edge) < np.maximum.reduceat(d, edge))
        shared |= (a[edge] == known) if known is not None else False
        shared |= kind[edge] == HOT
        known = a[-1] if shared[-1] else None
        each = np.repeat(shared, stop - edge)
        if each.any():
            yield _batch([x[each] for x in mine[:4]], np.full(each.sum(), SHARED))
        if not shared[-1]:
            held = [x[edge[-1] :] for x in mine]


WIDE = "k1 long, k2 long, doc long, place long, kind byte, context binary"


def _laid_out(length: int):
    """Of each text the bytes of its runs, or the positions of runs that are marked as crowded."""

    def wide(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary())], names=[*batch.schema.names, "context"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gather()
        for batch in batches:
            rows: list[tuple] = []
            for doc, tag, body, marks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                crowded = np.array([m["place"] for m in marks if m["crowded"]], np.int64)
                if len(crowded):  # only the bytes of its runs are named, laid end to end
                    start, n = _unpacked(crowded)
                    parts = [body[a : a + k + length - 1] for a, k in zip(start.tolist(), n.tolist(), strict=True)]
                    n32 = doubled(np.frombuffer(b"".join(parts), np.uint8), 32)[32]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    within = nth + np.repeat(np.cumsum(n + length - 1) - (n + length - 1), n)
                    out.add(n32[within], n32[within + length - 32], np.full(len(nth), doc), _placed(tag, nth + np.repeat(start, n), 1))
                    yield from map(wide, out.flush(CHUNK_ROWS))
                for m in marks:
                    if not m["crowded"]:
                        start, n = _unpacked(m["place"])
                        rows.append((m["k1"], 0, doc, m["place"], OPEN, body[start : start + n + length - 1]))
            if rows:
                types = (*[pa.int64()] * 4, pa.int8(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*_names(ROWS), "context"])
        yield from map(wide, out.flush(1))

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def _unpacked(place):
    """(start, positions) of packed runs."""
    return (place >> RUN_BITS) & ((1 << START_BITS) - 1), (place & ((1 << RUN_BITS) - 1)) + 1


def _met_again(length: int):
    """Over rows sorted by (k1, k2, doc): the covered runs of positions, from bytes where there are any, else from names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []

        def plain() -> Iterator[pa.RecordBatch]:
            anchor, first = None, {}  # of one anchor: the smallest document of each string
            for batch in batches:
                whole = batch.column(5).is_valid()
                part = batch.filter(whole)
                docs, places = [], []
                for k1, doc, place, context in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 5)), strict=True):
                    if k1 != anchor:
                        anchor, first = k1, {}
                    for p in range(len(context) - length + 1):
                        if first.setdefault(context[p : p + length], doc) < doc:
                            docs.append(doc)
                            places.append((((place >> RUN_BITS) + p) << RUN_BITS))
                if docs:
                    doc, place = _merged(np.array(docs, np.int64), np.array(places, np.int64))
                    ready.extend(_batches([doc, place, doc, place], COVERED))
                names = batch.filter(pc.invert(whole))
                if names.num_rows:
                    yield pa.RecordBatch.from_arrays(names.columns[:5], names=_names(ROWS))

        for done in _met(plain()):
            yield done
            yield from ready
            ready.clear()
        yield from ready

    return run


def _keys(text: Column, row_id: Column) -> dict[str, Column]:
    return {"key": F.coalesce(row_id.cast("long"), F.lit(LAST)), "tag": tag_of(text).cast("long"), "bytes": text.cast("binary")}


def _by_text(rows: DataFrame, what: Column | str = "place") -> DataFrame:
    tag = F.shiftrightunsigned("place", START_BITS + RUN_BITS)
    # A set: rows of one id and text mark the same places, and each of them is joined to all.
    return rows.groupBy(F.col("doc").alias("d"), tag.alias("t")).agg(F.collect_set(what).alias("places"))


def covered_runs(df: DataFrame, text: str = "text", row_id: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(doc, place): all runs of positions whose ``length``-byte strings also start in a document with a smaller id."""
    if not 32 <= length <= 64:
        raise ValueError("length must be 32 to 64 bytes")
    spark = df.sparkSession
    texts = df.where(F.octet_length(text) >= length).select(*[v.alias(k) for k, v in _keys(F.col(text), F.col(row_id)).items()])
    parts = parts_for(spark, 4 * df.count())
    # Each hot anchor has its share of the sample, so the driver gets at most 8 x parts of them.
    seen, seen_at = materialise(texts.where(F.pmod(F.xxhash64("key", "tag"), F.lit(SAMPLE)) == 0).mapInArrow(_anchored(length, []), ROWS).select("k1"), "anchor-sample")
    least = max(HOT_ROWS, seen.count() // (8 * parts))
    hot = sorted(r["k1"] for r in seen.groupBy("k1").count().where(F.col("count") > least).select("k1").collect())
    drop_scratch(spark, seen_at)
    order = ("k1", "k2", "doc")
    rows = texts.mapInArrow(_anchored(length, hot), ROWS).repartition(parts, "k1", F.when(F.col("kind") == HOT, F.col("k2")))
    met = rows.sortWithinPartitions(*order).mapInArrow(_met, ROWS)
    met, _ = materialise(met.select("k1", "doc", "place", "kind"), "runs-met")
    shared = met.where(F.col("kind") == SHARED)
    crowds = shared.groupBy(F.col("k1").alias("crowd")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("crowd")
    marked = shared.join(crowds, F.col("k1") == F.col("crowd"), "left").select("doc", "place", "k1", F.col("crowd").isNotNull().alias("crowded"))
    marked = _by_text(marked, F.struct("place", "k1", "crowded"))
    wide = texts.join(marked, (F.col("key") == F.col("d")) & (F.col("tag") == F.col("t"))).select("key", "tag", "bytes", "places")
    final = wide.mapInArrow(_laid_out(length), WIDE).repartition(parts, "k1").sortWithinPartitions(*order).mapInArrow(_met_again(length), ROWS)
    final, _ = materialise(final.where(F.col("kind") == COVERED).select("doc", "place"), "places-met")
    return met.where(F.col("kind") == COVERED).select("doc", "place").unionAll(final)


def spans(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered byte spans from packed runs."""
    start, n = _unpacked(places)
    n = n + length - 1
    order = np.argsort(start)
    out: list[list[int]] = []
    for a, b in zip(start[order].tolist(), (start + n)[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def suffix_dedup(df: DataFrame, text: str = "text", row_id: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """df with kept_bytes (what is left of the text) and removed (array of byte spans) added."""
    marks = _by_text(covered_runs(df, text, row_id, length, group))
    own = own_columns(df, "kept_bytes", "removed")
    keyed = boxed(df, df.columns, **_keys(F.col(text), F.col(row_id))).drop("bytes")  # the text travels once, in its row
    joined = keyed.join(marks, (F.col("key") == F.col("d")) & (F.col("tag") == F.col("t")), "left")
    joined = joined.select(F.struct(*unboxed(own)).alias("row"), F.col("row").getField(text).cast("binary").alias("bytes"), "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_t = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            kept, gone = [], []
            for body, places in zip(batch.column(1), batch.column(2), strict=True):
                body = body.as_py() or b""
                found = spans(places.values.to_numpy(zero_copy_only=False), length) if places.is_valid else []
                at, left = 0, []
                for a, b in found:
                    left.append(body[at:a])
                    at = b
                kept.append(b"".join([*left, body[at:]]) if found else body)
                gone.append([{"start": a, "stop": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(gone, span_t)], names=["row", "kept_bytes", "removed"])

    span = T.StructType().add("start", "long").add("stop", "long")
    schema = T.StructType([joined.schema["row"]]).add("kept_bytes", "binary").add("removed", T.ArrayType(span))
    return joined.mapInArrow(cut, schema).select(*unboxed(own), "kept_bytes", "removed")
