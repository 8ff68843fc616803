"""Substring dedup by sliding sentence spans: runs of consecutive sentences that an earlier document or place has.

A sentence ends after an end mark with white space behind it, and after a line break; it takes that white space
with it, so every character belongs to exactly one sentence and what is kept is a plain concatenation.  From each
sentence on, and back from each, the run of the fewest sentences, ``span`` at least, with ``min_words`` words is
named by a 128-bit hash of its words; together these cover every longer run that repeats.  The first place (by
doc_id, then place) of a run stays, and every sentence covered by any later place of it is removed.

Each task settles what repeats among its own rows and passes on one place of each run, so a run that a third of
all documents hold meets in one task at most once per task.

Defined results: null texts have no sentences and stay null, empty texts stay empty; rows of one doc_id are told
apart and ordered by their text, and full repetitions of a row are treated like that row; rows without an id come
last; a text short of ``min_words`` or ``span`` has no run; columns of the input may have any name, those that
clash with the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, materialise, own_columns, split_words

SPAN, MIN_WORDS, CHUNK = 2, 10, 1_000_000
#: What ends a sentence.
END = r"[.!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*"
_END = re.compile(END)
LAST = (1 << 63) - 1


def sentences(text: str) -> list[str]:
    """Pieces that together are the text."""
    cuts = [m.end() for m in _END.finditer(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < b]


def runs(pieces: list[str], span: int, min_words: int) -> list[tuple[int, int, int]]:
    """(first sentence, number of sentences, 128-bit name) of the shortest runs that start and that end at each sentence."""
    words = [split_words(p) for p in pieces]
    counts = [len(w) for w in words]
    joined = [" ".join(w) for w in words]
    found, end, total = set(), 0, 0
    for i in range(len(pieces)):
        while end < len(pieces) and (end - i < span or total < min_words):
            total += counts[end]
            end += 1
        if end - i < span or total < min_words:
            break
        if counts[i]:
            found.add((i, end))
        total -= counts[i]
    start, total = len(pieces), 0
    for end in range(len(pieces), 0, -1):
        while start > 0 and (end - start < span or total < min_words or not counts[start]):
            start -= 1
            total += counts[start]
        if end - start < span or total < min_words or not counts[start]:
            break
        found.add((start, end))
        total -= counts[end - 1]
    return [(i, end - i, xxhash.xxh3_128_intdigest(" ".join(joined[i:end]))) for i, end in sorted(found)]


def tag_of(text: Column) -> Column:
    """31 bits of the text's hash, to tell rows of one id apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 33)


def settled(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): rows sorted by key, doc and place; later marks all that are not the first place of their key."""
    order = np.lexsort((place, doc, k2, k1))
    a, b, d, p = k1[order], k2[order], doc[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    return order, (d != d[first]) | (p != p[first])


def repeated_runs(df: DataFrame, text: str, row_id: str, span: int, min_words: int) -> DataFrame:
    """(doc, tag, first, n): the later places of all runs; doc is the id, the last of all for null."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            names, docs, places, sizes = (list(x) for x in zip(*held, strict=True))
            raw = np.frombuffer(b"".join(n.to_bytes(16, "little") for n in names), "<i8").reshape(-1, 2)
            k1, k2, doc, place, n = raw[:, 0], raw[:, 1], np.array(docs), np.array(places), np.array(sizes, np.int32)
            order, later = settled(k1, k2, doc, place)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(x[order]) for x in (k1, k2, doc, place, n)] + [pa.array(later)], names=["k1", "k2", "doc", "place", "n", "later"]
            )

        for batch in batches:
            for doc, tag, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held += [(name, doc, tag << 32 | i, n) for i, n, name in runs(sentences(body), span, min_words)]
                if len(held) >= CHUNK:
                    yield flush()
        if held:
            yield flush()

    rows = df.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(row_id).cast("long"), F.lit(LAST)).alias("doc"), tag_of(F.col(text)).alias("tag"), F.col(text).alias("text")
    )
    found, _ = materialise(rows.mapInArrow(named, "k1 long, k2 long, doc long, place long, n int, later boolean"), "sentence-runs")
    here = F.struct("doc", "place")
    first = F.first(here).over(W.partitionBy("k1", "k2").orderBy("doc", "place"))
    across = found.where("NOT later").withColumn("_first", first).where(here != F.col("_first")).select("doc", "place", "n")
    return across.unionAll(found.where("later").select("doc", "place", "n"))


def span_dedup(df: DataFrame, text: str = "text", row_id: str = "doc_id", span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """df with ``text`` cut and ``n_sentences, n_removed, removed_chars`` added."""
    later = repeated_runs(df, text, row_id, span, min_words)
    marks = later.groupBy(F.col("doc").alias("d"), F.shiftright("place", 32).alias("t")).agg(
        F.collect_set(F.struct(F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("first"), "n")).alias("marks")
    )
    names = ("n_sentences", "n_removed", "removed_chars")
    own = own_columns(df, *names)
    rest = [c for c in own if c.lower() != text.lower()]
    keyed = boxed(df, rest, doc=F.coalesce(F.col(row_id).cast("long"), F.lit(LAST)), tag=tag_of(F.col(text)), body=F.col(text))
    joined = keyed.join(marks, (F.col("doc") == F.col("d")) & (F.col("tag") == F.col("t")), "left").select("row", "body", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, counts, gone, lost = [], [], [], []
            for body, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pieces = sentences(body or "")
                drop = {i for m in marks or () for i in range(m["first"], m["first"] + m["n"])}
                kept = body if not drop else "".join(p for i, p in enumerate(pieces) if i not in drop)
                bodies.append(kept)
                counts.append(len(pieces))
                gone.append(len(drop))
                lost.append(len(body or "") - len(kept or ""))
            cols = [batch.column(0), pa.array(bodies, pa.string()), *(pa.array(x, pa.int64()) for x in (counts, gone, lost))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "body", *names])

    schema = T.StructType([joined.schema["row"], T.StructField("body", T.StringType()), *(T.StructField(n, T.LongType()) for n in names)])
    done = joined.mapInArrow(cut, schema)
    return done.select(*[F.col("row").getField(c).alias(c) if c in rest else F.col("body").alias(c) for c in own], *names)
