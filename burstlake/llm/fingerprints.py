"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs that together are the text: lines with their line break, and long lines after each
sentence end and the blanks behind it.  The n-th repetition of a paragraph has a digest of its own.  Each digest is
added to three cells of a sketch (number, xor of digests, xor of checks).  A sketch has 12 * 2^k cells: it is made
larger until it can be peeled by itself, so a fingerprint always gives back all digests of its text.

The cell of a digest is its hash modulo a third of the cells, so folding the two halves of each third of a sketch
gives the sketch of half the size.  Two fingerprints are compared from their strings alone: both are folded to a small
common size and subtracted, what they share cancels, and peeling recovers the paragraphs that differ.  If
peeling gets stuck the sizes grow to the larger of both (a smaller fingerprint is peeled by itself and sketched anew);
what even those cannot tell apart is told by peeling each by itself.

Defined results: null counts as empty; two empty texts are alike (1.0), an empty and any other text are not (0.0);
rows of one doc_id are ordered by their text; rows without an id come last in descending order; one document is its own
successor; input columns of any other name are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_at_or_below, count_below, cut_points, parts_for

CELLS, GROWTH, LONG_LINE = 12, 2, 240
SENTENCE_END = re.compile(r"(?<=[.!?])[ \t]+")
LEAST = -(1 << 63)
CELL = struct.Struct("<IQI")


def paragraphs(text: str) -> list[str]:
    """Pieces that together are the text."""
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    out = []
    for line in lines:
        if len(line) > LONG_LINE:
            cuts = [0, *(m.end() for m in SENTENCE_END.finditer(line)), len(line)]
            out += [line[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        elif line:
            out.append(line)
    return out


def digests(text: str) -> list[int]:
    """Distinct 64-bit digests of a text's paragraphs; repetitions are told apart by their number."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        n = seen[p] = seen.get(p, -1) + 1
        out.append(xxhash.xxh3_64_intdigest(f"{p}\0{n}" if n else p))
    return out if len(set(out)) == len(out) else list(dict.fromkeys(out))


def _check(d: int) -> int:
    return ((d ^ (d >> 29)) * 0x9E3779B97F4A7C15 >> 32) & 0xFFFFFFFF


class Sketch:
    """Cells of (count, xor of digests, xor of checks); three sub-tables, one cell of each per digest."""

    __slots__ = ("cells", "checks", "counts", "keys")

    def __init__(self, items: list[int], cells: int = CELLS) -> None:
        third = cells // 3
        counts, keys, checks = [0] * cells, [0] * cells, [0] * cells
        for d in items:
            c = _check(d)
            for i in (d % third, third + (d >> 21) % third, 2 * third + (d >> 42) % third):
                counts[i] += 1
                keys[i] ^= d
                checks[i] ^= c
        self.cells, self.counts, self.keys, self.checks = cells, counts, keys, checks

    @classmethod
    def of(cls, counts: list[int], keys: list[int], checks: list[int]) -> Sketch:
        out = cls.__new__(cls)
        out.cells, out.counts, out.keys, out.checks = len(counts), counts, keys, checks
        return out

    def folded(self, cells: int) -> Sketch:
        """The sketch of the same digests with so many cells, this number over a power of two."""
        counts, keys, checks = self.counts, self.keys, self.checks
        while len(counts) > cells:
            half = len(counts) // 6
            both = [(i, i + half) for t in range(0, len(counts), 2 * half) for i in range(t, t + half)]
            counts = [counts[i] + counts[j] for i, j in both]
            keys = [keys[i] ^ keys[j] for i, j in both]
            checks = [checks[i] ^ checks[j] for i, j in both]
        return Sketch.of(counts, keys, checks)

    def minus(self, other: Sketch) -> Sketch:
        return Sketch.of(
            [a - b for a, b in zip(self.counts, other.counts, strict=True)],
            [a ^ b for a, b in zip(self.keys, other.keys, strict=True)],
            [a ^ b for a, b in zip(self.checks, other.checks, strict=True)],
        )

    def size(self) -> int:
        """Number of digests; of a difference, those on the left less those on the right."""
        return sum(self.counts) // 3

    def peel(self) -> tuple[list[int], list[int]] | None:
        """(digests only in the left text, only in the right one), or None if cells remain."""
        third, left, right = self.cells // 3, [], []
        counts, keys, checks = self.counts[:], self.keys[:], self.checks[:]
        todo = [i for i, n in enumerate(counts) if n in (1, -1)]
        while todo:
            i = todo.pop()
            n, d = counts[i], keys[i]
            if n not in (1, -1) or checks[i] != (c := _check(d)):
                continue
            at = (d % third, third + (d >> 21) % third, 2 * third + (d >> 42) % third)
            if i not in at:  # several digests that look like one
                continue
            (left if n == 1 else right).append(d)
            if len(left) + len(right) > self.cells:  # more than any sketch of this size can give back
                return None
            for j in at:
                counts[j] -= n
                keys[j] ^= d
                checks[j] ^= c
                if counts[j] in (1, -1):
                    todo.append(j)
        return None if any(counts) or any(keys) or any(checks) else (left, right)

    def text(self) -> str:
        """The sketch as text: count, digest and check of each cell."""
        return base64.b64encode(b"".join(map(CELL.pack, self.counts, self.keys, self.checks))).decode()

    @classmethod
    def read(cls, text: str) -> Sketch:
        cells = list(CELL.iter_unpack(base64.b64decode(text)))
        return cls.of(*([c[k] for c in cells] for k in range(3)))


def sketch(items: list[int]) -> Sketch:
    """The smallest sketch of a text's digests, of 12 * 2^k cells, that can be peeled by itself."""
    cells = CELLS
    while cells < len(items):
        cells *= GROWTH
    while (got := Sketch(items, cells)).peel() is None:
        cells *= GROWTH
    return got


def difference(a: Sketch, b: Sketch) -> tuple[int, int]:
    """How many digests only a has, and only b, by subtracting and peeling at growing sizes."""
    small, large = sorted((a.cells, b.cells))
    least = abs(a.size() - b.size())
    cells = CELLS
    while cells < small and cells < least:
        cells *= GROWTH
    while cells < small:
        if (got := a.folded(cells).minus(b.folded(cells)).peel()) is not None:
            return len(got[0]), len(got[1])
        cells *= GROWTH * GROWTH
    if (got := a.folded(small).minus(b.folded(small)).peel()) is not None:
        return len(got[0]), len(got[1])
    x, y = (set(s.peel()[0]) for s in (a, b))
    if small < large and (got := Sketch(list(x), large).minus(Sketch(list(y), large)).peel()) is not None:
        return len(got[0]), len(got[1])
    return len(x - y), len(y - x)


def likeness(a: Sketch, b: Sketch) -> float:
    """Shared share of all distinct digests of both."""
    na, nb = a.size(), b.size()
    if not na or not nb:
        return float(na == nb)
    if a.cells == b.cells and a.keys == b.keys and a.counts == b.counts and a.checks == b.checks:
        return 1.0
    left, right = difference(a, b)
    shared = na - left
    return shared / (shared + left + right)


def likeness_of(fingerprint: str, other: str) -> float:
    """The likeness of two fingerprints as they are stored."""
    return likeness(Sketch.read(fingerprint), Sketch.read(other))


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
SPARK_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each is compared with the row after it, which closes every run as a look-ahead row."""
    held = None
    for batch in batches:
        out = []
        for part, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = text or ""
            now = sketch(digests(text))
            if held and held[0] == part:
                _, last_id, last, had = held
                edited = edit(last, text)
                new = sketch(digests(edited))
                sha = hashlib.sha256(edited.encode()).hexdigest()
                out.append((last_id, len(last), sha, had.text(), new.text(), likeness(had, new), likeness(had, now)))
            held = (part, doc_id, text, now)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def successive_fingerprints(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per document: its sketch, that of its edited text, and how near it is to that and to the next document.

    Documents go in runs of descending id to partitions of bounded size; the first document of each run is
    also the look-ahead row of the run before, so one exchange of the texts is enough.  Rows of one id are one run, and so
    are those without an id; a run is streamed and never held.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(row_id).cast("long"), F.lit(LEAST)).alias("_key"), F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = rows.select("_key").count()
    points = cut_points(rows, "_key", parts_for(spark, n)) if n else []
    top = rows.agg(F.max("_key")).first()[0] if n else None
    if n and points[-1] != top:
        points.append(top)
    # Run r holds the keys above its lower point and up to its own, runs in descending order; its first key is a point.
    run = F.lit(len(points)) - count_below(F.col("_key"), points) if points else F.lit(1)
    first = run != F.lit(len(points)) - count_at_or_below(F.col("_key"), points) if points else F.lit(False)
    own = F.struct(F.lit(0).alias("look"), run.alias("run"))
    # The first document of all follows the last one, which is in the last run.
    before = F.struct(F.lit(1).alias("look"), F.when(run == 1, F.lit(max(1, len(points)))).otherwise(run - 1).alias("run"))
    placed = rows.withColumn("_at", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    # Runs are dealt by their number, not by its hash, so that no task gets several while another has none.
    placed = placed.repartitionById(max(1, len(points)), (F.col("_at.run") - 1).cast("int"))
    placed = placed.sortWithinPartitions(F.col("_at.run"), F.col("_at.look"), F.desc("_key"), F.col("text").asc_nulls_first())
    done = placed.select("_at.run", F.col("_at.look").alias("look"), "doc_id", "text")
    return done.mapInArrow(_with_look_ahead, SPARK_SCHEMA)


def _with_look_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop all look-ahead rows of a run but the first: rows that share the id of a run's first document."""
    state: dict[int, bool] = {"run": None, "done": False}

    def kept() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for run, look in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if run != state["run"]:
                    state["run"], state["done"] = run, False
                mask.append(not (look and state["done"]))
                state["done"] |= bool(look)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 2, 3)], names=["run", "doc_id", "text"]).filter(pa.array(mask))

    return _compared(kept())
