"""Best-fit packing with conflicts: documents into bins of fixed capacity, tightest compatible bin first.

A document longer than a bin is cut into full bins and a rest; the rest is packed like a short document.  No bin
holds two pieces of one source, nor two of one duplicate cluster (equal texts).  Bins are kept by residual room;
a bitmap over residuals tells where any bin is, and one bitmap per label (source or cluster) tells at which
residuals every bin already has the label.  The successor search takes the smallest residual that is large enough
and not full of either label, tries its bins in order of age, and goes on to the next residual until one fits.

Documents are packed in groups of bounded size, dealt by a hash of id and text; each group is one task's work and the
number of groups follows the rows.  Copies of a text and documents of one source spread evenly over the groups.
Full repetitions of a row are counted first, and their number is dealt evenly over all groups.

Defined results: null or empty texts have size 0 and are packed as empty pieces; null sources are one source;
repeated rows are packed as separate pieces of one cluster; an empty table gives no bins; other columns of the
input are not read.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

CAPACITY, GROUP_ROWS = 2_048, 10_000


class Bins:
    """Open bins of one group by residual room."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.room: list[int] = []
        self.labels: list[set[str]] = []
        self.at: dict[int, dict[int, None]] = defaultdict(dict)  # residual -> bins, oldest first
        self.any = 0  # bit r: some bin has residual r
        self.held: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))  # residual -> label -> bins that have it
        self.with_count: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))  # residual -> that number -> labels
        self.full: dict[str, int] = defaultdict(int)  # label -> bit r: every bin of residual r has it

    def _full(self, r: int, on: bool) -> None:
        """Set or clear the bit of r for the labels that all of its bins have."""
        n, bit = len(self.at[r]), 1 << r
        for x in self.with_count[r].get(n, ()) if n else ():
            self.full[x] = self.full[x] | bit if on else self.full[x] & ~bit
        self.any = self.any | bit if n else self.any & ~bit

    def _count(self, r: int, label: str, by: int) -> None:
        n = self.held[r].pop(label, 0)
        if n:
            self.with_count[r][n].discard(label)
        if n + by:
            self.held[r][label] = n + by
            self.with_count[r][n + by].add(label)

    def _leave(self, b: int) -> None:
        r = self.room[b]
        self._full(r, False)
        del self.at[r][b]
        for x in self.labels[b]:
            self._count(r, x, -1)
        self._full(r, True)

    def _enter(self, b: int) -> None:
        r = self.room[b]
        self._full(r, False)
        self.at[r][b] = None
        for x in self.labels[b]:
            self._count(r, x, 1)
        self._full(r, True)

    def place(self, size: int, labels: set[str]) -> tuple[int, bool]:
        """(bin, new?) of a piece: the tightest bin with room and none of its labels."""
        shut = 0
        for x in labels:
            shut |= self.full.get(x, 0)
        left = (self.any & ~shut) >> size
        r = size
        while left:
            step = (left & -left).bit_length() - 1
            r += step
            for b in self.at[r]:
                if self.labels[b].isdisjoint(labels):
                    self._leave(b)
                    self.room[b] -= size
                    self.labels[b] |= labels
                    self._enter(b)
                    return b, False
            left >>= step + 1
            r += 1
        b = len(self.room)
        self.room.append(self.capacity - size)
        self.labels.append(set(labels))
        self._enter(b)
        return b, True


def pack(pieces: list[tuple[int, set[str]]], capacity: int) -> list[int]:
    """The bin of each (size, labels), placed in order of falling size."""
    bins, out = Bins(capacity), [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        out[i] = bins.place(*pieces[i])[0]
    return out


def packed(
    df: DataFrame, capacity: int = CAPACITY, text: str = "text", source: str = "source", row_id: str = "doc_id", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, bin (group and number), source."""
    size = F.size(words_of(F.col(text))).cast("long")
    rows = df.select(F.col(row_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("cluster"))
    counted = rows.groupBy("doc_id", "source", "size", "cluster").agg(F.count(F.lit(1)).alias("times"))
    groups = max(1, -(-df.count() // group_rows))
    # The n copies of a row go to min(n, groups) groups from the one of its hash on, as evenly as they divide.
    grp = F.pmod(F.xxhash64("doc_id", F.lit("bin"), "cluster"), F.lit(groups))
    each = F.when(F.col("times") == 1, F.array(F.struct(grp.alias("grp"), F.lit(1).cast("long").alias("copies")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), (F.least("times", F.lit(groups)) - 1).cast("int")),
            lambda k: F.struct(F.pmod(grp + k, F.lit(groups)).alias("grp"), (F.floor(F.col("times") / groups) + F.when(k < F.col("times") % groups, 1).otherwise(0)).alias("copies")),
        )
    )
    rows = counted.select("doc_id", "source", "size", "cluster", F.inline(each))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "cluster", "doc_id", "source"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])]
        grp = int(pdf["grp"].iloc[0])
        rest, out, number = [], [], 0
        for doc_id, src, size, cluster in zip(pdf["doc_id"], pdf["source"], pdf["size"], pdf["cluster"], strict=True):
            whole = size // capacity if size % capacity or not size else size // capacity - 1
            for k in range(whole):
                out.append((doc_id, k, k * capacity, capacity, f"{grp}-full-{number}", src))
                number += 1
            labels = {f"c{cluster}", f"s{src}" if isinstance(src, str) else "n"}
            rest.append(((size - whole * capacity, labels), (doc_id, whole, whole * capacity, size - whole * capacity), src))
        for b, (_, row, src) in zip(pack([x[0] for x in rest], capacity), rest, strict=True):
            out.append((*row, f"{grp}-{b}", src))
        got = pd.DataFrame(out, columns=["doc_id", "piece", "first_word", "n_words", "bin", "source"])
        got["doc_id"] = got["doc_id"].astype("Int64")
        return got

    schema = "doc_id long, piece int, first_word long, n_words long, bin string, source string"
    return rows.groupBy("grp").applyInPandas(one, schema)
