"""Periodic runs of words in each text, by the method of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q that holds at least ``times`` periods and ``least`` words and that
no neighbouring word extends.  Each text is worked through by itself, in a task that Spark gives many texts:

1. A three-word string inside a run of four periods occurs three times or more in the text, so the text is cut at
   all strings that are rarer (``stretches``); a run and its two neighbours never cross such a cut.
2. A suffix automaton of the stretch gives its factors: the longest string that also starts earlier, or one new word.
3. Main's algorithm finds the runs that touch the start of a factor and end inside it, from the lengths to which
   the words left and right of that start agree with themselves, moved by each period.  A run of ``times`` periods
   reaches back less than the two factors before and one period, which bounds both window and periods.
4. A run wholly inside a factor is copied from the earlier place of that factor.

All steps are linear in the length of a stretch.  Other columns pass through the task as they are.

Defined results: null, empty and blank texts have no words and no runs; ties of equal words are what it looks for;
repeated rows are worked through alike; an empty table gives an empty one; columns may have any name, those that
clash with the added ones are replaced.  A text is one unit of work, so its words have to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, own_columns, split_words, unboxed

TIMES, LEAST, GRAM = 4, 6, 3
#: Characters of text that are turned into Python values at a time.
SLICE_CHARS = 4 << 20
Run = tuple[int, int, int]


def stretches(words: list[str], times: int = TIMES, least: int = LEAST) -> list[tuple[int, list[int]]]:
    """(start, word numbers) of the parts of a text that can hold a run of ``times`` >= 4 periods."""
    n = len(words)
    if n < least:
        return []
    seen: dict[str, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, count()), np.int64, n)  # each word is named by its first place
    if times < 4 or least < 6:
        return [(0, ids.tolist())]
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    _, gram, often = np.unique(pairs[:-1] * n + ids[GRAM - 1 :], return_inverse=True, return_counts=True)
    open_ = np.zeros(n - GRAM + 3, bool)
    open_[1:-1] = often[gram] >= 3
    edges = np.flatnonzero(open_[1:] != open_[:-1])
    return [(a, ids[a : b + GRAM - 1].tolist()) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least - GRAM + 1]


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start or -1): each factor is the longest string that also starts before it, or one new letter."""
    follow: list[dict[int, int]] = [{}]
    link, depth, ends = [-1], [0], [-1]  # ends: where a state's strings first end
    last = 0
    for i, letter in enumerate(word):
        state, at = len(depth), last
        follow.append({})
        depth.append(i + 1)
        ends.append(i)
        link.append(0)
        while at >= 0 and letter not in follow[at]:
            follow[at][letter] = state
            at = link[at]
        if at >= 0:
            to = follow[at][letter]
            if depth[at] + 1 == depth[to]:
                link[state] = to
            else:
                copy = len(depth)
                follow.append(follow[to].copy())
                depth.append(depth[at] + 1)
                ends.append(ends[to])
                link.append(link[to])
                link[to] = link[state] = copy
                while at >= 0 and follow[at].get(letter) == to:
                    follow[at][letter] = copy
                    at = link[at]
        last = state
    out, begin, n = [], 0, len(word)
    while begin < n:
        at, stop = 0, begin
        while stop < n and ends[to := follow[at][word[stop]]] < stop:
            at, stop = to, stop + 1
        out.append((begin, max(1, stop - begin), ends[at] - (stop - begin) + 1 if stop > begin else -1))
        begin = max(stop, begin + 1)
    return out


def agreement(s: list[int]) -> list[int]:
    """How far s agrees with itself from each place on."""
    n = len(s)
    out = [n] * n
    left = right = 0
    for i in range(1, n):
        k = out[i - left] if i < right else 0
        if i + k >= right:
            k = max(0, right - i)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        out[i] = k
    return out


def touching(word: list[int], begin: int, size: int, before: int, longest: int, times: int, least: int) -> Iterator[Run]:
    """(start, stop, period) of runs that start at or before ``begin`` and stop at one of the ``size`` places from it on."""
    reach = min(begin, before + longest)
    left, right = word[begin - reach : begin], word[begin : begin + size]
    back = left[::-1]
    whole = left + right
    # Periods laid to the left of begin: agree with the words one period earlier, both ways.
    most = min(longest, reach)
    own = agreement(back)
    ahead = agreement([*right, -2, *whole[reach - most :]])
    for q in range(1, most + 1):
        more = ahead[size + 1 + most - q]
        wide = q + (own[q] if q < reach else 0) + more
        if more < size and wide >= times * q and wide >= least:
            yield begin + more - wide, begin + more, q
    # Periods laid to the right of it.
    most = min(longest, size - 1)
    if most > 0:
        own = agreement(right)
        behind = agreement([*back, -2, *whole[: reach + most][::-1]])
        for q in range(1, most + 1):
            more, stop = behind[reach + 1 + most - q], begin + q + own[q]
            wide = more + q + own[q]
            if q + own[q] < size and wide >= times * q and wide >= least:
                yield begin - more, stop, q


def runs_of(word: list[int], times: int = TIMES, least: int = LEAST) -> list[Run]:
    """(start, length, smallest period) of all runs of a list of numbers >= 0, by start, then period."""
    if times < 2:
        raise ValueError("a run holds two periods or more")
    word = [*word, -1]  # a last letter of its own ends every run
    found: dict[int, dict[int, int]] = {}
    sizes = (0, 0)
    for begin, size, source in factors(word):
        if begin:
            longest = sizes[1] + max(size, sizes[0]) - 1  # (times - 1) * period < two neighbouring factors
            longest = longest // (times - 1)
            if longest > 0:
                for start, stop, q in touching(word, begin, size, sum(sizes), longest, times, least):
                    here = found.setdefault(start, {})
                    here[stop] = min(q, here.get(stop, q))
        if source >= 0:
            move, limit = begin - source, source + size
            for start in range(source + 1, limit):
                inside = found.get(start)
                if inside:
                    copied = {stop + move: q for stop, q in inside.items() if stop < limit}
                    if copied:
                        found.setdefault(start + move, {}).update(copied)
        sizes = (sizes[1], size)
    return sorted((start, stop - start, q) for start, each in found.items() for stop, q in each.items())


def text_runs(words: list[str], times: int = TIMES, least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs of a text, in words, by start, then period."""
    return sorted(
        ((a + start, length, q) for a, word in stretches(words, times, least) for start, length, q in runs_of(word, times, least)), key=lambda r: (r[0], r[2], r[1])
    )


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words that stay when of every run only its first period stays."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, out in zip(words, gone.tolist(), strict=True) if not out]


def sliced(batch: pa.RecordBatch, column: int, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about so many bytes of a text column, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def periodic_runs(df: DataFrame, text: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """df with runs (array of start, length, period) and collapsed_text (kept words, joined by one space) added.

    Only stretches of words between white space count; of every run its first period is kept.
    """
    own = own_columns(df, "runs", "collapsed_text")
    keyed = boxed(df, own, body=F.col(f"`{text}`"))
    run_t = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 1):
                ends, flat, left = [0], [], []
                for body in batch.column(1).to_pylist():
                    words = split_words(body or "")
                    runs = text_runs(words, times, least)
                    flat += runs
                    ends.append(len(flat))
                    left.append(" ".join(collapsed(words, runs) if runs else words))
                columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(run_t)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(left, pa.string())], names=["row", "runs", "collapsed_text"])

    run = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = T.StructType([keyed.schema["row"]]).add("runs", T.ArrayType(run)).add("collapsed_text", "string")
    return keyed.mapInArrow(found, schema).select(*unboxed(own), "runs", "collapsed_text")
