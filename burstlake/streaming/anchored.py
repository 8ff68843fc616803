"""Anchored sessions over a stream: keyed state holds the last time, the anchor and the group number of each key.

Rows of one key may come in several batches; within a batch they are folded in order of time.  A row that is
older than the last one of its key is late: it keeps the current group and changes no state.  An extension: the
batch operator is the reference point (operators.sessionize).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last_us long, anchor double, grp long"
OUTPUT = "key long, id long, grp long, late boolean"


def anchored_stream(rows: DataFrame, gap_us: int, limit: float) -> DataFrame:
    """rows: (key long, id long, us long, measure double) of a stream; one output row per input row."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["us", "id"], kind="stable")
        last, anchor, grp = state.get if state.exists else (None, None, 0)
        out = []
        for i, us, m in zip(pdf["id"], pdf["us"], pdf["measure"], strict=True):
            if last is not None and us < last:
                out.append((key[0], i, grp, True))
                continue
            m = None if pd.isna(m) else float(m)
            if last is None or us - last > gap_us or m is None or anchor is None or abs(m - anchor) > limit:
                grp, anchor = grp + 1, m
            last = int(us)
            out.append((key[0], i, grp, False))
        state.update((last, anchor, grp))
        yield pd.DataFrame(out, columns=["key", "id", "grp", "late"])

    return rows.groupBy("key").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
