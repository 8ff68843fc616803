"""Numbered result streams: progress and results of each session in order, each number once, whatever is restarted.

A session's messages are numbered from 0 in order of time.  A progress message that repeats the one before is dropped, and nothing comes after
a message that ends the session (done or error).  Numbers live in keyed state with the stream's checkpoint.  The sink writes each
micro-batch to a folder named after it, replacing what a broken-off attempt left, so a batch that runs twice is there once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from .supersession import STATE_STORE

OUTPUT = "session string, number long, kind string, message string, at_us long"
ENDS = ("done", "error")


class Numbered(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "next long, last string, ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, last, ended = self.progress.get() if self.progress.exists() else (0, None, False)
        batch = sorted((int(us), int(i), k, m) for pdf in rows for us, i, k, m in zip(pdf["at_us"], pdf["id"], pdf["kind"], pdf["message"], strict=True))
        out = []
        for us, _, kind, message in batch:
            if ended:
                break
            if kind == "progress" and message == last:
                continue
            last = message if kind == "progress" else None
            ended = kind in ENDS
            out.append((key[0], number, kind, message, us))
            number += 1
        self.progress.update((number, last, ended))
        yield pd.DataFrame(out, columns=["session", "number", "kind", "message", "at_us"])

    def close(self) -> None:
        pass


def numbered_stream(messages: DataFrame) -> DataFrame:
    """messages: a stream of (session string, id long, kind string, message string, at_us long)."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return messages.groupBy("session").transformWithStateInPandas(Numbered(), OUTPUT, "Append", "none")


def to_folder(numbered: DataFrame, folder: str, log: str) -> DataStreamWriter:
    """A writer that puts each micro-batch into folder/batch=<id>, once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id:010d}")

    return numbered.writeStream.option("checkpointLocation", log).foreachBatch(put)


def lines(results: DataFrame) -> DataFrame:
    """session, number and line: the message as an event-stream line of JSON."""
    body = F.to_json(F.struct(F.col("kind").alias("type"), F.col("message").alias("msg")))
    return results.select("session", "number", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("line"))
