"""Training a small head on labelled vectors by mini-batches whose gradients are added up across tasks.

The samples are laid out once in an order fixed by a hash of their ids; each epoch goes through a seeded permutation of their places,
written so that a batch's rows stand together.  Steps follow one another, as each needs the weights of the one before.

Large batches: a step reads one batch, each task adds up the gradient of its rows, groups of tasks add up theirs, and the driver
turns the sum of a few thousand numbers into the next weights (Adam).  Batches of at most ``LARGE`` rows: a task goes through a *leg* of
some ``LEG`` rows, batch by batch, and hands weights and moments on to the next leg's, so that a leg costs a job, not a batch.  No task
sees more than its share of a batch or one leg, and nothing is left out.  After each epoch the weights are written to the shared
folder, from which a run that was broken off goes on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from burstlake.sources.scratch import written

BATCH, HIDDEN, RATE, SEED = 16, 256, 0.001, 42
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8
#: Partial sums are first added up in this many groups where a batch is large enough to lie in many parts.
GROUPS, LARGE = 16, 4096
#: Rows of consecutive batches that one task goes through before it hands the weights on.
LEG = 16_384


@dataclass
class Head:
    """Two layers: hidden x dim and 2 x hidden weights with their biases; moments and steps of the optimiser."""

    params: list[np.ndarray]
    first: list[np.ndarray] = field(default_factory=list)
    second: list[np.ndarray] = field(default_factory=list)
    steps: int = 0

    @staticmethod
    def fresh(dim: int, hidden: int, seed: int) -> Head:
        rng = np.random.RandomState(seed)
        params = [rng.randn(hidden, dim) * math.sqrt(2 / dim), np.zeros(hidden), rng.randn(2, hidden) * math.sqrt(2 / hidden), np.zeros(2)]
        return Head(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])

    def moved(self, gradient: list[np.ndarray], rate: float) -> Head:
        t = self.steps + 1
        first = [BETA1 * m + (1 - BETA1) * g for m, g in zip(self.first, gradient, strict=True)]
        second = [BETA2 * v + (1 - BETA2) * g * g for v, g in zip(self.second, gradient, strict=True)]
        params = [p - rate * (m / (1 - BETA1**t)) / (np.sqrt(v / (1 - BETA2**t)) + TINY) for p, m, v in zip(self.params, first, second, strict=True)]
        return Head(params, first, second, t)


def gradient(params: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float, int]:
    """Sums over the rows: gradient of the softmax loss, loss, and how many are told right."""
    w1, b1, w2, b2 = params
    z = x @ w1.T + b1
    a = np.maximum(z, 0)
    s = a @ w2.T + b2
    e = np.exp(s - s.max(axis=1, keepdims=True))
    q = e / (e.sum(axis=1, keepdims=True) + 1e-12)
    rows = np.arange(len(y))
    loss, right = -np.log(q[rows, y] + 1e-12).sum(), int((q.argmax(axis=1) == y).sum())
    d = q.copy()
    d[rows, y] -= 1
    back = (d @ w2) * (z > 0)
    return [back.T @ x, back.sum(axis=0), d.T @ a, d.sum(axis=0)], float(loss), right


def permutation(n: int, epoch: int, seed: int) -> tuple[int, int]:
    """a and b of the permutation place -> (a * place + b) mod n of an epoch; a and n have no common divisor."""
    rng = np.random.RandomState(seed + 1 + epoch)
    a = int(rng.randint(1, max(2, n)))
    while math.gcd(a, n) != 1:
        a += 1
    return a % n if n > 1 else 1, int(rng.randint(0, n))


def laid_out(samples: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(place, x, y) with places 0 to n - 1 in order of a hash of the id, numbered part by part, and n."""
    keyed = samples.select(F.xxhash64(F.lit(seed), "id").alias("h"), F.col("id").cast("string").alias("i"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("int").alias("y"))
    parts = written(keyed.repartitionByRange("h", "i").withColumn("part", F.spark_partition_id()), "samples")
    counts = sorted((r["part"], r["count"]) for r in parts.groupBy("part").count().collect())  # one row per part
    ahead, table = 0, []
    for part, n in counts:
        table.append((part, ahead))
        ahead += n
    starts = samples.sparkSession.createDataFrame(table or [(0, 0)], "part int, ahead long")
    number = F.row_number().over(W.partitionBy("part").orderBy("h", "i")) - 1 + F.col("ahead")
    return written(parts.join(F.broadcast(starts), "part").select(number.alias("place"), "x", "y"), "places"), ahead


def _cut(flat: np.ndarray, shapes: list[tuple]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        out.append(flat[at : at + math.prod(shape)].reshape(shape))
        at += math.prod(shape)
    return out


def _leg(rows: DataFrame, head: Head, rate: float) -> tuple[Head, float, int]:
    """The head after the batches of a leg (batch, place, x, y), in order, by one task; loss and how many were told right."""
    shapes = [p.shape for p in head.params]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, right, waiting = head, 0.0, 0, []

        def step() -> None:
            nonlocal now, total, right
            x, y = (np.concatenate([w[k] for w in waiting]) for k in (1, 2))
            g, loss, told = gradient(now.params, x, y)
            now = now.moved([a / len(y) for a in g], rate)
            total, right = total + loss, right + told

        for part in batches:
            if not part.num_rows:
                continue
            number = part.column(0).to_numpy()
            x, y = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1), part.column(2).to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(number)) + 1), part.num_rows]
            for a, b in zip(ends, ends[1:], strict=False):
                if waiting and waiting[0][0] != number[a]:
                    step()
                    waiting = []
                waiting.append((number[a], x[a:b], y[a:b]))
        if waiting:
            step()
            state = np.concatenate([a.ravel() for g in (now.params, now.first, now.second) for a in g])
            columns = [pa.array([total]), pa.array([right]), pa.array([now.steps], pa.int32()), pa.array([state.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["loss", "told", "steps", "state"])

    one = rows.coalesce(1).sortWithinPartitions("batch", "place").select("batch", "x", "y")
    got = one.mapInArrow(run, "loss double, told long, steps int, state binary").first()  # one row
    state = _cut(np.frombuffer(got["state"]), shapes * 3)
    k = len(shapes)
    return Head(state[:k], state[k : 2 * k], state[2 * k :], got["steps"]), got["loss"], got["told"]


def _summed(batch: DataFrame, params: list[np.ndarray]) -> tuple[list[np.ndarray], float, int, int]:
    shapes = [p.shape for p in params]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, right, n = None, 0.0, 0, 0
        for rows in batches:
            if not rows.num_rows:
                continue
            x, y = rows.column(0).flatten().to_numpy().reshape(rows.num_rows, -1), rows.column(1).to_numpy()
            g, more, told = gradient(params, x, y)
            total = g if total is None else [a + b for a, b in zip(total, g, strict=True)]
            loss, right, n = loss + more, right + told, n + len(y)
        if total is not None:
            flat = np.concatenate([a.ravel() for a in total])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()]), pa.array([loss]), pa.array([right]), pa.array([n])], names=["g", "loss", "told", "n"])

    def added(table: pa.Table) -> pa.Table:
        g = np.sum([v.values.to_numpy() for v in table.column("g").combine_chunks()], axis=0)
        return pa.table({"g": [g.tolist()]} | {c: [sum(table.column(c).to_pylist())] for c in ("loss", "told", "n")})

    schema = "g array<double>, loss double, told long, n long"
    sums = batch.select("x", "y").mapInArrow(part, schema)
    sums = sums.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("group")).applyInArrow(added, schema)
    got = sums.collect()  # a few rows of as many numbers as the head has
    return _cut(np.sum([r["g"] for r in got], axis=0), shapes), sum(r["loss"] for r in got), sum(r["told"] for r in got), sum(r["n"] for r in got)


def _saved(spark: SparkSession, folder: str, epoch: int, head: Head, history: list[tuple]) -> None:
    row = (epoch, head.steps, *[[a.ravel().tolist() for a in g] for g in (head.params, head.first, head.second)], [list(map(float, h[1:])) for h in history])
    schema = "epoch int, steps int, params array<array<double>>, first array<array<double>>, second array<array<double>>, history array<array<double>>"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={epoch:05d}")


def _found(spark: SparkSession, folder: str, epochs: int, shapes: list[tuple]) -> tuple[Head, list[tuple]] | None:
    """The newest epoch that was saved whole."""
    for epoch in range(epochs - 1, -1, -1):
        try:
            row = spark.read.parquet(f"{folder}/epoch={epoch:05d}").drop("epoch").first()
        except AnalysisException:  # no such epoch, or one that was broken off
            continue
        if row:
            shaped = lambda g: [np.array(a).reshape(s) for a, s in zip(g, shapes, strict=True)]
            return Head(shaped(row["params"]), shaped(row["first"]), shaped(row["second"]), row["steps"]), [(k, *h) for k, h in enumerate(row["history"])]
    return None


def train_head(
    samples: DataFrame, epochs: int = 10, batch: int = BATCH, hidden: int = HIDDEN, rate: float = RATE, seed: int = SEED, folder: str | None = None
) -> tuple[Head, DataFrame]:
    """The trained head and (epoch, loss, accuracy) for samples (id, embedding, label 0 or 1); rows without a vector or label don't count.

    With ``folder`` (on shared storage) each epoch is saved there and a run goes on after the last one that was.
    """
    spark = samples.sparkSession
    table, n = laid_out(samples.where("embedding IS NOT NULL AND label IS NOT NULL"), seed)
    schema = "epoch int, loss double, accuracy double"
    if n == 0:
        return Head([]), spark.createDataFrame([], schema)
    batch, dim = min(batch, n), len(table.select("x").first()["x"])
    head, history = Head.fresh(dim, hidden, seed), []
    resumed = _found(spark, folder, epochs, [p.shape for p in head.params]) if folder else None
    if resumed:
        head, history = resumed
    for epoch in range(len(history), epochs):
        a, b = permutation(n, epoch, seed)
        place = (F.col("place") * a + b) % n
        numbered = table.select(F.floor(place / batch).alias("batch"), place.alias("place"), "x", "y")
        loss, right = 0.0, 0
        if batch <= LARGE:
            each = max(1, LEG // batch)  # batches of a leg
            legs = -(-n // (batch * each))
            ordered = written(numbered.withColumn("leg", F.floor(F.col("batch") / each)).repartitionByRange(legs, "leg"), "epoch", "leg")
            for k in range(legs):
                head, more, told = _leg(ordered.where(F.col("leg") == k), head, rate)
                loss, right = loss + more, right + told
        else:
            ordered = written(numbered.drop("place").repartitionByRange("batch").sortWithinPartitions("batch"), "epoch") if n > batch else numbered
            for k in range(-(-n // batch)):
                g, more, told, rows = _summed(ordered.where(F.col("batch") == k), head.params)
                head = head.moved([x / rows for x in g], rate)
                loss, right = loss + more, right + told
        history.append((epoch, loss / n, right / n))
        if folder:
            _saved(spark, folder, epoch, head, history)
    return head, spark.createDataFrame([(int(e), float(x), float(y)) for e, x, y in history], schema)


def probabilities(head: Head, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and p, the probability of label 1, for a table of vectors."""
    params = head.params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            z = np.maximum(x @ params[0].T + params[1], 0) @ params[2].T + params[3]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(z[:, 0] - z[:, 1])))], names=[key, "p"])

    narrow = rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("x"))
    return narrow.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, p double")
