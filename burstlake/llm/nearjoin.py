"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

Each text is the set of its runs of five lower-cased words.  Equal word sequences are one class with the row of
smallest id as representative; only representatives are joined.  A representative has ``TREES`` labels of ``DEPTH``
MinHash values each.  A tree of the forest is the prefix trie of one label of all representatives; Spark groups the
labels by their prefix of d values, so one grouping is one level of all tries.

The matched prefix starts at the full depth and is shortened level by level.  A level takes the trie nodes that
have more than one child (at the first level: more than one label); the pairs that meet there for the first time,
in this tree and on this level, are verified.  After each level the recall is measured on the pairs found so far:
a pair of similarity s was found with probability p = 1 - (1 - s^d)^TREES, so the found pairs stand for the sum of
their 1 / p.  Shortening ends when found / that sum reaches the target recall, or at the depth that gives it
to every pair at the threshold.

Members of a node are dealt in blocks: a node of more than ``BLOCK`` texts, or of very long ones, is cut by a hash and
each pair of its blocks is one unit of work, so no group has to fit in one task.  Units learn first from the labels
alone whether they own any pair; only texts that have one go on to exact verification in integers, where all owned
pairs of a unit are compared.  Units return the number of links of each text and a spanning set of links, never the
pairs.  Classes of linked texts come from contracting those links in rounds of distributed hooking and pointer jumping.

Defined results: null and empty texts, and texts without a word, match nothing and are their own representative;
texts of one to four words are one run as a whole; copies share their representative's links; rows of one id with
different texts are different texts; rows without an id link like others and come after them, so a representative
has no id only where none of its group has one; columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import boxed, drop_scratch, materialise, own_columns, parts_for, split_words, unboxed

WORDS, THRESHOLD, TREES, DEPTH, RECALL, BLOCK, BLOCK_RUNS = 5, 0.8, 20, 6, 0.9999, 512, 2_000_000
BINS = 64
MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(5)
MULTIPLIERS = _rng.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit names of a text's word runs; remembers a bounded number of word hashes."""

    MOST = 300_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _word(self, w: str) -> int:
        got = self.known.get(w)
        if got is None:
            got = xxhash.xxh3_64_intdigest(w.encode())
            if len(self.known) < self.MOST:
                self.known[w] = got
        return got

    def words(self, text: str) -> np.ndarray:
        split = split_words(text.lower())
        return np.fromiter(map(self._word, split), np.uint64, len(split))

    @staticmethod
    def runs(words: np.ndarray, width: int = WORDS) -> np.ndarray:
        if not len(words):
            return words
        width = min(width, len(words))
        h = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            h *= MIX
            h ^= h >> np.uint64(29)
            h += words[k : len(words) - width + 1 + k]
        h *= MIX
        h ^= h >> np.uint64(32)
        return np.unique(h)


def label(runs: np.ndarray) -> np.ndarray:
    """TREES x DEPTH MinHash values of 16 bits, computed over blocks so that long texts need no more memory."""
    best = np.full(len(MULTIPLIERS), (1 << 64) - 1, np.uint64)
    for i in range(0, len(runs), 512):
        h = np.multiply.outer(MULTIPLIERS, runs[i : i + 512])
        h += OFFSETS[:, None]
        np.minimum(best, h.min(axis=1), out=best)
    # The high bits of a minimum are small for many runs; a multiplication spreads all bits.
    return ((best * MIX) >> np.uint64(48)).astype("<u2").reshape(TREES, DEPTH)


def meets(similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
    """How likely a pair of that similarity shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def last_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which even pairs at the threshold meet with the target recall."""
    depth = DEPTH
    while depth > 1 and meets(threshold, depth) < recall:
        depth -= 1
    return depth


def measured_recall(found: dict[int, int], depth: int, threshold: float) -> float | None:
    """The share of all pairs that those found down to ``depth`` are, from their numbers by similarity bin."""
    n = sum(found.values())
    low = {k: threshold + (1 - threshold) * k / BINS for k in found}
    return n / sum(v / meets(low[k], depth) for k, v in found.items()) if n else None


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        names, labels, sizes = [], [], []
        for text in batch.column(3).to_pylist():
            words = shingler.words(text)
            runs = shingler.runs(words)
            names.append(xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None)
            labels.append(label(runs).tobytes() if len(words) else None)
            sizes.append(len(runs))
        cols = [*batch.columns[:3], pa.array(names, pa.binary()), pa.array(labels, pa.binary()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["none", "doc", "tag", "name", "label", "runs"])


def _prefix_names(labels: np.ndarray, depth: int) -> np.ndarray:
    """One 64-bit name for each text and tree of the label's first ``depth`` values."""
    h = np.zeros(labels.shape[:2], np.uint64)
    for k in range(depth):
        h *= MIX
        h ^= h >> np.uint64(31)
        h += labels[:, :, k].astype(np.uint64) + np.uint64(1)
    return h


class Rows:
    """The columns of a batch of rows (label, tree, block, i, j, name, and text if there) and where its units begin."""

    def __init__(self, table: pa.Table, depth: int) -> None:
        col = lambda n: table.column(n).combine_chunks()
        labels = np.frombuffer(b"".join(col("label").to_pylist()), "<u2").reshape(-1, TREES, DEPTH)
        self.keys = _prefix_names(labels, depth)
        self.deeper = _prefix_names(labels, depth + 1) if depth < DEPTH else None
        self.tree, self.block, self.i, self.j = (col(n).to_numpy(zero_copy_only=False) for n in ("tree", "block", "i", "j"))
        self.name = col("name").to_pylist()
        self.text = col("text").to_pylist() if "text" in table.column_names else None
        key = np.frombuffer(b"".join(col("key").to_pylist()), "<u2").reshape(-1, depth)
        new = np.zeros(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        for x in (self.tree, self.i, self.j):
            new[1:] |= x[1:] != x[:-1]
        self.starts = [0, *np.flatnonzero(new).tolist()]

    def pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left rows, right rows, which of their pairs the unit owns): those that meet in its tree, in none before it and nowhere deeper."""
        block = self.block[a:b]
        left, right = a + np.flatnonzero(block == self.i[a]), a + np.flatnonzero(block == self.j[a])
        tree = int(self.tree[a])
        own = np.ones((len(left), len(right)), bool)
        if self.i[a] == self.j[a]:
            own = np.triu(own, 1)
        if self.deeper is not None:
            own &= self.deeper[left, tree][:, None] != self.deeper[right, tree][None, :]
        for t in range(TREES):
            if not own.any():
                break
            if t < tree:
                own &= self.keys[left, t][:, None] != self.keys[right, t][None, :]
            elif self.deeper is not None:
                own &= self.deeper[left, t][:, None] != self.deeper[right, t][None, :]
        return left, right, own


def _whole_units(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[pa.Table, Rows, list[tuple[int, int]]]]:
    """Rows sorted by unit, cut so that no unit is split: what is open at a batch's end waits for the next one."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if table.num_rows:
            rows = Rows(table, depth)
            last = rows.starts[-1]
            yield table, rows, list(zip(rows.starts, rows.starts[1:], strict=False))
            rest = table.slice(last)
    if rest is not None:
        yield rest, Rows(rest, depth), [(0, rest.num_rows)]


def _with_pairs(depth: int):
    """The rows of units that have a part in a pair their unit owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows, units in _whole_units(batches, depth):
            busy = np.zeros(table.num_rows, bool)
            for a, b in units:
                left, right, own = rows.pairs(a, b)
                busy[left[own.any(axis=1)]] = True
                busy[right[own.any(axis=0)]] = True
            yield from table.filter(pa.array(busy)).to_batches()

    return run


def _shared(sets: dict[int, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of shared runs of all left-right pairs, by products of 0/1 matrices over slices of the runs in both."""
    used = sorted({*left.tolist(), *right.tolist()})
    flat = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    values, column = np.unique(flat, return_inverse=True)
    common = np.bincount(column) > 1
    owner, column = owner[common[column]], (np.cumsum(common) - 1)[column[common[column]]]
    row = {k: n for n, k in enumerate(used)}
    a, b = ([row[k] for k in side.tolist()] for side in (left, right))
    total = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(common.sum()), 4096):
        s, e = np.searchsorted(column, (lo, lo + 4096))
        m = np.zeros((len(used), 4096), np.float32)  # sums of at most 4,096 ones are exact
        m[owner[s:e], column[s:e] - lo] = 1
        total += (m[a] @ m[b].T).astype(np.int64)
    return total


def _verified(depth: int, threshold: float):
    least = Fraction(str(threshold))

    def unit(rows: Rows, a: int, b: int, shingler: Shingler, bins: np.ndarray) -> tuple[list[bytes], list[int], list[bytes]]:
        left, right, own = rows.pairs(a, b)
        sets = {k: shingler.runs(shingler.words(rows.text[k])) for k in range(a, b)}
        links, parent = dict.fromkeys(range(a, b), 0), list(range(b - a))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        at = np.argwhere(own)
        if len(at) > 8:
            both = _shared(sets, left, right)[own]
        else:
            both = np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)) for i, j in at], np.int64)
        size = lambda side: np.array([len(sets[k]) for k in side], np.int64)
        either = size(left[at[:, 0]]) + size(right[at[:, 1]]) - both if len(at) else both
        near = least.denominator * both >= least.numerator * either
        share = (both[near] / either[near] - threshold) / (1 - threshold) if threshold < 1 else both[near]
        bins += np.bincount(np.clip((share * BINS).astype(np.int64), 0, BINS), minlength=BINS + 1)
        for i, j in at[near]:
            x, y = int(left[i]), int(right[j])
            links[x] += 1
            links[y] += 1
            p, q = root(x - a), root(y - a)
            if p != q:
                parent[max(p, q)] = min(p, q)
        got = [k for k, n in links.items() if n]
        return [rows.name[k] for k in got], [links[k] for k in got], [rows.name[a + root(k - a)] for k in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bins = Shingler(), np.zeros(BINS + 1, np.int64)
        for _, rows, units in _whole_units(batches, depth):
            out: tuple[list, ...] = ([], [], [])
            for a, b in units:
                for x, y in zip(out, unit(rows, a, b, shingler, bins), strict=True):
                    x.extend(y)
            yield batch_of(*out, [None] * len(out[0]))
        yield batch_of([None], [None], [None], [bins.tolist()])

    def batch_of(*columns: list) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["name", "links", "root", "bins"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): the smallest node that is connected to each.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to their ends by doubling,
    and contracts the edges to the ends; nodes at least halve.  Every table of a round is written to the shared
    folder, and edges are joined by a node, never gathered for one.
    """
    spark = edges.sparkSession
    up = F.greatest("a", "b")
    edges, at = materialise(edges.where("a <> b").select(up.alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes, nodes_at = materialise(edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct().select("node", F.col("node").alias("root")), "nodes")
    while not edges.isEmpty():
        hooks, hooks_at = materialise(edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("p")), "hooks")
        while True:
            far = hooks.select(F.col("x").alias("y"), F.col("p").alias("q"))
            stepped, stepped_at = materialise(hooks.join(far, F.col("p") == F.col("y"), "left").select("x", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "hooks")
            drop_scratch(spark, hooks_at)
            hooks, hooks_at = stepped.drop("moved"), stepped_at
            if stepped.where("moved").isEmpty():
                break
        a, b = (hooks.select(F.col("x").alias(f"x{s}"), F.col("p").alias(f"p{s}")) for s in "ab")
        moved = edges.join(a, F.col("a") == F.col("xa"), "left").join(b, F.col("b") == F.col("xb"), "left")
        moved = moved.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b")
        moved = moved.select(up.alias("a"), F.least("a", "b").alias("b")).distinct()
        new_edges, new_at = materialise(moved, "edges")
        new_nodes, new_nodes_at = materialise(nodes.join(a, F.col("root") == F.col("xa"), "left").select("node", F.coalesce("pa", "root").alias("root")), "nodes")
        drop_scratch(spark, at, hooks_at, nodes_at)
        edges, at, nodes, nodes_at = new_edges, new_at, new_nodes, new_nodes_at
    drop_scratch(spark, at)
    return nodes


def _level(reps: DataFrame, texts: DataFrame, depth: int, threshold: float, parts: int) -> tuple[DataFrame, str]:
    """Links (name, links, root, bins) of the pairs that first meet at prefixes of ``depth`` values."""
    part = lambda n: F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("label", t * (2 * DEPTH) + 1, F.lit(2 * n)))
    placed = reps.select("name", "runs", F.posexplode(F.arrays_zip(part(depth).alias("key"), part(min(DEPTH, depth + 1)).alias("child"))).alias("tree", "p"))
    placed = placed.select("name", "runs", "tree", "p.key", "p.child")
    nodes = placed.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("runs").alias("all"), (F.min("child") != F.max("child")).alias("forks"))
    nodes = nodes.where("n > 1" if depth == DEPTH else "forks")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_RUNS)).cast("int")
    nodes = nodes.select(F.col("tree").alias("t"), F.col("key").alias("k"), blocks.alias("blocks"))
    busy = placed.join(nodes, (F.col("tree") == F.col("t")) & (F.col("key") == F.col("k"))).select(F.col("name").alias("m"), "tree", "key", "blocks")
    busy = busy.join(reps.select("name", "doc", "none", "tag", "label"), F.col("m") == F.col("name")).drop("m")
    busy = busy.withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["tree", "key", "i", "j"]
    units = busy.select("none", "doc", "tag", "name", "label", "tree", "key", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    shape = "none boolean, doc long, tag long, name binary, label binary, tree int, key binary, block int, i int, j int"
    units, units_at = materialise(units.repartition(parts, *unit).sortWithinPartitions(*unit).mapInArrow(_with_pairs(depth), shape), "units")

    # Only now do texts move, and only those of representatives that own a pair.
    dealt = units.select(F.struct("name", "label", "tree", "key", "block", "i", "j").alias("u"), F.col("none").alias("e"), F.col("doc").alias("d"), F.col("tag").alias("g"))
    dealt = dealt.groupBy("e", "d", "g").agg(F.collect_list("u").alias("us"))
    met = texts.join(dealt, _same("none", "doc", "tag", "e", "d", "g")).select("text", F.explode("us").alias("u"))
    met = met.select("text", "u.*").repartition(parts, *unit).sortWithinPartitions(*unit)
    found, found_at = materialise(met.mapInArrow(_verified(depth, threshold), "name binary, links long, root binary, bins array<long>"), "links")
    drop_scratch(reps.sparkSession, units_at)
    return found, found_at


def _same(a: str, b: str, c: str, x: str, y: str, z: str) -> Column:
    return (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)) & (F.col(c) == F.col(z))


def _keys(row_id: Column, text: Column) -> dict[str, Column]:
    """How a row is known inside: whether it has no id, its id, and some bits of its text's hash."""
    return {"none": row_id.isNull(), "doc": F.coalesce(row_id.cast("long"), F.lit(0)), "tag": F.xxhash64(text)}


def near_classes(df: DataFrame, text: str = "text", row_id: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per id and text of df that has a word: its keys (none, doc, tag), and of its group
    rep (those keys of the first row with the same words), n_links (number of other such texts within the threshold)
    and near (the keys of the first row that links connect to it)."""
    spark = df.sparkSession
    keys = _keys(F.col(row_id), F.col(text))
    texts = df.where(F.col(text).isNotNull()).select(*[v.alias(k) for k, v in keys.items()], F.col(text).alias("text"))
    shape = "none boolean, doc long, tag long, name binary, label binary, runs long"
    rows, _ = materialise(texts.mapInArrow(_labels, shape).where("name IS NOT NULL"), "labels")
    parts = parts_for(spark, 4 * rows.count())
    reps, _ = materialise(rows.groupBy("name").agg(F.min(F.struct("none", "doc", "tag", "label", "runs")).alias("r")).select("name", "r.*"), "classes")
    if not texts.groupBy("none", "doc", "tag").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["none", "doc", "tag"])

    found, bins, depth = [], {}, DEPTH
    while True:
        found.append(_level(reps, texts, depth, threshold, parts)[0])
        for r in found[-1].where("bins IS NOT NULL").select(F.posexplode("bins").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).where("n > 0").collect():
            bins[r["k"]] = bins.get(r["k"], 0) + r["n"]  # at most BINS + 1 rows
        got = measured_recall(bins, depth, threshold)
        if depth <= last_depth(threshold, recall) or (got is not None and got >= recall):
            break
        depth -= 1
    links = found[0]
    for more in found[1:]:
        links = links.unionAll(more)
    links = links.where("name IS NOT NULL")

    keys = F.struct("none", "doc", "tag")
    near = components(links.select(F.col("name").alias("a"), F.col("root").alias("b")))
    linked = near.join(reps.select(F.col("name").alias("rn"), keys.alias("rep")), F.col("node") == F.col("rn")).select("node", "root", "rep")
    first = linked.groupBy(F.col("root").alias("r0")).agg(F.min("rep").alias("near"))
    count = links.groupBy("name").agg(F.sum("links").alias("n_links")).withColumnRenamed("name", "l")
    linked = linked.join(first, F.col("root") == F.col("r0")).join(count, F.col("node") == F.col("l")).select("node", "near", "n_links")
    classes = reps.select(F.col("name").alias("cn"), keys.alias("rep")).join(linked, F.col("cn") == F.col("node"), "left")
    classes = classes.select("cn", "rep", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("near", "rep").alias("near"))
    return rows.join(classes, F.col("name") == F.col("cn")).select("none", "doc", "tag", "rep", "n_links", "near")


def _joined(df: DataFrame, text: str, row_id: str, **how) -> DataFrame:
    """(row, none, doc, tag, rep, n_links, near) for each row of df, the last three null where a text matches nothing; one
    exchange of df, by the keys."""
    got = near_classes(df, text, row_id, **how).dropDuplicates(["none", "doc", "tag"])
    got = got.select(F.col("none").alias("e"), F.col("doc").alias("d"), F.col("tag").alias("g"), "rep", "n_links", "near")
    keyed = boxed(df, df.columns, **_keys(F.col(row_id), F.col(text)))
    return keyed.join(got, _same("none", "doc", "tag", "e", "d", "g"), "left").drop("e", "d", "g")


def near_join(df: DataFrame, text: str = "text", row_id: str = "doc_id", **how) -> DataFrame:
    """df with copy_of and near_of (an id; the row's own where a text matches nothing) and n_links."""
    own = own_columns(df, "copy_of", "n_links", "near_of")
    id_of = lambda c: F.when(F.col(c).isNull(), F.col("row").getField(row_id).cast("long")).when(~F.col(c)["none"], F.col(c)["doc"])
    joined = _joined(df, text, row_id, **how)
    return joined.select(*unboxed(own), id_of("rep").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), id_of("near").alias("near_of"))


def one_of_each(df: DataFrame, text: str = "text", row_id: str = "doc_id", **how) -> DataFrame:
    """The first row of each group of linked texts (smallest id, rows without one last), once if it is repeated; texts without a word all stay."""
    joined = _joined(df, text, row_id, **how)
    nth = F.row_number().over(W.partitionBy("none", "doc", "tag").orderBy("tag"))
    first = F.struct("none", "doc", "tag") == F.col("near")
    return joined.where(F.col("near").isNull() | first).withColumn("nth", nth).where("near IS NULL OR nth = 1").select(*unboxed(df.columns))
