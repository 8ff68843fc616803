"""Toxicity: a logistic classifier that is penalised for what it makes of identity terms.

Features are the distinct lower-cased words of a text and their prefixes of 4 to 7 letters; a bounded number is
kept by log odds.  For each labelled sentence with an identity term, every other term of the same group is put
in its place, and the squared change of the score is added to the loss.  A group mentioned often in toxic texts
so gains no weight of its own, which lowers false positives on neutral mentions.

Groups of terms are a parameter; by default those of four languages.  Beside them terms are mined from the labelled
rows: words that at least ``SHARE`` of the texts of either label have, but that lean to one label, can each be replaced
by common words that lean to none.  Such words are what neutral texts mention and toxic ones overuse, whatever the language.

The model is fitted on at most ``max_rows`` labelled ids (those with the smallest hash; one text each, the first in order
where an id has several), and applied to every whole text.  Defined results: null counts as empty and gets the score
of a text without known words; a null id is held out; labels of one id that disagree count as toxic; null labels are
ignored; without labels of both kinds the score is the share of toxic labels (0 without labels); other columns of the
input are not read.
"""

from __future__ import annotations

import ast
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialise, split_words

FOLDS, MAX_ROWS, MAX_FEATURES, LEAST_DOCS = 5, 12_000, 4_000, 4
#: Mined terms: how many at most, how many replacements each, in what share of the texts of either label, and from what log odds on; up to what log odds a word is even.
MINED, REPLACEMENTS, SHARE, LEANS, EVEN = 24, 3, 0.01, 0.7, 0.2
PREFIXES = (4, 5, 6, 7)
#: Identity terms that may stand in for each other.
IDENTITY = (
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("women", "men"),
    ("woman", "man"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("schwarze", "weiße", "asiaten"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
    ("einwanderer", "flüchtlinge", "einheimische"),
    ("behindert", "blind", "taub"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("noirs", "blancs", "asiatiques"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "autochtones"),
    ("handicapés", "aveugles", "sourds"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("negros", "blancos", "asiáticos"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "nativos"),
    ("discapacitados", "ciegos", "sordos"),
)
SENTENCE = re.compile(r"[^.!?\n]+")
EDGE = ".,;:!?\"'()[]{}*#&%$|<>-"
Partners = dict[str, tuple[str, ...]]


class Model(NamedTuple):
    """A fitted model; pairs is how many swaps it was trained on, terms what was swapped."""

    weights: dict[str, float]
    bias: float
    pairs: int
    terms: tuple[str, ...]


def partners_of(groups: Iterable[tuple[str, ...]]) -> Partners:
    """What may stand in for each term."""
    out: dict[str, list[str]] = {}
    for group in groups:
        for term in group:
            out.setdefault(term, []).extend(x for x in group if x != term and x not in out.get(term, ()))
    return {k: tuple(v) for k, v in out.items()}


def log_odds(pos: int, neg: int, n1: int, n0: int) -> float:
    return math.log((pos + 0.5) / (n1 + 1)) - math.log((neg + 0.5) / (n0 + 1))


def mined(lean: list[str], even: list[str]) -> Partners:
    """Each leaning word with some even ones, dealt out in turn."""
    if not even:
        return {}
    return {w: tuple(dict.fromkeys(even[(k * REPLACEMENTS + j) % len(even)] for j in range(REPLACEMENTS))) for k, w in enumerate(lean)}


def tokens(text: str) -> set[str]:
    return {w for x in split_words(text.lower()) if (w := x.strip(EDGE))}


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


def text_features(words: Iterable[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def swaps(text: str, partners: Partners) -> Iterator[tuple[set[str], set[str]]]:
    """For each sentence with a term and each that may stand in for it: words before and after the swap."""
    for sentence in SENTENCE.findall(text):
        have = tokens(sentence)
        for term in have & partners.keys():
            for other in partners[term]:
                yield have, (have - {term}) | {other}


def surety(pos: int, neg: int, n1: int, n0: int) -> float:
    """How surely the odds of a feature differ from even: its log odds over their rough standard error."""
    return abs(log_odds(pos, neg, n1, n0)) / math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def with_terms(names: list[str], partners: Partners) -> list[str]:
    words = {*partners, *(x for v in partners.values() for x in v)}
    return names + sorted(text_features(words) - set(names))


def encode(text: str, at: dict[str, int], partners: Partners) -> tuple[list[int], list[tuple[tuple[int, ...], tuple[int, ...]]]]:
    """The chosen features of a text, and for each swap in it those that go and those that come."""
    words = tokens(text)
    pairs = []
    if not partners.keys().isdisjoint(words):
        for a, b in swaps(text, partners):
            x, z = text_features(a), text_features(b)
            pairs.append(tuple(tuple(sorted(at[f] for f in s if f in at)) for s in (x - z, z - x)))
    return sorted(at[f] for f in text_features(words) if f in at), pairs


def train(
    names: list[str], rows: list[list[int]], labels: list[int], pairs: Counter, counterfactual: float = 5.0, ridge: float = 3e-5, steps: int = 400
) -> tuple[dict[str, float], float]:
    """(weights, bias) of a logistic model by Adam on the full batch."""
    n1 = sum(labels)
    if not 0 < n1 < len(labels):
        share = n1 / len(labels) if labels else 0.0
        return {}, math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    y = np.array(labels, float)
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.fromiter((j for x in rows for j in x), np.int64, len(r))
    weight = np.array(list(pairs.values()), float) / max(1, sum(pairs.values()))
    pr = np.array([i for i, (g, k) in enumerate(pairs) for _ in (*g, *k)], np.int64)
    pc = np.array([j for g, k in pairs for j in (*g, *k)], np.int64)
    ps = np.array([s for g, k in pairs for s in [-1.0] * len(g) + [1.0] * len(k)], float)
    w, b = np.zeros(len(names)), math.log(n1 / (len(rows) - n1))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], len(rows)) + b, -40, 40)))
        e = (p - y) / len(rows)
        g = np.bincount(c, e[r], len(names)) + ridge * w
        if len(pr):
            change = np.bincount(pr, w[pc] * ps, len(weight))
            g += counterfactual * 2 * np.bincount(pc, (weight * change)[pr] * ps, len(names))
        g = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    return {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, float(b)


def fit(samples: list[tuple[str, int]], most: int = MAX_FEATURES, groups=IDENTITY, **how) -> Model:
    """A model from (text, label) pairs that fit in memory."""
    counts: dict[str, list[int]] = {}
    for text, label in samples:
        for f in text_features(tokens(text)):
            counts.setdefault(f, [0, 0])[label] += 1
    n1 = sum(label for _, label in samples)
    n0 = len(samples) - n1
    kept = {f: surety(n[1], n[0], n1, n0) for f, n in counts.items() if sum(n) >= LEAST_DOCS}
    odds = {f: log_odds(n[1], n[0], n1, n0) for f, n in counts.items() if not f.endswith("~") and n[1] >= SHARE * n1 and n[0] >= SHARE * n0 and sum(n) >= LEAST_DOCS}
    lean = sorted((f for f, x in odds.items() if abs(x) >= LEANS), key=lambda f: (-kept[f], f))[:MINED]
    even = sorted((f for f, x in odds.items() if abs(x) <= EVEN), key=lambda f: (-sum(counts[f]), f))[:MINED]
    partners = mined(lean, even) | partners_of(groups)
    names = with_terms(sorted(kept, key=lambda f: (-kept[f], f))[:most], partners)
    at = {f: i for i, f in enumerate(names)}
    coded = [encode(t, at, partners) for t, _ in samples]
    return _model(names, [x for x, _ in coded], [label for _, label in samples], Counter(p for _, ps in coded for p in ps), partners, **how)


def _model(names: list[str], rows: list[list[int]], labels: list[int], pairs: Counter, partners: Partners, **how) -> Model:
    return Model(*train(names, rows, labels, pairs, **how), sum(pairs.values()), tuple(sorted(partners)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for f in text_features(tokens(text or "")):
                counts.setdefault(f, [0, 0])[label] += 1
        cols = [pa.array(list(counts), pa.string()), *(pa.array([n[k] for n in counts.values()], pa.int64()) for k in (1, 0))]
        yield pa.RecordBatch.from_arrays(cols, names=["feature", "pos", "neg"])


def fit_sample(sample: DataFrame, most: int = MAX_FEATURES, groups=IDENTITY, **how) -> Model:
    """A model from a table (text, label): features and terms are counted and chosen by Spark, texts stay there.

    The driver gets ``most`` feature names, some mined terms and, for each row of the bounded sample, the numbers of those it has.
    """
    n = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    n1, n0 = n["pos"], n["n"] - n["pos"]
    if not n1 or not n0:
        return _model([], [[]] * n["n"], [1] * n1 + [0] * n0, Counter(), {})
    counts = sample.select("text", "label").mapInArrow(_counted, "feature string, pos long, neg long")
    counts = counts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= LEAST_DOCS)
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    sure = F.abs(odds) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    counts, path = materialise(counts.select("feature", "pos", "neg", odds.alias("odds"), sure.alias("sure")), "features")
    names = [r["feature"] for r in counts.orderBy(F.desc("sure"), "feature").limit(most).collect()]
    common = counts.where(~F.col("feature").endswith("~") & (F.col("pos") >= SHARE * n1) & (F.col("neg") >= SHARE * n0))
    lean = [r["feature"] for r in common.where(F.abs("odds") >= LEANS).orderBy(F.desc("sure"), "feature").limit(MINED).collect()]
    even = [r["feature"] for r in common.where(F.abs("odds") <= EVEN).orderBy(F.desc(F.col("pos") + F.col("neg")), "feature").limit(MINED).collect()]
    drop_scratch(sample.sparkSession, path)
    partners = mined(lean, even) | partners_of(groups)
    names = with_terms(names, partners)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(names)}
        for batch in batches:
            got = [encode(t or "", at, partners) for t in batch.column(0).to_pylist()]
            flat = [np.array(x, np.int32).tobytes() for x, _ in got]
            pairs = [repr(Counter(p).most_common()) for _, p in got]
            cols = [batch.column(1), pa.array(flat, pa.binary()), pa.array(pairs, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["label", "feats", "pairs"])

    rows = sample.select("text", "label").mapInArrow(coded, "label int, feats binary, pairs string").collect()
    pairs: Counter = Counter()
    for r in rows:
        if r["pairs"] != "[]":
            for pair, k in ast.literal_eval(r["pairs"]):
                pairs[pair] += k
    rows.sort(key=lambda r: (bytes(r["feats"]), r["label"]))
    pairs = Counter(dict(sorted(pairs.items())))
    return _model(names, [np.frombuffer(r["feats"], np.int32).tolist() for r in rows], [r["label"] for r in rows], pairs, partners, **how)


class Scorer:
    """Scores texts with a fitted model; remembers a bounded number of words and the features they bring."""

    MOST = 300_000

    def __init__(self, model: Model) -> None:
        self.weights, self.bias = model.weights, model.bias
        self.known: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        feats: set[str] = set()
        for raw in set(split_words((text or "").lower())):
            got = self.known.get(raw)
            if got is None:
                got = tuple(f for f in word_features(raw.strip(EDGE)) if f in self.weights)
                if len(self.known) < self.MOST:
                    self.known[raw] = got
            if got:
                feats.update(got)
        # In a fixed order, so that reruns give the same sum.
        z = self.bias + math.fsum(map(self.weights.__getitem__, feats))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def held_out(row_id: Column) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit_labelled(df: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", max_rows: int = MAX_ROWS, **how) -> Model:
    """A model of at most ``max_rows`` labelled ids that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").alias("i")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label")).orderBy(F.xxhash64("i"), "i").limit(max_rows)
    docs = df.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    # At most max_rows pairs of numbers are broadcast; one text of each id is taken, however often the id occurs.
    sample = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("i")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample, path = materialise(sample.select("text", "label"), "labelled")
    model = fit_sample(sample, **how)
    drop_scratch(df.sparkSession, path)
    return model


def score_toxicity(df: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", max_rows: int = MAX_ROWS, **how) -> DataFrame:
    """One row per row of df: doc_id, held_out, score, predicted."""
    docs = df.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(fit_labelled(df, labels, text, row_id, max_rows, **how))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    got = docs.mapInArrow(scored, f"doc_id {kind}, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
