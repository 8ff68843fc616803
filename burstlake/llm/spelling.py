"""Spelling variants by full neighbourhood generation.

Words are counted, then every word emits all distinct strings one deletion, replacement or insertion away over
the letters that the vocabulary has, and the strings are hash-joined to the vocabulary: a string that meets a word *is*
that word, so no distance is worked out.

A word of 10 letters has some 900 such strings, nearly all of which are no word.  They are made as 64-bit names (the
exclusive or of one random number for each letter at each place, so a changed string's name takes a few steps) and
looked up in a filter of the vocabulary before any string is written out or shuffled: a bit set of at most
``FILTER_BITS`` bits, whatever the size of the vocabulary.  What it lets through by chance finds no partner in the join.

Each distinct string comes once: of equal neighbouring letters only the last is deleted, a letter is inserted
only where the next one differs, and a letter is replaced by another one only.

A word's form is its most frequent near word if that is ``ratio`` times as frequent or more; roots follow forms to the
end.  Counts grow by the ratio at each step, so following ends, and by doubling the steps in a few joins.

Defined results: null and empty texts have no words; a row without id counts as one of an empty id; ties go to the smallest word in code-point order; repeated
rows count again; an empty table gives an empty one; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialise, parts_for

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Most bits of the filter (64 MB), bits for each word, strings named at a time, and when a word counts as long.
FILTER_BITS, BITS_A_WORD, CHUNK, LONG = 29, 32, 1 << 21, 48
#: Looks into the filter for a string, and for one of a long word, which is costly to write out.
LOOKS, LONG_LOOKS = 2, 12
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit number for each 64-bit number."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def named(places: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The number of a letter (code point) at a place; a string's name is the exclusive or of its letters' numbers."""
    return mixed(places.astype(np.uint64) << np.uint64(21) | letters.astype(np.uint64))


def looks(names: np.ndarray, bits: int, n: int) -> Iterator[np.ndarray]:
    """The places of the filter that a name stands for."""
    for k in range(n):
        yield (names if k == 0 else mixed(names + np.uint64(k))) >> np.uint64(64 - bits)


def points(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length)


def word_names(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        of = np.flatnonzero(lengths == length)
        step = max(1, CHUNK // max(1, length))
        for at in range(0, len(of), step):
            rows = of[at : at + step]
            for begin in range(0, length, CHUNK):
                part = [words[i][begin : begin + CHUNK] for i in rows.tolist()]
                letters = points(part, len(part[0]))
                out[rows] ^= np.bitwise_xor.reduce(named(begin + np.arange(letters.shape[1]), letters), axis=1)
    return out


def passing(bitset: np.ndarray, bits: int, names: np.ndarray, n: int) -> np.ndarray:
    """Flat places of the names that the filter lets through."""
    kept = None
    for k in range(n):
        at = names if kept is None else names[kept]
        place = next(looks(at, bits, 1)) if k == 0 else mixed(at + np.uint64(k)) >> np.uint64(64 - bits)
        hit = np.flatnonzero(bitset[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        kept = hit if kept is None else kept[hit]
    return kept


def neighbours(words: list[str], length: int, alphabet: np.ndarray, bitset: np.ndarray, bits: int) -> Iterator[tuple[int, str]]:
    """(word number, string) for all strings one edit from words of one length that the filter lets through."""
    letters = points(words, length)
    m, size = len(words), len(alphabet)
    tries = LOOKS if length <= LONG else LONG_LOOKS
    own = named(np.arange(length), letters)
    moved_left = np.zeros((m, length + 1), np.uint64)  # names of what is right of a place, moved by one
    moved_right = np.zeros((m, length + 1), np.uint64)
    if length > 1:
        back = lambda x: np.bitwise_xor.accumulate(x[:, ::-1], axis=1)[:, ::-1]
        moved_left[:, : length - 1] = back(named(np.arange(length - 1), letters[:, 1:]))
    moved_right[:, :length] = np.bitwise_xor.accumulate(named(np.arange(1, length + 1), letters)[:, ::-1], axis=1)[:, ::-1]
    before = np.zeros((m, length + 1), np.uint64)  # names of what is left of a place
    before[:, 1:] = np.bitwise_xor.accumulate(own, axis=1)
    whole = before[:, -1:]
    # Deletions: the last of equal neighbours.
    last = np.ones((m, length), bool)
    last[:, :-1] = letters[:, :-1] != letters[:, 1:]
    for f in passing(bitset, bits, (before[:, :-1] ^ moved_left[:, :length]).ravel(), tries).tolist():
        w, i = divmod(f, length)
        if last[w, i]:
            yield w, words[w][:i] + words[w][i + 1 :]
    # Replacements and insertions, some places at a time.
    codes = list(map(chr, alphabet.tolist()))
    step = max(1, CHUNK // (m * size))
    for begin in range(0, length + 1, step):
        stop = min(begin + step, length + 1)
        new = named(np.repeat(np.arange(begin, stop), size), np.tile(alphabet, stop - begin)).reshape(1, stop - begin, size)
        put = (before[:, begin:stop] ^ moved_right[:, begin:stop])[:, :, None] ^ new
        for f in passing(bitset, bits, put.ravel(), tries).tolist():
            w, i, c = f // ((stop - begin) * size), f // size % (stop - begin) + begin, codes[f % size]
            word = words[w]
            if i == length or word[i] != c:
                yield w, word[:i] + c + word[i:]
        end = min(stop, length)
        if begin < end:
            put = (whole ^ own[:, begin:end])[:, :, None] ^ new[:, : end - begin]
            for f in passing(bitset, bits, put.ravel(), tries).tolist():
                w, i, c = f // ((end - begin) * size), f // size % (end - begin) + begin, codes[f % size]
                word = words[w]
                if word[i] != c:
                    yield w, word[:i] + c + word[i + 1 :]


def filter_bits(count: int) -> int:
    """The filter's size for so many words, as a power of two."""
    return max(16, min(FILTER_BITS, (max(1, count) * BITS_A_WORD - 1).bit_length()))


def vocabulary_filter(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The bit set of a table of words: put together on executors in 64-bit pieces, of which the driver gets 2^bits / 64 at most."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            names, long = word_names(words), np.fromiter(map(len, words), np.int64, len(words)) + 1 >= LONG
            at = np.concatenate([*looks(names, bits, LOOKS), *list(looks(names[long], bits, LONG_LOOKS))[LOOKS:]])
            piece, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(piece), np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int64)), pa.array(value.view(np.int64))], names=["piece", "value"])

    pieces = vocabulary.select("word").mapInArrow(placed, "piece long, value long").groupBy("piece").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[pieces.column("piece").to_numpy()] = pieces.column("value").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of words of a table (word, n) that differ by one edit, both ways round."""
    spark = vocabulary.sparkSession
    count = vocabulary.count()
    bits = filter_bits(count)
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint32)  # letters of a language, not rows
    sent = spark.sparkContext.broadcast((alphabet, vocabulary_filter(vocabulary, bits)))

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, bitset = sent.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            by_length: dict[int, list[str]] = {}
            for w in words:
                by_length.setdefault(len(w), []).append(w)
            sources, strings = [], []
            for length, each in sorted(by_length.items()):
                step = max(1, CHUNK // (8 * max(1, length)))
                for at in range(0, len(each), step):
                    part = each[at : at + step]
                    chars = 0
                    for w, string in neighbours(part, length, alphabet, bitset, bits):
                        sources.append(part[w])
                        strings.append(string)
                        chars += 2 * length
                        if chars >= CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(strings, pa.string())], names=["word", "string"])
                            sources, strings, chars = [], [], 0
            if sources:
                yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(strings, pa.string())], names=["word", "string"])

    # A few MB of words are minutes of work: they are dealt over many tasks.
    strings = vocabulary.select("word").repartition(parts_for(spark, count), "word").mapInArrow(emitted, "word string, string string")
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return strings.hint("shuffle_hash").join(known.hint("shuffle_hash"), F.col("string") == F.col("near")).select("word", "near", "near_n")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) whose forms lead to ends: those that have no form of their own."""
    spark = forms.sparkSession
    at, path = materialise(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("ended")), "forms")
    while True:
        step = at.select(F.col("word").alias("w"), F.col("root").alias("r"), F.col("ended").alias("e"))
        moved = at.where("NOT ended").join(step, F.col("root") == F.col("w"), "left")
        # Two steps at once; a root without a row has no form, and neither has one that has ended.
        moved = moved.select("word", F.coalesce("r", "root").alias("root"), (F.col("w").isNull() | F.col("e")).alias("ended"))
        before, (at, path) = path, materialise(at.where("ended").unionAll(moved), "forms")
        drop_scratch(spark, before)
        if at.where("NOT ended").isEmpty():
            return at.select("word", "root")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Of a table (word, n) of distinct words: word, form, root, n, n_near, form_n."""
    vocabulary, _ = materialise(words.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best")
    near = near_pairs(vocabulary).groupBy(F.col("word").alias("w")).agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = vocabulary.join(near, F.col("word") == F.col("w"), "left")
    has = -F.col("best")["m"] >= ratio * F.col("n")
    form, form_n = F.when(has, F.col("best")["near"]), F.when(has, -F.col("best")["m"])
    grouped, _ = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), form_n.alias("form_n")), "near-words")
    roots = followed(grouped.where("form IS NOT NULL").select("word", "form")).select(F.col("word").alias("w"), "root")
    out = grouped.join(roots, F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def counted_words(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of a table (word, n) of partial counts."""
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_words(df: DataFrame, text: str = "text", row_id: str = "doc_id", least: int = LEAST_LENGTH, typo_every: int = 0, dictionary: int = 200_000) -> DataFrame:
    """(word, n): counts of the maximal runs of letters of at least ``least`` letters, per task; only A-Z is lower-cased.

    With ``typo_every`` the checksum of "<id>:<word>" decides which words of a row lose a letter (in n rows of
    ``typo_every`` times as many), at the place checksum modulo length.
    """
    run = re.compile(f"[{LETTERS}]{{{least},}}")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        shape = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for key, text in zip(*(batch.column(i) for i in range(2)), strict=True):
                each: Counter[str] = Counter()
                for w, n in Counter(run.findall(text.as_py() or "")).items():
                    each[w.lower() if w.isascii() else w.translate(lower)] += n
                head = f"{key.as_py() if key.is_valid else ''}:"
                for w, n in each.items():
                    if typo_every:
                        h = zlib.crc32((head + w).encode())
                        if h % typo_every == 0:
                            h %= len(w)
                            w = w[:h] + w[h + 1 :]
                            if len(w) < least:
                                continue
                    total[w] += n
                if len(total) >= dictionary:
                    yield shape(total)
                    total.clear()
        if total:
            yield shape(total)

    return df.select(F.col(row_id).alias("doc"), F.col(text).alias("text")).mapInArrow(counted, "word string, n long")


def variants(df: DataFrame, text: str = "text", row_id: str = "doc_id", ratio: int = RATIO, typo_every: int = 0) -> DataFrame:
    """The spelling groups of the words of a table of texts."""
    return spelling_groups(counted_words(letter_words(df, text, row_id, typo_every=typo_every)), ratio)

