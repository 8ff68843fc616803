"""Token files: each document's ids compressed on their own with one shared zstandard dictionary.

A file holds the documents of one run of ascending ids::

    b"BLIDS1\\0\\0" | frames | index: one (doc_id i64, null u8, offset u64, length u32, ids u32) per document | footer

The footer is (index offset u64, documents u32, bytes per id u8, sha256 of the dictionary 32 bytes, b"BLIDSEND").
A reader seeks to the footer, then to one frame, so a short document costs one small read; a file whose
dictionary hash differs from the given dictionary is refused.  ``dictionary.zdict`` and ``manifest.json`` (ids
before each file) lie beside the files.  A run goes on in a new file after ``FILE_BYTES``, so files stay small
whatever the table.  A file is written under a temporary name and renamed, and depends only on its rows, so a task
that runs again leaves the same file.

The dictionary is trained by executors' samples: at most ``SAMPLE_DOCS`` documents, chosen by a hash of the id, and of
each long one at most ``SAMPLE_PIECES`` pieces of ``PIECE_BYTES`` of its ids, evenly spread over the whole document.

Defined results: null counts as empty; a document without tokens still has its end id; rows of one id are
ordered by their ids; rows without an id come first, as one run; an empty table gives no files and no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_at_or_below, cut_points, parts_for, scratch_path, split_words

MAGIC, END_MAGIC = b"BLIDS1\0\0", b"BLIDSEND"
INDEX, FOOTER = "<qBQII", "<QIB32s8s"
INDEX_SIZE, FOOTER_SIZE = struct.calcsize(INDEX), struct.calcsize(FOOTER)
END_ID, SAMPLE_DOCS, DICT_BYTES, LEVEL = 2, 1_000, 65_536, 3
SAMPLE_PIECES, PIECE_BYTES, FILE_BYTES = 8, 2_048, 1 << 28
LEAST = -(1 << 63)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A text is the concatenation of its words' ids where the tokenizer provably never looks across white space:
    then each distinct word is encoded once, by the library, and bounded numbers of words, and of words without their
    closing marks, are remembered.  For any other kind of tokenizer whole texts are encoded.
    """

    MOST_WORDS, MOST_STEMS, ROUND_CHARS = 300_000, 600_000, 6_000_000
    #: ASCII marks but the apostrophe, which starts pieces of its own with letters behind it.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Words that are encoded as one text, with a mark between them whose id no other text has.
    JOINED, BETWEEN, LONG_WORD = 500, "|", 200

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks keep the cores busy; the library's own threads would only compete
        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = splits_at_spaces(json.loads(spec))
        self.between = self.tokenizer.encode(self.BETWEEN, add_special_tokens=False).ids
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        packed = [array(code, e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for a in packed:
                a.byteswap()
        return [a.tobytes() for a in packed]

    def _pieces(self, words: list[str]) -> list[bytes]:
        """Ids of each of these words.  Most are encoded many at a time: a call for each costs more than its ids."""
        if len(self.between) != 1:
            return self._encode(words)
        out: dict[str, bytes] = {}
        alone = [w for w in words if len(w) > self.LONG_WORD or self.BETWEEN in w]
        out.update(zip(alone, self._encode(alone), strict=True))
        rest = [w for w in words if w not in out]
        groups = [rest[i : i + self.JOINED] for i in range(0, len(rest), self.JOINED)]
        width = self.dtype.itemsize
        for group, ids in zip(groups, self._encode([f" {self.BETWEEN} ".join(g) for g in groups]), strict=True):
            at = 0
            for w, stop in zip(group, [*(width * np.flatnonzero(np.frombuffer(ids, self.dtype) == self.between[0])).tolist(), len(ids)], strict=True):
                out[w] = ids[at:stop]
                at = stop + width
        return [out[w] for w in words]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words.  Closing marks behind letters are pieces of their own, and the case of ASCII letters does not count."""
        parts = []
        for w in words:
            stem = w.rstrip(self.MARKS)
            marks = w[len(stem) :]
            plain = stem.isascii()
            # Some letters turn into a letter and a combining mark, which would join the marks behind it.
            if marks and not (stem if plain else unicodedata.normalize("NFC", stem).lower()).isalpha():
                stem, marks = w, ""
            elif plain:
                stem = stem.lower()
            parts.append((stem, marks))
        known = self.stems
        new = list({x for part in parts for x in part if x and x not in known})
        fresh = dict(zip(new, self._pieces(new), strict=True))
        if len(known) < self.MOST_STEMS:
            known.update(fresh)
        fresh[""] = b""
        get = lambda x: fresh[x] if x in fresh else known[x]
        return {w: get(a) + get(b) for w, (a, b) in zip(words, parts, strict=True)}

    def batch(self, texts: list[str]) -> list[bytes]:
        """All ids of each text and the end id, little-endian in the width of the vocabulary."""
        end = np.array([END_ID], self.dtype).tobytes()
        if not self.by_word:
            return [ids + end for ids in self._encode(texts)]
        out, i = [], 0
        while i < len(texts):  # some texts at a time, so that few words are held and the library gets many at once
            words, size = [], 0
            while i < len(texts) and (not words or size < self.ROUND_CHARS):
                words.append(split_words(texts[i]))
                size += len(texts[i])
                i += 1
            ids = {w: self.words.get(w) for w in set().union(*words)}
            fresh = self._words([w for w, got in ids.items() if got is None])
            ids.update(fresh)
            if len(self.words) < self.MOST_WORDS:
                self.words.update(fresh)
            out += [b"".join(map(ids.__getitem__, ws)) + end for ws in words]
        return out


def splits_at_spaces(spec: dict) -> bool:
    """Does this tokenizer give a text the ids of its words one after the other?

    It does if it turns white space into blanks at first, cuts at pieces that hold no blank, adds none itself, and has
    no added token with one.  NFC and lower-casing work inside a word: a blank composes with nothing and no case
    rule for letters looks past one.  By the same pattern letters and the marks behind them are different pieces, and as
    there is lower-casing ASCII letters may be lower-cased before.
    """
    norm = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    plain = all(x == blanks or x["type"] in ("NFC", "Lowercase") for x in norm) and blanks in norm and {"type": "Lowercase"} in norm
    # Known patterns of runs of letters, single digits, runs of other marks and English endings, none with a blank.
    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    cut = [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": words} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    tokens = spec.get("added_tokens") or []
    apart = all(not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in tokens)
    whole = not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
    return bool(plain and cut and not pre[1]["add_prefix_space"] and apart and whole)


_encoders: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One encoder for a Python worker, whose memories then serve all its tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def train_dictionary(arrays: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary from serialized id arrays; their raw content where there are too few to train one."""
    if not arrays:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, arrays)) // 8)), arrays, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[-size:]


def spread(ids: bytes) -> list[bytes]:
    """A document's ids, or evenly spread pieces of them where they are long."""
    if len(ids) <= SAMPLE_PIECES * PIECE_BYTES:
        return [ids]
    step = (len(ids) - PIECE_BYTES) // (SAMPLE_PIECES - 1) // 4 * 4
    return [ids[i * step : i * step + PIECE_BYTES] for i in range(SAMPLE_PIECES)]


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def read_footer(blob: bytes, dictionary: bytes) -> tuple[int, int, np.dtype]:
    """(index offset, documents, id type) of a file's bytes."""
    at, n, width, sha, end = struct.unpack_from(FOOTER, blob, len(blob) - FOOTER_SIZE)
    if end != END_MAGIC or blob[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    if sha != hashlib.sha256(dictionary).digest():
        raise ValueError("the file was written with another dictionary")
    return at, n, np.dtype(f"<u{width}")


def read_document(blob: bytes, i: int, dictionary: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of the i-th document of a file."""
    at, n, dtype = read_footer(blob, dictionary)
    if not 0 <= i < n:
        raise IndexError(i)
    doc_id, null, offset, length, count = struct.unpack_from(INDEX, blob, at + i * INDEX_SIZE)
    raw = zstandard.ZstdDecompressor(dict_data=_dict(dictionary)).decompress(blob[offset : offset + length])
    return None if null else doc_id, np.frombuffer(raw, dtype, count)


def write_token_files(df: DataFrame, tokenizer_file: str, folder: str, text: str = "text", row_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> list[dict]:
    """Write df's ids under ``folder`` and return the manifest: file, run, documents, tokens, tokens before.

    The dictionary is trained on pieces of ``sample_docs`` documents at most (with the bounds above 16 MB), which
    executors encode; every document is encoded whole.  Compressed documents, not texts, are exchanged.
    """
    spark = df.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    rows = df.select(F.coalesce(F.col(row_id).cast("long"), F.lit(LEAST)).alias("_key"), F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = rows.select("_key").count()
    if not n:
        return []
    share = F.lit(max(1, n // sample_docs))
    chosen = rows.where(F.pmod(F.xxhash64("_key"), share) == 0).select("text").limit(sample_docs)
    vocabulary = spark.sparkContext.broadcast(spec)  # one file of a fixed size

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary.value)
        for batch in batches:
            pieces = [p for t in batch.column(0).to_pylist() for ids in enc.batch([t or ""]) for p in spread(ids)]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], names=["piece"])

    pieces = chosen.mapInArrow(sampled, "piece binary").toArrow().column(0).to_pylist()
    dictionary = train_dictionary(sorted(pieces))
    shared = spark.sparkContext.broadcast((spec, dictionary))  # a vocabulary file and at most DICT_BYTES
    points = cut_points(rows, "_key", parts_for(spark, n))
    width = Encoder(spec).dtype.itemsize

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, dictionary = shared.value
        enc, pack = _encoder(spec), zstandard.ZstdCompressor(LEVEL, dict_data=_dict(dictionary), write_dict_id=False, write_checksum=False)
        for batch in batches:
            runs, ids, texts = (batch.column(i) for i in range(3))
            raw = enc.batch([t or "" for t in texts.to_pylist()])
            # Rows of one id are ordered by what they hold.
            tie = [zlib.crc32(x) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [runs, ids, pa.array(tie, pa.int64()), pa.array([len(x) // width for x in raw], pa.int64()), pa.array([pack.compress(x) for x in raw], pa.binary())],
                names=["run", "doc_id", "tie", "n_tokens", "frame"],
            )

    run = count_at_or_below(F.col("_key"), points)
    frames = rows.select(run.cast("int").alias("run"), "doc_id", "text").mapInArrow(compressed, "run int, doc_id long, tie long, n_tokens long, frame binary")
    # Runs are dealt by their number, so that no task gets several while another has none.
    frames = frames.repartitionById(len(points) + 1, F.col("run")).sortWithinPartitions("run", F.col("doc_id").asc_nulls_first(), "tie")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, writer, done = shared.value[1], None, []
        for batch in batches:
            for run, doc_id, _, n_tokens, frame in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if writer is None or writer.run != run or writer.at >= FILE_BYTES:
                    part = writer.part + 1 if writer and writer.run == run else 0
                    if writer:
                        done.append(writer.close())
                    writer = _Writer(folder, run, part, width, dictionary)
                writer.add(doc_id, n_tokens, frame)
        if writer:
            done.append(writer.close())
        if done:
            names = ["run", "part", "file", "documents", "tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)

    made = sorted(frames.mapInArrow(written, "run long, part long, file string, documents long, tokens long").collect())  # one row per file
    manifest, before = [], 0
    for r in made:
        manifest.append(r.asDict() | {"before": before})
        before += r["tokens"]
    fs, at = pa.fs.FileSystem.from_uri(folder)
    for name, data in (("dictionary.zdict", dictionary), ("manifest.json", json.dumps(manifest).encode())):
        with fs.open_output_stream(f"{at}/{name}") as out:
            out.write(data)
    return manifest


class _Writer:
    def __init__(self, folder: str, run: int, part: int, width: int, dictionary: bytes) -> None:
        self.fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(at, recursive=True)
        self.run, self.part, self.name = run, part, f"{at}/run-{run:06d}-{part:04d}.ids"
        self.temporary = f"{at}/.run-{run:06d}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.at, self.index, self.tokens, self.width, self.sha = len(MAGIC), [], 0, width, hashlib.sha256(dictionary).digest()

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        self.out.write(frame)
        self.index.append(struct.pack(INDEX, doc_id or 0, doc_id is None, self.at, len(frame), n_tokens))
        self.at += len(frame)
        self.tokens += n_tokens

    def close(self) -> tuple[int, int, str, int, int]:
        self.out.write(b"".join(self.index) + struct.pack(FOOTER, self.at, len(self.index), self.width, self.sha, END_MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.name)
        return self.run, self.part, self.name.rpartition("/")[2], len(self.index), self.tokens


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    dictionary, manifest = (fs.open_input_stream(f"{at}/{name}").read() for name in ("dictionary.zdict", "manifest.json"))
    # One entry of some 100 bytes per file of up to FILE_BYTES.
    shared = spark.sparkContext.broadcast((dictionary, {x["file"]: x["before"] for x in json.loads(manifest)}))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, before = shared.value
        unpack = zstandard.ZstdDecompressor(dict_data=_dict(dictionary))
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                blob, start = memoryview(content.as_buffer()), before[path.as_py().rpartition("/")[2]]
                at, n, dtype = read_footer(bytes(blob[: len(MAGIC)]) + bytes(blob[-FOOTER_SIZE :]), dictionary)
                out = []
                for doc_id, null, offset, length, count in struct.iter_unpack(INDEX, blob[at : at + n * INDEX_SIZE]):
                    ids = np.frombuffer(unpack.decompress(blob[offset : offset + length]), dtype, count).astype("<u4")
                    out.append((None if null else doc_id, start, count, zlib.crc32(ids.tobytes())))
                    start += count
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "run-*.ids").load(folder).select("path", "content")
    return files.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer_file: str, **how) -> DataFrame:
    """Write df's token files to the shared scratch folder and read them back."""
    spark = df.sparkSession
    folder = scratch_path(spark, "token-files")
    if not write_token_files(df, tokenizer_file, folder, **how):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder)
