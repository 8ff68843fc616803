"""Image headers: sizes and tags from the first bytes of JPEG, PNG and TIFF-like files (DNG and many raw files); pixels are never read.

``register_source(spark)`` adds the data source ``photo_headers``: ``spark.read.format("photo_headers").load(folder)`` lists the photos of
a folder (option ``recursive``), deals them over tasks (``filesPerTask``) and reads ranges of each file through pyarrow.fs, so a folder may be on
any storage that it knows.  ``tag_rows`` does the same walk over a binary column.

The walk goes through the first directory and those of exposure, position and interoperability tags that it points to, with a queue; a directory that was
met before is not entered again, and numbers of directories, entries and bytes of a value are bounded.  Bytes-valued tags (maker notes,
profiles) are left out.  Whatever is damaged yields what was read before it, and ``error``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from burstlake.functions import metadata as M

from .tables import IMAGE_SUFFIXES, RAW_SUFFIXES

MOST_DIRECTORIES, MOST_ENTRIES, MOST_BYTES = 32, 4096, 1 << 16
#: Tags that point to directories, tags without text value, and names, by number.
POINTERS = {34665: "exif", 34853: "gps", 40965: "interop"}
BLOBS = {"MakerNote", "ICC_Profile", "InterColorProfile", "PrintIM", "Padding"}
NAMES = {
    256: "ImageWidth", 257: "ImageLength", 271: "Make", 272: "Model", 274: "Orientation", 306: "DateTime", 33434: "ExposureTime", 33437: "FNumber", 34675: "InterColorProfile",
    34855: "ISOSpeedRatings", 36867: "DateTimeOriginal", 37386: "FocalLength", 37500: "MakerNote", 37521: "SubsecTimeOriginal", 41989: "FocalLengthIn35mmFilm", 42034: "LensSpecification",
    42035: "LensMake", 42036: "LensModel", 50341: "PrintIM", 59932: "Padding",
}
GPS_NAMES = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude"}
#: Bytes and format of the twelve value types.
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I")}
Fetch = Callable[[int, int], bytes]
Tag = tuple[str, int, str, list[float] | None, str | None]  # directory, number, name, numbers, text


@dataclass
class Header:
    width: int | None = None
    height: int | None = None
    error: str | None = None


def _read(fetch: Fetch, at: int, n: int) -> bytes:
    got = fetch(at, n)
    if len(got) < n:
        raise ValueError("the file ends early")
    return got


def _value(raw: bytes, kind: int, count: int, order: str) -> tuple[list[float] | None, str | None]:
    size, form = KINDS[kind]
    if form == "s":
        try:
            return None, raw.rstrip(b"\0").decode("utf-8")
        except UnicodeDecodeError:
            return None, None
    if len(form) == 2:
        pairs = struct.unpack(f"{order}{form * count}", raw)
        numbers = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
    else:
        numbers = [float(x) for x in struct.unpack(f"{order}{count}{form}", raw)]
    sound = all(x is not None and x - x == 0 for x in numbers)
    return (numbers if sound else None), None


def walk(fetch: Fetch, base: int = 0, pointers: dict[int, str] = POINTERS) -> Iterator[Tag]:
    """The tags of a TIFF structure that starts at ``base``."""
    head = _read(fetch, base, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(f"{order}H", head[2:4])[0] != 42:
        raise ValueError("no TIFF header")
    queue, seen = [(struct.unpack(f"{order}I", head[4:])[0], "image")], set()
    while queue:
        at, directory = queue.pop(0)
        if at in seen or at == 0:
            continue
        seen.add(at)
        if len(seen) > MOST_DIRECTORIES:
            raise ValueError("too many directories")
        n = struct.unpack(f"{order}H", _read(fetch, base + at, 2))[0]
        if n > MOST_ENTRIES:
            raise ValueError("too many entries")
        entries = _read(fetch, base + at + 2, 12 * n)
        names = GPS_NAMES if directory == "gps" else NAMES
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", entries, 12 * k)
            if tag in pointers and directory != "gps":
                queue.append((struct.unpack_from(f"{order}I", entries, 12 * k + 8)[0], pointers[tag]))
                continue
            name = names.get(tag, str(tag))
            size = KINDS[kind][0] * count if kind in KINDS else MOST_BYTES + 1
            if name in BLOBS or size > MOST_BYTES:
                continue
            raw = entries[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else _read(fetch, base + struct.unpack_from(f"{order}I", entries, 12 * k + 8)[0], size)
            numbers, text = _value(raw, kind, count, order)
            if numbers is not None or text is not None:
                yield directory, tag, name, numbers, text


def _jpeg(fetch: Fetch, header: Header) -> Iterator[Tag]:
    at, seen = 2, False
    while True:
        mark = _read(fetch, at, 4)
        if mark[0] != 0xFF:
            raise ValueError("a segment does not start with a marker")
        code, size = mark[1], struct.unpack(">H", mark[2:])[0]
        if code == 0xFF:
            at += 1
            continue
        if code == 0x01 or 0xD0 <= code <= 0xD8:
            at += 2
            continue
        if code in (0xD9, 0xDA):
            return
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            header.height, header.width = struct.unpack(">HH", _read(fetch, at + 5, 4))
        if code == 0xE1 and not seen and _read(fetch, at + 4, 6) == b"Exif\0\0":
            seen = True
            try:
                yield from walk(fetch, at + 10)
            except (ValueError, struct.error) as e:
                header.error = str(e)
        at += 2 + size


def _png(fetch: Fetch, header: Header) -> Iterator[Tag]:
    at = 8
    while True:
        size, kind = struct.unpack(">I4s", _read(fetch, at, 8))
        if kind == b"IHDR":
            header.width, header.height = struct.unpack(">II", _read(fetch, at + 8, 8))
        elif kind == b"eXIf":
            yield from walk(fetch, at + 8)
        elif kind == b"IEND":
            return
        at += 12 + size


def read_header(fetch: Fetch) -> tuple[Header, list[Tag]]:
    """Size and tags of one file, of which ``fetch(start, length)`` gives bytes."""
    header, tags = Header(), []
    try:
        start = fetch(0, 8)
        of = _jpeg if start[:2] == b"\xff\xd8" else _png if start == b"\x89PNG\r\n\x1a\n" else None
        for tag in of(fetch, header) if of else walk(fetch):
            tags.append(tag)
            if of is None and tag[0] == "image" and tag[1] in (256, 257) and tag[3]:
                setattr(header, "width" if tag[1] == 256 else "height", int(tag[3][0]))
    except (ValueError, struct.error, OSError) as e:
        header.error = str(e)
    return header, tags


TAG = T.StructType().add("directory", "string").add("tag", "integer").add("name", "string").add("numbers", T.ArrayType(T.DoubleType())).add("text", "string")
SCHEMA = T.StructType().add("path", "string").add("size_bytes", "long").add("width", "integer").add("height", "integer").add("tags", T.ArrayType(TAG)).add("error", "string")


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.per_task = options["path"], int(options.get("filespertask", 500))
        self.recursive = str(options.get("recursive", "false")).lower() == "true"

    def partitions(self) -> list[_Files]:
        import pyarrow.fs

        fs, at = _filesystem(self.path)
        listed = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=self.recursive)) if fs.get_file_info(at).type == pyarrow.fs.FileType.Directory else [fs.get_file_info(at)]
        suffixes = (*IMAGE_SUFFIXES, *RAW_SUFFIXES)
        found = sorted((f.path, f.size) for f in listed if f.type == pyarrow.fs.FileType.File and f.path.lower().endswith(suffixes))
        return [_Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, _ = _filesystem(self.path)
        for path, size in partition.files:
            try:
                with fs.open_input_file(path) as file:

                    def fetch(at: int, n: int, file=file, size=size) -> bytes:
                        return file.read_at(min(n, max(0, size - at)), at) if at < size else b""

                    header, tags = read_header(fetch)
            except OSError as e:
                header, tags = Header(error=str(e)), []
            yield path, size, header.width, header.height, tags, header.error


def _filesystem(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


class PhotoHeaders(DataSource):
    """path, size_bytes, width, height, tags, error of each photo of a folder."""

    @classmethod
    def name(cls) -> str:
        return "photo_headers"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(PhotoHeaders)


def tag_rows(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, width, height, tags and error for a column of file contents (or their first bytes)."""
    out = T.StructType([df.schema[key], *SCHEMA.fields[2:]])
    tag_t = pa.list_(pa.struct([("directory", pa.string()), ("tag", pa.int32()), ("name", pa.string()), ("numbers", pa.list_(pa.float64())), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_header(lambda at, n, body=body.as_py() or b"": body[at : at + n]) for body in batch.column(1)]
            tags = [[dict(zip(TAG.names, t, strict=True)) for t in tags] for _, tags in got]
            sizes = [pa.array([getattr(h, c) for h, _ in got], pa.int32()) for c in ("width", "height")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array(tags, tag_t), pa.array([h.error for h, _ in got], pa.string())], names=out.names)

    return df.select(key, F.col(content).cast("binary").alias("body")).mapInArrow(run, out)


def photo_metadata(headers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Capture metadata from rows with path, size_bytes, width, height and tags; tags met later win.  Columns ``keep`` go along."""
    last = lambda name: F.element_at(F.filter("tags", lambda t: t["name"] == name), -1)
    tag = lambda name: F.when(F.size(F.filter("tags", lambda t: t["name"] == name)) > 0, last(name))
    number = lambda name: _positive(F.get(tag(name)["numbers"], F.lit(0)))
    text = lambda name: F.nullif(F.trim(tag(name)["text"]), F.lit(""))
    size = M.oriented(F.col("width"), F.col("height"), F.coalesce(F.get(tag("Orientation")["numbers"], F.lit(0)), F.lit(1.0)))
    lens = M.lens_range(tag("LensSpecification")["numbers"], tag("LensModel")["text"])
    focal, focal35 = number("FocalLength"), number("FocalLengthIn35mmFilm")
    return headers.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "size_bytes", size["width"].alias("width"), size["height"].alias("height"), number("ISOSpeedRatings").alias("iso"),
        number("FNumber").alias("aperture"), number("ExposureTime").alias("exposure_time"), focal.alias("focal_length"), lens.alias("lens_focal_range"), focal35.alias("focal_length_35mm"),
        M.range_35mm(focal, focal35, lens).alias("lens_focal_range_35mm"), F.coalesce(text("Model"), text("Make")).alias("camera_model"), text("LensModel").alias("lens_model"), *keep,
    )


def _positive(x):
    return F.when(x > 0, x)
