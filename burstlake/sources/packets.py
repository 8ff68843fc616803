"""Settings in XML beside photos (XMP packets): reading, merging into what is there, and a sink that commits all files or none.

A merge edits the text of the packet: of the first ``rdf:Description`` it replaces, adds or drops the named properties and leaves every
other byte as it was, so properties of other programs, prefixes, quotes, comments and layout survive.  A property is an attribute or a child element; whichever
there is gives way.  Namespaces decide what a name means, never prefixes.

``register_sink(spark)`` adds the data source ``sidecars``: ``df.write.format("sidecars").mode("append").save(folder)`` for rows (sidecar, settings).  Tasks
read, merge and write staging files into a folder beside the sidecars; only when all tasks have ended are these renamed, and when one fails the folder is deleted.

Packets that are not well-formed, not UTF-8, have a DOCTYPE or no place for settings are errors: nothing is written over what cannot be read.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .headers import _filesystem

#: The namespaces of packets and of the raw converter's settings.
RDF, META, CRS, XML = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "adobe:ns:meta/", "http://ns.adobe.com/camera-raw-settings/1.0/", "http://www.w3.org/XML/1998/namespace"
PREFIXES = {CRS: "crs", RDF: "rdf"}
EMPTY = f'<x:xmpmeta xmlns:x="{META}"><rdf:RDF xmlns:rdf="{RDF}"><rdf:Description rdf:about=""/></rdf:RDF></x:xmpmeta>'
ATTRIBUTE = re.compile(rb"""\s+([^\s=<>"']+)\s*=\s*("[^"<]*"|'[^'<]*')""")
Name = tuple[str, str]  # namespace, local name
Value = str | list[str] | None  # text, the items of a sequence, or none: the property goes


@dataclass
class Child:
    name: Name
    start: int
    stop: int = -1
    text: list[str] = field(default_factory=list)
    items: list[str] = field(default_factory=list)


@dataclass
class Packet:
    """The first description of a packet: where its tag and children stand, its attributes, and prefixes in scope."""

    body: bytes
    start: int = -1
    tag_stop: int = -1
    prefixes: dict[str, str] = field(default_factory=dict)
    attributes: dict[Name, str] = field(default_factory=dict)
    children: list[Child] = field(default_factory=list)
    depth: int = -1
    open: bool = False


def _name(full: str) -> Name:
    space, _, local = full.rpartition("\n")
    return space, local


def parse(body: bytes) -> Packet:
    packet, path = Packet(body), []
    spaces: dict[str, list[str]] = {}
    reader = expat.ParserCreate("UTF-8", "\n")
    reader.buffer_text = True

    def started(full: str, attributes: dict[str, str]) -> None:
        depth, at = len(path), reader.CurrentByteIndex
        path.append(full)
        if packet.start < 0 and not packet.open and _name(full) == (RDF, "Description"):
            packet.start, packet.depth = at, depth
            packet.attributes = {_name(k): v for k, v in attributes.items()}
            packet.prefixes = {p: s[-1] for p, s in spaces.items() if s}
            packet.open = True
        elif packet.open:
            if depth == packet.depth + 1:
                packet.children.append(Child(_name(full), at))
            elif _name(full) == (RDF, "li"):
                packet.children[-1].items.append("")

    def ended(full: str) -> None:
        path.pop()
        if packet.open:
            if len(path) == packet.depth:
                packet.open = False
            elif len(path) == packet.depth + 1:
                child, at = packet.children[-1], reader.CurrentByteIndex
                child.stop = body.index(b">", at) + 1 if body[at : at + 2] == b"</" else _tag_stop(body, child.start)

    def text(data: str) -> None:
        if packet.open and packet.children and packet.children[-1].stop < 0:
            child = packet.children[-1]
            if len(path) == packet.depth + 2:
                child.text.append(data)
            elif child.items and _name(path[-1]) == (RDF, "li"):
                child.items[-1] += data

    def refused(*_: object) -> None:
        raise ValueError("a packet with a document type")

    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler, reader.StartDoctypeDeclHandler = started, ended, text, refused
    reader.StartNamespaceDeclHandler = lambda p, s: spaces.setdefault(p or "", []).append(s or "")
    reader.EndNamespaceDeclHandler = lambda p: spaces[p or ""].pop()
    try:
        reader.Parse(body, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    if packet.start < 0:
        raise ValueError("no description")
    packet.tag_stop = _tag_stop(body, packet.start)
    return packet


def _tag_stop(body: bytes, start: int) -> int:
    quote, at = b"", start
    while True:
        c = body[at : at + 1]
        if quote:
            quote = b"" if c == quote else quote
        elif c in (b'"', b"'"):
            quote = c
        elif c == b">":
            return at + 1
        at += 1


def values(body: bytes) -> dict[Name, str | list[str]]:
    """The properties of a packet: texts, and lists of sequences."""
    packet = parse(body)
    out: dict[Name, str | list[str]] = {n: v for n, v in packet.attributes.items() if n != (RDF, "about")}
    for c in packet.children:
        out[c.name] = c.items if c.items else "".join(c.text).strip()
    return out


def merge(body: bytes | None, settings: dict[Name, Value]) -> bytes:
    """The packet with these properties set (or dropped) and all else as it was; a new packet for none."""
    packet = parse(body if body is not None else EMPTY.encode())
    body = packet.body
    tag = body[packet.start : packet.tag_stop]
    closed = tag.endswith(b"/>")
    scope = dict(packet.prefixes)

    def meaning(raw: str) -> Name:
        prefix, colon, local = raw.rpartition(":")
        return ((XML if prefix == "xml" else scope.get(prefix, "")) if colon else "", local)

    todo = dict(settings)
    edited, at = b"", 0
    for m in ATTRIBUTE.finditer(tag):
        name = meaning(m[1].decode())
        if name not in settings:
            continue
        edited += tag[at : m.start()]
        value = todo.pop(name)
        if isinstance(value, str):
            edited += tag[m.start() : m.start(2)] + quoteattr(value).encode()
        elif value is not None:
            todo[name] = value
        at = m.end()
    edited += tag[at : len(tag) - (2 if closed else 1)]
    by_space = {s: p for p, s in scope.items() if p}

    def prefixed(name: Name) -> tuple[str, bytes]:
        space, local = name
        if not space:
            return local, b""
        if space in by_space:
            return f"{by_space[space]}:{local}", b""
        n, wish = 0, PREFIXES.get(space, "ns")
        prefix = wish
        while prefix in scope:
            n += 1
            prefix = f"{wish}{n}"
        scope[prefix], by_space[space] = space, prefix
        return f"{prefix}:{local}", f" xmlns:{prefix}={quoteattr(space)}".encode()

    added = b""
    for name, value in todo.items():
        if value is None:
            continue
        raw, declared = prefixed(name)
        edited += declared
        if isinstance(value, str):
            edited += f" {raw}={quoteattr(value)}".encode()
        else:
            seq, more = prefixed((RDF, "Seq"))
            edited += more
            items = "".join(f"<{seq[:-3]}li>{escape(v)}</{seq[:-3]}li>" for v in value)
            added += f"<{raw}><{seq}>{items}</{seq}></{raw}>".encode()
    inner, at = b"", packet.tag_stop
    for c in packet.children:
        if c.name in settings:
            inner += body[at : c.start]
            at = c.stop
    name = re.match(rb"<([^\s/>]+)", tag)[1]
    if closed:
        middle = b">" + added + b"</" + name + b">" if added else b"/>"
        return body[: packet.start] + edited + middle + body[packet.tag_stop :]
    return body[: packet.start] + edited + b">" + added + inner + body[at:]


SETTING = T.StructType().add("namespace", "string").add("name", "string").add("value", "string").add("items", T.ArrayType(T.StringType()))


def _settings(rows: list[dict]) -> dict[Name, Value]:
    return {(r["namespace"] or "", r["name"]): r["items"] if r["items"] is not None else r["value"] for r in rows}


def packet_values(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, namespace, name, value, items for each property of the packets of a binary column; one row with error for one that cannot be read."""
    out = T.StructType([df.schema[key], *SETTING.fields]).add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, packet in enumerate(batch.column(1)):
                try:
                    found = values(packet.as_py()) if packet.is_valid else {}
                    got = [(s, n, v if isinstance(v, str) else None, None if isinstance(v, str) else v, None) for (s, n), v in found.items()]
                except ValueError as e:
                    got = [(None, None, None, None, str(e))]
                at += [i] * len(got)
                rows += got
            types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=out.names)

    return df.select(key, F.col(body).cast("binary").alias("body")).mapInArrow(run, out)


def merged_packets(df: DataFrame, key: str, body: str, settings: str) -> DataFrame:
    """key, packet and error: the packets of a binary column (null: none yet) with an array of settings merged in."""
    out = T.StructType([df.schema[key]]).add("packet", "binary").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packets, errors = [], []
            for packet, rows in zip(batch.column(1), batch.column(2), strict=True):
                try:
                    packets.append(merge(packet.as_py(), _settings(rows.as_py() or [])))
                    errors.append(None)
                except ValueError as e:
                    packets.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packets, pa.binary()), pa.array(errors, pa.string())], names=out.names)

    return df.select(key, F.col(body).cast("binary").alias("body"), F.col(settings).cast(T.ArrayType(SETTING)).alias("settings")).mapInArrow(run, out)


# ---- sink -----------------------------------------------------------------------------------------------------------


@dataclass
class _Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Staging files lie in a folder of their own that only the driver makes: once it is gone, a task that still runs cannot leave any."""

    def __init__(self, options: dict) -> None:
        self.folder, self.create_only = options["path"].rstrip("/"), str(options.get("createonly", "false")).lower() == "true"
        fs, root = _filesystem(self.folder)
        self.root, self.staging = root.rstrip("/"), f"{root.rstrip('/')}/.staged-{uuid.uuid4().hex}"
        fs.create_dir(self.staging)

    def write(self, iterator) -> _Staged:
        import pyarrow.fs

        fs, _ = _filesystem(self.folder)
        staged: list[tuple[str, str]] = []
        for row in iterator:
            target = f"{self.root}/{row['sidecar']}"
            there = fs.get_file_info(target).type != pyarrow.fs.FileType.NotFound
            if there and self.create_only:
                continue
            before = None
            if there:
                with fs.open_input_stream(target) as file:
                    before = file.read()
            packet = merge(before, _settings([s.asDict() for s in row["settings"]]))
            part = f"{self.staging}/{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as file:
                file.write(packet)
            staged.append((part, target))
        return _Staged(staged)

    def commit(self, messages: list[_Staged | None]) -> None:
        fs, _ = _filesystem(self.folder)
        for message in messages:
            for part, target in message.files if message else ():
                fs.move(part, target)
        self._clear()

    def abort(self, messages: list[_Staged | None]) -> None:
        """Nothing has been renamed yet."""
        self._clear()

    def _clear(self) -> None:
        fs, _ = _filesystem(self.folder)
        for k in range(20):
            try:
                fs.delete_dir(self.staging)
                return
            except FileNotFoundError:
                return
            except OSError:  # a task has just put a file there
                if k == 19:
                    raise
                time.sleep(0.1)


class Sidecars(DataSource):
    """Settings merged into the sidecars of a folder, all or none."""

    @classmethod
    def name(cls) -> str:
        return "sidecars"

    def schema(self) -> T.StructType:
        return T.StructType().add("sidecar", "string").add("settings", T.ArrayType(SETTING))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register_sink(spark: SparkSession) -> None:
    spark.dataSource.register(Sidecars)
