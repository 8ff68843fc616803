"""Lists of lens corrections stored in raw files: big-endian records of gain maps and warps, as rows.

A list that is damaged anywhere gives one row with ``error`` and nothing else, so that no half of it is applied.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The numbers of the two records that are read, the version that is known, and the flag of records that may be skipped.
WARP, GAIN_MAP, VERSION, OPTIONAL = 1, 9, 0x01030000, 1
MOST_RECORDS, MOST_BYTES, MOST_POINTS, MOST_VALUES = 64, 16 << 20, 512, 1_000_000
PLACE = ("top", "left", "bottom", "right", "plane", "planes", "row_pitch", "col_pitch", "points_v", "points_h", "spacing_v", "spacing_h", "origin_v", "origin_h", "map_planes")
GAIN_HEAD = struct.Struct(">10I4dI")


def _gain_map(data: bytes) -> dict:
    if len(data) < GAIN_HEAD.size:
        raise ValueError("a gain map is shorter than its parameters")
    at = dict(zip(PLACE, GAIN_HEAD.unpack_from(data), strict=True))
    n = at["points_v"] * at["points_h"] * at["map_planes"]
    if not n or max(at["points_v"], at["points_h"]) > MOST_POINTS or n > MOST_VALUES:
        raise ValueError("the size of a gain map is out of bounds")
    if len(data) != GAIN_HEAD.size + 4 * n:
        raise ValueError("the length of a gain map does not fit its size")
    if not all(map(math.isfinite, (at["spacing_v"], at["spacing_h"], at["origin_v"], at["origin_h"]))) or min(at["spacing_v"], at["spacing_h"]) <= 0:
        raise ValueError("the spacing of a gain map is not sound")
    if at["bottom"] <= at["top"] or at["right"] <= at["left"]:
        raise ValueError("the area of a gain map is empty")
    gains = np.frombuffer(data, ">f4", n, GAIN_HEAD.size)
    if not np.isfinite(gains).all() or (gains < 0).any():
        raise ValueError("a gain is not sound")
    return {"map": {c: at[c] for c in PLACE}, "values": gains.astype(np.float64).tolist()}


def _warp(data: bytes) -> dict:
    planes = struct.unpack_from(">I", data)[0] if len(data) >= 4 else 0
    if planes not in (1, 3) or len(data) != 4 + 8 * (6 * planes + 2):
        raise ValueError("a warp does not have one or three planes, or its length does not fit them")
    values = struct.unpack_from(f">{6 * planes + 2}d", data, 4)
    with np.errstate(over="ignore"):
        sound = np.isfinite(np.array(values, np.float32)).all()
    if not sound or not all(0 <= x <= 1 for x in values[-2:]):
        raise ValueError("a warp's numbers are not finite or its centre lies outside")
    return {"map": None, "values": [*(values[:6] * 3 if planes == 1 else values[:18]), *values[-2:]]}


def parse(payload: bytes) -> list[dict]:
    """seq, opcode, version, optional, map (of a gain map) and values of each record."""
    if len(payload) < 4 or len(payload) > MOST_BYTES:
        raise ValueError("the list has no count or is too long")
    count, at, out = struct.unpack_from(">I", payload)[0], 4, []
    if count > MOST_RECORDS:
        raise ValueError("too many records")
    for seq in range(count):
        if len(payload) - at < 16:
            raise ValueError("a record's head is cut off")
        opcode, version, flags, size = struct.unpack_from(">4I", payload, at)
        at += 16
        if size > len(payload) - at:
            raise ValueError("a record reaches beyond the list")
        data = payload[at : at + size]
        at += size
        read = {GAIN_MAP: _gain_map, WARP: _warp}.get(opcode)
        known = read is not None and version == VERSION and not flags & ~OPTIONAL
        out.append({"seq": seq, "opcode": opcode, "version": version, "optional": bool(flags & OPTIONAL), "known": known, **(read(data) if read else {"map": None, "values": None})})
    if at != len(payload):
        raise ValueError("bytes behind the last record")
    return out


MAP = T.StructType()
for _c in PLACE:
    MAP = MAP.add(_c, "double" if _c.startswith(("spacing", "origin")) else "long")
RECORD = T.StructType().add("seq", "integer").add("opcode", "long").add("version", "long").add("optional", "boolean").add("known", "boolean").add("map", MAP)
RECORD = RECORD.add("values", T.ArrayType(T.DoubleType())).add("error", "string")


def opcode_rows(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key and one row per record of the lists in a binary column, or one row with error; null lists have no row."""
    out = T.StructType([df.schema[key], *RECORD.fields])
    map_t = pa.struct([(f.name, pa.float64() if f.dataType == T.DoubleType() else pa.int64()) for f in MAP.fields])
    types = dict(zip(RECORD.names, (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), map_t, pa.list_(pa.float64()), pa.string()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column(1)):  # a list may hold a million values: one at a time
                try:
                    rows = parse(body.as_py())
                except ValueError as e:
                    rows = [{"error": str(e)}]
                if rows:
                    same = batch.column(0).take(pa.array([i] * len(rows), pa.int32()))
                    yield pa.RecordBatch.from_arrays([same, *[pa.array([r.get(c) for r in rows], t) for c, t in types.items()]], names=out.names)

    return df.where(F.col(payload).isNotNull()).select(key, F.col(payload).cast("binary").alias("body")).mapInArrow(run, out)


def gain_points(rows: DataFrame, key: str) -> DataFrame:
    """key, seq, v, h, plane, gain: the grid of each gain map, one row per value."""
    maps = rows.where((F.col("opcode") == GAIN_MAP) & F.col("map").isNotNull())
    flat = maps.select(key, "seq", F.col("map.points_h").alias("n"), F.col("map.map_planes").alias("m"), F.posexplode("values").alias("p", "gain"))
    return flat.select(key, "seq", F.floor(F.col("p") / (F.col("n") * F.col("m"))).alias("v"), (F.floor(F.col("p") / F.col("m")) % F.col("n")).alias("h"), (F.col("p") % F.col("m")).alias("plane"), "gain")


def _single(rows: DataFrame, key: str, opcode: int) -> DataFrame:
    """The one record of this kind of a key; keys with several, with damage, or (for warps) with unknown records that must not be skipped have none."""
    sure = F.lit(True) if opcode == GAIN_MAP else ~F.bool_or(~F.col("known") & (~F.col("optional") | F.col("opcode").isin(WARP, GAIN_MAP)))
    one = F.max_by(F.struct("map", "values"), F.when(F.col("opcode") == opcode, F.lit(1)).otherwise(0))
    seqs = lambda code: F.min(F.when(F.col("opcode") == code, F.col("seq")))
    sound = (F.count_if(F.col("error").isNotNull()) == 0) & (F.count_if(F.col("opcode") == opcode) == 1) & sure
    got = rows.groupBy(key).agg(sound.alias("sound"), one.alias("one"), seqs(GAIN_MAP).alias("gain_at"), seqs(WARP).alias("warp_at"), F.count_if(F.col("opcode") == GAIN_MAP).alias("gains"))
    return got.where("sound") if opcode == GAIN_MAP else got.where("sound AND gains <= 1")


def gain_maps(rows: DataFrame, key: str) -> DataFrame:
    """key, map and values of the keys with exactly one gain map."""
    return _single(rows, key, GAIN_MAP).select(key, F.col("one.map").alias("map"), F.col("one.values").alias("values"))


def warps(rows: DataFrame, key: str) -> DataFrame:
    """key, coefficients (six for each of three planes), centre_x, centre_y and gain_first (whether a gain map comes before the warp)."""
    v = F.col("one.values")
    first = F.coalesce(F.col("gain_at") < F.col("warp_at"), F.lit(False)).alias("gain_first")
    return _single(rows, key, WARP).select(key, F.slice(v, 1, 18).alias("coefficients"), v[18].alias("centre_x"), v[19].alias("centre_y"), first)
