"""Literal cases of culling and metadata through the public functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from burstlake.api import Cull, merge_settings, pair_companions, upsert_decisions, usable_weights
from burstlake.functions import metadata as M
from burstlake.sources.tables import labelled_scan, scan_photos

SHOT = "shot_id long, folder int, captured_at timestamp, dhash string, aesthetic double, exposure double, sharpness double, severe_blur boolean, eye_defect boolean, failed boolean"
T0 = datetime.datetime(2024, 5, 1, 12)


def shots(spark, rows):
    base = {"folder": 1, "dhash": "0" * 64, "aesthetic": 0.5, "exposure": 1.0, "sharpness": 100.0, "severe_blur": False, "eye_defect": False, "failed": False}
    full = [{"shot_id": i, "captured_at": T0 + datetime.timedelta(seconds=i)} | base | r for i, r in enumerate(rows)]
    names = [x.split()[0] for x in SHOT.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SHOT)


@pytest.mark.parametrize(("action", "kept", "moved", "review"), [("keep", 1, 2, False), ("review", 1, 2, True), ("reject", 0, 3, False)])
def test_all_blurry(spark, action, kept, moved, review):
    df = shots(spark, [{"aesthetic": a, "severe_blur": True} for a in (1.0, 0.7, 0.4)])
    got = Cull(df).sessionize().route(1, action).rows.collect()
    assert sum(r["kept"] for r in got) == kept and sum(r["category"] != "keep" for r in got) == moved
    assert {r["needs_review"] for r in got} == {review}


def test_scores_and_routing(spark):
    df = shots(spark, [{"sharpness": 100.0}, {"sharpness": 82.0}, {"sharpness": 55.0, "eye_defect": True}, {"failed": True}])
    got = {r["shot_id"]: r for r in Cull(df).sessionize().route(1).rows.collect()}
    assert abs(got[1]["norm_sharp"] - 0.3690) < 1e-3 and got[0]["norm_sharp"] == 1.0 and got[2]["norm_sharp"] == 0.0
    assert [got[i]["category"] for i in range(4)] == ["keep", "review", "defect", "keep"]
    assert got[3]["score"] is None and got[0]["needs_review"]
    assert abs(got[0]["w_aes"] + got[0]["w_sharp"] + got[0]["w_exp"] - 1) < 1e-12 and got[0]["w_aes"] >= 0.45


def test_single_shots_split(spark):
    df = shots(spark, [{}, {"captured_at": T0 + datetime.timedelta(seconds=3)}, {"captured_at": T0 + datetime.timedelta(seconds=4), "dhash": "1" * 64}])
    assert Cull(df).sessionize().rows.select("slot").distinct().count() == 3


def test_weights():
    assert usable_weights({"aesthetic": 0.05, "sharpness": 0.9, "exposure": 0.05}) == (0.05, 0.9, 0.05)
    assert usable_weights({"aesthetic": 0, "sharpness": 0, "exposure": 0}) is None
    assert usable_weights({"aesthetic": -1, "sharpness": 1, "exposure": 1}) is None and usable_weights(None) is None


def test_scan_and_pairing(spark, tmp_path):
    for name in ("DSC_0001.NEF", "DSC_0001.JPG", "DSC_0002.ARW", "dsc_0002.jpg", "note.txt", "DSC_0003.xmp"):
        (tmp_path / name).write_bytes(b"\0" * 16)
    files = scan_photos(spark, str(tmp_path))
    got = {r["stem_key"]: r for r in pair_companions(files).collect()}
    assert set(got) == {"dsc_0001", "dsc_0002"}
    assert got["dsc_0001"]["primary_path"].endswith("DSC_0001.NEF") and len(got["dsc_0002"]["all_paths"]) == 2
    assert labelled_scan(spark, str(tmp_path), str(tmp_path)).groupBy("label").count().count() == 2


def test_metadata(spark):
    df = spark.createDataFrame([("2024:05:01 12:00:00", "5", T0, [24.0, 70.0], "x", 50.0, 75.0), ("bad", None, T0, [0.0, 0.0], "Example 35mm F1.8", 35.0, 36.0), (None, "x", T0, None, "none", 1.0, 1.0)], "taken string, sub string, stored timestamp, spec array<double>, lens string, f double, f35 double")
    got = df.select(
        M.capture_micros(F.col("taken"), F.col("sub"), F.col("stored")).alias("us"), M.lens_range(F.col("spec"), F.col("lens")).alias("r"),
        M.range_35mm(F.col("f"), F.col("f35"), M.lens_range(F.col("spec"), F.col("lens"))).alias("r35"), M.rational(F.lit(28), F.lit(10)).alias("q"),
        M.rational(F.lit(1), F.lit(0)).alias("z"), M.oriented(F.lit(640), F.lit(480), F.lit(6)).alias("o"), M.clamp(F.lit(float("nan"))).alias("c"), M.flag(F.lit(" Yes ")).alias("b"),
    ).collect()
    assert got[0]["us"] - got[1]["us"] == 500_000
    assert [r["r"] for r in got] == [[24, 70], [35, 35], None]
    assert [r["r35"] for r in got] == [[36, 105], [35, 35], None]
    assert (got[0]["q"], got[0]["z"], tuple(got[0]["o"]), got[0]["c"], got[0]["b"]) == (2.8, None, (480, 640), 0.0, True)


def test_upsert_and_merge(spark):
    log = spark.createDataFrame([(1, True), (2, False)], "photo_id long, kept boolean")
    new = spark.createDataFrame([(2, True), (3, False)], "photo_id long, kept boolean")
    assert sorted(map(tuple, upsert_decisions(log, new).collect())) == [(1, True), (2, True), (3, False)]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "old map<string,string>, new map<string,string>")
    assert maps.select(merge_settings("old", "new").alias("m")).first()["m"] == {"a": "1", "b": "3"}
