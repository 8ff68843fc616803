"""Photos reach the tasks in bounded numbers, whatever the size of the table that they are joined with."""

import re

import pytest

import __spark_entry__ as entry
from burstlake.plans.dialect import SPARK
from burstlake.plans.rasters import Raster, gauss
from burstlake.sources import tables


@pytest.fixture
def shuffled(spark, monkeypatch):
    monkeypatch.setattr(tables, "PHOTOS", 40)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["scene_estimate", "physical_dehaze", "transmission_regularised"])
def test_a_task_has_a_bounded_number_of_photos(shuffled, sf_dir, name):
    photos = shuffled.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert entry.queries()[name](shuffled, sf_dir).rdd.getNumPartitions() == -(-photos // 40)


def test_filters_do_no_arithmetic_of_places_in_lambdas():
    r = Raster(SPARK)
    for sql in (r.along_rows("a", gauss(8, 1.0)), r.along_columns("a", gauss(8, 1.0)), r.extreme("a", 2, True, True), r.beside("a", 1, -1)):
        assert not re.search(r"%| div |abs\(", sql)


@pytest.mark.parametrize("name", ["trilinear_splat", "trilinear_lookup", "optical_depth_lut", "nonlocal_field", "transmission_relief"])
def test_cubes_are_made_and_read_where_the_photo_is(spark, sf_dir, name):
    """One reading of the photos and one exchange, by their key: corners and cells, hundreds a photo, never travel."""
    text = plan(entry.queries()[name](spark, sf_dir))
    assert len(re.findall(r"Exchange hashpartitioning\((?!a#)", text)) == 1  # a is of the fixed table of weights
    assert len(re.findall(r"Scan parquet .*embeddings|FileScan parquet .*embeddings\.parquet", text)) == 1
    assert "SortMergeJoin" not in text
