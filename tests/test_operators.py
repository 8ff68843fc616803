"""The reference cases: groups, scores and routing, iterative solvers, and a sample of queries against their oracles."""

import datetime
import importlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.operators import sessionize

CATALOGS = [importlib.import_module(f"burstlake.plans.{m}").catalog for m in ("culling", "metadata", "numeric", "physical", "spatial", "nonlocal_field", "colour", "jobs", "sidecars", "stateful")]
SAMPLE = ("reliability_lut", "enhancement_transfer", "fuzzy_best_match", "exif_walk", "unique_export_path", "companion_pairing", "adaptive_weights", "category_routing_reject", "lens_specification_parse", "trilinear_splat", "isotonic_minmax", "move_plan", "anchored_bursts_photos")


def run(spark, name, sf_dir):
    return next(c for c in CATALOGS if name in c.queries).queries[name](spark, sf_dir).collect()


def groups(spark, rows, gap_us=1_500_000, limit=12, bits=False):
    kind = "string" if bits else "double"
    df = spark.createDataFrame(rows, f"key int, id int, us long, m {kind}").withColumn("ts", F.timestamp_micros("us"))
    got = sessionize.anchored_groups(df, "key", "ts", "id", "m", gap_us, limit, bits).collect()
    return [r["grp"] for r in sorted(got, key=lambda r: r["id"])]


def test_groups_by_gap_and_anchor(spark):
    s = 1_000_000
    rows = [
        (1, 1, 0, 0.0), (1, 2, s, 0.0), (1, 3, 4 * s, 0.0),  # the third is too late
        (2, 4, 0, 0.0), (2, 5, s, 10.0), (2, 6, 2 * s, 20.0),  # near the one before, far from the first
        (3, 7, 0, 0.0), (3, 8, s, None), (3, 9, 2 * s, 0.0), (3, 10, 3 * s, 0.0),  # unknown stands alone
        (4, 11, 0, 0.0), (4, 12, 1_500_000, 12.0),  # both limits reached exactly
    ]
    assert groups(spark, rows) == [1, 1, 2, 1, 1, 2, 1, 2, 3, 3, 1, 1]


def test_groups_by_bits(spark):
    zero, ones = "0" * 64, "1" * 64
    assert groups(spark, [(1, 1, 0, zero), (1, 2, 10, zero), (1, 3, 20, ones)], bits=True) == [1, 1, 2]


def test_groups_of_a_hot_key_in_time_ranges(spark):
    rng = np.random.default_rng(4)
    us = np.cumsum(rng.integers(0, 3_000_000, 400))
    rows = [(7, int(i), int(u), None if i % 50 == 9 else float(m)) for i, (u, m) in enumerate(zip(us, rng.integers(0, 30, 400), strict=True))]
    df = spark.createDataFrame(rows, "key int, id int, us long, m double").withColumn("ts", F.timestamp_micros("us"))
    whole, cut = ({r["id"]: r["grp"] for r in sessionize.anchored_groups(df, "key", "ts", "id", "m", 1_500_000, 12, range_rows=n).collect()} for n in (10_000, 30))
    assert whole == cut and len(set(cut.values())) > 50
    assert sessionize.anchored_groups(df.limit(0), "key", "ts", "id", "m", 1_500_000, 12).count() == 0


def photos(spark, tmp_path, values):
    """Tables of photos with these gray values (64 numbers of 0 to 1 each) under tmp_path."""
    back = lambda v: (round(v * 255) - 128.2) / 400
    rows = [(i, [float(back(x)) for x in v], i % 3) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    when = datetime.datetime(2024, 5, 1, 12)
    events = [(i, when + datetime.timedelta(seconds=i), 1, "view", 50.0, "{}") for i in range(len(values))]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def channels(gray):
    """r, g, b of a photo: rotations of its gray values."""
    g = np.round(np.asarray(gray) * 255) / 255
    return [np.roll(g, -k).reshape(8, 8) for k in (0, 9, 18)]


def test_field_solves_its_linear_system(spark, tmp_path):
    """The field of the sure places against a dense solve of the same system; an unsure photo keeps the prior."""
    rng = np.random.default_rng(1)
    values = [rng.random(64), np.full(64, 0.8), np.full(64, 0.1), rng.random(64)]
    got = {r["shot_id"]: r for r in run(spark, "pcg_wls", photos(spark, tmp_path, values))}
    for k, v in enumerate(values):
        rgb = np.stack(channels(v))
        luma = np.tensordot([0.2126, 0.7152, 0.0722], rgb, 1)
        sure = (luma > 0.5).astype(float)
        system = np.diag((sure + 0.05).ravel())
        for y in range(8):
            for x in range(8):
                for yy, xx in ((y, x + 1), (y + 1, x)):
                    if yy < 8 and xx < 8:
                        w = 0.18 * np.exp(-((rgb[:, y, x] - rgb[:, yy, xx]) ** 2).sum() / 0.06**2)
                        a, b = 8 * y + x, 8 * yy + xx
                        system[[a, b], [a, b]] += w
                        system[[a, b], [b, a]] -= w
        want = np.linalg.solve(system, (sure * luma).ravel()).mean()
        assert got[k]["converged"] and abs(got[k]["mean"] - want) < 2e-4
    assert got[2]["iterations"] == 0 and got[2]["mean"] == 0


def test_isotonic_and_curve(spark, tmp_path):
    """Green is red turned by nine places: fits are non-decreasing and keep the weighted mean; curves end at the first and last bin."""
    rng = np.random.default_rng(2)
    at = photos(spark, tmp_path, [np.linspace(0, 1, 64), rng.random(64)])
    bins, fits, knots = (run(spark, n, at) for n in ("binned_means_64", "isotonic_minmax", "curve_simplify"))
    for shot in (0, 1):
        own = {r["bin"]: r for r in bins if r["shot_id"] == shot}
        fit = sorted((r["bin"], r["fitted"]) for r in fits if r["shot_id"] == shot)
        y = [v for _, v in fit]
        assert all(a <= b + 1e-9 for a, b in zip(y, y[1:], strict=False)) and [b for b, _ in fit] == sorted(own)
        assert abs(sum(own[b]["n"] * v for b, v in fit) - sum(r["n"] * r["mean_y"] for r in own.values())) < 1e-2
        line = sorted((r["x"], r["y"]) for r in knots if r["shot_id"] == shot)
        x = [own[b]["mean_x"] for b, _ in fit]
        assert 2 <= len(line) <= 16 and abs(line[0][0] - x[0]) < 1e-4 and abs(line[-1][0] - x[-1]) < 1e-4
        if len(line) < 16:
            assert np.abs(np.interp(x, *zip(*line, strict=True)) - y).max() <= 0.7501


def test_gray_photos_by_hand(spark, tmp_path):
    """Photos of one gray: what the operators give can be worked out by hand."""
    at = photos(spark, tmp_path, [np.full(64, g) for g in (0.2, 0.6, 1.0)])
    g = [51 / 255, 153 / 255, 1.0]
    by = lambda name: sorted(run(spark, name, at), key=lambda r: r["shot_id"])
    # A flat upper frame: all 32 places agree, except that light of 0.94 and more is no candidate.
    air = by("upper_airlight")
    assert [r["places"] for r in air] == [32, 32, 0] and [round(r["upper_r"], 5) for r in air] == [round(x, 5) for x in g]
    assert [round(r["upper_conf"], 5) for r in air] == [1.0, 1.0, 0.15]
    t = 1 - 0.7 * (0.66 - 0.14 * 0.3) * 0.95 * (0.92 + 0.08 * min(0.92, max(0.12, (g[1] - 0.03) / 0.92)))
    assert abs(by("global_transmission")[1]["transmission"] - max(t, 0.27 + 0.063 + 0.055)) < 1e-6
    assert [r["quality"] for r in by("absolute_sharpness")] == [0, 0, 0] and [r["sharpness"] for r in by("region_sharpness")] == [0, 0, 0]
    assert [r["exposure"] for r in by("exposure_score")] == [1, 1, 0]
    assert all(r["right_weight"] == (1 if r["x"] < 7 else 0) and r["down_weight"] == (1 if r["y"] < 7 else 0) for r in by("edge_weights"))
    # Gray keeps its hue and is never brightened; the second photo is hazy gray and gets darker.
    out = by("physical_dehaze")
    assert all(r["r"] == r["g"] == r["b"] <= round(255 * g[r["shot_id"]]) for r in out)
    assert {r["r"] for r in out if r["shot_id"] == 2} == {255}
    film = by("film_look_gray")
    assert all(r["r"] == r["g"] == r["b"] <= 248 for r in film) and len({(r["shot_id"], r["r"]) for r in film}) == 3
    assert all(abs(r["r"] - g[r["shot_id"]]) < 1e-3 for r in by("colour_grading_lab") if r["shot_id"] == 2)
    assert {r["fallback_reason"] if "fallback_reason" in r else r["reason"] for r in by("nonlocal_gate")} <= {"eligible", "low_airlight", "uncertain_airlight", "backlit_scene", "clipped_highlights"}
    assert [r["ev"] for r in by("auto_exposure_ev")] == [round(float(np.log2(0.18 / (0.3 * x))), 6) if 0.3 * x < 0.18 else 0 for x in g]
    lum = {r["shot_id"]: r for r in by("basic_controls")}
    assert all(r["r"] == r["g"] == r["b"] for r in lum.values())


def test_files_move_together_or_not_at_all(spark, tmp_path):
    from burstlake.sources.files import move_groups, write_sidecars

    for n in ("a.nef", "a.jpg", "b.nef"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a.jpg").write_bytes(b"old")
    u = lambda n: f"file://{tmp_path}/{n}"
    plan = spark.createDataFrame([(1, u("a.nef"), u("out/a.nef")), (1, u("a.jpg"), u("out/a.jpg")), (2, u("b.nef"), u("out/b.nef")), (2, u("c.jpg"), u("out/c.jpg"))], "grp int, src string, dst string")
    got = {r["src"].rpartition("/")[2]: (r["dst"].rpartition("/")[2], r["moved"]) for r in move_groups(plan).collect()}
    assert got == {"a.nef": ("a.nef", True), "a.jpg": ("a_dup1.jpg", True), "b.nef": ("b.nef", False), "c.jpg": ("c.jpg", False)}
    assert (tmp_path / "b.nef").exists() and not (tmp_path / "out/b.nef").exists() and (tmp_path / "out/a.jpg").read_bytes() == b"old"
    rows = spark.createDataFrame([(u("b.nef"), u("b.xmp"), "<x/>"), (u("gone.nef"), u("gone.xmp"), "<x/>")], "photo string, sidecar string, text string")
    status = lambda **how: sorted(r["status"] for r in write_sidecars(rows, **how).collect())
    assert status() == ["missing", "written"] and status() == ["missing", "updated"] and status(create_only=True) == ["missing", "skipped"]
    assert (tmp_path / "b.xmp").read_text() == "<x/>" and not (tmp_path / "gone.xmp").exists()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_oracle(spark, sf_dir, name):
    catalog = next(c for c in CATALOGS if name in c.queries)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    got, want = catalog.queries[name](spark, sf_dir), con.sql(catalog.oracles[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = sorted(tuple(map(text, r)) for r in got.select(*cols).collect())
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())


def test_registry(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert entry.entry(spark).count() > 0


def test_box_filter_reads_every_image(spark, sf_dir):
    import __spark_entry__ as entry

    got = entry.queries()["box_filter_reflect"](spark, sf_dir).toPandas()
    gray = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    values = {i: np.clip(np.floor(128.5 + 400 * np.asarray(v, float)), 0, 255) / 255 for i, v in zip(gray["vec_id"], gray["embedding"], strict=True)}
    planes = {i: np.tensordot([0.2126, 0.7152, 0.0722], np.stack(channels(v)), 1) for i, v in values.items()}
    assert len(got) == 64 * len(planes) and set(got["shot_id"]) == set(planes)
    wide = {k: np.pad(v, 1, mode="reflect") for k, v in planes.items()}
    want = [wide[s][y : y + 3, x : x + 3].mean() for s, x, y in zip(got["shot_id"], got["x"], got["y"], strict=True)]
    assert np.allclose(got["mean"], want, atol=1e-6)


def replayed(x, y, epochs, batch, hidden, seed=42, rate=0.001):
    """The same steps on whole arrays, in single precision nowhere."""
    from burstlake.operators.iterative import permutation

    draw = np.random.RandomState(seed)
    p = [draw.randn(hidden, x.shape[1]) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), draw.randn(2, hidden) * np.sqrt(2 / hidden), np.zeros(2)]
    m, v, t, out = [0.0] * 4, [0.0] * 4, 0, []
    for epoch in range(epochs):
        a, b = permutation(len(y), epoch, seed)
        at = (np.arange(len(y)) * a + b) % len(y)
        assert sorted(at) == list(range(len(y)))
        total, right = 0.0, 0
        for k in range(0, len(y), batch):
            rows = np.flatnonzero((at >= k) & (at < k + batch))
            xb, yb, t = x[rows], y[rows], t + 1
            z = xb @ p[0].T + p[1]
            s = np.maximum(z, 0) @ p[2].T + p[3]
            q = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
            total -= np.log(q[np.arange(len(rows)), yb]).sum()
            right += (q.argmax(axis=1) == yb).sum()
            d = (q - np.eye(2)[yb]) / len(rows)
            h = (d @ p[2]) * (z > 0)
            for i, g in enumerate((h.T @ xb, h.sum(axis=0), d.T @ np.maximum(z, 0), d.sum(axis=0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        out.append((epoch, total / len(y), right / len(y)))
    return p, out


def test_training_in_batches_equals_a_replay(spark, tmp_path):
    import __spark_entry__ as entry
    from burstlake.operators import iterative

    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 8)], None if i == 9 else i % 10) for i in range(61)] + [(99, None, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    order = [r["vec_id"] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").where("embedding IS NOT NULL AND label IS NOT NULL").selectExpr("vec_id", "xxhash64(42, vec_id) AS h").orderBy("h").collect()]
    by = {r[0]: r for r in rows}
    x, y = np.array([by[i][1] for i in order], np.float32).astype(float), np.array([int(by[i][2] < 5) for i in order])
    _, want = replayed(x, y, 2, 16, 256)
    got = entry.queries()["mlp_train"](spark, str(tmp_path)).orderBy("epoch").collect()
    assert [r["epoch"] for r in got] == [0, 1] and np.allclose([(r["loss"], r["accuracy"]) for r in got], [w[1:] for w in want], atol=1e-6)
    samples = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id AS id", "embedding", "CAST(label < 5 AS INT) AS label")
    params, want = replayed(x, y, 4, 7, 12)
    iterative.train_head(samples, epochs=2, batch=7, hidden=12, folder=f"file://{tmp_path}/head")
    head, history = iterative.train_head(samples.repartition(20), epochs=4, batch=7, hidden=12, folder=f"file://{tmp_path}/head")  # goes on after the second epoch
    assert np.allclose([r["loss"] for r in history.orderBy("epoch").collect()], [w[1] for w in want], atol=1e-9) and want[-1][1] < want[0][1]
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(head.params, params, strict=True))
    p = {r["id"]: r["p"] for r in iterative.probabilities(head, samples.drop("label"), "id", "embedding").collect()}
    s = np.maximum(x @ params[0].T + params[1], 0) @ params[2].T + params[3]
    assert np.allclose([p[i] for i in order], np.exp(s[:, 1]) / np.exp(s).sum(axis=1), atol=1e-9)
    assert iterative.train_head(samples.limit(0))[1].count() == 0


def test_small_batches_cost_a_job_for_many(spark, tmp_path):
    from burstlake.operators import iterative

    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 6)], i % 2) for i in range(500)]
    samples = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    order = [r["id"] for r in samples.selectExpr("id", "xxhash64(42, id) AS h").orderBy("h").collect()]
    params, want = replayed(np.array([rows[i][1] for i in order]), np.array([rows[i][2] for i in order]), 2, 5, 7)
    whole, leg = iterative.LEG, 43  # 8 batches a leg; the last one is cut
    tracker = spark.sparkContext.statusTracker()
    try:
        iterative.LEG = leg
        spark.sparkContext.setJobGroup("head", "head")
        head, history = iterative.train_head(samples, epochs=2, batch=5, hidden=7)
        jobs = len(tracker.getJobIdsForGroup("head"))
    finally:
        iterative.LEG = whole
        spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs < 100  # 200 batches in 26 legs
    assert np.allclose([r["loss"] for r in history.orderBy("epoch").collect()], [w[1] for w in want], atol=1e-9)
    assert head.steps == 200 and all(np.allclose(a, b, atol=1e-9) for a, b in zip(head.params, params, strict=True))


def test_a_cache_token_is_the_hash_of_sorted_json(spark, tmp_path):
    import hashlib
    import json

    import __spark_entry__ as entry

    spark.createDataFrame([(7, 22), (9, 40), (8, 1)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: r["token"] for r in entry.queries()["cache_token"](spark, str(tmp_path)).collect()}
    names = ("brightness_protection", "color_protection", "color_recovery", "fog_retention", "highlight_protection", "local_contrast", "naturalness", "shadow_protection", "strength")
    for key, size in ((7, 22), (9, 40), (8, 1)):
        payload = {"version": "linear-v29-native-scene-dense", "nonlocal_relief": ("off", "conservative", "strong")[key % 3], "auto_exposure": size % 2 == 0, "auto_exposure_algorithm": "linear-median768-highlight095-ev2-v1"}
        payload |= {n: float(round(max(0.0, min(1.0, size / 40 - k / 10)), 3)) for k, n in enumerate(names)}
        assert got[key] == hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:20]


def test_rows_that_cost_much_are_dealt_out_by_number(spark, tmp_path):
    from burstlake.plans import packets
    from burstlake.sources import tables

    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 100, 1, 1).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    few = packets.records(spark, str(tmp_path), "part")  # one file of one split
    assert few.rdd.getNumPartitions() == cores and few.count() == 100
    many = tables.dealt(spark.range(0, 1000, 1, 1), 10, "id")
    assert many.rdd.getNumPartitions() == 100 and many.count() == 1000 and many.agg({"id": "sum"}).first()[0] == 499_500
