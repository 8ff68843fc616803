"""Streams and folds against replays in plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from burstlake.operators import fifo
from burstlake.streaming.supersession import OUTPUT, supersession_stream

REQUEST = "session string, client string, generation long, at timestamp"
START = datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC)


def replay(rows, idle, end):
    out, state = [], {}
    for s, c, g, at in sorted(rows, key=lambda r: (r[3], r[2])):
        newest, last = state.get((s, c), (None, None))
        if last is not None and at - last > idle:
            out.append((s, c, newest, "expired", None, last + idle))
            newest = None
        if newest is None or g > newest:
            if newest is not None:
                out.append((s, c, newest, "superseded", g, at))
            newest = g
            out.append((s, c, g, "accepted", None, at))
        else:
            out.append((s, c, g, "repeated" if g == newest else "stale", None, at))
        state[s, c] = (newest, at)
    gone = {k: v for k, v in state.items() if v[1] + idle < end}
    return out + [(*k, n, "expired", None, last + idle) for k, (n, last) in gone.items()], len(state) - len(gone)


@pytest.mark.parametrize("per_batch", [1, 50])
def test_newest_request_wins_in_any_micro_batches(spark, tmp_path, per_batch):
    rng, t, rows = random.Random(2), 0, []
    for _ in range(240):
        t += rng.choice((1, 7, 60, 290, 420))
        rows.append((f"s{rng.randint(0, 2)}", f"c{rng.randint(0, 2)}", rng.randint(1, 30), t))
    for k in range(0, 240, 48):
        part = [(s, c, g, START + datetime.timedelta(seconds=at)) for s, c, g, at in rows[k : k + 48]]
        spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", per_batch).parquet(f"file://{tmp_path}/in")
    query = supersession_stream(source).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start(f"file://{tmp_path}/out")
    query.awaitTermination()
    first = int(START.timestamp() * 1e6)
    got = sorted((tuple(r) for r in spark.read.schema(OUTPUT).parquet(f"file://{tmp_path}/out").collect()), key=str)
    want, left = replay(rows, 300, t)
    assert got == sorted(((s, c, g, status, by, first + at * 1_000_000) for s, c, g, status, by, at in want), key=str)
    keys = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert keys == left and left < 9  # forgotten keys hold no state


def test_a_cache_of_entries_and_bytes(spark):
    rng = random.Random(4)
    puts = [(k, i, rng.choice("abcdefgh"), rng.choice((None, 0, 5, 20, 60, 101))) for k in ("x", "y", None) for i in range(300)]
    want = {}
    for k in ("x", "y", None):
        cache = {}
        for i, name, size in [p[1:] for p in puts if p[0] == k]:
            size = size or 0
            gone = []
            if size <= 100:
                cache.pop(name, None)
                while cache and (len(cache) >= 4 or sum(cache.values()) + size > 100):
                    gone.append(next(iter(cache)))
                    del cache[gone[-1]]
                cache[name] = size
            want[k, i] = (size <= 100, gone, len(cache), sum(cache.values()))
    df = spark.createDataFrame(puts, "k string, i int, name string, size long").repartition(5)
    got = {(r["k"], r["i"]): (r["stored"], r["evicted"], r["entries"], r["bytes"]) for r in fifo.fifo_cache(df, "k", ["i"], "name", "size", 4, 100).collect()}
    assert got == want
    assert fifo.fifo_cache(df.where(F.lit(False)), "k", ["i"], "name", "size", 4, 100).count() == 0


MESSAGE = "session string, id long, kind string, message string, at_us long"


def numbered(rows):
    out, state = [], {}
    for s, _, kind, message, us in sorted(rows, key=lambda r: (r[4], r[1])):
        n, last, ended = state.get(s, (0, None, False))
        if ended or kind == "progress" and message == last:
            continue
        out.append((s, n, kind, message, us))
        state[s] = (n + 1, message if kind == "progress" else None, kind in ("done", "error"))
    return sorted(out)


def test_results_have_each_number_once_after_a_restart(spark, tmp_path):
    from pathlib import Path

    from burstlake.streaming import results

    rng = random.Random(5)
    rows = [(f"s{rng.randint(0, 3)}", i, rng.choice(["progress"] * 20 + ["result", "done"]), rng.choice(("a", "b", 'c "\n')), 1000 * i) for i in range(300)]
    put = lambda part: spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    folder = f"file://{tmp_path}/out"

    def run():
        source = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        results.to_folder(results.numbered_stream(source), folder, f"file://{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(results.OUTPUT).parquet(f"{folder}/*").collect())

    for k in range(0, 180, 60):
        put(rows[k : k + 60])
    assert run() == numbered(rows[:180])
    newest = max(Path(tmp_path, "log", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (newest, newest.with_name(f".{newest.name}.crc")):  # the last batch was written, its end was not recorded
        p.unlink(missing_ok=True)
    for k in range(180, 300, 60):
        put(rows[k : k + 60])
    want = numbered(rows)
    assert run() == want and len(want) > 20 and {r[0] for r in want} == {"s0", "s1", "s2", "s3"}
    line = results.lines(spark.createDataFrame([("s", 0, "error", 'x "y"', 1)], results.OUTPUT)).first()["line"]
    assert line == 'data: {"type":"error","msg":"x \\"y\\""}\n\n'


def test_lens_data_from_the_text_of_a_tool(spark):
    from burstlake.functions import tooljson

    texts = {
        "vendor": '[{"SourceFile": "a", "Make": "NIKON CORPORATION", "LensModel": " ", "LensID": "AF-S 24-70mm f/2.8", "FocalLengthIn35mmFormat": 36.5, "LensSerialNumber": 1234}]',
        "listed": '[{"LensSpec": "Zoom", "LensInfo": [24, "70", 2.8, 4], "LensMake": "Sony", "FocalLengthIn35mmFilm": 0, "FocalLengthIn35mmFormat": "50"}]',
        "empty list": '[{"LensSpecification": [], "LensInfo": "14-24 mm F/2.8-4"}]', "null in list": '[{"LensInfo": [24, null, 2.8, 4], "Lens": "35mm f/1.8"}]', "prime": '[{"Lens": "35mm f/1.8"}, {"Lens": "no"}]',
        "backwards": '[{"Lens": "70-24mm f/2.8"}]', "no aperture": '[{"Lens": "24-70mm"}]', "none": "[]", "object": '{"LensModel": "x"}', "cut": '[{"LensModel": "x"', "number": "3", "null": None, "blank": "", "inner": '["x"]',
    }
    got = {r["k"]: r["lens"] for r in tooljson.with_lens(spark.createDataFrame(list(texts.items()), "k string, t string"), "t").collect()}
    empty = (None,) * 5
    want = {
        "vendor": ("AF-S 24-70mm f/2.8", "Nikon", "1234", 36.5, [24, 70, 2.8, 2.8]), "listed": ("Zoom", "Sony", None, 50.0, [24, 70, 2.8, 4]), "empty list": (None, None, None, None, [14, 24, 2.8, 4]),
        "null in list": ("35mm f/1.8", None, None, None, None), "prime": ("35mm f/1.8", None, None, None, [35, 35, 1.8, 1.8]), "backwards": ("70-24mm f/2.8", None, None, None, None), "no aperture": ("24-70mm", None, None, None, None),
    }
    assert {k: tuple(v) for k, v in got.items()} == {k: want.get(k, empty) for k in texts}


def test_a_new_key_costs_three_calls_for_state():
    from pyspark.sql import Row

    from burstlake.streaming.supersession import Supersession

    calls = []

    class Fake:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (self if name == "getValueState" else None)

    one = Supersession(300_000_000)
    one.init(Fake())
    calls.clear()
    out = list(one.handleInputRows(("s", "c"), iter([Row(at_us=2, generation=5), Row(at_us=1, generation=4)]), None))
    assert calls == ["get", "registerTimer", "update"]
    assert [(r.generation, r.status, r.replaced_by, r.at_us) for r in out] == [(4, "accepted", None, 1), (4, "superseded", 5, 2), (5, "accepted", None, 2)]
