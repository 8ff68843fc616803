"""Sessions, iterative operators and the culling pipeline as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.functions import tooljson
from burstlake.operators import fifo, iterative, matching, sessionize
from burstlake.sources.scratch import scratch_path
from burstlake.sources.tables import table
from burstlake.streaming import results
from burstlake.streaming.anchored import anchored_stream
from burstlake.streaming.supersession import OUTPUT as SUPERSESSION
from burstlake.streaming.supersession import supersession_stream

from .bursts import BURSTS_SQL, photo_bursts
from .dialect import Catalog, _doubles

catalog = Catalog()
GAP_US, LIMIT = 21_600_000_000, 20.0


def _add(f, oracle: str | None = None):
    catalog.queries[f.__name__] = f
    if oracle:
        catalog.oracles[f.__name__] = _doubles(oracle)
    return f


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("value").cast("double").alias("value"))


def anchored_bursts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize.anchored_groups(_events(spark, sf_dir), "user_id", "ts", "event_id", "value", GAP_US, LIMIT)


_add(anchored_bursts_events, f"""WITH RECURSIVE o AS (SELECT user_id, event_id, CAST(value AS DOUBLE) AS v, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, us, v AS anchor, 1 AS grp FROM o WHERE n = 1
      UNION ALL SELECT o.user_id, o.event_id, o.n, o.us, CASE WHEN o.us - f.us > {GAP_US} OR abs(o.v - f.anchor) > {LIMIT} THEN o.v ELSE f.anchor END,
        CASE WHEN o.us - f.us > {GAP_US} OR abs(o.v - f.anchor) > {LIMIT} THEN f.grp + 1 ELSE f.grp END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
    SELECT user_id, event_id, grp FROM f""")  # fmt: skip


def anchored_bursts_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo_bursts(spark, sf_dir)


_add(anchored_bursts_photos, BURSTS_SQL)


@_add
def streaming_anchored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one file, folded with keyed state into files, with a checkpoint beside them."""
    src = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*").parquet(f"{sf_dir}/events*")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = src.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), us.alias("us"), F.col("value").cast("double").alias("measure"))
    folder, log = scratch_path(spark, "anchored"), scratch_path(spark, "anchored-log")
    stream = anchored_stream(rows, GAP_US, LIMIT).writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True)
    stream.start(folder).awaitTermination()
    return spark.read.parquet(folder).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "grp")


catalog.oracles["streaming_anchored_events"] = catalog.oracles["anchored_bursts_events"]


@_add
def streaming_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as requests of sessions (users) and clients (kinds of event): which are accepted, replaced, repeated, stale or forgotten."""
    src = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*").parquet(f"{sf_dir}/events*")
    requests = src.where("ts IS NOT NULL AND event_id IS NOT NULL").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("client"), F.col("event_id").alias("generation"), F.col("ts").cast("timestamp").alias("at")
    )
    folder, log = scratch_path(spark, "supersession"), scratch_path(spark, "supersession-log")
    supersession_stream(requests).writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(folder).awaitTermination()
    return spark.read.schema(SUPERSESSION).parquet(folder)


_IDLE = "300000000"
catalog.oracles["streaming_supersession"] = f"""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS session, event_type AS client, event_id AS g, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
    n AS (SELECT *, CASE WHEN us - lag(us) OVER w > {_IDLE} THEN 1 ELSE 0 END AS fresh FROM o WINDOW w AS (PARTITION BY session, client ORDER BY us, g)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY session, client ORDER BY us, g ROWS UNBOUNDED PRECEDING) AS part FROM n),
    b AS (SELECT *, max(g) OVER (PARTITION BY session, client, part ORDER BY us, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
    e AS (SELECT session, client, part, max(g) AS g, max(us) + {_IDLE} AS us, part < max(part) OVER (PARTITION BY session, client) AS followed FROM s GROUP BY session, client, part)
    SELECT session, client, g AS generation, CASE WHEN before IS NULL OR g > before THEN 'accepted' WHEN g = before THEN 'repeated' ELSE 'stale' END AS status, CAST(NULL AS BIGINT) AS replaced_by, us AS at_us FROM b
    UNION ALL SELECT session, client, before, 'superseded', g, us FROM b WHERE g > before
    UNION ALL SELECT session, client, g, 'expired', NULL, us FROM e WHERE followed OR (us + 999) // 1000 + 1 < (SELECT max(us) // 1000 FROM o)"""


@_add
def streaming_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as progress of sessions, numbered, without repeats, up to the first error; as event-stream lines."""
    src = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*").parquet(f"{sf_dir}/events*")
    kind = F.when(F.col("event_type") == "error", "error").otherwise("progress")
    messages = src.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("id"), kind.alias("kind"), F.col("event_type").alias("message"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    folder = scratch_path(spark, "results")
    results.to_folder(results.numbered_stream(messages), folder, scratch_path(spark, "results-log")).trigger(availableNow=True).start().awaitTermination()
    return results.lines(spark.read.schema(results.OUTPUT).parquet(f"{folder}/*"))


catalog.oracles["streaming_results"] = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_type AS m, epoch_us(ts) AS us, event_id AS i FROM events),
    n AS (SELECT *, lag(m) OVER w AS before, coalesce(sum(CASE WHEN m = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY us, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e WINDOW w AS (PARTITION BY session ORDER BY us, i)),
    k AS (SELECT * FROM n WHERE ended = 0 AND (before IS NULL OR before <> m))
    SELECT session, row_number() OVER (PARTITION BY session ORDER BY us, i) - 1 AS number, 'data: {"type":"' || CASE WHEN m = 'error' THEN 'error' ELSE 'progress' END || '","msg":"' || m || '"}' || chr(10) || chr(10) AS line FROM k"""


ENTRIES, BYTES = 6, 300


def fifo_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews put into each user's cache: 12 names that come again, sizes of 0 to 200 and more, at most 6 entries and 300 bytes."""
    puts = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_id") % 12).alias("entry"), F.floor(F.col("value").cast("double") * 3).alias("size"))
    got = fifo.fifo_cache(puts, "user_id", ["us", "event_id"], "entry", "size", ENTRIES, BYTES)
    return got.select("user_id", "event_id", "stored", F.array_join("evicted", ",").alias("evicted"), "entries", "bytes")


_add(fifo_cache, f"""WITH RECURSIVE o AS (SELECT user_id, event_id, event_id % 12 AS e, CAST(floor(CAST(value AS DOUBLE) * 3) AS BIGINT) AS z, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, z <= {BYTES} AS stored, CAST([] AS BIGINT[]) AS gone, CASE WHEN z <= {BYTES} THEN [{{'e': e, 'z': z}}] ELSE CAST([] AS STRUCT(e BIGINT, z BIGINT)[]) END AS c FROM o WHERE n = 1
      UNION ALL SELECT user_id, event_id, n, z <= {BYTES}, CASE WHEN z > {BYTES} THEN CAST([] AS BIGINT[]) ELSE list_transform(b[:k], lambda x: x.e) END, CASE WHEN z > {BYTES} THEN old ELSE list_append(b[k + 1:], {{'e': e, 'z': z}}) END
        FROM (SELECT *, list_filter(range(len(b) + 1), lambda k: len(b) - k < {ENTRIES} AND coalesce(list_sum(list_transform(b[CAST(k AS BIGINT) + 1:], lambda x: x.z)), 0) + z <= {BYTES})[1] AS k
          FROM (SELECT o.user_id, o.event_id, o.n, o.e, o.z, f.c AS old, list_filter(f.c, lambda x: x.e <> o.e) AS b FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)))
    SELECT user_id, event_id, stored, array_to_string(gone, ',') AS evicted, CAST(len(c) AS INTEGER) AS entries, CAST(coalesce(list_sum(list_transform(c, lambda x: x.z)), 0) AS BIGINT) AS bytes FROM f""")  # fmt: skip


@_add
def mlp_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and accuracy of two epochs over all labelled vectors, in batches of 16."""
    got = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") < 5).cast("int").alias("label"))
    _, epochs = iterative.train_head(got, epochs=2)
    return epochs.select("epoch", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def fuzzy_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, some cut, bare or joined, with the best entry of a catalog of the parts' own names and types; many share a word."""
    part = table(spark, sf_dir, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    written = F.when(k % 5 == 0, F.regexp_replace(name, "[^A-Za-z0-9]+", "")).when(k % 5 == 1, F.substring(name, 4, 9)).when(k % 5 == 2, F.concat(F.lit("Alpha Mount "), F.upper(name))).when(k % 5 == 3, F.lit("Alpha")).otherwise(name)
    names = part.where(k % 4 == 0).select(written.alias("name"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("make"))
    entries = part.where(k % 4 != 0).select(F.when(k % 7 == 0, F.concat(F.lit("Alpha "), name)).otherwise(name).alias("model"), F.col("p_type").alias("maker"))
    return matching.best_matches(names, entries).select("name", "make", "model", "maker", F.round("score", 6).alias("score"))


def _compared(a: str, b: str) -> str:
    flat = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
    tokens = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
    share = f"len(list_intersect({tokens(a)}, {tokens(b)})) / CAST(greatest(len({tokens(a)}), len({tokens(b)})) AS DOUBLE)"
    return f"CASE WHEN {flat(a)} = '' OR {flat(b)} = '' THEN 0 WHEN {flat(a)} = {flat(b)} THEN 1 WHEN contains({flat(b)}, {flat(a)}) OR contains({flat(a)}, {flat(b)}) THEN CAST(0.86 AS DOUBLE) ELSE {share} END"


_add(fuzzy_prefix_match, f"""WITH n AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g') WHEN 1 THEN substr(p_name, 4, 9) WHEN 2 THEN 'Alpha Mount ' || upper(p_name) WHEN 3 THEN 'Alpha' ELSE p_name END AS name,
        CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS make FROM part WHERE p_partkey % 4 = 0),
    e AS (SELECT DISTINCT CASE WHEN p_partkey % 7 = 0 THEN 'Alpha ' || p_name ELSE p_name END AS model, p_type AS maker FROM part WHERE p_partkey % 4 <> 0),
    m AS (SELECT name, model, {_compared("name", "model")} AS m FROM (SELECT DISTINCT name FROM n), (SELECT DISTINCT model FROM e)),
    k AS (SELECT make, maker, CASE WHEN make = '' THEN CAST(0.5 AS DOUBLE) ELSE {_compared("make", "maker")} END AS k FROM (SELECT DISTINCT make FROM n), (SELECT DISTINCT maker FROM e)),
    s AS (SELECT n.name, n.make, e.model, e.maker, CAST(0.78 AS DOUBLE) * m + CAST(0.22 AS DOUBLE) * k AS score FROM n JOIN m ON m.name = n.name AND m.m > 0 JOIN e ON e.model = m.model JOIN k ON k.make = n.make AND k.maker = e.maker),
    b AS (SELECT * FROM s WHERE score >= 0.34 QUALIFY row_number() OVER (PARTITION BY name, make ORDER BY score DESC, model, maker) = 1)
    SELECT n.name, n.make, model, maker, round(score, 6) AS score FROM n LEFT JOIN b ON b.name = n.name AND b.make = n.make""")  # fmt: skip


def tool_json_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lens data from a metadata tool's JSON, one text per part: nested, partly empty, numbers for names, cut off, or no list at all."""
    k, name = F.col("p_partkey"), F.col("p_name")
    field = lambda c, tag, value: F.when(c, F.struct(F.lit(tag).alias("k"), value.alias("v")))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    fields = F.array_compact(F.array(
        field(k % 3 == 0, "LensModel", F.when(k % 2 == 0, quoted(name)).otherwise(F.lit('"  "'))), field(k % 5 < 3, "LensID", F.when(k % 5 == 0, k.cast("string")).otherwise(F.lit('{"deep": 1}'))),
        field(k % 2 == 0, "Lens", quoted(F.concat((10 + k % 40).cast("string"), F.lit("-"), (50 + k % 90).cast("string"), F.lit("mm f/2.8")))),
        field(k % 4 == 1, "LensSpecification", F.concat(F.lit("["), F.concat_ws(", ", F.lit("24"), F.when(k % 8 == 1, "70").otherwise("null"), F.lit("2.8"), F.lit('"4"')), F.lit("]"))),
        field(k % 6 == 2, "LensInfo", F.lit("[]")), field(k % 7 == 0, "Make", F.lit('"NIKON CORPORATION"')), field(k % 11 == 0, "FocalLengthIn35mmFormat", (k % 100).cast("string")),
    ))
    body = F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda f: F.concat(F.lit('"'), f["k"], F.lit('": '), f["v"])), ", "), F.lit("}"))
    text = F.when(k % 13 == 4, F.concat(F.lit("["), body)).when(k % 13 == 5, body).when(k % 13 == 6, "[]").when(k % 13 == 7, F.lit(None)).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    got = tooljson.with_lens(table(spark, sf_dir, "part").select(k.alias("part"), text.alias("text")), "text", "x")
    return got.select("part", "x.model", "x.make", "x.focal_35mm", F.array_join(F.transform("x.specification", lambda v: v.cast("string")), " ").alias("specification"))


_add(tool_json_lens)
catalog.oracles["tool_json_lens"] = """WITH p AS (SELECT p_partkey AS k, p_name AS n, p_partkey % 13 BETWEEN 4 AND 7 AS bad, (10 + p_partkey % 40) || '-' || (50 + p_partkey % 90) || 'mm f/2.8' AS lens FROM part),
    m AS (SELECT *, CASE WHEN k % 3 = 0 AND k % 2 = 0 AND trim(n) <> '' THEN n WHEN k % 5 = 0 THEN CAST(k AS VARCHAR) WHEN k % 2 = 0 THEN lens END AS model FROM p)
    SELECT k AS part, CASE WHEN NOT bad THEN model END AS model, CASE WHEN NOT bad AND k % 7 = 0 THEN 'Nikon' END AS make, CASE WHEN NOT bad AND k % 11 = 0 AND k % 100 > 0 THEN CAST(k % 100 AS DOUBLE) END AS focal_35mm,
        CASE WHEN bad THEN NULL WHEN k % 8 = 1 THEN '24.0 70.0 2.8 4.0' WHEN k % 4 = 1 THEN NULL WHEN k % 2 = 0 THEN (10 + k % 40) || '.0 ' || (50 + k % 90) || '.0 2.8 2.8' END AS specification FROM m"""
