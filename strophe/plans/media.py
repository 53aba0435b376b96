"""Queries of archives and recordings: written to the shared folder, read back, held to SQL over the tables they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import audio, tokens
from strophe.plans.files import _new
from strophe.plans.registry import query, r6
from strophe.sources import archives, readers

#: Samples a second of the recordings made of vectors, and their scale.
RATE = 8000
_SHORT = "CAST(CAST(round_even(CAST(x AS DOUBLE) * 20000, 0) AS INT) AS DOUBLE)"


def _recordings(t, path: str) -> None:
    """Each vector as a recording of 16-bit samples."""
    e = t("embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("name"), F.lit(RATE).alias("rate"), F.transform("embedding", lambda x: F.bround(x.cast("double") * 20000, 0) / 32768).alias("samples"))
    archives.write_files(audio.encoded(e), path)


def _vec(c="path"):
    return F.regexp_extract(c, r"v(\d+)\.wav$", 1).cast("long")


@query("""SELECT 'block_' || ((row_number() OVER (ORDER BY name) - 1) // 64 * 64) || '_web.tar.gz' AS shard, name, page_id, sha256(html) AS body
FROM (SELECT page_id, html, printf('%08d.html', page_id) AS name FROM pages)""")
def archived_pages(t):
    p = t("pages").select(F.format_string("%08d.html", "page_id").alias("name"), F.encode("html", "UTF-8").alias("body"))
    path = _new(p)
    archives.write_archives(p, path, 64, [".html"], "web")
    got = archives.read_archives(p.sparkSession, path)
    return got.select("shard", "name", F.substring("name", 1, 8).cast("long").alias("page_id"), F.sha2("body", 256).alias("body"))


@query("""SELECT shard, count(*) AS members FROM (
  SELECT page_id, 'block_' || ((row_number() OVER (ORDER BY printf('%08d', page_id)) - 1) // 10 * 10) || '_0.tar.gz' AS shard FROM pages) WHERE page_id % 3 = 0 GROUP BY 1""")
def archived_by_suffix(t):
    p = t("pages").select(F.concat(F.format_string("%08d", "page_id"), F.when(F.col("page_id") % 3 == 0, ".htm").otherwise(".txt")).alias("name"), F.encode("url", "UTF-8").alias("body"))
    path = _new(p)
    archives.write_archives(p, path, 10, [".htm"])
    return archives.read_archives(p.sparkSession, path).groupBy("shard").agg(F.count(F.lit(1)).alias("members"))


@query(f"""SELECT vec_id, len(embedding) AS frames, 44 + 2 * len(embedding) AS size, round(len(embedding) / 8000, 3) AS seconds, list_transform(embedding, lambda x: {_SHORT}) AS samples FROM embeddings""")
def audio_round_trip(t):
    path = _new(t("embeddings"))
    _recordings(t, path)
    got = audio.read_audio(t("embeddings").sparkSession, path)
    return got.select(_vec().alias("vec_id"), "frames", "size", audio.seconds(F.col("frames"), F.col("rate")).alias("seconds"), F.transform("samples", lambda x: x * 32768).alias("samples"))


@query(f"""SELECT vec_id, db > -20.5 AS loud, round(db, 6) AS db FROM (SELECT vec_id, 20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: ({_SHORT} / 32768) ** 2)) / len(embedding)) + 1e-8) AS db FROM embeddings)""")
def audio_levels(t):
    path = _new(t("embeddings"))
    _recordings(t, path)
    got = audio.read_audio(t("embeddings").sparkSession, path)
    return got.select(_vec().alias("vec_id"), tokens.has_vocal(F.col("samples"), -20.5).alias("loud"), r6(tokens.rms_db(F.col("samples"))).alias("db"))


@query(f"""SELECT vec_id, list_transform(CASE WHEN n <= 5 THEN embedding ELSE list_slice(embedding, (n // 2 - 2) * 8 + 1, (n // 2 + 3) * 8) END, lambda x: {_SHORT}) AS samples
FROM (SELECT vec_id, embedding, CAST(round(len(embedding) * 1000 / 8000) AS BIGINT) AS n FROM embeddings)""")
def audio_cuts(t):
    first, second = _new(t("embeddings")), _new(t("embeddings"))
    _recordings(t, first)
    spark = t("embeddings").sparkSession
    cut = audio.cut(audio.read_audio(spark, first), 5).withColumn("name", F.concat(F.lit("seg_"), F.element_at(F.split("path", "/"), -1)))
    archives.write_files(audio.encoded(cut), second)
    return audio.read_audio(spark, second).select(_vec().alias("vec_id"), F.transform("samples", lambda x: x * 32768).alias("samples"))


def _convolved(up: int, down: int, zeros: int = audio.ZEROS) -> str:
    """Direct convolution of each vector with the filter, for the output samples of its length."""
    cut = min(1.0, up / down)
    reach = zeros / cut
    return f"""WITH x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
n AS (SELECT vec_id, unnest(range(CAST(ceil(len(embedding) * {up} / {down}) AS BIGINT))) AS m FROM embeddings),
h AS (SELECT n.vec_id, n.m, CAST(x.x AS DOUBLE) AS x, n.m * {down} / {up} - x.k AS t FROM n JOIN x ON n.vec_id = x.vec_id AND abs(n.m * {down} / {up} - x.k) < {reach})
SELECT vec_id, m AS i, round(sum(x * {cut} * (CASE WHEN t = 0 THEN 1 ELSE sin(pi() * {cut} * t) / (pi() * {cut} * t) END) * (0.5 + 0.5 * cos(pi() * t / {reach}))), 6) + 0.0 AS y FROM h GROUP BY ALL"""


def _resampled(t, source: int, target: int, size: int):
    blocks = audio.in_blocks(t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples")), size, "vec_id")
    out = audio.resampled_blocks(blocks, source, target, size, "vec_id")
    whole = out.groupBy("vec_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "samples"))), lambda b: b["samples"])).alias("samples"))
    return whole.select("vec_id", F.posexplode("samples").alias("i", "y")).select("vec_id", F.col("i").cast("long").alias("i"), (r6("y") + 0.0).alias("y"))


@query(_convolved(3, 2))
def resampled_up(t):
    return _resampled(t, 16_000, 24_000, 10)


@query(_convolved(1, 3))
def resampled_down(t):
    return _resampled(t, 48_000, 16_000, 16)


@query("""SELECT 'c' || vec_id AS stem, [2, len(embedding) // 2] AS shape, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 500) AS BIGINT)) AS tokens FROM embeddings""")
def read_codec_files(t):
    e = t("embeddings").select(F.concat(F.lit("c"), F.col("vec_id").cast("string"), F.lit(".npy")).alias("name"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 500).cast("int")).alias("tokens"))
    path = _new(e)
    archives.write_files(archives.array_files(e, "name", "tokens", 2), path)
    return readers.arrays(e.sparkSession, path).select("stem", F.transform("shape", lambda x: x.cast("long")).alias("shape"), "tokens")


@query("""SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INT) AS idx, p_name AS title FROM part QUALIFY idx < 100""")
def first_json_items(t):
    p = t("part").select("p_partkey", F.struct(F.col("p_name").alias("title")).alias("s"))
    body = p.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "s"))), lambda x: x["s"])).alias("value"))
    path = _new(p)
    body.coalesce(1).write.text(path)
    return readers.json_items(p.sparkSession, path, "title string", 100)


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS status, event_id % 11 <> 0 AND event_type IN ('failed', 'running') AS processed
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE event_type END AS event_type FROM events WHERE user_id < 10)""")
def previous_api_results(t):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise(F.col("event_type"))
    e = t("events").where("user_id < 10").select("event_id", F.to_json(F.struct(F.struct(status.alias("status"), "value").alias("api_response"))).alias("body"))
    body = F.encode(F.when(F.col("event_id") % 11 == 0, F.substring("body", 1, 20)).otherwise(F.col("body")), "UTF-8")
    path = _new(e)
    archives.write_files(e.select(F.concat(F.lit("song_"), F.col("event_id").cast("string"), F.lit(".json")).alias("name"), body.alias("body")), path)
    got = readers.previous_results(e.sparkSession, path)
    return got.select(F.regexp_extract("path", r"song_(\d+)\.json", 1).cast("long").alias("event_id"), "status", "processed")
