"""Queries of the engine's own operators over whole tables, each with the SQL that must give the same rows.

Tables carry no lyrics, so time-coded lines, labels, audio turns, metrics and run logs are derived from
their columns, in the same way on both sides. Queries without SQL are tested against plain loops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions import jsonx, lrc, text, tokens
from strophe.operators import dedup, hysteresis, models, ordered, phonemes, relational, report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Callable[[str], DataFrame]], DataFrame]], Callable]:
    """Registers a function of a table reader under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# Filters and projections


@query("""SELECT regexp_replace(t, '^[^:]*:', '') AS tag, count(*) AS n FROM (
  SELECT lower(trim(x, E' \\n\\t\\r')) AS t FROM (SELECT unnest(regexp_split_to_array(text, '[,，.]')) AS x FROM documents)) WHERE t <> '' GROUP BY 1""")
def tag_counts(t):
    return t("documents").select(F.explode(text.normalise_tags(F.col("text"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def filter_lang(t):
    return relational.filter_lang(t("documents"), ["de", "fr"]).select("doc_id", "lang")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500 AND n_chars <= 2500")
def filter_length(t):
    return relational.filter_length(t("documents"), 500, 2500, "n_chars").select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE n_chars >= 4000")
def filter_length_open(t):
    return relational.filter_length(t("documents"), 4000, -1, "n_chars").select("doc_id")


@query("""SELECT p_partkey, p_name FROM part WHERE trim(p_name) <> '' AND length(trim(p_name)) <= 20 AND NOT (contains(p_name, ':') AND contains(p_name, '.'))""")
def valid_labels(t):
    return t("part").where(relational.valid_label(F.col("p_name"), 20)).select("p_partkey", "p_name")


@query("""SELECT doc_id, CASE WHEN doc_id <= 500 THEN 'cn' ELSE 'en' END AS lang_part, CASE WHEN doc_id <= 500 THEN doc_id - 1 ELSE doc_id - 501 END AS new_idx
FROM documents WHERE doc_id BETWEEN 1 AND 1000""")
def index_split(t):
    return relational.split_by_index(t("documents").select("doc_id"), "doc_id", 500)


@query("SELECT conv_id, turn, role FROM conversations WHERE turn > 0 AND role <> 'assistant'")
def prompts_only(t):
    return relational.prompts_only(t("conversations")).select("conv_id", "turn", "role")


@query("""SELECT a.p_partkey, CASE WHEN length(b.p_type) > length(a.p_name) THEN b.p_type ELSE a.p_name END AS lyric FROM part a JOIN part b USING (p_partkey)""")
def longer_lyric(t):
    return t("part").select("p_partkey", relational.longer_lyric(F.col("p_name"), F.col("p_type")).alias("lyric"))


@query("""SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'URGENT') THEN o_orderpriority WHEN o_totalprice > 100000 THEN o_orderpriority ELSE o_orderstatus END AS tag FROM orders""")
def choose_tag(t):
    p = F.col("o_orderpriority")
    return t("orders").select("o_orderkey", relational.choose_tag(F.replace(p, F.lit("URGENT"), F.lit("cn")), p, F.col("o_orderstatus"), F.col("o_totalprice"), F.lit(100000.0)).alias("tag"))


@query("""SELECT vec_id, CASE p WHEN 7 THEN '' ELSE 'd' || p END AS descr FROM (SELECT vec_id, list_position(embedding, list_max(embedding)) AS p FROM embeddings)""")
def choose_description(t):
    descs = F.transform("embedding", lambda x, i: F.when(i == 6, "音频过短").otherwise(F.concat(F.lit("d"), (i + 1).cast("string"))))
    return t("embeddings").select("vec_id", relational.choose_description(descs, F.col("embedding")).alias("descr"))


@query("""WITH f AS (SELECT user_id, event_type, event_id % 3 + 1 AS stage, event_id % 4 AS k FROM events),
g AS (SELECT user_id, list(DISTINCT k) FILTER (stage = 1) AS s1, list(DISTINCT k) FILTER (stage = 2) AS s2, bool_or(stage = 3) AS stage3 FROM f GROUP BY user_id),
h AS (SELECT user_id, coalesce(len(s1), 0) >= 2 AS stage1, coalesce(len(s1), 0) >= 2 AND len(list_filter(s1, lambda x: NOT list_contains(coalesce(s2, []), x))) = 0 AS stage2, stage3 FROM g)
SELECT user_id AS song, stage1, stage2, stage3, CASE WHEN stage3 THEN 4 WHEN stage2 THEN 3 WHEN stage1 THEN 2 ELSE 1 END AS resume FROM h""")
def stage_status(t):
    files = t("events").select(F.col("user_id").alias("song"), F.concat(F.lit("stage"), (F.col("event_id") % 3 + 1).cast("string"), F.lit("/"), (F.col("event_id") % 4).cast("string"), F.lit(".npy")).alias("name"))
    return relational.generation_stage(files)


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'processing' ELSE 'failed' END AS state FROM orders""")
def api_states(t):
    s = F.col("o_orderstatus")
    return t("orders").select("o_orderkey", relational.api_state(F.when(s == "F", "succeeded").when(s == "O", "running").otherwise("cancelled")).alias("state"))


# Joins


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality IS NOT NULL)")
def resume_anti(t):
    return relational.drop_finished(t("documents"), t("labels"), "doc_id", "quality").select("doc_id", "lang")


@query("""SELECT page_id FROM pages WHERE regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') NOT IN (SELECT DISTINCT regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') FROM pages WHERE page_id % 3 = 0)""")
def drop_done_files(t):
    p = t("pages").withColumn("path", F.col("url"))
    return relational.drop_done_files(p, p.where("page_id % 3 = 0").select("path")).select("page_id")


@query("""SELECT l.l_orderkey, l.l_linenumber, q.p_partkey, q.p_name FROM lineitem l JOIN part s ON l.l_partkey = s.p_partkey
JOIN (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1) q ON s.p_name = q.p_name""")
def match_lastwins(t):
    last = relational.last_wins(t("part"), ["p_name"], ["p_partkey"]).select("p_name", "p_partkey")
    named = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return named.join(last, "p_name").select("l_orderkey", "l_linenumber", "p_partkey", "p_name")


@query("""SELECT count(*) AS total, count(*) FILTER (c_custkey IS NOT NULL AND n > 0) AS kept, count(*) FILTER (c_custkey IS NULL OR n IS NULL) AS skipped
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def composite_join_counts(t):
    items = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(items, "o_orderkey", "left")
    kept = F.col("c_custkey").isNotNull() & F.coalesce(F.col("n") > 0, F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"), F.count_if(F.col("c_custkey").isNull() | F.col("n").isNull()).alias("skipped"))


@query("""SELECT a.conv_id, b.turn AS file_index, a.text AS hyp, b.text AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn""")
def offset_join(t):
    c = t("conversations")
    hyp = c.select("conv_id", "turn", F.col("text").alias("hyp")).withColumn("k", F.col("conv_id") * 100000 + F.col("turn"))
    gt = c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("file_index"), F.col("text").alias("ref"))
    return relational.offset_join(hyp, gt, F.col("k"), 1).select("conv_id", (F.col("file_index") - F.col("conv_id") * 100000).alias("file_index"), "hyp", "ref")


@query("""WITH a AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS n FROM benchmark), b AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM pages)
SELECT item_id, page_id FROM a JOIN b USING (n)""")
def positional_join(t):
    return relational.zip_in_order(t("benchmark").select("item_id"), t("pages").select("page_id"), "item_id", "page_id").select("item_id", "page_id")


@query("""WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn AS user_turn, a.turn AS assistant_turn FROM u JOIN a ON u.conv_id = a.conv_id AND u.n = a.n AND u.c = a.c""")
def zip_guard(t):
    side = lambda role, name: t("conversations").where(F.col("role") == role).select("conv_id", F.col("turn").alias(name))
    return relational.zip_guarded(side("user", "user_turn"), side("assistant", "assistant_turn"), "conv_id", "user_turn", "assistant_turn").select("conv_id", "user_turn", "assistant_turn")


@query("""SELECT a.o_orderkey AS vocal, b.o_orderkey AS instrumental FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey - 1 WHERE a.o_orderkey % 2 = 0""")
def pair_stems(t):
    k = F.col("o_orderkey")
    name = F.concat(F.floor(k / 2).cast("string"), F.when(k % 2 == 0, "_vtrack").otherwise("_itrack"))
    p = relational.pair_stems(t("orders").select(name.alias("path")))
    n = F.regexp_extract("vocal", r"^(\d+)", 1).cast("long")
    return p.select((n * 2).alias("vocal"), (n * 2 + 1).alias("instrumental"))


# Aggregates


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def label_counts(t):
    return relational.label_counts(t("events").select(F.array("event_type").alias("labels")))


@query("SELECT combo, count(*) AS n FROM (SELECT string_agg(role, ' | ' ORDER BY turn) AS combo FROM conversations GROUP BY conv_id) GROUP BY 1")
def label_combos(t):
    lists = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("labels"))
    return relational.label_combinations(lists)


@query("""WITH s AS (SELECT conv_id, turn AS pos, CASE role WHEN 'user' THEN 'en' ELSE 'zh' END AS lang, text FROM conversations),
v AS (SELECT conv_id, lang, count(*) AS n, min(pos) AS f FROM s WHERE (CASE WHEN lang = 'en' THEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) ELSE length(text) END) >= 5 GROUP BY 1, 2),
k AS (SELECT conv_id, list(lang ORDER BY f) AS l FROM v WHERE n >= 2 GROUP BY 1)
SELECT c.conv_id, CASE WHEN l IS NULL THEN 'pure' WHEN len(l) = 1 THEN l[1] ELSE 'multi: ' || array_to_string(l, ' ') END AS vote FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k USING (conv_id)""")
def lang_vote(t):
    s = t("conversations").select("conv_id", F.col("turn").alias("pos"), F.when(F.col("role") == "user", "en").otherwise("zh").alias("lang"), "text")
    return relational.language_vote(s, "conv_id", 5, 2)


_SONG_SQL = "CASE lang WHEN 'de' THEN translate(text, 'aeioun', '安恩伊欧乌嗯') WHEN 'fr' THEN CASE WHEN doc_id % 2 = 0 THEN translate(text, 'a', '安') || chr(10) || repeat('one two three four five' || chr(10), 6) || repeat('一二三四五' || chr(10), 6) ELSE text END ELSE text END"


def _song(t) -> DataFrame:
    more = "\n" + "one two three four five\n" * 6 + "一二三四五\n" * 6
    said = F.when(F.col("lang") == "de", F.translate("text", "aeioun", "安恩伊欧乌嗯")).when((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0), F.concat(F.translate("text", "a", "安"), F.lit(more)))
    return t("documents").select("doc_id", "lang", said.otherwise(F.col("text")).alias("text"))


_LYRIC_LANG_SQL = f"""l AS (SELECT doc_id, unnest(string_split({_SONG_SQL}, chr(10))) AS x FROM documents),
m AS (SELECT doc_id, regexp_replace(x, '[''￥·′´（），。？"!@#$%^&*()?./,=+_—— ！…《》<>0-9～※~;－・、☆｜△【】＃「」‖{{}}\\[\\]-]', ' ', 'g') AS x FROM l),
c AS (SELECT doc_id, length(regexp_replace(x, '[\\x{{4e00}}-\\x{{9fff}}a-zA-Z\\s]', '', 'g')) AS nan, length(x) - length(regexp_replace(x, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS cjk, len(string_split(regexp_replace(x, '[\\x{{4e00}}-\\x{{9fff}}]+', '', 'g'), ' ')) AS en FROM m),
g AS (SELECT doc_id, count(*) FILTER (nan > 3) AS n_nan, count(*) FILTER (nan <= 3 AND cjk > 3) AS n_zh, count(*) FILTER (nan <= 3 AND en > 3) AS n_en FROM c GROUP BY 1),
decided AS (SELECT doc_id, CASE WHEN n_nan > 5 THEN 'nan' WHEN n_zh > 5 AND n_en > 5 THEN 'ez' WHEN n_zh > 5 THEN 'zh' WHEN n_en > 5 THEN 'en' ELSE 'instrument' END AS lyric_lang FROM g)"""


@query(f"WITH {_LYRIC_LANG_SQL} SELECT doc_id, lyric_lang FROM decided")
def lyric_lang(t):
    return _song(t).select("doc_id", relational.lyric_language(F.split("text", "\n")).alias("lyric_lang"))


@query(f"WITH {_LYRIC_LANG_SQL} SELECT lyric_lang, count(*) AS n FROM decided GROUP BY 1")
def lyric_lang_counts(t):
    return relational.counts_by(_song(t).select(relational.lyric_language(F.split("text", "\n")).alias("lyric_lang")), "lyric_lang")


@query("SELECT round(coalesce(avg(value), 1.0), 6) AS per, count(*) AS count FROM events WHERE event_type = 'no such type'")
def mean_of_none(t):
    return relational.mean_or(t("events").where("event_type = 'no such type'"), "value", 1.0, "per")


@query("SELECT round(coalesce(avg(value), 0.0), 6) AS similarity, count(*) AS count FROM events")
def metric_means(t):
    return relational.mean_or(t("events"), "value", 0.0, "similarity").withColumn("similarity", r6("similarity"))


@query("""WITH f AS (SELECT 'm' || (o_orderkey % 7) AS model, count(*) AS count FROM orders GROUP BY 1),
s AS (SELECT 'm' || (l_orderkey % 7) AS model, avg(l_quantity) AS CE, avg(l_discount) AS CU, avg(l_tax) AS PC, avg(l_linenumber) AS PQ FROM lineitem GROUP BY 1)
SELECT model, count, round(CE, 6) AS CE, round(CU, 6) AS CU, round(PC, 6) AS PC, round(PQ, 6) AS PQ, round(CE + CU + PC + PQ, 6) AS Score FROM f LEFT JOIN s USING (model)""")
def aesthetics(t):
    model = lambda k: F.concat(F.lit("m"), (F.col(k) % 7).cast("string")).alias("model")
    scores = t("lineitem").select(model("l_orderkey"), F.col("l_quantity").alias("CE"), F.col("l_discount").alias("CU"), F.col("l_tax").alias("PC"), F.col("l_linenumber").alias("PQ"))
    out = relational.aesthetics(t("orders").select(model("o_orderkey")), scores)
    return out.select("model", "count", *(r6(c).alias(c) for c in ("CE", "CU", "PC", "PQ", "Score")))


_METRICS_SQL = "m AS (SELECT 'm' || (user_id % 9) || (CASE event_id % 2 WHEN 0 THEN '_cn' ELSE '_en' END) AS model, event_type AS metric, avg(value) AS value FROM events GROUP BY 1, 2)"


def _metrics(t) -> DataFrame:
    model = F.concat(F.lit("m"), (F.col("user_id") % 9).cast("string"), F.when(F.col("event_id") % 2 == 0, "_cn").otherwise("_en"))
    return t("events").groupBy(model.alias("model"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))


@query(f"WITH {_METRICS_SQL} SELECT regexp_replace(model, '_(cn|en)$', '') AS model, metric, round(avg(value), 6) AS value FROM m GROUP BY 1, 2")
def metric_merge(t):
    return relational.merge_languages(_metrics(t)).withColumn("value", r6("value"))


@query(f"""WITH {_METRICS_SQL}, s AS (SELECT regexp_replace(model, '_(cn|en)$', '') AS base, regexp_extract(model, '_(cn|en)$', 1) AS part, metric, value FROM m)
SELECT base, part, metric, round(avg(value), 6) AS value FROM s GROUP BY GROUPING SETS ((base, part, metric), (base, metric))""")
def metric_report(t):
    return relational.metric_report(_metrics(t)).select("base", "part", "metric", r6("value").alias("value"))


@query(f"WITH {_METRICS_SQL} SELECT metric, round(CASE WHEN metric = 'click' THEN min(value) ELSE max(value) END, 6) AS best FROM m GROUP BY metric")
def metric_best(t):
    return relational.best_values(_metrics(t), "click").withColumn("best", r6("best"))


@query(f"""WITH {_METRICS_SQL}, w AS (SELECT model, metric, abs(value - CASE WHEN metric = 'click' THEN min(value) OVER (PARTITION BY metric) ELSE max(value) OVER (PARTITION BY metric) END) < 1e-9 AS is_best FROM m)
SELECT model, metric FROM w WHERE is_best""")
def metric_marks(t):
    return relational.mark_best(_metrics(t), "click").where("is_best").select("model", "metric")


@query(f"WITH {_METRICS_SQL} SELECT model, round(max(value) FILTER (metric = 'click'), 6) AS click, round(max(value) FILTER (metric = 'purchase'), 6) AS purchase FROM m WHERE metric IN ('click', 'purchase') GROUP BY model")
def metric_table(t):
    return relational.metric_table(_metrics(t).where(F.col("metric").isin("click", "purchase")), ["click", "purchase"]).select("model", r6("click").alias("click"), r6("purchase").alias("purchase"))


@query(f"""WITH {_METRICS_SQL}, w AS (SELECT model, metric, printf('%.4f', value) AS s, abs(value - max(value) OVER (PARTITION BY metric)) < 1e-9 AS b FROM m),
c AS (SELECT model, metric, CASE WHEN b THEN '**' || s || '**' ELSE s END AS cell FROM w)
SELECT model, '| ' || model || ' | ' || coalesce(max(cell) FILTER (metric = 'click'), '-') || ' | ' || coalesce(max(cell) FILTER (metric = 'none'), '-') || ' |' AS row FROM c GROUP BY model""")
def markdown_rows(t):
    return report.markdown_rows(_metrics(t), ["click", "none"])


@query("""WITH l AS (SELECT event_type <> 'error' AND event_id % 5 <> 0 AS success, event_id % 3 AS tracks_count, abs(value) AS wait_time, abs(value) / 10 AS download_time, abs(value) * 2 AS total_time, event_id * 1000 AS download_bytes, event_id % 7 AS poll_count FROM events)
SELECT count(*) AS total, count(*) FILTER (success) AS n_success, count(*) FILTER (NOT success) AS n_fail, CAST(coalesce(sum(tracks_count) FILTER (success), 0) AS BIGINT) AS tracks, round(avg(tracks_count) FILTER (success), 6) AS avg_tracks,
round(avg(wait_time) FILTER (success), 6) AS avg_wait, round(min(wait_time) FILTER (success), 6) AS min_wait, round(max(wait_time) FILTER (success), 6) AS max_wait, round(sum(download_time) FILTER (success), 4) AS sum_download, round(avg(download_time) FILTER (success), 6) AS avg_download,
CAST(sum(download_bytes) FILTER (success) AS BIGINT) AS bytes, CAST(sum(poll_count) FILTER (success) AS BIGINT) AS polls, round(avg(poll_count) FILTER (success), 6) AS avg_polls FROM l""")
def run_report(t):
    v = F.abs("value")
    e = F.col("event_id")
    log = t("events").select(((F.col("event_type") != "error") & (e % 5 != 0)).alias("success"), (e % 3).alias("tracks_count"), v.alias("wait_time"), (v / 10).alias("download_time"), (v * 2).alias("total_time"), (e * 1000).alias("download_bytes"), (e % 7).alias("poll_count"))
    rounded = {c: r6(c) for c in ("avg_tracks", "avg_wait", "min_wait", "max_wait", "avg_download", "avg_polls")} | {"sum_download": F.round("sum_download", 4)}
    return relational.run_report(log).withColumns(rounded).drop("sum_total", "songs_per_minute", "efficiency")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus = 'O') AS processing, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders")
def state_counts(t):
    s = F.col("o_orderstatus")
    return relational.state_counts(t("orders").select(F.when(s == "F", "success").when(s == "O", "processing").otherwise("failed").alias("state")), states=("success", "processing", "failed"))


@query("SELECT round(avg(n_chars), 6) AS avg_n_chars FROM (SELECT n_chars FROM documents ORDER BY doc_id LIMIT 50)")
def mean_of_first(t):
    return relational.mean_of_first(t("documents"), "doc_id", 50, "n_chars").withColumn("avg_n_chars", r6("avg_n_chars"))


@query("SELECT count(*) FILTER (a = b) AS \"right\", count(*) AS total, round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 6) AS accuracy FROM (SELECT l_returnflag AS a, l_linestatus AS b FROM lineitem UNION ALL SELECT 'F', 'F')")
def polyphone_accuracy(t):
    spark = t("lineitem").sparkSession
    j = t("lineitem").select(F.col("l_returnflag").alias("expected"), F.col("l_linestatus").alias("predicted")).union(spark.createDataFrame([("F", "F")], "expected string, predicted string"))
    return relational.polyphone_accuracy(j).withColumn("accuracy", r6("accuracy"))


@query("""WITH n AS (SELECT p_brand AS char, p_type AS reading FROM part WHERE p_type <> p_name AND p_brand <> 'Brand#1' QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1),
o AS (SELECT DISTINCT p_brand AS char, 'old' AS reading FROM part UNION SELECT DISTINCT p_type, 'other' FROM part) SELECT * FROM n UNION ALL SELECT * FROM o WHERE char NOT IN (SELECT char FROM n)""")
def correction_dictionary(t):
    p = t("part")
    expected = F.when(F.col("p_brand") == "Brand#1", F.col("p_name")).otherwise(F.col("p_type"))  # one brand is never wrong
    judged = p.select(F.col("p_brand").alias("char"), expected.alias("expected"), F.col("p_name").alias("predicted"), F.col("p_partkey").alias("row_idx"))
    old = p.select(F.col("p_brand").alias("char"), F.lit("old").alias("reading")).union(p.select("p_type", F.lit("other"))).distinct()
    return relational.corrections(judged, old)


@query("SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1")
def distinct_in_order(t):
    return relational.distinct_in_order(t("part"), "p_brand", "p_partkey")


# Order, limits and samples


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'), doc_id LIMIT 100")
def sample_k(t):
    return relational.sample_k(t("documents").select("doc_id"), "doc_id", 100, 7)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'), doc_id) - 1 AS pool_rank, count(*) OVER () AS n FROM documents)
SELECT doc_id, pool_rank, CASE WHEN pool_rank < n // 30 * 30 THEN pool_rank // 30 ELSE -1 END AS draw FROM r""")
def sample_pool(t):
    return relational.sample_pool(t("documents").select("doc_id"), "doc_id", 30, 7).select("doc_id", F.col("pool_rank").cast("long").alias("pool_rank"), F.coalesce(F.col("draw").cast("long"), F.lit(-1)).alias("draw"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch FROM events")
def batch_ids(t):
    return ordered.batch_ids(t("events").select("event_id"), "event_id", 64).select("event_id", F.col("batch").cast("long").alias("batch"))


@query("SELECT text, max(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup_last(t):
    return relational.last_wins(t("documents").select("doc_id", "text"), ["text"], ["doc_id"])


# Text functions


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace('[' || source || '] ' || text, '\\[[^\\n]*?\\]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM documents""")
def clean_lyrics(t):
    return t("documents").select("doc_id", text.clean_lyrics(F.concat(F.lit("["), "source", F.lit("] "), "text")).alias("cleaned"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(text, '[ ,。"，:;&—''.\\]\\[()?\\n-]', ' ', 'g'), ' {2,}', ' ', 'g') AS filtered FROM documents""")
def signal_filter(t):
    return t("documents").select("doc_id", text.signal_filter(F.col("text")).alias("filtered"))


@query("""WITH a AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(trim(text, E' \\n\\t\\r'), chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> ''), ' ') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '([.,!?:;，。！？；])\\s*', '\\1' || chr(10), 'g'), '''\\s+', '''', 'g'), '[ \\t]+', ' ', 'g') AS t FROM a)
SELECT doc_id, trim(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x)), chr(10)), E' \\n') AS cleaned FROM b""")
def clean_newlines(t):
    return t("documents").select("doc_id", text.clean_newlines(F.col("text")).alias("cleaned"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[,。"，:;&—‘''.\\]\\[()?\\n-]', '.', 'g'), '\\.{2,}', '.', 'g'), '\\.$', '') AS broken FROM documents""")
def broken_lyrics(t):
    return t("documents").select("doc_id", text.broken_lyrics(F.col("text")).alias("broken"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') AS stem, coalesce(CAST(list_extract(regexp_extract_all(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', ''), '\\d+'), -1) AS BIGINT), -1) AS idx FROM pages""")
def stem_index(t):
    return t("pages").select("page_id", text.file_stem(F.col("url")).alias("stem"), F.coalesce(text.last_number(F.col("url")), F.lit(-1)).alias("idx"))


@query("""SELECT p_partkey, CASE WHEN lower(p_type) LIKE 'verse%' THEN '[verse]' WHEN contains(lower(p_type), 'chorus') THEN '[chorus]' WHEN contains(lower(p_type), 'bridge') THEN '[bridge]' ELSE '[' || lower(p_type) || ']' END AS label FROM part""")
def structure_labels(t):
    return t("part").select("p_partkey", text.structure_label(F.col("p_type")).alias("label"))


@query("""SELECT conv_id, turn, '[' || role || ']' || chr(10) || trim(text, E' \\n') || chr(10) || chr(10) AS block FROM conversations""")
def lyric_blocks(t):
    bare = F.concat(F.lit("["), "role", F.lit("]"), F.col("text"))
    return t("conversations").select("conv_id", "turn", F.explode(text.lyric_blocks(bare)).alias("block"))


@query("""SELECT event_id, printf('%.2f', CASE WHEN v < 1024 THEN v WHEN v < 1048576 THEN v / 1024 WHEN v < 1073741824 THEN v / 1048576 ELSE v / 1073741824 END) || CASE WHEN v < 1024 THEN ' B' WHEN v < 1048576 THEN ' KB' WHEN v < 1073741824 THEN ' MB' ELSE ' GB' END AS size
FROM (SELECT event_id, CAST(event_id * event_id * 7 AS DOUBLE) AS v FROM events)""")
def pretty_bytes(t):
    return t("events").select("event_id", text.pretty_bytes(F.col("event_id") * F.col("event_id") * 7, "GB").alias("size"))  # as its SQL, which has no larger unit


@query("""SELECT doc_id, CAST(length(regexp_replace(text, '[a-zA-Z\\s]', '', 'g')) AS INT) AS other FROM documents""")
def count_other(t):
    return t("documents").select("doc_id", text.count_other(F.col("text")).alias("other"))


@query("""SELECT conv_id, turn, role AS section, nullif(trim(regexp_replace(text, '[\\[\\]]', '', 'g'), E' \\n\\t\\r'), '') AS descr FROM conversations""")
def described_sections(t):
    c = F.concat(F.lit("["), "role", F.lit("][desc:"), F.regexp_replace("text", r"[\[\]]", ""), F.lit("][lyrics:x]"))
    return t("conversations").select("conv_id", "turn", text.section_name(c).alias("section"), text.described(c).alias("descr"))


@query("""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split('INFO Retry 1' || chr(10) || text || chr(10) || 'saved to x', chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, 'Retry') AND NOT contains(x, 'saved to')), ' ') AS said FROM conversations""")
def asr_text(t):
    c = F.concat(F.lit("INFO Retry 1\n"), "text", F.lit("\nsaved to x"))
    return t("conversations").select("conv_id", "turn", text.asr_text(c).alias("said"))


# Time-coded lyrics

_LRC_SQL = "d AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: printf('[%02d:%02d.%02d]', (i * 7) // 60, (i * 7) % 60, (i * 13) % 100) || x), chr(10)) AS lyric FROM documents)"


def _lrc(t) -> DataFrame:
    i = lambda k: (k + 1) * 7
    line = lambda x, k: F.concat(F.format_string("[%02d:%02d.%02d]", F.floor(i(k) / 60).cast("int"), (i(k) % 60).cast("int"), ((k + 1) * 13 % 100).cast("int")), x)
    return t("documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("lyric"))


_STAMP_SQL = "'\\[(\\d{1,2}):(\\d{1,2})(?:[.:](\\d{1,3}))?\\]([^\\[]*)'"


@query(f"""WITH {_LRC_SQL}, m AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(lyric, {_STAMP_SQL}, 1), regexp_extract_all(lyric, {_STAMP_SQL}, 2), regexp_extract_all(lyric, {_STAMP_SQL}, 3), regexp_extract_all(lyric, {_STAMP_SQL}, 4))) AS z FROM d)
SELECT doc_id, round(CAST(z[1] AS INT) * 60 + CAST(z[2] AS INT) + CAST(z[3] AS DOUBLE) / 1000, 6) AS start_s, trim(z[4], E' \\n') AS line FROM m WHERE trim(z[4], E' \\n') <> ''""")
def lrc_parse_a(t):
    return _lrc(t).select("doc_id", F.explode(lrc.lines_to_bracket(F.col("lyric"))).alias("l")).select("doc_id", r6("l.start_s").alias("start_s"), F.col("l.text").alias("line"))


@query(f"""WITH {_LRC_SQL}, m AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(lyric, {_STAMP_SQL}, 1), regexp_extract_all(lyric, {_STAMP_SQL}, 2), regexp_extract_all(lyric, {_STAMP_SQL}, 3), regexp_extract_all(lyric, {_STAMP_SQL}, 4))) AS z FROM d)
SELECT doc_id, round(CAST(z[1] AS INT) * 60 + CAST(z[2] AS INT) + CAST(z[3] AS DOUBLE) / 100, 6) AS start_s, trim(z[4], E' \\n') AS line FROM m""")
def lrc_parse_b(t):
    return _lrc(t).select("doc_id", F.explode(lrc.lines_to_stamp(F.col("lyric"))).alias("l")).select("doc_id", r6("l.start_s").alias("start_s"), F.col("l.text").alias("line"))


_T3 = "'\\[(\\d{2}):(\\d{2})(?:\\.(\\d{2}))?\\]'"


@query(f"""WITH {_LRC_SQL}, m AS (SELECT doc_id, unnest(list_zip(regexp_extract_all(lyric, {_T3}, 1), regexp_extract_all(lyric, {_T3}, 2), regexp_extract_all(lyric, {_T3}, 3))) AS z FROM d)
SELECT doc_id, round(CAST(z[1] AS INT) * 60 + CAST(z[2] AS INT) + CAST(z[3] AS DOUBLE) / 100, 6) AS start_s FROM m""")
def lrc_parse_c(t):
    return _lrc(t).select("doc_id", F.explode(lrc.stamps(F.col("lyric"))).alias("s")).select("doc_id", r6("s").alias("start_s"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) >= 2 AND (len(string_split(text, chr(10))) * 7 + (len(string_split(text, chr(10))) * 13) % 100 / 100) >= 30 AS valid FROM documents""")
def lrc_valid(t):
    return _lrc(t).select("doc_id", lrc.is_valid(F.col("lyric"), 30.0, 35.0).alias("valid"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, n_chars FROM documents)
SELECT doc_id, pos, CAST(pos * 7 AS DOUBLE) AS start_s, CAST(coalesce(lead(pos * 7) OVER (PARTITION BY doc_id ORDER BY pos), n_chars) AS DOUBLE) AS end_s FROM l""")
def line_spans(t):
    lines = t("documents").select("doc_id", "n_chars", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), (F.col("pos") * 7).cast("double").alias("start_s"), "n_chars")
    return ordered.line_spans(lines, "doc_id", "pos", "start_s", F.col("n_chars").cast("double")).drop("n_chars")


# Ordered operators


@query("""WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN '[Verse ' || turn || ']' || text ELSE text END AS line FROM conversations),
s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sec, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
g AS (SELECT conv_id, sec, 'Verse ' || min(turn) AS label, min(turn) * 10.0 AS start_s, string_agg(line, chr(10) ORDER BY turn) AS text, first(n) * 10.0 + 5 AS total FROM s WHERE sec >= 0 GROUP BY 1, 2)
SELECT conv_id, CAST(sec AS BIGINT) AS sec, label, CAST(start_s AS DOUBLE) AS start_s, text, CAST(coalesce(lead(start_s) OVER (PARTITION BY conv_id ORDER BY sec), total) AS DOUBLE) AS end_s FROM g""")
def sections(t):
    line = F.when(F.col("role") == "user", F.concat(F.lit("[Verse "), F.col("turn").cast("string"), F.lit("]"), "text")).otherwise(F.col("text"))
    c = t("conversations").select("conv_id", "turn", line.alias("text"), (F.col("turn") * 10).cast("double").alias("start_s"), (F.count(F.lit(1)).over(Window.partitionBy("conv_id")) * 10.0 + 5).alias("total_s"))
    return ordered.sections(c, "conv_id", "turn").drop("outro_s")


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN '[verse] ' || text ELSE text END AS word, turn % 5 <> 3 AS success FROM conversations),
s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg FROM c WHERE success)
SELECT conv_id, CAST(seg AS BIGINT) AS seg, 'verse' AS label, CAST(min(turn) AS DOUBLE) AS start, CAST(coalesce(max(turn) FILTER (role <> 'user') + 0.5, 0) AS DOUBLE) AS "end", string_agg(regexp_replace(word, '^\\[verse\\] ', ''), '' ORDER BY turn) AS word FROM s WHERE seg >= 0 GROUP BY 1, 2""")
def segments(t):
    w = F.when(F.col("role") == "user", F.concat(F.lit("[verse] "), "text")).otherwise(F.col("text"))
    c = t("conversations").select("conv_id", "turn", w.alias("word"), (F.col("turn") % 5 != 3).alias("success"), F.col("turn").cast("double").alias("startS"), (F.col("turn") + 0.5).cast("double").alias("endS"))
    return ordered.segments(c, "conv_id", "turn")


@query("""WITH c AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' AND length(text) % 3 <> 0 THEN turn END) OVER w AS p, max(CASE WHEN role = 'assistant' THEN turn END) OVER w AS a
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sub_idx FROM c WHERE role = 'assistant')
SELECT u.conv_id, u.turn, q.text AS text_prompt, u.sub_idx, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) - 1 AS flat_index FROM u JOIN conversations q ON q.conv_id = u.conv_id AND q.turn = u.p WHERE u.a IS NULL OR u.p > u.a""")
def chunk_prompts(t):
    prompt = F.when(F.length("text") % 3 != 0, F.col("text"))
    out = ordered.chunk_prompts(t("conversations"), "conv_id", prompt=prompt, audio=F.lit(True))
    return out.select("conv_id", "turn", "text_prompt", F.col("sub_idx").cast("long").alias("sub_idx"), F.col("flat_index").cast("long").alias("flat_index"))


@query("""WITH c AS (SELECT conv_id, turn, CAST(floor(length(text) / 25 * 48000) AS BIGINT) AS dur FROM conversations),
s AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_sample FROM c)
SELECT conv_id, turn, CAST(start_sample AS BIGINT) AS start_sample, CAST(least(start_sample + dur, 2000000) AS BIGINT) AS end_sample FROM s WHERE start_sample < 2000000""")
def sample_offsets(t):
    c = t("conversations").withColumn("n", F.length("text"))
    return ordered.sample_offsets(c, "conv_id", "turn", F.col("n"), F.lit(2_000_000)).select("conv_id", "turn", F.col("start_sample").cast("long").alias("start_sample"), F.col("end_sample").cast("long").alias("end_sample"))


@query("""WITH c AS (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS joined_length FROM conversations WHERE text <> '')
SELECT conv_id, turn, CAST(joined_length AS BIGINT) AS joined_length FROM c WHERE joined_length <= 1600""")
def greedy_prefix(t):
    return ordered.greedy_prefix(t("conversations").where("text <> ''"), "conv_id", "turn", "text").select("conv_id", "turn", "joined_length")


@query("""SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 9999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_window(t):
    return ordered.request_rate(t("events").select("event_id", "ts")).select("event_id", "in_window")


@query("""SELECT conv_id, turn, coalesce(history, '') AS history FROM (SELECT conv_id, turn, role, string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM conversations) WHERE role = 'assistant'""")
def history_prompt(t):
    return ordered.history_prompts(t("conversations"), "conv_id").select("conv_id", "turn", "history")


@query("""WITH RECURSIVE f AS (SELECT user_id, epoch_us(ts) / 1e6 AS ts, value > 10 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(ts DOUBLE, v BOOLEAN)[]) AS held, CAST(NULL AS DOUBLE) AS open, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM f
UNION ALL SELECT user_id, k, CASE WHEN turned THEN [] ELSE h END, CASE WHEN NOT turned THEN open WHEN open IS NULL THEN h[1].ts END,
  CASE WHEN turned AND open IS NOT NULL THEN open WHEN k = n AND NOT turned THEN open WHEN k = n AND open IS NULL THEN h[1].ts END, CASE WHEN (turned AND open IS NOT NULL) OR k = n THEN ts + 0.03 END
  FROM (SELECT *, len(list_filter(h, lambda x: x.v = (open IS NULL))) > 9 AS turned FROM (
    SELECT r.user_id, f.k, f.n, f.ts, r.open, list_append(list_slice(r.held, greatest(len(r.held) - 8, 1), len(r.held)), {'ts': f.ts, 'v': f.v}) AS h FROM r JOIN f ON f.user_id = r.user_id AND f.k = r.k + 1))),
s AS (SELECT user_id, a, b, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS span FROM r WHERE a IS NOT NULL)
SELECT user_id AS path, CAST(coalesce(span, 0) AS INT) AS span, round(coalesce(a, -1), 6) AS start, round(coalesce(b, -1), 6) AS "end" FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN s USING (user_id)""")
def voiced_spans(t):
    e = t("events").select(F.col("user_id").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (F.col("value") > 10).alias("is_speech"))
    return hysteresis.voiced_spans(e).withColumns({"start": r6("start"), "end": r6("end")})


@query("""WITH RECURSIVE f AS (SELECT user_id, epoch_us(ts) / 1e6 AS ts_s, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS ts_s, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS before FROM f
UNION ALL SELECT r.user_id, f.k, f.ts_s, CASE WHEN r.before IS NOT NULL AND greatest(f.ts_s, r.last) - r.before < 3600 THEN r.before + 3600 + 0.05 ELSE greatest(f.ts_s, coalesce(r.last, f.ts_s)) END, r.last FROM r JOIN f ON f.user_id = r.user_id AND f.k = r.k + 1)
SELECT user_id, round(ts_s, 6) AS ts_s, round(last, 6) AS admitted_s FROM r WHERE k > 0""")
def admission_times(t):
    out = ordered.admission(t("events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_s")), "user_id", limit=2, seconds=3600.0)
    return out.withColumns({"ts_s": r6("ts_s"), "admitted_s": r6("admitted_s")})


# Arrays and tokens


@query("""SELECT vec_id, '[SOA]' || coalesce(array_to_string(list_transform(list_slice(q, 26, 50), lambda x: '<AUDIO_' || x || '>'), ''), '') || '[EOA]' AS piece FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 500) AS INT)) AS q FROM embeddings)""")
def token_slice(t):
    q = _quantised(t)
    return q.select("vec_id", tokens.audio_text(tokens.token_slice(F.col("q"), F.lit(1.0), F.lit(2.0))).alias("piece"))


def _quantised(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 500).cast("int")).alias("q"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 500) AS INT)) AS q FROM embeddings)
SELECT vec_id, flatten(list_transform(range(1, 33), lambda i: [q[i] + 45334, q[i + 32] + 46358])) AS ids FROM e""")
def codec_ids(t):
    rows = F.array(F.slice("q", 1, 32), F.slice("q", 33, 32))
    return _quantised(t).select("vec_id", tokens.interleave(tokens.offset_codes(rows, "xcodec")).alias("ids"))


@query("""WITH e AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 500) AS INT) // 64)) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
c AS (SELECT vec_id, x, count(*) AS n, min(p) AS f FROM e GROUP BY 1, 2),
m AS (SELECT vec_id, arg_max(x, n * 1000 - f) AS mode FROM c GROUP BY 1)
SELECT vec_id, list(CASE WHEN x < 0 OR x >= 8 THEN mode ELSE x END ORDER BY p) AS repaired FROM e JOIN m USING (vec_id) GROUP BY vec_id""")
def mode_repair(t):
    q = _quantised(t).withColumn("q", F.transform("q", lambda x: F.floor(x / 64).cast("int")))
    return q.select("vec_id", tokens.repair_by_mode(F.col("q"), 8).alias("repaired"))


@query("""SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.3""")
def dedup_pairs(t):
    return dedup.similarity_edges(t("embeddings"), 0.3).withColumn("cos", r6("cos"))


@query("""WITH RECURSIVE e AS (SELECT b.vec_id AS j, list(a.vec_id) AS nb FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.3 GROUP BY 1),
n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k, coalesce(nb, []) AS nb FROM embeddings LEFT JOIN e ON j = vec_id),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT n.k, CASE WHEN list_has_any(kept, nb) THEN kept ELSE list_append(kept, vec_id) END FROM r JOIN n ON n.k = r.k + 1)
SELECT unnest(kept) AS vec_id FROM r WHERE k = (SELECT max(k) FROM n)""")
def dedup_greedy(t):
    v = t("embeddings").select("vec_id", "embedding")
    return dedup.greedy_similar(v, 0.3).select("vec_id")


# JSON and phonemes


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract(t):
    answer = F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```\nDone."))
    return t("events").select("event_id", jsonx.parsed(answer, "k long")["k"].alias("k"))


@query("""SELECT event_id, event_type AS description FROM events""")
def json_songs(t):
    answer = F.concat(F.lit('```json\n[{"description": "'), "event_type", F.lit('", "lyrics": "la"},]\n```'))
    return t("events").select("event_id", F.explode(jsonx.songs(answer)).alias("s")).select("event_id", F.col("s.description").alias("description"))


@query("""WITH p AS (SELECT a.conv_id, a.turn, left(a.text, least(length(a.text), length(b.text))) AS ref, left(b.text, least(length(a.text), length(b.text))) AS hyp FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
w AS (SELECT conv_id, turn, regexp_replace(ref, '[^a-z]', '', 'g') AS r, regexp_replace(hyp, '[^a-z]', '', 'g') AS h FROM p)
SELECT conv_id, turn, round(CASE WHEN length(r) = 0 THEN (CASE WHEN length(h) > 0 THEN 1.0 ELSE 0.0 END) ELSE levenshtein(r, h) / length(r) END, 6) AS per FROM w""")
def phoneme_errors(t):
    c = t("conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    ref, hyp = phonemes.equal_length(F.col("text"), F.col("hyp"))
    letters = lambda x: F.filter(F.split(F.regexp_replace(x, "[^a-z]", ""), ""), lambda y: y != "")
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", r6(phonemes.phoneme_error_rate(letters(ref), letters(hyp))).alias("per"))


# Composite pipelines over derived inputs


@query("""WITH p AS (SELECT page_id AS row_idx, url AS path, length(html) / 20 AS duration, strpos('0123456789abcdef', substr(sha256(url), 16, 1)) - 1 AS h FROM pages)
SELECT row_idx, path, duration, ['rock', 'folk', 'jazz', 'pop'][h % 4 + 1] || ',' || ['rock', 'folk', 'jazz', 'pop'][h // 4 + 1] AS tags FROM p WHERE duration BETWEEN 20 AND 360""")
def metadata_pipeline(t):
    from strophe.plans.composites import metadata

    raw = t("pages").select(F.col("page_id").alias("row_idx"), F.col("url").alias("path"), (F.length("html") / 20).alias("duration"))
    return metadata(raw, lo=20, hi=360).withColumn("tags", F.array_join("tags", ","))


@query("""WITH l AS (SELECT doc_id, n_chars, x, i, CAST(i * 7 AS DOUBLE) + (i * 13) % 100 / 1000 AS start_s FROM (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
k AS (SELECT doc_id, n_chars, trim(x, E' \\n\\t\\r') AS x, start_s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM l WHERE trim(x, E' \\n\\t\\r') <> ''),
e AS (SELECT *, lead(start_s) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM k),
s AS (SELECT *, least(CAST(trunc(start_s * 25) AS BIGINT), n_chars + 1) AS a, least(CAST(trunc(coalesce(nxt, (n_chars + 1) / 25.0) * 25) AS BIGINT), n_chars + 1) AS b FROM e),
m AS (SELECT doc_id, 0 AS turn, 'user' AS role, 'song ' || doc_id AS content FROM s WHERE i = 1
UNION ALL SELECT doc_id, 1, 'assistant', '[SOA]' || array_to_string(list_transform(range(0, a), lambda v: '<AUDIO_' || v || '>'), '') || '[EOA]' FROM s WHERE i = 1
UNION ALL SELECT doc_id, 2 * i, 'user', CASE WHEN nxt IS NULL THEN '请生成歌词' || x || '以及歌曲结尾' ELSE x END FROM s
UNION ALL SELECT doc_id, 2 * i + 1, 'assistant', '[SOA]' || coalesce(array_to_string(list_transform(range(a, b), lambda v: '<AUDIO_' || v || '>'), ''), '') || '[EOA]' FROM s)
SELECT CAST(doc_id AS VARCHAR) AS stem, CAST(turn AS INT) AS turn, role, content FROM m""")
def line_conversations(t):
    from strophe.plans.composites import line_conversations as convert

    items = _lrc(t).select(F.col("doc_id").cast("string").alias("stem"), "lyric", F.lit("").alias("tlyric"))
    audio = t("documents").select(F.col("doc_id").cast("string").alias("stem"), "n_chars")
    turns = convert(items, audio, F.concat(F.lit("song "), "stem"), F.sequence(F.lit(0), F.col("n_chars").cast("int"))).select("stem", F.posexplode("messages").alias("turn", "m"))
    return turns.select("stem", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, nullif(trim(regexp_replace(text, '[\\[\\]]', '', 'g'), E' \\n\\t\\r'), '') AS said, max(CASE WHEN role = 'user' AND trim(regexp_replace(text, '[\\[\\]]', '', 'g'), E' \\n\\t\\r') <> '' THEN turn END) OVER w AS p, max(CASE WHEN role <> 'user' THEN turn END) OVER w AS a
FROM (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant' END AS role FROM conversations WHERE role IN ('user', 'assistant')) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sub_idx FROM c WHERE role = 'assistant'),
j AS (SELECT u.conv_id, u.turn, q.said AS text_prompt, u.sub_idx, length(u.text) + 1 AS n_tokens FROM u JOIN c q ON q.conv_id = u.conv_id AND q.turn = u.p WHERE u.a IS NULL OR u.p > u.a),
d AS (SELECT *, CAST(floor(n_tokens / 25 * 48000) AS BIGINT) AS dur FROM j),
o AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_sample, row_number() OVER (ORDER BY conv_id, turn) - 1 AS flat_index FROM d)
SELECT conv_id AS song_idx, turn, text_prompt, 'Verse' AS section_name, CAST(sub_idx AS BIGINT) AS sub_idx, CAST(flat_index AS BIGINT) AS flat_index, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(start_sample AS BIGINT) AS start_sample, CAST(start_sample + dur AS BIGINT) AS end_sample,
  CAST(CAST('0x' || substr(sha256(text_prompt), 1, 16) AS UBIGINT) % 10000 AS DOUBLE) / 10000 AS score FROM o""")
def chunk_evaluation(t):
    from strophe.plans.composites import chunk_evaluation as evaluate

    c = t("conversations")
    said = F.when(F.col("role") == "user", F.concat(F.lit("[Verse][desc:"), F.regexp_replace("text", r"[\[\]]", ""), F.lit("]"))).otherwise(tokens.audio_text(F.sequence(F.lit(0), F.length("text"))))
    return evaluate(c.select(F.lit("chat.jsonl").alias("file"), F.col("conv_id").alias("song_idx"), "turn", "role", said.alias("text"))).select(
        "song_idx", "turn", "text_prompt", "section_name", *(F.col(c).cast("long").alias(c) for c in ("sub_idx", "flat_index", "n_tokens", "start_sample", "end_sample")), "score")


@query("""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN 'answer ' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) ELSE text END AS text, CASE WHEN role = 'assistant' THEN 'generated' ELSE 'given' END AS status, '' AS error FROM conversations""")
def generated_turns(t):
    return models.generate_turns(t("conversations"), lambda history: f"answer {len(history)}").withColumn("error", F.coalesce("error", F.lit("")))


from strophe.plans import files, media, more, songs, speech, streams, tokenized  # noqa: E402, F401  (their queries register themselves)
