"""Further queries: operators that need no files, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import jsonx, lrc, text, tokens
from strophe.operators import models, ordered, phonemes, relational, vocab
from strophe.plans.registry import _LRC_SQL, _lrc, _quantised, query, r6
from strophe.shared import cut, ranked

_TRIM = "E' \\n\\t\\r'"

# Filters, joins and sets


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def existing_paths(t):
    listing = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("path"))
    return relational.filter_existing(t("orders").withColumn("path", F.col("o_custkey")), listing).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name <> '' AND length(p_type) > 6")
def required_fields(t):
    p = t("part").select("p_partkey", "p_name", F.when(F.length("p_type") > 6, F.col("p_type")).otherwise("").alias("kind"))
    return relational.with_fields(p, "p_name", "kind").select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_partkey AS k FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1) ON l_partkey = k")
def polyphone_rows(t):
    items = t("lineitem").withColumn("char", F.col("l_partkey"))
    readings = items.groupBy("char").agg(F.collect_set("l_returnflag").alias("readings"))
    return relational.polyphones(items, readings).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN source ELSE lang END AS lyric FROM documents")
def lyric_or_translation(t):
    return t("documents").select("doc_id", relational.lyric_or_translation(F.when(F.col("lang") == "de", "").otherwise(F.col("lang")), F.col("source")).alias("lyric"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_name ELSE c_mktsegment END AS intro FROM customer")
def choose_intro(t):
    return t("customer").select("c_custkey", relational.choose_intro(F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal"), F.lit(5000.0)).alias("intro"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN props ELSE event_type END AS genre FROM events")
def genre_fallback(t):
    return t("events").select("event_id", relational.truthy_or(F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")), F.col("props")).alias("genre"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'auto' ELSE 'none' END AS source FROM events")
def prompt_sources(t):
    k = F.col("event_id") % 3
    return t("events").select("event_id", relational.prompt_source(F.when(k == 0, F.col("event_type")), F.when(k == 1, "Pop"), ["Pop", "Rock"]).alias("source"))


@query("""WITH t AS (SELECT o_orderkey AS file_idx, o_orderstatus AS hyp FROM orders WHERE o_orderkey % 5 <> 0)
SELECT file_idx, hyp FROM t UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey NOT IN (SELECT file_idx FROM t)""")
def fill_missing(t):
    o = t("orders").select(F.col("o_orderkey").alias("file_idx"), F.col("o_orderstatus").alias("hyp"))
    return relational.fill_missing(o, o.where("file_idx % 5 <> 0"), o.select("file_idx", F.lit("missing").alias("hyp")))


@query("""WITH l AS (SELECT p_partkey, replace(p_name, ' ', '') || ' - ' || p_brand || '.mp3' AS f FROM part), w AS (SELECT f, max(p_partkey) AS k FROM l GROUP BY 1)
SELECT m.p_partkey, w.k FROM l m JOIN w USING (f)""")
def match_music(t):
    p = t("part")
    music = p.select("p_partkey", F.concat(F.lit("music/"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit(" - "), "p_brand", F.lit(".mp3")).alias("path"))
    lyrics = p.select(F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("name"), F.col("p_brand").alias("artist"), F.col("p_partkey").alias("k"))
    return relational.match_music(music, lyrics)[0].select("p_partkey", "k")


@query("""SELECT o_orderkey AS song_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS INT) AS track_index, o_totalprice AS duration, c_custkey AS n_tokens FROM orders JOIN customer ON c_custkey = o_custkey""")
def with_descriptions(t):
    o = t("orders").withColumn("track", F.when(F.col("o_orderkey") % 2 == 1, 1))  # none counts as 0
    meta = o.select(F.col("o_orderkey").alias("song_id"), F.col("track").alias("track_index"), F.concat(F.lit("a/"), F.col("o_custkey").cast("string"), F.lit(".mp3")).alias("src_path"))
    desc = o.select(F.col("o_orderkey").alias("song_id"), F.coalesce("track", F.lit(0)).alias("track_index"), F.col("o_totalprice").alias("duration"))
    audio = t("customer").select(F.col("c_custkey").cast("string").alias("stem"), F.col("c_custkey").alias("n_tokens"))
    return relational.with_descriptions(meta, desc, audio).select("song_id", "track_index", "duration", "n_tokens")


@query("SELECT event_id, 'p' || (event_id % 60) AS prompt FROM events WHERE event_id % 60 < 40")
def prompt_by_index(t):
    prompts = t("region").where("r_regionkey = 0").select(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("p"), i.cast("string"))).alias("prompts"))
    return relational.with_prompt(t("events").select("event_id", (F.col("event_id") % 60).cast("int").alias("idx")), prompts).select("event_id", "prompt")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def keys_only_left(t):
    return relational.keys_only_left(t("customer"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def keys_in_both(t):
    return relational.keys_in_both(t("customer"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT c_custkey AS idx, CASE WHEN c_custkey <= 50 THEN 'zh/song_' || c_custkey ELSE 'en/song_' || (c_custkey - 50) END || '.jsonl' AS target FROM customer WHERE c_custkey > 0""")
def target_files(t):
    return relational.target_files(t("customer").where("c_custkey > 0").select(F.col("c_custkey").alias("idx"))).select("idx", "target")


@query("""SELECT path, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'old') AS prompt FROM (SELECT 'zh/song_' || c_custkey || '.jsonl' AS path, c_custkey FROM customer WHERE c_custkey BETWEEN 1 AND 50 UNION ALL SELECT 'en/song_' || (c_custkey - 50) || '.jsonl', c_custkey FROM customer WHERE c_custkey > 50) JOIN customer USING (c_custkey)""")
def updated_targets(t):
    songs = t("customer").where("c_custkey > 0").select(F.col("c_custkey").alias("idx"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("prompt"))
    files = relational.target_files(songs).select(F.col("target").alias("path"), F.lit("old").alias("prompt"))
    return relational.update_targets(files, songs)


@query("""SELECT c_custkey AS audio_duration, c_name AS prompt, CAST(0 AS DOUBLE) AS guidance_scale_text, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 7.5) AS guidance_scale, c_custkey || ', ' || c_nationkey AS actual_seeds FROM customer""")
def parameters(t):
    rows = t("customer").select(F.col("c_custkey").alias("audio_duration"), F.col("c_name").alias("prompt"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("guidance_scale"), F.array("c_custkey", F.col("c_nationkey").cast("long")).alias("actual_seeds"))
    return relational.with_defaults(rows, {"audio_duration": None, "prompt": None, "guidance_scale_text": 0.0, "guidance_scale": 7.5, "actual_seeds": None})


# Aggregates, order and samples


@query("SELECT lang, count(*) AS total, count(*) FILTER (n_chars >= 500) AS kept, count(*) FILTER (n_chars < 500) AS skipped FROM documents GROUP BY 1")
def counters(t):
    return relational.counters(t("documents"), F.col("n_chars") >= 500, "lang")


@query("SELECT vec_id, round(CAST(list_max(embedding) AS DOUBLE), 6) AS most, round(CAST(list_min(embedding) AS DOUBLE), 6) AS least FROM embeddings")
def similarity_extremes(t):
    e = t("embeddings").withColumn("x", relational.extremes(F.transform("embedding", lambda x: x.cast("double"))))
    return e.select("vec_id", r6("x.max").alias("most"), r6("x.min").alias("least"))


@query("""WITH f AS (SELECT page_id, length(html) AS size, row_number() OVER (ORDER BY page_id) AS count FROM pages), s AS (SELECT *, sum(size) OVER (ORDER BY page_id) AS total_bytes FROM f),
b AS (SELECT min(count) AS stop FROM s WHERE count % 16 = 0 AND total_bytes > 300000) SELECT page_id, CAST(count AS BIGINT) AS count, CAST(total_bytes AS BIGINT) AS total_bytes FROM s, b WHERE stop IS NULL OR count <= stop""")
def fitting_files(t):
    return relational.fitting_files(t("pages").select("page_id", F.length("html").alias("size")), "page_id", "size", 300_000, 16).select("page_id", "count", "total_bytes")


def _in_order(df):
    """The rows of a sorted frame with their place in it."""
    return ranked(cut(df.withColumn("__m", F.monotonically_increasing_id())), "__m", "place").drop("__m")


@query("SELECT user_id, n, first, row_number() OVER (ORDER BY n DESC, first) - 1 AS place FROM (SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1)")
def counts_in_order(t):
    return _in_order(relational.by_count(t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")), "n", "first"))


@query("""SELECT path, row_number() OVER (ORDER BY TRY_CAST(regexp_extract(regexp_replace(path, '^.*/', ''), '([0-9]+)[^0-9]*\\.mp3$', 1) AS BIGINT) NULLS LAST, path) - 1 AS place FROM (
  SELECT CASE WHEN page_id % 7 = 0 THEN 'a1/none_' || chr(CAST(97 + page_id % 26 AS INT)) || '.mp3' ELSE 'a1/s' || (page_id * 7919 % 1000) || '_' || page_id || '.mp3' END AS path FROM (SELECT DISTINCT page_id FROM pages))""")
def paths_by_number(t):
    i = F.col("page_id")
    none = F.concat(F.lit("a1/none_"), F.char(97 + i % 26), F.lit(".mp3"))
    path = F.when(i % 7 == 0, none).otherwise(F.concat(F.lit("a1/s"), (i * 7919 % 1000).cast("string"), F.lit("_"), i.cast("string"), F.lit(".mp3")))
    return _in_order(relational.sort_by_path_number(t("pages").select(path.alias("path"))))


@query("""SELECT file_idx, place FROM (SELECT CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS file_idx, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_custkey END, 999999)) - 1 AS place FROM orders)""")
def sorted_by_index(t):
    return _in_order(relational.sort_by_index(t("orders").select(F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("file_idx"))))


@query("SELECT arg_max(event_id, ts) AS event_id FROM events")
def latest(t):
    return relational.latest(t("events"), "event_id", "ts")


@query("SELECT event_id FROM events WHERE event_id < 100")
def first_rows(t):
    return relational.first_rows(t("events").select("event_id"), 100, "event_id")


@query("SELECT doc_id, 170 + CAST('0x' || substr(md5(doc_id || '|3'), 1, 12) AS BIGINT) % 41 AS drawn FROM documents")
def random_ints(t):
    return t("documents").select("doc_id", relational.random_int(F.col("doc_id"), F.lit(170), F.lit(210), 3).alias("drawn"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'e', '鹅') ELSE text END AS t FROM documents),
n AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[\\x{4e00}-\\x{9fff}]') THEN length(replace(t, chr(10), '')) ELSE len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) END AS n FROM d),
b AS (SELECT doc_id, CAST(floor(n * 0.4::DOUBLE) AS BIGINT) AS lo, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS hi FROM n)
SELECT doc_id, lo + CAST('0x' || substr(md5(doc_id || '|5'), 1, 12) AS BIGINT) % (hi - lo + 1) AS seconds FROM b""")
def lyric_durations(t):
    text_of = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "e", "鹅")).otherwise(F.col("text"))
    return t("documents").select("doc_id", relational.lyric_duration(text_of, F.col("doc_id"), 5).alias("seconds"))


# Text


@query("""SELECT conv_id, turn, '[' || CASE role WHEN 'user' THEN 'pre' ELSE role END || ']' AS tag FROM conversations""")
def section_tags(t):
    c = F.concat(F.lit("["), F.when(F.col("role") == "user", "Pre ").otherwise(F.initcap("role")), (F.col("turn") % 10).cast("string"), F.lit(" (x)][desc:"), F.lit("y]"))
    return t("conversations").select("conv_id", "turn", text.section_tag(c).alias("tag"))


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[,。"，:;&—‘''.\\]\\[()?\\n-]', '.', 'g'), '\\.{2,}', '.', 'g'), '') AS x, regexp_replace(regexp_replace(regexp_replace(text, '[,。"，:;&—‘''.\\]\\[()?\\n-]', '.', 'g'), '\\.{2,}', '.', 'g'), '\\.$', '') AS lyrics FROM conversations""")
def section_lyrics(t):
    c = F.concat(F.lit("[verse][desc:d][lyrics:\n"), "text", F.lit("][phoneme:p]"))
    broken = F.regexp_replace(F.regexp_replace("text", text.BREAKS, "."), r"\.{2,}", ".")
    return t("conversations").select("conv_id", "turn", broken.alias("x"), text.section_lyrics(c).alias("lyrics"))


@query("""SELECT conv_id, turn, role AS style FROM conversations""")
def style_between(t):
    c = F.concat(F.lit("<s>"), "role", F.lit("</s> rest"))
    return t("conversations").select("conv_id", "turn", text.between(c, "<s>", "</s>").alias("style"))


@query(f"""SELECT conv_id, turn, trim(regexp_extract(text, '^[^\\n]*'), {_TRIM}) AS style FROM conversations""")
def style_lines(t):
    return t("conversations").select("conv_id", "turn", text.style_line(F.concat(F.lit("in the following style:"), "text")).alias("style"))


@query("""SELECT p_partkey, p_type || ' ' || p_size AS section, lower(replace(p_type || ' x ', ' ', '')) AS key FROM part""")
def section_keys(t):
    label = F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"))
    return t("part").select("p_partkey", text.bracket_section(F.concat(F.lit("12 [1] ["), label, F.lit("] la"))).alias("section"), text.section_key(F.concat("p_type", F.lit(" x "), F.col("p_size").cast("string"))).alias("key"))


@query("""SELECT p_partkey, p_name AS descr FROM part""")
def clean_descriptions(t):
    return t("part").select("p_partkey", text.clean_description(F.concat(F.lit(" [desc] ["), "p_name", F.lit("]\n"))).alias("descr"))


@query("""SELECT p_partkey, replace(replace(p_type, '/', '_'), ' ', '-') || ',' || replace(p_name, ' ', '-') AS genre FROM part""")
def filename_genres(t):
    return t("part").select("p_partkey", text.filename_genre(F.concat(F.lit("??"), "p_type", F.lit(", "), "p_name")).alias("genre"))


@query("""SELECT conv_id, turn, len(string_split(text, chr(10))) AS n_lines, string_split(text, chr(10))[1] AS first FROM conversations""")
def phoneme_lines(t):
    lines = text.phoneme_lyrics(F.concat(F.lit("[verse][lyrics:"), "text", F.lit("]")))
    return t("conversations").select("conv_id", "turn", F.size(lines).cast("long").alias("n_lines"), lines[0].alias("first"))


@query("""SELECT conv_id, turn, role AS lang, text AS lyric FROM conversations""")
def asr_sentences(t):
    c = F.concat(F.lit("<|"), "role", F.lit("|><asr>"), "text")
    return t("conversations").select("conv_id", "turn", F.explode(text.asr_sentences(c)).alias("s")).select("conv_id", "turn", F.col("s.lang").alias("lang"), F.col("s.lyric").alias("lyric"))


@query("""SELECT doc_id, length(x) - length(regexp_replace(x, '[\\x{4e00}-\\x{9fff}]', '', 'g')) AS cjk, regexp_matches(x, '[\\x{4e00}-\\x{9fff}]') AS has FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE translate(text, 'ae', '安伊') END AS x FROM documents)""")
def cjk_counts(t):
    c = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.translate("text", "ae", "安伊"))
    return t("documents").select("doc_id", text.count_cjk(c).cast("long").alias("cjk"), text.has_cjk(c).alias("has"))


@query("""SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 500) AS INT)) AS codes FROM embeddings""")
def audio_codes(t):
    c = F.concat(F.lit("said "), tokens.audio_text(F.col("q")), F.lit(" <AUDIO_x>"))
    return _quantised(t).select("vec_id", text.audio_codes(c).alias("codes"))


@query("""SELECT event_id, printf('%06d_%04d', event_id, event_id % 100) AS tail FROM events""")
def song_ids(t):
    e = F.col("event_id")
    return t("events").select("event_id", F.regexp_replace(vocab.song_id(F.lit("track"), e, e % 100), "^track_", "").alias("tail"))


@query("""SELECT event_id, printf('[%02d:%02d.00]', (event_id % 400) // 60, (event_id % 400) % 60) AS stamp, (event_id % 5) || '分15秒' AS spoken, CAST((event_id % 5) * 60 + 15 AS INT) AS seconds FROM events""")
def clocks(t):
    clock = F.concat((F.col("event_id") % 5).cast("string"), F.lit(".15"))
    return t("events").select("event_id", text.clock_stamp(F.col("event_id") % 400).alias("stamp"), text.spoken_duration(clock).alias("spoken"), text.clock_seconds(clock).alias("seconds"))


@query("""SELECT p_partkey, 'Please generate a song in the following style:' || p_type || '.' || chr(10) || 'Next, I will tell you the requirements and lyrics for the song fragment to be generated, section by section.' || chr(10) AS prelude FROM part""")
def style_preludes(t):
    return t("part").select("p_partkey", text.style_prelude(F.col("p_type")).alias("prelude"))


@query("""SELECT event_id, contains('!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', substr(props, 1, 1)) AS ascii, regexp_matches(event_type || CASE WHEN event_id % 2 = 0 THEN '。' ELSE '' END, '。') AS cjk FROM events""")
def punctuation(t):
    return t("events").select("event_id", text.is_ascii_punctuation(F.substring("props", 1, 1)).alias("ascii"), text.has_cjk_punctuation(F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "。").otherwise(""))).alias("cjk"))


@query("SELECT conv_id, turn, text AS prompt FROM conversations")
def segment_prompts(t):
    return t("conversations").select("conv_id", "turn", text.segment_prompt(F.concat(F.lit("[start_of_segment]"), "text")).alias("prompt"))


@query(f"""WITH {_LRC_SQL} SELECT doc_id, regexp_replace(lyric, '\\[\\d{{2}}:\\d{{2}}(?:\\.\\d+)?\\]', '', 'g') AS bare FROM d""")
def stripped_stamps(t):
    return _lrc(t).select("doc_id", lrc.strip_stamps(F.col("lyric")).alias("bare"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_TRIM})), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, list_concat(['[start]', '[intro]'], list_concat(w, ['[end]'])) AS lines FROM l""")
def lyric_lines(t):
    return _lrc(t).select("doc_id", text.lrc_lines(F.col("lyric")).alias("lines"))


# Tokens and arrays


@query("""SELECT event_id, CAST(floor(event_id / 25 * 48000) AS BIGINT) AS samples, CAST(floor(event_id * 1000 / 48000 * 25) + 1 AS BIGINT) AS n FROM events""")
def token_samples(t):
    e = F.col("event_id")
    return t("events").select("event_id", tokens.samples_of_tokens(e).alias("samples"), tokens.token_count(e * 1000).alias("n"))


_Q = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 500) AS INT)) AS q FROM embeddings)"


@query(f"""WITH {_Q} SELECT vec_id, list_transform(range(1, 33), lambda i: q[2 * i - 1]) AS vocal, list_transform(range(1, 33), lambda i: q[2 * i]) AS music FROM e""")
def split_tracks(t):
    vocal, music = tokens.split_tracks(F.col("q"))
    return _quantised(t).select("vec_id", vocal.alias("vocal"), music.alias("music"))


@query(f"""WITH {_Q} SELECT vec_id, k AS block, list_slice(q, 10 * k + 1, 10 * k + 10) AS codes FROM e, (SELECT unnest(range(0, 7)) AS k)""")
def token_blocks(t):
    return _quantised(t).select("vec_id", F.posexplode(tokens.blocks(F.col("q"), 10)).alias("block", "codes")).withColumn("block", F.col("block").cast("long"))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 500 = 0 THEN 0 ELSE (event_id % 500 - 1) // 30 END AS BIGINT) AS frames FROM events""")
def vad_frames(t):
    return t("events").select("event_id", F.size(tokens.frame_starts(F.col("event_id") % 500, 30)).cast("long").alias("frames"))


@query(f"""WITH {_Q} SELECT vec_id, list_slice(q, 55, 64) AS last, list_slice(q, 2, 63) AS inside FROM e""")
def token_tails(t):
    return _quantised(t).select("vec_id", tokens.tail(F.col("q"), 10).alias("last"), tokens.inner(F.col("q")).alias("inside"))


@query(f"""WITH {_Q} SELECT vec_id, q FROM e""")
def codec_round_trip(t):
    rows = F.array(F.slice("q", 1, 32), F.slice("q", 33, 32))
    flat = _quantised(t).withColumn("ids", tokens.interleave(tokens.offset_codes(rows, "xcodec"))).where(tokens.codec_of(F.col("ids")) == "xcodec")
    return flat.select("vec_id", F.flatten(tokens.restore_codes(tokens.deinterleave(F.col("ids"), 2), "xcodec")).alias("q"))


@query("""SELECT vec_id, 20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 64) + 1e-8) > -18.2 AS vocal FROM embeddings""")
def vocal_present(t):
    return t("embeddings").select("vec_id", tokens.has_vocal(F.transform("embedding", lambda x: x.cast("double")), -18.2).alias("vocal"))


@query("""SELECT event_id, round(CASE WHEN value <= 30 THEN 0 ELSE (value - 30) * 0.5 END, 6) AS first, round(CASE WHEN value <= 30 THEN value ELSE (value - 30) * 0.5 + 30 END, 6) AS last FROM events""")
def cut_bounds(t):
    a, b = tokens.cut_bounds(F.col("value"))
    return t("events").select("event_id", r6(a).alias("first"), r6(b).alias("last"))


_X = "x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS s FROM embeddings), p AS (SELECT *, list_max(list_transform(s, lambda v: abs(v))) AS peak FROM x)"


@query(f"""WITH {_X} SELECT vec_id, list_transform(s, lambda v: round(CASE WHEN peak > 0.3 THEN v / (peak / 0.3) ELSE v END, 9)) AS s FROM p""")
def limited_samples(t):
    s = tokens.limited(F.transform("embedding", lambda x: x.cast("double")), 0.3)
    return t("embeddings").select("vec_id", F.transform(s, lambda v: F.round(v, 9)).alias("s"))


@query(f"""WITH {_X} SELECT vec_id, list_concat(list_slice(s, 1, 24), list_concat(list_transform(range(0, 8), lambda i: round(s[25 + i] * (1 - i / 7.0) + s[33 + i] * (i / 7.0), 9)), list_slice(s, 41, 64))) AS s FROM p""")
def cross_faded(t):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    joined = tokens.cross_faded(F.slice("s", 1, 32), F.slice("s", 33, 32), 8)
    return e.select("vec_id", F.transform(joined, lambda v, i: F.when(i.between(24, 31), F.round(v, 9)).otherwise(v)).alias("s"))


@query(f"""WITH {_X} SELECT vec_id, s AS l, list_transform(range(0, 64), lambda i: CASE WHEN i < 10 THEN 0.0 ELSE round(s[i - 9] * 0.8, 9) END) AS r FROM p""")
def fake_stereo(t):
    e = t("embeddings").select("vec_id", tokens.fake_stereo(F.transform("embedding", lambda x: x.cast("double")), 1000).alias("c"))
    return e.select("vec_id", F.col("c")[0].alias("l"), F.transform(F.col("c")[1], lambda v: F.round(v, 9)).alias("r"))


@query("""SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN i >= 8 AND i < 16 THEN 'masked' ELSE 'open' END) AS marks FROM embeddings""")
def masked_ids(t):
    m = vocab.masked_logits(F.transform("embedding", lambda x: x.cast("double")), 8, 16)
    return t("embeddings").select("vec_id", F.transform(m, lambda x: F.when(x == float("-inf"), "masked").otherwise("open")).alias("marks"))


# JSON, models, composites


@query("""SELECT event_id, event_type AS id, event_id % 9 / 2 AS duration, 'none' AS missing FROM events""")
def service_tracks(t):
    e = F.col("event_id")
    body = F.concat(F.lit('{"response": {"sunoData": [{"id": "'), "event_type", F.lit('", "duration": '), (e % 9 / 2).cast("string"), F.lit("}]}}"))
    out = t("events").select("event_id", F.explode(jsonx.tracks(body)).alias("x"), F.create_map(F.lit("k"), F.lit("v")).alias("m"))
    return out.select("event_id", F.col("x.id").alias("id"), F.col("x.duration").alias("duration"), jsonx.get(F.col("m"), "missing", "none").alias("missing"))


@query("""SELECT page_id, '<|' || CASE strpos('0123456789abcdef', substr(sha256(url), 16, 1)) % 2 WHEN 1 THEN 'en' ELSE 'zh' END || '|><asr>words of ' || url AS said FROM pages""")
def asr_batch(t):
    return models.batch_map(t("pages").select("page_id", "url"), "url", "said", "string", models.load_asr).select("page_id", "said")


@query("""WITH s AS (SELECT i AS song, i % 7 <> 6 AS ok, i % 3 + 1 AS polls FROM (SELECT unnest(range(0, 200)) AS i))
SELECT count(*) AS total, count(*) FILTER (ok) AS n_success, count(*) FILTER (NOT ok) AS n_fail, CAST(sum(CASE WHEN ok THEN 2 ELSE 0 END) AS BIGINT) AS tracks, CAST(sum(polls) AS BIGINT) AS polls, round(avg(polls), 6) AS avg_polls FROM s""")
def generation_run(t):
    from strophe.plans.composites import generation_run as run

    return run(t("region").sparkSession, 200)[1].withColumn("avg_polls", r6("avg_polls"))


@query("""SELECT song AS song, task, CASE WHEN song % 7 = 6 THEN 'failed' ELSE 'succeeded' END AS state, CAST(song % 3 + 1 AS BIGINT) AS poll_count FROM (SELECT i AS song, 'task-' || printf('%06d', i) AS task FROM (SELECT unnest(range(0, 200)) AS i))""")
def service_songs(t):
    from strophe.plans.composites import generation_run as run

    return run(t("region").sparkSession, 200)[0].select("song", F.col("task_id").alias("task"), "state", "poll_count")


@query("""SELECT conv_id, '[intro-medium] ;' || coalesce(string_agg(' [verse] ' || regexp_replace(regexp_replace(regexp_replace(text, '[,。"，:;&—‘''.\\]\\[()?\\n-]', '.', 'g'), '\\.{2,}', '.', 'g'), '\\.$', '') || ' ;', '' ORDER BY turn) FILTER (turn > 0 AND role <> 'assistant'), '') || ' [outro-medium]' AS gt_lyric FROM conversations GROUP BY 1""")
def baseline_lyrics(t):
    from strophe.plans.composites import baseline_lyrics as reshape

    c = t("conversations").withColumn("text", F.concat(F.lit("[Verse "), (F.col("turn") % 10).cast("string"), F.lit("][desc:d][lyrics:\n"), "text", F.lit("][phoneme:p]")))
    return reshape(c, "conv_id")


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, lang FROM documents)""")
def written_songs(t):
    from strophe.plans.composites import written_songs as write

    return write(t("documents").select("doc_id", F.concat("lang", F.col("doc_id").cast("string")).alias("prompt"))).agg(F.count(F.lit(1)).alias("n"))
