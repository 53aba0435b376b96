"""Composite pipelines: what users call. Each is one lazy plan; model calls are pluggable stand-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import lrc, text, tokens
from strophe.operators import dedup, models, ordered, phonemes, relational, report, similarity
from strophe.shared import cut, ranked


def metadata(raw: DataFrame, limit: int | None = None, lo: float = 120, hi: float = 360, langs: list[str] | None = None) -> DataFrame:
    """Files of a fitting length, in wanted languages, with style tags; with a limit, of the first by place."""
    kept = relational.filter_length(raw if limit is None or limit < 0 else relational.first_rows(raw, limit), lo, hi)
    if langs is not None:
        asr = models.batch_map(kept, "path", "__asr", "string", models.load_asr)
        kept = relational.filter_lang(asr.withColumn("lang", text.asr_sentences(F.col("__asr"))[0]["lang"]), langs).drop("__asr")
    return models.tagged(kept)


def lyric_conversion(src: DataFrame, suffix: str = "") -> DataFrame:
    """Lyrics (P12) parsed into metadata and lines (W04), with the language decided."""
    chosen = src.where("has_lyric").withColumns({"lyric": relational.lyric_or_translation(F.col("lyric"), F.col("tlyric")), "source": F.concat("source", F.lit(suffix))})
    chosen = cut(chosen.withColumn("__song", F.monotonically_increasing_id()))  # numbers that a second run would give otherwise
    lines = chosen.select("__song", F.posexplode(lrc.lines_to_bracket(F.col("lyric"))).alias("pos", "l")).select("__song", "pos", "l.*")
    parsed = ordered.parsed_lyrics(lines, "__song")
    pick = lambda kind, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", c)))), lambda x: x[c])
    pairs = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "meta", F.struct("pos", F.struct("key", "value").alias("e"))))), lambda x: x["e"])
    later = lambda e, i: F.exists(F.slice("pairs", i + 2, F.size("pairs")), lambda y: y["key"] == e["key"])
    meta = F.map_from_entries(F.filter("pairs", lambda e, i: ~later(e, i)))  # of equal keys the last holds
    songs = parsed.groupBy("__song").agg(pairs.alias("pairs"), pick("lyric", "value").alias("lyrics"), pick("lyric", "start_s").alias("lyrics_time")).withColumn("lyrics_meta", meta).drop("pairs")
    out = chosen.drop("lyric", "tlyric", "artists").join(songs, "__song", "left").drop("__song")
    return out.withColumn("lyric_lang", relational.lyric_language(F.coalesce("lyrics", F.array().cast("array<string>"))))


def line_conversations(items: DataFrame, audio: DataFrame, intro: Column, tokens_of: Column | None = None) -> DataFrame:
    """One conversation a song: the prelude, then a turn for each line and its audio tokens.

    items: stem, lyric, tlyric and what `intro` needs; audio: stem, tokens. Songs without lines drop; minutes may have any digits.
    tokens_of: the tokens by other columns of audio, made once a song after the join, so that only those columns are shuffled.
    """
    lines = lrc.lines_to_bracket(relational.longer_lyric(F.coalesce("lyric", F.lit("")), F.coalesce("tlyric", F.lit(""))), lrc.LONG_STAMP)
    j = items.select("*", F.explode(F.array(lines)).alias("lines")).where(F.size("lines") > 0).join(audio, "stem")  # a generator, so that lyrics are parsed once
    j = j if tokens_of is None else j.select("*", F.explode(F.array(tokens_of)).alias("tokens"))
    n = F.size("lines")
    end = lambda i: F.when(i + 1 < n, F.try_element_at("lines", (i + 2).cast("int"))["start_s"]).otherwise(F.size("tokens") / F.lit(float(tokens.RATE)))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    said = lambda x, i: F.when(i + 1 < n, x["text"]).otherwise(F.concat(F.lit("请生成歌词"), x["text"], F.lit("以及歌曲结尾")))
    rounds = F.flatten(F.transform("lines", lambda x, i: F.array(turn("user", said(x, i)), turn("assistant", tokens.audio_text(tokens.token_slice(F.col("tokens"), x["start_s"], end(i)))))))
    first = F.array(turn("user", intro), turn("assistant", tokens.audio_text(tokens.token_slice(F.col("tokens"), F.lit(0.0), F.col("lines")[0]["start_s"]))))
    return j.select("stem", F.concat(first, rounds).alias("messages"))


def section_conversations(meta: DataFrame, desc: DataFrame, audio: DataFrame) -> DataFrame:
    """One conversation a track: the prelude with the style, then a turn for each section, then the close.

    Descriptions go to sections by their order, without the first and the last of the list.
    """
    keys = ["song_id", "track_index"]
    j = relational.with_descriptions(meta, desc, audio)
    j = j.withColumns({"__key": F.concat_ws("_", *keys), "total_s": F.size("tokens") / F.lit(float(tokens.RATE)), "descs": F.array_sort(F.coalesce("sections", F.array()), lambda a, b: F.when(F.coalesce(a["startS"], F.lit(0.0)) < F.coalesce(b["startS"], F.lit(0.0)), -1).when(F.coalesce(a["startS"], F.lit(0.0)) > F.coalesce(b["startS"], F.lit(0.0)), 1).otherwise(0))})
    lines = j.select("__key", "total_s", F.posexplode(lrc.lines_to_stamp(F.coalesce("lyrics", F.lit("")))).alias("pos", "l")).select("__key", "total_s", "pos", "l.*")
    secs = ordered.sections(lines, "__key")
    j2 = secs.join(j.select("__key", "tokens", "total_s", "descs", "omni", "style", "omni_sim", "style_sim", "song_id", "track_index", "src_path", "lang", "tag", "duration"), "__key")
    middle = ordered.middle_descriptions(F.col("descs"))
    said = F.coalesce(text.clean_description(F.try_element_at(middle, (F.col("sec") + 1).cast("int"))["desc"]), F.lit(""))
    words = F.regexp_replace(text.strip(F.col("text")), r"^\[.*?\]\s*\n?", "")
    content = F.concat(F.lit("["), F.col("label"), F.lit("][desc:"), said, F.lit("]"), F.when(words != "", F.concat(F.lit("[lyrics:\n"), words, F.lit("]"))).otherwise(""))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    piece = lambda a, b: tokens.audio_text(tokens.token_slice(F.col("tokens"), a, b))
    each = j2.withColumn("__turns", F.array(turn("user", content), turn("assistant", piece(F.col("start_s"), F.col("end_s")))))
    per = each.groupBy("__key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sec", "__turns"))), lambda x: x["__turns"])).alias("__body"), F.min("start_s").alias("__first"), F.first("outro_s").alias("outro_s"),
        *(F.first(c).alias(c) for c in ("tokens", "total_s", "descs", "omni", "style", "omni_sim", "style_sim", *keys, "src_path", "lang", "tag", "duration")),
        F.count(F.lit(1)).alias("n_sections"),
    )
    edge = lambda at, name: F.coalesce(F.when(F.lower(F.try_element_at("descs", F.lit(at))["section"]) == name, text.clean_description(F.try_element_at("descs", F.lit(at))["desc"])), F.lit(""))
    style = relational.choose_tag(F.col("song_id"), F.col("omni"), F.col("style"), F.col("omni_sim"), F.col("style_sim"))
    intro = F.concat(text.style_prelude(F.coalesce(style, F.lit(""))), F.lit("[Intro][desc:"), edge(1, "intro"), F.lit("]"))
    head = F.array(turn("user", intro), turn("assistant", piece(F.lit(0.0), F.col("__first"))))
    close = F.when(F.col("outro_s") < F.col("total_s"), F.array(turn("user", F.concat(F.lit("[Outro][desc:"), edge(-1, "outro"), F.lit("]"))), turn("assistant", piece(F.col("outro_s"), F.col("total_s")))))
    messages = F.concat(head, F.col("__body"), F.coalesce(close, F.slice(head, 1, 0)))
    return per.select(*keys, "src_path", "tag", "lang", "duration", messages.alias("messages"), "n_sections", F.size(ordered.middle_descriptions(F.col("descs"))).alias("n_descriptions"))


def similarity_dedup(songs: DataFrame, threshold: float = 0.9, key: str = "row_idx") -> DataFrame:
    """Songs without an earlier kept one of cosine above the threshold, by the words of description and lyrics."""
    said = similarity.word_counts(songs, key, dedup.song_text(F.coalesce("description", F.lit("")), F.coalesce("lyrics", F.lit(""))))
    gone = similarity.first_kept(similarity.word_vectors(said), threshold)
    return songs.join(gone.withColumnRenamed("id", key), key, "left_anti")


def per_evaluation(hyp: DataFrame, gt: DataFrame, lexicon: DataFrame, offset: int = 0, **spoken) -> DataFrame:
    """Phoneme error rate of each transcription: file_index, per, ref_text, hyp_text, phonemes of both."""
    index = F.coalesce(F.col("file_idx"), text.last_number(F.col("file_name")))
    pairs = relational.offset_join(hyp, gt, index, offset)
    ref, heard = phonemes.equal_length(text.signal_filter(F.col("lyrics")), text.signal_filter(F.col("hyp_text")))
    pairs = pairs.withColumns({"ref_text": ref, "heard": heard}).select("file_index", "ref_text", F.col("heard").alias("hyp_text"))
    sides = pairs.select("file_index", F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.col("ref_text").alias("t")), F.struct(F.lit("hyp").alias("side"), F.col("hyp_text").alias("t")))).alias("s")).select(F.concat_ws("|", "file_index", "s.side").alias("k"), "s.t")
    runs = sides.select("k", F.posexplode(phonemes.language_runs(F.col("t"))).alias("pos", "r")).select("k", "pos", F.col("r.text").alias("text"))
    said = phonemes.phonemes(runs, "k", lexicon, **spoken)
    empty = F.array().cast("array<string>")
    side = lambda s: said.where(F.col("k").endswith(f"|{s}")).select(F.split("k", r"\|")[0].cast("long").alias("file_index"), F.col("phonemes").alias(f"{s}_phonemes"))
    out = pairs.join(side("ref"), "file_index", "left").join(side("hyp"), "file_index", "left")
    out = out.withColumns({"ref_phonemes": F.coalesce("ref_phonemes", empty), "hyp_phonemes": F.coalesce("hyp_phonemes", empty)})
    return out.withColumn("per", phonemes.phoneme_error_rate(F.col("ref_phonemes"), F.col("hyp_phonemes")))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Rows of the report: merged models beside the language models they come from."""
    merged = relational.merge_languages(metrics)
    return report.markdown_rows(metrics.unionByName(merged.join(metrics.select("model", "metric"), ["model", "metric"], "left_anti")))


def chunk_evaluation(turns: DataFrame, file: str = "file", song: str = "song_idx") -> DataFrame:
    """Prompted chunks with their token counts and sample ranges, and a similarity for each."""
    t = turns.withColumn("__conv", F.concat_ws("|", file, song))
    chunks = ordered.chunk_prompts(t, "__conv")
    counted = ranked(chunks.drop("flat_index"), [song, "turn"], "flat_index", file).withColumn("n_tokens", F.size(text.audio_codes(F.col("text"))))
    total = F.sum(tokens.samples_of_tokens(F.col("n_tokens"))).over(Window.partitionBy("__conv"))
    placed = ordered.sample_offsets(counted.withColumn("total_samples", total), "__conv", "turn", F.col("n_tokens"), F.col("total_samples"))
    return models.batch_map(placed, "text_prompt", "score", "double", models.load_similarity).drop("__conv")


def baseline_lyrics(turns: DataFrame, conv: str, mark: str = ".", size: str = "medium") -> DataFrame:
    """A conversation's sections as one line for a baseline model; it stops at the first section
    without lyrics or with an outro label."""
    w = Window.partitionBy(conv).orderBy("turn")
    p = relational.prompts_only(turns).withColumns({"tag": text.section_tag(F.col("text")), "lyric": text.section_lyrics(F.col("text"), mark)})
    stop = (F.col("lyric") == "") | F.col("tag").startswith("[outro")
    live = p.withColumn("__stopped", F.max(stop.cast("int")).over(w)).where("__stopped = 0")
    body = live.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit(" "), "tag", F.lit(" "), "lyric", F.lit(" ;")).alias("s")))), lambda x: x["s"]), "").alias("b"))
    return turns.select(conv).distinct().join(body, conv, "left").select(conv, F.concat(F.lit(f"[intro-{size}] ;"), F.coalesce("b", F.lit("")), F.lit(f" [outro-{size}]")).alias("gt_lyric"))


def evaluation_conversations(songs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Test songs to conversations whose answers are empty: style, then a turn for each section.

    songs: song_id, omni1, omni2, omni1_sim, omni2_sim, sections (section, text, desc1..3, desc1..3_sim).
    A section's description is the most similar of three; lyrics and their phonemes follow it.
    """
    each = songs.select("song_id", F.posexplode("sections").alias("sec", "s")).withColumn("key", F.concat_ws("|", "song_id", "sec"))
    desc = relational.choose_description(F.array(*(F.col(f"s.desc{i}") for i in (1, 2, 3))), F.array(*(F.col(f"s.desc{i}_sim") for i in (1, 2, 3))))
    bare = F.when(desc.startswith("[desc] "), F.concat(F.substring(desc, F.lit(8), F.length(desc)), F.lit("]"))).otherwise(desc)
    said = F.regexp_replace("s.text", r"(?s)^.*\]", "")
    block = F.when(text.strip(said) != "", F.when(F.col("song_id").startswith("suno_test_en"), F.concat(F.lit("[lyrics:\n"), text.clean_newlines(said), F.lit("]"))).otherwise(F.concat(F.lit("[lyrics:"), said, F.lit("]"))))
    each = each.select("song_id", "sec", "key", F.col("s.section").alias("section"), F.when(desc == "", "[desc:]").otherwise(F.concat(F.lit("[desc:"), F.substring(bare, F.lit(2), F.length(bare)))).alias("d"), text.phoneme_lyrics(block).alias("lines"))
    lines = each.select("key", F.posexplode("lines").alias("n", "line")).withColumn("k", F.concat_ws("#", "key", "n"))
    runs = lines.select("k", F.posexplode(phonemes.language_runs(F.col("line"))).alias("pos", "r")).select("k", "pos", F.col("r.text").alias("text"))
    spoken = lines.join(phonemes.phonemes(runs, "k", lexicon, with_sp=True), "k", "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce(F.array_join("phonemes", " "), F.lit("")).alias("p")))), lambda x: x["p"]), "\n")
    per = each.join(spoken.groupBy("key").agg(joined.alias("p")), "key", "left")
    tail = F.when(F.col("lines").isNotNull(), F.concat(F.lit("[lyrics:"), F.array_join("lines", "\n"), F.lit("][phoneme:"), F.coalesce("p", F.lit("")), F.lit("]"))).otherwise("")
    style = relational.choose_intro(F.col("omni1"), F.col("omni2"), F.col("omni1_sim"), F.col("omni2_sim"))
    intro = text.style_prelude(style)
    turns = per.join(songs.select("song_id", intro.alias("intro")), "song_id").withColumn("content", F.concat(F.when(F.col("sec") == 0, F.col("intro")).otherwise(""), F.lit("["), "section", F.lit("]"), "d", tail))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("sec", "content"))), lambda x: F.array(turn("user", x["content"]), turn("assistant", F.lit(""))))
    return turns.groupBy("song_id").agg(F.flatten(pairs).alias("messages"))


def written_songs(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Songs that a model writes for each prompt, those with valid time codes only."""
    from strophe.functions import jsonx

    answered = models.batch_map(prompts, prompt, "__answer", "string", models.load_writer)
    songs = answered.withColumn("__song", F.explode(jsonx.songs(F.col("__answer")))).select(*prompts.columns, "__song.*")
    return relational.with_fields(songs, "description", "lyrics").where(lrc.is_valid(F.col("lyrics")))


def conversation_phonemes(turns: DataFrame, conv: str, lexicon: DataFrame, with_sp: bool = True, **spoken) -> DataFrame:
    """Turns after the first that aren't the assistant's, with the phonemes of their lyrics line by line."""
    said = relational.prompts_only(turns).withColumn("lines", text.phoneme_lyrics(F.col("text"))).where(F.col("lines").isNotNull())
    lines = said.select(conv, "turn", F.posexplode("lines").alias("n", "line")).withColumn("k", F.concat_ws("|", conv, "turn", "n"))
    runs = lines.select("k", F.posexplode(phonemes.language_runs(F.col("line"))).alias("pos", "r")).select("k", "pos", F.col("r.text").alias("text"))
    heard = lines.join(phonemes.phonemes(runs, "k", lexicon, with_sp=with_sp, **spoken), "k", "left")
    per = F.array_sort(F.collect_list(F.struct("n", F.coalesce(F.array_join("phonemes", " "), F.lit("")).alias("p"))))
    return heard.groupBy(conv, "turn").agg(F.array_join(F.transform(per, lambda x: x["p"]), "\n").alias("phonemes"))


def generation_run(spark, songs: int, partitions: int = 4) -> tuple[DataFrame, DataFrame]:
    """C11: songs submitted to the service and polled to their end, and the report over the run."""
    from strophe.sources.services import SongSource

    spark.dataSource.register(SongSource)
    log = spark.read.format("song_service").option("songs", songs).option("partitions", partitions).load()
    log = log.withColumns({"success": F.col("state") == "succeeded", "tracks_count": F.when(F.col("state") == "succeeded", 2).otherwise(0)})
    report = log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_fail"), F.sum("tracks_count").alias("tracks"),
        F.sum("poll_count").alias("polls"), F.avg("poll_count").alias("avg_polls"),
    )
    return log, report
