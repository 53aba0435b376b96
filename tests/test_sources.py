import json
import os
import pickle

import pytest
from pyspark.sql import functions as F

from strophe.operators import relational, report
from strophe.plans import composites, registry
from strophe.sources import archives, readers, sinks
from strophe.streaming import incremental


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"a": 1}\n\n{bad\n{"a": null}\n{"a": 3}\n{"a": 4}\n')
    rows = lambda df: [(r.row_idx, r.a) for r in df.orderBy("row_idx").collect()]
    assert rows(readers.jsonl(spark, p, "a int")) == [(0, 1), (3, None), (4, 3), (5, 4)]
    assert rows(readers.jsonl(spark, p, "a int", limit=4)) == [(0, 1), (3, None)]
    assert rows(readers.tolerant_jsonl(spark, p, "a int", ["a"], max_count=2)) == [(0, 1), (4, 3)]
    bad = readers.tolerant_jsonl(spark, p, "a int", keep_bad=True).where("bad_line is not null").collect()
    assert [(b.row_idx, b.bad_line) for b in bad] == [(2, "{bad")]
    assert rows(readers.row_range(readers.jsonl(spark, p, "a int"), 3, 5)) == [(3, None), (4, 3)]
    assert readers.json(spark, str(tmp_path / "missing.json"), "a int").count() == 0


def test_order_over_files(spark, tmp_path):
    for k in range(3):
        put(tmp_path / "many" / f"f{k}.jsonl", "".join(json.dumps({"v": 10 * k + i}) + "\n" for i in range(4)))
    got = readers.jsonl(spark, str(tmp_path / "many"), "v int").orderBy("row_idx").collect()
    assert [g.v for g in got] == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23] and [g.row_idx for g in got] == list(range(12))


def test_array_or_lines(spark, tmp_path):
    a, b = put(tmp_path / "a.json", '\n [{"n": 1},\n {"n": 2}]'), put(tmp_path / "b.jsonl", '{"n": 1}\n{"n": 2}\n')
    assert [sorted(r.n for r in readers.json_or_jsonl(spark, p, "n int").collect()) for p in (a, b)] == [[1, 2], [1, 2]]


def test_side_files(spark, tmp_path):
    lex = put(tmp_path / "lex.txt", "Hello HH AH0 L OW1\nhello X\nworld W ER1 L D\n")
    assert {r.word: r.phones for r in readers.lexicon(spark, lex).collect()} == {"hello": ["HH", "AH0", "L", "OW1"], "world": ["W", "ER1", "L", "D"]}
    put(tmp_path / "ly" / "a.txt", "English\n one \n\ntwo\n")
    put(tmp_path / "ly" / "b.txt", "uno\ndos")
    assert sorted(r.lyrics for r in readers.lyric_files(spark, str(tmp_path / "ly")).collect()) == ["one two", "uno dos"]
    put(tmp_path / "m" / "per" / "x.json", '{"model": "m_cn", "metrics": {"PER": 0.5}, "count": 2}')
    put(tmp_path / "m" / "per" / "y.json", '{"model": "m_cn", "metrics": {"PER": 0.25}, "count": 2}')
    put(tmp_path / "m" / "per" / "x_details.json", '{"model": "zz", "metrics": {"PER": 9.0}}')
    assert [tuple(r) for r in readers.metric_files(spark, str(tmp_path / "m")).select("model", "metric", "value").collect()] == [("m_cn", "PER", 0.25)]
    gt = put(tmp_path / "gt.jsonl", '{"file_index": 1, "lyrics": "a"}\nbad\n{"file_index": null, "lyrics": "n"}\n{"file_index": 1, "lyrics": "b"}\n')
    assert [tuple(r) for r in readers.ground_truth(spark, gt).collect()] == [(1, "b")]
    assert [tuple(r) for r in readers.prompt_list(spark, put(tmp_path / "p.json", '["x", "y"]')).collect()] == [(0, "x"), (1, "y")]
    put(tmp_path / "audio" / "d" / "one.mp3", "x")
    put(tmp_path / "audio" / "two.wav", "xyz")
    put(tmp_path / "audio" / "three.MP3", "x")
    assert [os.path.basename(r.path) for r in readers.listing(spark, str(tmp_path / "audio")).collect()] == ["one.mp3", "two.wav"]
    put(tmp_path / "tracks" / "t.json", '{"song_id": "s", "track_index": 1, "style": "pop", "timestamped_lyrics": {"alignedWords": [{"success": true, "word": "la", "startS": 1.0, "endS": 2.0}]}}')
    assert [tuple(r) for r in readers.field_of_tracks(spark, str(tmp_path / "tracks"), "style").collect()] == [("s_1", "pop")]
    assert [(r.pos, r.word) for r in readers.aligned_words(spark, str(tmp_path / "tracks")).collect()] == [(0, "la")]
    desc = put(tmp_path / "desc_3.jsonl", '{"song_id": "s", "omni": "a"}\nbad\n{"song_id": "s", "track_index": 0, "omni": "b"}\n')
    good, wrong = readers.descriptions(spark, desc, "song_id string, track_index int, omni string")
    assert [r.omni for r in good.collect()] == ["b"] and [r.bad_line for r in wrong.collect()] == ["bad"]
    assert spark.range(1).select(readers.suffix_of(F.lit("x/desc_3.jsonl"))).first()[0] == 3


def test_chats_and_chunks(spark, tmp_path):
    chat = lambda *turns: json.dumps({"messages": [{"role": r, "content": c} for r, c in turns]})
    p = tmp_path / "chat"
    put(p / "a.jsonl", "\n" + "__FAIL__{}\n" + chat(("user", "[A][desc:d]"), ("assistant", "<AUDIO_1><AUDIO_2>"), ("assistant", "<AUDIO_3>")) + "\n")
    put(p / "mulan_a.jsonl", chat(("user", "x")) + "\n")
    chats = readers.chat_lines(spark, str(p))
    assert [(r.file, r.song_idx) for r in chats.collect()] == [("a.jsonl", 2)]
    got = composites.chunk_evaluation(readers.long_turns(chats)).collect()
    assert [(g.text_prompt, g.section_name, g.flat_index, g.n_tokens, g.start_sample, g.end_sample) for g in got] == [("d", "A", 0, 2, 0, 3840)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "中", "cn"), (1, "b", "en")], "row_idx long, messages string, lang string")
    sinks.write_jsonl(df, str(tmp_path / "o"))
    sinks.write_jsonl(df, str(tmp_path / "o"), append=True)
    assert spark.read.json(str(tmp_path / "o")).count() == 4
    sinks.write_twins(df, str(tmp_path / "m"), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).columns == ["lang", "row_idx"]
    sinks.write_json(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j"), wholetext=True).first()[0])[0]["messages"] == "中"
    sinks.append_log(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_each(df, str(tmp_path / "e"), "lang")
    assert sorted(x for x in os.listdir(tmp_path / "e") if "=" in x) == ["lang=cn", "lang=en"]
    metrics = spark.createDataFrame([("m", "PER", 0.5)], "model string, metric string, value double")
    sinks.append_history(metrics, str(tmp_path / "h"))
    assert spark.read.schema("models map<string,map<string,double>>").json(str(tmp_path / "h")).first().models == {"m": {"PER": 0.5}}
    sinks.write_shards(spark.range(10), str(tmp_path / "s"), "id", 4)
    assert sorted(x for x in os.listdir(tmp_path / "s") if "=" in x) == ["batch=0", "batch=1", "batch=2"]
    lines = spark.createDataFrame([('__VLLM_FAIL__{"a": 1}',), ("{}",)], "value string")
    assert [tuple(r) for r in sinks.read_failures(lines).select("value", "status").collect()] == [('{"a": 1}', "failed"), ("{}", "ok")]
    assert sinks.updated(df, spark.createDataFrame([(1, "new")], "row_idx long, messages string"), "row_idx", "messages").where("messages = 'new'").count() == 1


def test_joins(spark):
    music = spark.createDataFrame([("d/AB - x.mp3",), ("e/AB - x.mp3",), ("d/C - y.mp3",)], "path string")
    lyrics = spark.createDataFrame([(0, "A B", "x", "old"), (1, "AB", "x", "new")], "row_idx long, name string, artist string, lyric string")
    hit, miss = relational.match_music(music, lyrics)
    assert sorted((r.path, r.lyric) for r in hit.collect()) == [("d/AB - x.mp3", "new"), ("e/AB - x.mp3", "new")] and [r.path for r in miss.collect()] == ["d/C - y.mp3"]
    raw, saved = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "x"), (1, None), (2, None)], "k int, tags string")
    assert sorted(r.k for r in relational.drop_finished(raw, saved, "k", "tags").collect()) == [2, 3]
    done = spark.createDataFrame([(1, "a")], "file_idx int, hyp_text string")
    filled = relational.fill_missing(spark.createDataFrame([(1,), (2,), (None,)], "file_idx int"), done, spark.createDataFrame([(1, "zz"), (2, "b")], "file_idx int, hyp_text string"))
    assert [tuple(r) for r in relational.sort_by_index(filled).collect()] == [(1, "a"), (2, "b")]
    files = spark.createDataFrame([("p/a_itrack.npy",), ("p/a_vtrack.npy",), ("p/b_itrack.npy",)], "path string")
    assert [tuple(r) for r in relational.pair_stems(files).collect()] == [("p/a_vtrack.npy", "p/a_itrack.npy")]
    prompts = spark.createDataFrame([(["x", "y"],)], "prompts array<string>")
    assert sorted((r.idx, r.prompt) for r in relational.with_prompt(spark.createDataFrame([(1,), (5,)], "idx int"), prompts).collect()) == [(1, "y")]


def test_report(spark):
    m = spark.createDataFrame([("a_cn", "PER", 0.2), ("a_en", "PER", 0.4), ("b_cn", "PER", 0.3), ("b_cn", "CE", 5.0)], "model string, metric string, value double")
    table = report.markdown_table(relational.merge_languages(m), ["CE", "PER"])
    assert table.splitlines() == ["## Results", "", "| Model | CE | PER |", "| --- | --- | --- |", "| a | - | **0.3000** |", "| b | **5.0000** | **0.3000** |"]
    assert {r.model for r in composites.metric_summary(m).collect()} == {"a", "b", "a_cn", "a_en", "b_cn"}
    log = spark.createDataFrame([(True, 2, 10.0, 1.0, 12.0, 100, 3), (False, None, None, None, 5.0, None, None)], "success boolean, tracks_count int, wait_time double, download_time double, total_time double, download_bytes long, poll_count int")
    r = relational.run_report(log).first()
    assert (r.total, r.n_success, r.n_fail, r.tracks, r.max_wait, r.songs_per_minute) == (2, 1, 1, 2, 10.0, 5.0)
    assert relational.run_report(log.where("false")).first().songs_per_minute is None


def test_per_pipeline(spark):
    hyp = spark.createDataFrame([("x/song_1.wav", "song_1.wav", None, "hello word"), ("x", "y.wav", 2, ""), ("x", "none.wav", None, "a")], "file_path string, file_name string, file_idx long, hyp_text string")
    gt = spark.createDataFrame([(1, "Hello, world"), (2, "text")], "file_index long, lyrics string")
    lex = spark.createDataFrame([("hello", ["HH", "AH0", "L", "OW1"])], "word string, phones array<string>")
    got = {r.file_index: r for r in composites.per_evaluation(hyp, gt, lex).collect()}
    assert got[1].ref_phonemes == ["HH", "AH", "L", "OW", "W", "O", "R", "L"] and got[1].hyp_phonemes == ["HH", "AH", "L", "OW", "W", "O", "R", "D"]
    assert got[1].per == pytest.approx(1 / 8) and got[2].per == 0.0 and set(got) == {1, 2}


def test_section_conversations(spark):
    lyrics = "[00:02.00][Verse]one\n[00:03.00]two\n[00:06.00][Chorus]x\n[00:08.00]"
    meta = spark.createDataFrame([("cn1", None, "d/cn1_0.mp3", lyrics, "zh", "t", 10.0)], "song_id string, track_index int, src_path string, lyrics string, lang string, tag string, duration double")
    part = "array<struct<section:string,startS:double,endS:double,text:string,desc:string>>"
    sections = [("Outro", 8.0, 9.0, "", "bye"), ("Intro", 0.0, 2.0, "", "[desc][soft]"), ("Verse", 2.0, 6.0, "", "low"), ("Chorus", 6.0, 8.0, "", "high")]
    desc = spark.createDataFrame([("cn1", 0, "omni", "style", 0.1, 0.9, sections)], f"song_id string, track_index int, omni string, style string, omni_sim double, style_sim double, sections {part}")
    audio = spark.createDataFrame([("cn1_0", list(range(250)))], "stem string, tokens array<int>")
    got = composites.section_conversations(meta, desc, audio).first()
    said = [m.content for m in got.messages if m.role == "user"]
    assert said[0].startswith("Please generate a song in the following style:omni.\n") and said[0].endswith("[Intro][desc:soft]")
    assert said[1:] == ["[Verse][desc:low][lyrics:\none\ntwo]", "[Chorus][desc:high][lyrics:\nx]", "[Outro][desc:bye]"]
    audio_turns = [m.content for m in got.messages if m.role == "assistant"]
    assert [a.count("<AUDIO_") for a in audio_turns] == [50, 100, 50, 50] and got.n_sections == got.n_descriptions == 2


def test_line_conversations_and_lyrics(spark):
    items = spark.createDataFrame([("s", "[00:01.000]a\n[00:02.000]b", ""), ("t", "", "")], "stem string, lyric string, tlyric string")
    audio = spark.createDataFrame([("s", list(range(75)))], "stem string, tokens array<int>")
    got = composites.line_conversations(items, audio, F.lit("intro")).collect()
    assert [(m.role, m.content if m.role == "user" else m.content.count("<AUDIO_")) for m in got[0].messages] == [("user", "intro"), ("assistant", 25), ("user", "a"), ("assistant", 25), ("user", "请生成歌词b以及歌曲结尾"), ("assistant", 25)]
    src = spark.createDataFrame([("n", "", "z", "", "[00:01.00]by: me\n" + "\n".join(f"[00:{i:02d}.00]we are the world" for i in range(10, 20)), True, "src"), ("n", "", "z", "x", "y", False, "src")], "name string, artist string, artists string, lyric string, tlyric string, has_lyric boolean, source string")
    r = composites.lyric_conversion(src, "_a").collect()
    assert len(r) == 1 and r[0].lyric_lang == "en" and r[0].lyrics_meta == {"by": "me"} and len(r[0].lyrics) == 10 and r[0].source == "src_a"


def test_baseline_and_dedup(spark):
    turns = [(1, 0, "user", "style"), (1, 1, "user", "[Verse 1][desc:d][lyrics:\nla, la][phoneme:x]"), (1, 2, "assistant", "x"), (1, 3, "user", "[Pre-Chorus][desc:d][lyrics:\nhey][phoneme:x]"), (1, 4, "user", "[Bridge][desc:d]"), (1, 5, "user", "[Verse][desc:d][lyrics:\nno][phoneme:x]")]
    got = composites.baseline_lyrics(spark.createDataFrame(turns, "conv int, turn int, role string, text string"), "conv").first()
    assert got.gt_lyric == "[intro-medium] ; [verse] la. la ; [chorus] hey ; [outro-medium]"
    songs = spark.createDataFrame([(0, "a b", "[x]one two"), (1, "a b", "one  two"), (2, "c", "other words here")], "row_idx long, description string, lyrics string")
    assert sorted(r.row_idx for r in composites.similarity_dedup(songs).collect()) == [0, 2]
    raw = spark.createDataFrame([(0, "a.mp3", 100.0), (1, "b.mp3", 200.0)], "row_idx long, path string, duration double")
    assert [(r.path, len(r.tags)) for r in composites.metadata(raw, langs=["en", "zh"]).collect()] == [("b.mp3", 2)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = lambda ids: spark.createDataFrame([(i,) for i in ids], "path string").write.mode("append").json(src)
    run = lambda: incremental.process_new(spark.readStream.schema("path string").json(src), "path", lambda d: d.withColumn("n", F.length("path")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows(["a", "bb"])
    run()
    rows(["bb", "ccc"])
    run()
    assert sorted((r.path, r.n) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("a", 1), ("bb", 2), ("ccc", 3)]
    log = str(tmp_path / "log")
    spark.createDataFrame([(0,), (3,), (12,)], "s long").select(F.timestamp_seconds("s").alias("ts")).write.json(log)
    w = incremental.request_windows(spark.readStream.schema("ts timestamp").json(log))
    q = w.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").agg(F.max("n")).first()[0] == 2


def test_services_and_vocabulary(spark):
    from strophe.operators import vocab
    from strophe.sources import services

    spark.dataSource.register(services.SongSource)
    got = spark.read.format("song_service").option("songs", 20).load().collect()
    assert sorted(g.song for g in got) == list(range(20)) and all((g.state == "failed") == (g.song % 7 == 6) and g.poll_count == g.song % 3 + 1 for g in got)

    class Down(services.SongService):
        def status(self, task, polls):
            if polls < 3:
                raise OSError("busy")
            return "succeeded"

    assert services.finish(Down(), "task-1") == ("succeeded", 3) and services.finish(Down(), "task-1", retries=1) == ("failed", 2) and services.finish(services.SongService(), "task-2", most_polls=2) == ("timeout", 2)
    df = spark.createDataFrame([("a<X>b<XY>", ["[verse]", "hi", ""])], "t string, lines array<string>")
    row = df.select(vocab.text_ids(F.col("t"), {"<X>": 1000, "<XY>": 1001}).alias("t"), vocab.line_ids(F.col("lines")).alias("l"), vocab.song_id(F.lit("s"), F.lit(3), F.lit(4)).alias("i")).first()
    assert row.t == [97, 1000, 98, 1001] and row.l == [503, 511, 104, 105, 511, 511] and row.i == "s_000003_0004"
    assert vocab.extended({"a": 3}, ["b", "a", "c"]) == {"a": 3, "b": 4, "c": 5}
    songs = composites.written_songs(spark.createDataFrame([("p",)], "prompt string")).collect()
    assert len(songs) == 1 and songs[0].description.startswith("about ")


def test_evaluation_conversations(spark):
    part = "array<struct<section:string,text:string,desc1:string,desc2:string,desc3:string,desc1_sim:double,desc2_sim:double,desc3_sim:double>>"
    sections = [("Intro", "[Intro]", "音频过短", "b", "c", 0.9, 0.1, 0.2), ("Verse", "[Verse]hello [x] hello, hi", "[a]", "[desc] soft", "c", 0.1, 0.9, 0.9)]
    songs = spark.createDataFrame([("suno_test_en_1", "o1", "o2", 0.5, 0.5, sections)], f"song_id string, omni1 string, omni2 string, omni1_sim double, omni2_sim double, sections {part}")
    lex = spark.createDataFrame([("hello", ["HH", "AH0"])], "word string, phones array<string>")
    m = composites.evaluation_conversations(songs, lex).first().messages
    assert m[0].content.startswith("Please generate a song in the following style:o2.\n") and m[0].content.endswith("\n[Intro][desc:]")
    assert m[2].content == "[Verse][desc:oft][lyrics:\nhello,\nhi][phoneme:\nHH AH sp\nH I sp]"
    assert [x.role for x in m] == ["user", "assistant"] * 2 and m[1].content == ""


def test_lyrics_stay_with_their_songs(spark):
    """Rows that come in another order each time they are made keep their own lines."""

    def shuffled(batches):
        for b in batches:
            yield b.sample(frac=1, random_state=int.from_bytes(os.urandom(4), "little"))

    rows = [(i, "s", True, f"[00:01.00]line {i}", "", "x") for i in range(50)]
    src = spark.createDataFrame(rows, "k long, source string, has_lyric boolean, lyric string, tlyric string, artists string").coalesce(1).mapInPandas(shuffled, "k long, source string, has_lyric boolean, lyric string, tlyric string, artists string")
    assert {r.k: r.lyrics for r in composites.lyric_conversion(src).collect()} == {i: [f"line {i}"] for i in range(50)}


def test_files_send_no_names_to_the_driver(spark, tmp_path):
    """A task's commit message doesn't grow with its files, and a pattern of names is one listing of their folder."""
    df = spark.createDataFrame([(f"{i}.txt", bytearray(b"x")) for i in range(300)], "name string, body binary")
    message = archives._Files(str(tmp_path / "a"), df.schema, False).write(iter(df.collect()))
    assert len(pickle.dumps(message)) < 1000
    archives.write_files(df, f"file://{tmp_path}/b")
    put(tmp_path / "b" / "1.other", "y")
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.suffix == ".txt") == sorted(r.name for r in df.collect())
    got = readers.whole_text(spark, f"file://{tmp_path}/b/*.txt")
    assert got.count() == 300 and {r.path.rpartition("/")[2] for r in got.collect()} == {r.name for r in df.collect()}


def test_lines_are_cut_and_numbered_by_size(spark, tmp_path):
    """Files of lines have as many ranges as a shuffle has partitions; lines meet the places of their blocks without a shuffle."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        path = registry.files._lines(spark.range(1000), F.col("id").cast("string"), "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    lines = readers.numbered_lines(spark, path)
    assert lines.select("file").distinct().count() > 4
    assert {int(r.value) for r in lines.where("int(value) <> row_idx").collect()} == set() and lines.count() == 1000
    assert "Exchange hashpartitioning" not in lines._jdf.queryExecution().executedPlan().toString()


def test_line_conversations_shuffle_no_made_tokens(spark):
    items = spark.createDataFrame([("a", "[00:01.00]one\n[00:02.00]two", ""), ("b", "", "")], "stem string, lyric string, tlyric string")
    audio = spark.createDataFrame([("a", 100), ("b", 5)], "stem string, n int")
    made = F.sequence(F.lit(0), F.col("n"))
    want = composites.line_conversations(items, audio.select("stem", made.alias("tokens")), F.lit("intro")).collect()
    got = composites.line_conversations(items, audio, F.lit("intro"), made)
    assert got.collect() == want and len(want) == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sequence(0") < plan.index("Join")  # above the join


def test_line_conversations_keep_lines_after_100_minutes(spark):
    items = spark.createDataFrame([("s", "[99:58.00]a\n[100:05.00]b\n[1000:00.00]c", "")], "stem string, lyric string, tlyric string")
    audio = spark.createDataFrame([("s", 1000 * 60 * 25 + 50)], "stem string, n int")
    got = composites.line_conversations(items, audio, F.lit("intro"), F.sequence(F.lit(1), F.col("n"))).first().messages
    assert [m.content for m in got if m.role == "user"] == ["intro", "a", "b", "请生成歌词c以及歌曲结尾"]
    assert [m.content.count("<AUDIO_") for m in got if m.role != "user"] == [5998 * 25, 7 * 25, (60000 - 6005) * 25, 50]


def test_lyric_files_as_their_sql(spark, tmp_path):
    """Texts that begin with a language's name, empty ones and none are read as the query's SQL reads them."""
    texts = ["one\ntwo", "en", "En\n en \nthe end", "zh\nx", "\nen\nb", "", "\n", None, " English \r\nc", "a\n\n b\n"]
    spark.createDataFrame(list(enumerate(texts * 2, 1)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.lyrics for r in registry.QUERIES["read_lyric_files"](spark, str(tmp_path)).collect()}
    want = [None if x is None else " ".join(filter(None, (y.strip(" \n\t\r") for y in x.splitlines()))) for x in texts * 2]
    assert got == dict(enumerate(want, 1))


def test_a_language_line_is_the_first_line(spark, tmp_path):
    for name, text in (("a", "\nen\nb"), ("b", " EN \nb"), ("c", "en"), ("d", "")):
        put(tmp_path / "ly" / f"{name}.txt", text)
    assert {r.path[-5]: r.lyrics for r in readers.lyric_files(spark, f"file://{tmp_path}/ly/*.txt").collect()} == {"a": "en b", "b": "b", "c": "", "d": ""}


def test_files_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no names of files; spread files lie in folders of bounded size."""
    monkeypatch.setattr(archives, "SPREAD", 7)
    df = spark.range(50).select(F.concat("id", F.lit(".txt")).alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("body"))
    archives._Files(str(tmp_path / "w"), df.schema, False, True).commit([archives._Files(str(tmp_path / "w"), df.schema, False, True).write(iter(df.collect()))])
    assert sorted(len(list(p.iterdir())) for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")) == [1, *[7] * 7]
    archives.write_files(df, f"file://{tmp_path}/s", spread=True)
    got = readers.whole_text(spark, f"file://{tmp_path}/s/*/[!x]*.{{txt,md}}")
    assert got.inputFiles() == [] and {(r.path[:7], r.path.rpartition("/")[2], r.text) for r in got.collect()} == {("file://", f"{i}.txt", str(i)) for i in range(50)}
    assert [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("_")] == []
