"""Window forms against literal loops on random inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import dedup, hysteresis, models, ordered, phonemes, relational


def test_sections(spark):
    rows = [("a", 0, 0.0, "pre"), ("a", 1, 5.0, "[Verse 1]one"), ("a", 2, 8.0, "two"), ("a", 3, 20.0, "[Chorus]"), ("a", 4, 30.0, ""), ("b", 0, 1.0, "[Hook]x"), ("b", 1, 2.0, "y"), ("c", 0, 1.0, "no label")]
    df = spark.createDataFrame(rows, "song string, pos int, start_s double, text string").withColumn("total_s", F.lit(40.0))
    got = [tuple(r) for r in ordered.sections(df, "song").orderBy("song", "sec").select("song", "sec", "label", "start_s", "end_s", "text", "outro_s").collect()]
    assert got == [("a", 0, "Verse 1", 5.0, 20.0, "[Verse 1]one\ntwo", 30.0), ("a", 1, "Chorus", 20.0, 30.0, "[Chorus]\n", 30.0), ("b", 0, "Hook", 1.0, 40.0, "[Hook]x\ny", None)]
    size = lambda n: spark.range(1).select(F.size(ordered.middle_descriptions(F.array(*[F.lit("d")] * n)))).first()[0]
    assert [size(n) for n in (1, 2, 3, 4)] == [0, 1, 1, 2]


def plain_segments(words):
    out, now = [], None
    for ok, w, s, e in words:
        if not ok:
            continue
        label = w[1 : w.index("]")] if w.startswith("[") and "]" in w else ""
        if label.strip() and len(label.strip()) <= 30 and not (":" in label and "." in label):
            now = [label, s, 0.0, w[len(label) + 3 :]]
            out.append(now)
        elif now is not None:
            now[2], now[3] = e, now[3] + w
    return [tuple(x) for x in out]


def test_segments_random(spark):
    r = random.Random(7)
    songs = {k: [(r.random() > 0.2, r.choice(["[Verse]\nla ", "[Chorus] x", "[00:10.5]t", "[" + "x" * 31 + "]", "la ", "di ", "[open"]), float(i), i + 0.5) for i in range(r.randint(0, 12))] for k in range(60)}
    rows = [(k, i, *w) for k, ws in songs.items() for i, w in enumerate(ws)]
    got = {}
    for x in ordered.segments(spark.createDataFrame(rows, "song int, pos int, success boolean, word string, startS double, endS double"), "song").orderBy("song", "seg").collect():
        got.setdefault(x.song, []).append((x.label, x.start, x.end, x.word))
    assert got == {k: p for k, ws in songs.items() if (p := plain_segments(ws))}


def test_strict_segments(spark):
    schema = "song int, pos int, success boolean, word string, startS double, endS double"
    cases = {
        # closed by an invalid label at the song's end: once, with the last word again and the last end
        1: ([(True, "[Verse]\nla"), (True, "di"), (True, "[00:1.5]"), (False, "x")], [("Verse", 0.0, 3.5, "ladi[00:1.5][00:1.5]")]),
        # the next label closes; the last segment is never closed
        2: ([(True, "la"), (True, "[A] a"), (False, "no"), (True, "b"), (True, "[B] c")], [("A", 1.0, 3.5, "ab")]),
        # an invalid label inside brings the segment out twice, both in the final state
        3: ([(True, "[A] a"), (True, "[ ]"), (True, "b"), (True, "[C"), (True, "[D] d")], [("A", 0.0, 2.5, "a[ ]b"), ("A", 0.0, 2.5, "a[ ]b")]),
        4: ([(False, "[A] a"), (True, "b")], []),
    }
    # in case 3 `[C` without a closing bracket is a label of all but its last character, which is none
    rows = [(k, i, ok, word, float(i), i + 0.5) for k, (words, _) in cases.items() for i, (ok, word) in enumerate(words)]
    got = {k: [] for k in cases}
    for g in ordered.strict_segments(spark.createDataFrame(rows, schema).repartition(3), "song").orderBy("song", "seg").collect():
        assert g.seg == len(got[g.song])
        got[g.song].append((g.label, g.start, g.end, g.word))
    want = {k: v for k, (_, v) in cases.items()}
    want[3] = [("A", 0.0, 3.5, "a[ ]b[C")] * 3
    assert got == want


def test_parsed_lyrics(spark):
    lines = [(0.0, "a / b"), (1.0, "by: me"), (2.0, "hello"), (2.0, "你好"), (3.0, "x/y"), (4.0, "作曲：他"), (3.0, "again"), (5.0, "z")]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(lines)], "song int, pos int, start_s double, text string")
    got = [(g.kind, g.key, g.value) for g in ordered.parsed_lyrics(df, "song").orderBy("pos").collect()]
    assert got == [("meta", "by", "me"), ("lyric", None, "hello"), ("lyric", None, "x/y"), ("meta", "作曲", "他"), ("lyric", None, "z")]


def test_chunk_prompts_random(spark):
    r = random.Random(11)
    convs = {k: [(r.choice(["user", "assistant"]), r.choice(["[A][desc:d%d]" % i, "[B]", "<AUDIO_1>", "text"])) for i in range(r.randint(0, 12))] for k in range(80)}
    want = {}
    for k, turns in convs.items():
        prompt, section, sub, flat = None, None, 0, 0
        for i, (role, c) in enumerate(turns):
            if role == "user" and "[desc:" in c:
                prompt, section = c[len("[A][desc:") : -1], "A"
            elif role == "assistant" and "<AUDIO" in c:
                if prompt:
                    want[k, i] = (prompt, section, flat, sub)
                    prompt, flat = None, flat + 1
                sub += 1
    rows = [(k, i, *t) for k, ts in convs.items() for i, t in enumerate(ts)]
    got = ordered.chunk_prompts(spark.createDataFrame(rows, "conv int, turn int, role string, text string"), "conv").collect()
    assert {(g.conv, g.turn): (g.text_prompt, g.section_name, g.flat_index, g.sub_idx) for g in got} == want


def test_offsets_prefix_and_batches(spark):
    r = random.Random(2)
    rows = [(k, i, r.randint(1, 60)) for k in range(20) for i in range(r.randint(1, 8))]
    df = spark.createDataFrame(rows, "song int, pos int, n int")
    want = {}
    for k in range(20):
        at = 0
        for _, i, n in sorted(x for x in rows if x[0] == k):
            if at >= 200_000:
                break
            want[k, i] = (at, min(at + int(n / 25 * 48000), 200_000))
            at += int(n / 25 * 48000)
    got = {(g.song, g.pos): (g.start_sample, g.end_sample) for g in ordered.sample_offsets(df, "song", "pos", F.col("n"), F.lit(200_000)).collect()}
    assert got == want
    texts = df.withColumn("text", F.repeat(F.lit("x"), F.col("n")))
    kept = {(g.song, g.pos) for g in ordered.greedy_prefix(texts, "song", "pos", "text", 100).collect()}
    plain = set()
    for k in range(20):
        length = -1
        for _, i, n in sorted(x for x in rows if x[0] == k):
            length += n + 1
            if length > 100:
                break
            plain.add((k, i))
    assert kept == plain
    b = ordered.batch_ids(spark.range(1000).withColumn("x", 1000 - F.col("id")), "x", 64).collect()
    assert all(g.batch == (g.x - 1) // 64 for g in b)


def test_voiced_spans(spark):
    frames = [("a", i * 0.03, 20 <= i < 60) for i in range(120)] + [("quiet", i * 0.03, False) for i in range(30)] + [("end", i * 0.03, i > 5) for i in range(40)]
    got = {}
    for g in hysteresis.voiced_spans(spark.createDataFrame(frames, "path string, ts double, is_speech boolean")).collect():
        got.setdefault(g.path, []).append((round(g.start, 2), round(g.end, 2)))
    assert got["quiet"] == [(-1.0, -1.0)] and len(got["a"]) == 1 and got["a"][0][0] == 0.6 and got["end"][0][1] == pytest.approx(1.2)


def test_rates(spark):
    times = [0, 1, 9_999_999, 10_000_000, 10_000_001, 25_000_000, 34_999_999, 35_000_000, 35_000_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {g.id: g.in_window for g in ordered.request_rate(df).collect()}
    assert got == {i: sum(t - 9_999_999 <= x <= t for x in times) for i, t in enumerate(times)}
    a = spark.createDataFrame([("c", 0.1 * i) for i in range(5)], "who string, ts_s double")
    assert [round(g.admitted_s, 3) for g in ordered.admission(a, "who", limit=2).orderBy("ts_s").collect()] == [0.0, 0.1, 10.05, 10.15, 20.1]


def test_greedy_keep_is_the_first_kept_set(spark):
    r = random.Random(4)
    edges = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(90)} | {(100 + i, 101 + i) for i in range(6)})
    nodes = [*range(60), *range(100, 110)]
    kept = []
    for n in nodes:
        if not any((k, n) in edges for k in kept):
            kept.append(n)
    df = spark.createDataFrame([(n,) for n in nodes], "vec_id long")
    got = dedup.greedy_keep(df, spark.createDataFrame(edges, "i long, j long"))
    assert sorted(g.vec_id for g in got.collect()) == kept
    assert dedup.greedy_keep(df, spark.createDataFrame([], "i long, j long")).count() == len(nodes)


@pytest.mark.parametrize(("n", "finish"), [(5000, dedup.FINISH), (120, 25)])
def test_greedy_keep_along_a_path(spark, n, finish):
    edges = spark.createDataFrame([(i + 1, i) if i % 3 else (i, i + 1) for i in range(n - 1)], "i long, j long").repartition(4)
    kept = dedup.greedy_keep(spark.range(n).withColumnRenamed("id", "vec_id"), edges, finish=finish)
    assert sorted(r.vec_id for r in kept.collect()) == list(range(0, n, 2))


@pytest.mark.parametrize("finish", [7, 60])
def test_greedy_keep_in_steps(spark, finish):
    r = random.Random(3)
    edges = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(150)})
    kept = []
    for n in range(60):
        if not any((k, n) in edges for k in kept):
            kept.append(n)
    got = dedup.greedy_keep(spark.range(60).withColumnRenamed("id", "vec_id"), spark.createDataFrame(edges, "i long, j long"), finish=finish)
    assert sorted(x.vec_id for x in got.collect()) == kept



def test_similarity_edges_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 16)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    got = {(g.i, g.j) for g in dedup.similarity_edges(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    assert got == {(i, j) for i, a in rows for j, b in rows if i < j and sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b) > 0.9}


def test_language_vote(spark):
    long_en, long_zh = "one two three four five", "一二三四五"
    rows = [(1, i, "en", long_en) for i in range(5)] + [(1, 5 + i, "zh", long_zh) for i in range(5)] + [(2, i, "en", long_en) for i in range(4)] + [(3, i, "zh", long_zh) for i in range(6)] + [(4, i, "en", "a b") for i in range(9)]
    got = {g.k: g.vote for g in relational.language_vote(spark.createDataFrame(rows, "k int, pos int, lang string, text string"), "k").collect()}
    assert got == {1: "multi: en zh", 2: "pure", 3: "zh", 4: "pure"}


def test_generated_turns_carry_history_and_failures(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", "b"), (1, 3, "assistant", None), (2, 0, "user", "fail"), (2, 1, "assistant", None)]

    def model(history):
        if history[0][1] == "fail":
            raise ValueError("no")
        return "+".join(t for _, t in history)

    got = {(g.conv_id, g.turn): (g.text, g.status, g.error) for g in models.generate_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), model).collect()}
    assert got[1, 3] == ("a+a+b", "generated", None) and got[2, 1] == (None, "failed", "no") and got[1, 0][1] == "given"


def walked(flags, times, ring, share, frame_s):
    """Spans of one recording, frame by frame."""
    spans, held, start = [], [], None
    for ts, flag in zip(times, flags, strict=True):
        held = [*held[-(ring - 1) :], (ts, flag)]
        if sum(v == (start is None) for _, v in held) > share * ring:
            if start is None:
                start = held[0][0]
            else:
                spans.append((start, ts + frame_s))
                start = None
            held = []
    if start is not None:
        spans.append((start, times[-1] + frame_s))
    return spans or [(-1.0, -1.0)]


@pytest.mark.parametrize(("block", "ring", "share"), [(7, 10, 0.9), (64, 5, 0.5), (4096, 10, 0.9), (1, 3, 0.6)])
def test_spans_of_blocks_equal_a_walk(spark, block, ring, share):
    r = np.random.default_rng(block)
    tracks = {"empty speech": [False] * 40, "all": [True] * 25, "one": [True]}
    for i in range(6):
        tracks[f"t{i}"] = np.repeat(r.random(40) < 0.5, r.integers(1, 25, 40)).tolist()
    rows = [(p, k * 0.03, None if not f and k % 5 == 0 else bool(f)) for p, flags in tracks.items() for k, f in enumerate(flags)]
    got = {}
    for g in hysteresis.voiced_spans(spark.createDataFrame(rows, "path string, ts double, is_speech boolean").repartition(5), ring=ring, share=share, block=block).orderBy("path", "span").collect():
        got.setdefault(g.path, []).append((g.start, g.end))
    assert got == {p: walked(f, [k * 0.03 for k in range(len(f))], ring, share, 0.03) for p, f in tracks.items()}


def test_only_paths_of_several_blocks_have_maps(spark, monkeypatch):
    """Paths of one block beside one of three: the frames that get maps are those of the long one, the spans are a walk's."""
    asked, later = [], hysteresis.later_blocks
    monkeypatch.setattr(hysteresis, "later_blocks", lambda *a: asked.append(later(*a)) or asked[0])
    r = np.random.default_rng(4)
    tracks = {p: np.repeat(r.random(9) < 0.5, 16)[:n].tolist() for p, n in (("a", 50), ("b", 64), ("long", 140), ("c", 1))}
    rows = [(p, float(k), bool(f)) for p, flags in tracks.items() for k, f in enumerate(flags)]
    got = {}
    for g in hysteresis.voiced_spans(spark.createDataFrame(rows, "path string, ts double, is_speech boolean"), block=64).orderBy("path", "span").collect():
        got.setdefault(g.path, []).append((g.start, g.end))
    assert got == {p: walked(f, [float(k) for k in range(len(f))], 10, 0.9, 0.03) for p, f in tracks.items()}
    assert {x.path for x in asked[0].collect()} == {"long"} and asked[0].count() == 140


def test_spans_of_a_million_frames_on_one_path(spark):
    n = 1_000_000
    flag = F.pmod(F.xxhash64(F.floor(F.col("id") / 17)), F.lit(3)) == 0
    frames = spark.range(n).select(F.lit("p").alias("path"), F.col("id").cast("double").alias("ts"), flag.alias("is_speech"))
    got = [(g.start, g.end) for g in hysteresis.voiced_spans(frames).orderBy("span").collect()]
    flags = [r.is_speech for r in frames.orderBy("ts").collect()]
    assert got == walked(flags, [float(k) for k in range(n)], 10, 0.9, 0.03) and len(got) > 10_000


def test_distances_of_any_alphabet():
    r = random.Random(2)
    for _ in range(400):
        a, b = ([r.randrange(r.choice([2, 5, 90])) for _ in range(r.randrange(0, 150))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, above = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(above[j] + (x != y), above[j + 1] + 1, row[-1] + 1))
        assert phonemes.bit_distance(a, b) == row[-1]
        for most in (0, 3, row[-1]):
            assert (phonemes.bit_distance(a, b, most) > most) == (row[-1] > most)


def test_distances_of_a_hundred_thousand_symbols(spark):
    n = 100_000
    a = F.sequence(F.lit(1), F.lit(n))
    rows = spark.range(1).select(a.alias("a"), F.filter(F.transform(a, lambda x: F.when(x % 1000 == 0, -x).otherwise(x)), lambda x: x % 777 != 0).alias("b"), F.array(F.lit(1)).alias("c"), F.array().cast("array<int>").alias("d"))
    got = rows.select(phonemes.list_distance(F.col("a"), F.col("b")), phonemes.list_distance(F.col("a"), F.col("c")), phonemes.list_distance(F.col("d"), F.col("a")), phonemes.list_distance(F.col("c"), F.col("c"))).first()
    gone, swapped = n // 777, n // 1000
    assert list(got) == [gone + swapped, n - 1, n, 0]
