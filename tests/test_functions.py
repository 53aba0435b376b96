import random

import pytest
from pyspark.sql import functions as F

from strophe.functions import jsonx, lrc, text, tokens
from strophe.operators import phonemes, relational
from strophe.plans import registry


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {kind}" for k, (_, kind) in cols.items()) or "x int"
    row = [tuple(v for v, _ in cols.values()) or (1,)]
    return spark.createDataFrame(row, schema).select(expr.alias("r")).first()[0]


def s(spark, f, value):
    return one(spark, f(F.col("c")), c=(value, "string"))


CASES = [
    (text.file_stem, "a/b/c.tar.gz", "c.tar"), (text.file_stem, "noext", "noext"), (text.last_number, "x/song_12_003.wav", 3), (text.last_number, "x/none.wav", None),
    (text.clean_lyrics, "[Verse 1]\nhello　 world\n[x\ny] z", "hello world [x y] z"),
    (text.clean_newlines, "  one\r\ntwo, three.four' s \n\n五，六", "one two,\nthree.\nfour's 五，\n六"), (text.clean_newlines, None, ""),
    (text.signal_filter, "a,b  (c)—d", "a b c d"), (text.broken_lyrics, "a, b?\n", "a. b"), (lambda c: text.broken_lyrics(c, "\n"), "a, b?\n", "a\n b"),
    (text.normalise_tags, " Rock， mood: Sad.x: ,", ["rock", " sad", ""]),
    (text.section_tag, "[Pre-Chorus 2][desc:x]", "[chorus]"), (text.section_tag, "[Verse 1 (soft)][desc:y]", "[verse]"),
    (text.section_lyrics, "[V][desc:d][lyrics:\nla, la\nend][phoneme:x]", "la. la.end"), (text.section_lyrics, "[V][desc:d]", ""),
    (text.structure_label, "Verse 2", "[verse]"), (text.structure_label, "Pre-Chorus", "[chorus]"), (text.structure_label, "Solo", "[solo]"),
    (text.lrc_lines, "[Verse 1]\n[00:01.20]hi\n\n[00:03]", ["[start]", "[intro]", "[verse]", "hi", "[end]"]),
    (lambda c: text.between(c, "<<", ">>"), "a<<b>>c", "b"), (text.style_line, "the following style: soft rock \nnext", "soft rock"), (text.style_line, "none", ""),
    (text.lyric_blocks, "[a] x\n[b]\ny", ["[a]\nx\n\n", "[b]\ny\n\n"]), (text.bracket_section, "[1x] [Verse 2] go", "Verse 2"), (text.bracket_section, "none", None),
    (text.section_key, "Verse 12", "verse"), (text.clean_description, " [desc][soft] ", "soft"), (text.described, "[V][dsec: a\nb ][x]", "a\nb"), (text.described, "[desc: ]", None),
    (text.section_name, "[Verse][desc:x]", "Verse"), (text.section_name, "[Hook] x", "Hook"), (text.section_name, "x", "Unknown"),
    (text.filename_genre, "pop: a, b c", "pop_-a,b-c"), (text.filename_genre, "", "Unknown"), (text.filename_genre, "x" * 90, "x" * 80), (text.filename_genre, "a" * 50 + ", " + "b" * 40 + ",c", "a" * 50),
    (text.phoneme_lyrics, "[V][lyrics:a [b] c\nd]", ["a  c", "d"]), (text.phoneme_lyrics, "none", None),
    (text.asr_text, "Loaded wav duration: 1\nFull Transcription: hi\nSegmenting done, total segments: 3 there\n\nyou", "hi there you"),
    (text.audio_tags, "[SOA]<AUDIO_1>x<AUDIO_22>", "<AUDIO_1><AUDIO_22>"), (text.audio_codes, "[SOA]<AUDIO_1>x<AUDIO_22>", [1, 22]),
    (text.is_cjk, "龥", True), (text.is_cjk, "㐀", True), (text.is_cjk, "一二", False), (text.count_other, "aé 1一", 2), (text.segment_prompt, "[start_of_segment]a", "a"),
    (text.is_ascii_punctuation, "", True), (text.is_ascii_punctuation, "()", True), (text.is_ascii_punctuation, "a", False),
    (lrc.stamps, "[00:10.50]a[1:2]b[01:00]", [10.5, 60.0]), (lrc.strip_stamps, "[00:01.5]a[00:02]b", "ab"),
    (lrc.is_valid, "[02:20.00]a[02:55.00]b", True), (lrc.is_valid, "[02:19.99]a[02:55.00]b", False), (lrc.is_valid, "[02:50.00]a", False), (lrc.is_valid, "[02:40.00]a[02:49.99]", False),
    (jsonx.json_text, 'Sure ```json\n{"a": 1}\n``` ok', '{"a": 1}'), (jsonx.repaired, "x {'a': [1,2,],}", '{"a": [1,2]}'),
]


@pytest.mark.parametrize(("f", "value", "want"), CASES)
def test_text(spark, f, value, want):
    assert s(spark, f, value) == want


def test_stamped_lines(spark):
    c = "[00:01.50]a[x]\n[0:02.5][00:03:123]b "
    pairs = lambda v: [(round(r.start_s, 6), r.text) for r in v]
    assert pairs(s(spark, lrc.lines_to_bracket, c)) == [(1.05, "a"), (3.123, "b")]
    assert pairs(s(spark, lrc.lines_to_stamp, c)) == [(1.5, "a[x]"), (2.005, ""), (3.123, "b")]


def test_asr_sentences(spark):
    got = s(spark, text.asr_sentences, "<|en|><asr>hello there <|zh|>你好")
    assert [(r.lang, r.lyric) for r in got] == [("en", "hello there"), ("zh", "你好")]


def test_sizes(spark):
    for n, want in ((0, "0.00 B"), (1023, "1023.00 B"), (1536, "1.50 KB"), (5 * 1024**3, "5.00 GB"), (3 * 1024**4, "3.00 TB")):
        assert one(spark, text.pretty_bytes(F.col("c")), c=(n, "long")) == want


def test_size_in_a_largest_unit(spark, tmp_path):
    for n, want in ((1023, "1023.00 B"), (5 * 1024**3, "5.00 GB"), (3 * 1024**4, "3072.00 GB")):
        assert one(spark, text.pretty_bytes(F.col("c"), "GB"), c=(n, "long")) == want
    spark.range(1_000_000, 1_000_001).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    assert registry.QUERIES["pretty_bytes"](spark, str(tmp_path)).first().size == "6519.26 GB"  # as the query's SQL


def test_songs(spark):
    got = s(spark, jsonx.songs, '```json\n[{"description": "d", "lyrics": "l"},]\n```')
    assert [(r.description, r.lyrics) for r in got] == [("d", "l")]
    assert [r.lyrics for r in s(spark, jsonx.songs, '{"description": "d", "lyrics": "l"}')] == ["l"]
    assert s(spark, jsonx.tracks, '{"response": {"sunoData": [{"id": "1", "audioUrl": "u"}]}}')[0].audioUrl == "u"


def test_tokens(spark):
    arr = ([*range(100)], "array<int>")
    c = F.col("c")
    assert one(spark, tokens.token_slice(c, F.lit(1.03), F.lit(1.2)), c=arr) == [25, 26, 27, 28, 29]
    assert one(spark, tokens.token_slice(c, F.lit(3.9), F.lit(99.0)), c=arr) == [97, 98, 99]
    assert one(spark, tokens.token_slice(c, F.lit(3.0), F.lit(2.0)), c=arr) == []
    assert one(spark, tokens.audio_text(F.slice(c, 2, 2)), c=arr) == "[SOA]<AUDIO_1><AUDIO_2>[EOA]"
    assert one(spark, tokens.inner(F.slice(c, 1, 3)), c=arr) == [1] and one(spark, tokens.inner(F.slice(c, 1, 1)), c=arr) == []
    assert [len(b) for b in one(spark, tokens.blocks(c, 40), c=arr)] == [40, 40, 20]
    assert one(spark, tokens.frame_starts(F.lit(90), 30)) == [0, 30]
    assert one(spark, tokens.tail(c, 3), c=arr) == [97, 98, 99] and one(spark, tokens.tail(F.slice(c, 1, 2), 3), c=arr) == [0, 1]
    even, odd = tokens.split_tracks(F.slice(c, 1, 5))
    assert one(spark, even, c=arr) == [0, 2] and one(spark, odd, c=arr) == [1, 3]
    assert one(spark, tokens.token_count(F.lit(48000)), c=arr) == 26
    assert one(spark, tokens.repair_by_mode(c), c=([5, 2000, 7, 7, 5, -1], "array<int>")) == [5, 5, 7, 7, 5, 5]
    assert one(spark, tokens.repair_by_mode(c), c=([2000, 2000, 5], "array<int>")) == [2000, 2000, 5]
    rows = ([[1, 2, 3], [4, 5, 6]], "array<array<int>>")
    flat = tokens.interleave(tokens.offset_codes(c, "xcodec"))
    assert one(spark, flat, c=rows) == [45335, 46362, 45336, 46363, 45337, 46364]
    assert one(spark, tokens.restore_codes(tokens.deinterleave(flat, 2), "xcodec"), c=rows) == [[1, 2, 3], [4, 5, 6]]
    assert one(spark, tokens.codec_of(flat), c=rows) == "xcodec"
    with pytest.raises(Exception, match="codebook"):
        one(spark, tokens.offset_codes(c, "xcodec"), c=([[1024]], "array<array<int>>"))
    assert one(spark, tokens.has_vocal(c), c=([0.5, -0.5], "array<double>")) is True and one(spark, tokens.has_vocal(c), c=([], "array<double>")) is False
    start, end = tokens.cut_bounds(F.lit(50.0))
    assert (one(spark, start), one(spark, end)) == (10.0, 40.0)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_list_distance_and_per(spark):
    r = random.Random(5)
    pairs = [([r.choice(["AA", "B", "sp", "zh"]) for _ in range(r.randint(0, 8))], [r.choice(["AA", "B", "x"]) for _ in range(r.randint(0, 8))]) for _ in range(60)]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(phonemes.list_distance(F.col("a"), F.col("b")), phonemes.phoneme_error_rate(F.col("a"), F.col("b"))).collect()
    for (a, b), (d, per) in zip(pairs, got, strict=True):
        assert d == levenshtein(a, b) and per == pytest.approx(d / len(a) if a else float(bool(b)))


def test_language_runs(spark):
    got = lambda t: [(r.text, r.tag) for r in s(spark, phonemes.language_runs, t)]
    assert got("你好 hello 12 a b c 34-5 d") == [("你好", 0), ("hello", 1), ("a", 1), ("b", 1), ("c", 1), ("three", 1), ("five", 1), ("d", 1)]


def test_pinyin(spark):
    for py, want in (("zhi1", ("zh", "iii1")), ("yue4", ("", "ve4")), ("wu3", ("", "u3")), ("wo3", ("", "uo3")), ("jue2", ("j", "ve2")), ("liu2", ("l", "iou2")), ("hun1", ("h", "uen1")), ("ni3", ("n", "i3")), ("er2", ("", "er2")), ("ng2", ("", "eng2")), ("yang2", ("", "iang2"))):
        assert tuple(s(spark, phonemes.split_pinyin, py)) == want, py
    assert tuple(s(spark, lambda c: phonemes.split_pinyin(c, "train"), "yue4")) == ("y", "ve4")


def test_lyric_language(spark):
    lang = lambda lines: one(spark, relational.lyric_language(F.col("c")), c=(lines, "array<string>"))
    assert lang(["we are the world"] * 6) == "en" and lang(["we are the world"] * 5) == "instrument"
    assert lang(["我们是世界"] * 6) == "zh" and lang(["我们是世界"] * 6 + ["we are the world"] * 6) == "ez"
    assert lang(["éééé éé"] * 6) == "nan" and lang(["a b c"] * 9) == "instrument" and lang(["<nop>"] * 9) == "instrument" and lang(["1 2 3 4"] * 6) == "en"
    assert "[" in relational.LYRIC_SYMBOLS


def test_choices(spark):
    a = lambda v: F.lit(v).cast("string")
    d = lambda v: F.lit(v).cast("double")
    assert one(spark, relational.choose_tag(a("song_cn_1"), a("o"), a("s"), d(0), d(1))) == "o"
    assert one(spark, relational.choose_tag(a("x"), a("o"), a("s"), d(1), d(1))) == "s" and one(spark, relational.choose_tag(a("x"), a("o"), a("s"), d(None), d(1))) == "o"
    assert one(spark, relational.choose_intro(a("1"), a("2"), d(1), d(1))) == "2"
    assert one(spark, relational.choose_description(F.array(a("a"), a("b"), a("c")), F.array(d(1), d(3), d(3)))) == "b"
    assert one(spark, relational.choose_description(F.array(a("音频过短"), a("b")), F.array(d(3), d(1)))) == ""
    assert one(spark, relational.truthy_or(a(""), a("d"))) == "d" and one(spark, relational.longer_lyric(a("ab"), a("cd"))) == "ab" and one(spark, relational.lyric_or_translation(a(None), a("t"))) is None
    assert one(spark, relational.prompt_source(a(None), a("pop"), ["pop"])) == "auto"
    with pytest.raises(Exception, match="prompt type"):
        one(spark, relational.prompt_source(a("x"), a("pop"), ["pop"]))
    for label, ok in (("Verse", True), ("  ", False), ("x" * 31, False), (" " + "x" * 30 + " ", True), ("00:10.5", False), ("a:b", True)):
        assert one(spark, relational.valid_label(F.col("c")), c=(label, "string")) is ok
