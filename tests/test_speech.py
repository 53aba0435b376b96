import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strophe.operators import chinese, g2p, phonemes


def test_cuts_equal_all_cuts_enumerated():
    r = random.Random(1)
    for _ in range(200):
        words = {"".join(r.choice("甲乙丙") for _ in range(r.randrange(1, 4))): -r.randrange(1, 40) for _ in range(8)}
        text, unknown = "".join(r.choice("甲乙丙丁") for _ in range(r.randrange(1, 9))), -30
        trie = chinese.Trie((w, s, None) for w, s in words.items())
        best = None
        for marks in itertools.product((0, 1), repeat=len(text) - 1):
            at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(text)]
            parts = [text[a:b] for a, b in itertools.pairwise(at)]
            if all(len(p) == 1 or p in words for p in parts):
                key = (sum(words.get(p, unknown) for p in parts), [len(p) for p in parts])
                best = max(best or key, key)
        assert [len(p) for p in chinese.cut(text, trie, unknown)] == best[1]


@pytest.mark.parametrize("most", [chinese.MOST, 2])
def test_words_resolve_readings(spark, most):
    """A lexicon beyond the bound takes the join; both give the same cuts. Unknown characters, nulls, repeated words."""
    rows = [("银行", 50.0, ["yin2", "hang2"]), ("行", 20.0, ["xing2"]), ("走", 9.0, ["zou3"]), ("行走", 30.0, ["xing2", "zou3"]), ("行", 3.0, ["hang2"]), ("银", 1.0, None), ("", 5.0, []), ("长安街", 7.0, None), ("长安", 5.0, ["chang2", "an1"]), ("街", 5.0, ["jie1"])]
    lexicon = spark.createDataFrame(rows, "word string, weight double, readings array<string>")
    runs = spark.createDataFrame([("银行行走",), ("行银",), ("银行行走",), ("龙",), (None,), ("",), ("长安街",)], "run string")
    got = {r.run: (r.words, r.readings) for r in chinese.cut_runs(runs, lexicon, most=most).collect()}
    assert got == {
        "银行行走": (["银行", "行走"], [["yin2", "hang2"], ["xing2", "zou3"]]), "行银": (["行", "银"], [["xing2"], [None]]),
        "龙": (["龙"], [[None]]), "长安街": (["长安街"], [["chang2", "an1", "jie1"]]),
    }
    assert chinese.cut_runs(runs.limit(0), lexicon, most=most).count() == 0
    said = chinese.cut_runs(runs, lexicon, most=most).where("run = '银行行走'").select(chinese.spoken(F.col("words"), F.col("readings"), phonemes.split_pinyin, True).alias("p")).first().p
    assert said == ["in2", "h", "ang2", "sp", "x", "ing2", "z", "ou3", "sp"]


def rule(word):
    for a, b in (("ck", "K "), ("ph", "F "), ("x", "K S "), ("gh", " "), ("e$", "")):
        word = word[:-1] if a == "e$" and word.endswith("e") else word.replace(a, b) if a != "e$" else word
    return [x for c in word.split(" ") for x in ([c] if c.isupper() else list(c))]


def test_learned_conversion_beats_spelling(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice(["ba", "ck", "phi", "x", "lo", "gh", "re", "ne", "ti", "um"]) for _ in range(r.randrange(1, 5))) for _ in range(900)})
    r.shuffle(words)
    model = g2p.Model([(w, rule(w)) for w in words[:-200]])
    right = sum(model.convert(w) == rule(w) for w in words[-200:])
    spelled = sum([x.upper() for x in w] == [x.upper() for x in rule(w)] for w in words[-200:])
    assert right >= 190 and right > spelled + 50
    lexicon = spark.createDataFrame([(w, rule(w)) for w in words[:-200]], "word string, phones array<string>")
    one, two = (g2p.fit(lexicon.repartition(n), most=300) for n in (2, 7))
    assert [one.convert(w) for w in words[-50:]] == [two.convert(w) for w in words[-50:]]
    got = g2p.convert_words(spark.createDataFrame([("ba",), ("ba",), (None,), ("",), ("?!",)], "word string"), one).collect()
    assert {r.word: r.phones for r in got} == {"ba": ["b", "a"], None: [], "": [], "?!": []}
    assert g2p.Model([]).convert("ba") == []


def test_a_cut_into_fewer_units_is_not_likelier_for_it():
    """Spellings whose rule the entries show in every context are said by it, however the entries are dealt."""
    r = random.Random(3)
    words = sorted({"".join(r.choice(["ba", "ck", "phi", "x", "lo", "gh", "re", "ne", "ti", "um"]) for _ in range(r.randrange(1, 5))) for _ in range(900)})
    r.shuffle(words)
    for at in (0, 200, 400):
        model = g2p.Model([(w, rule(w)) for w in words[:at] + words[at + 200 :]])
        assert [w for w in words[at : at + 200] if model.convert(w) != rule(w)] == []
    assert g2p.Model([("a$", "A"), ("b", "B")]).convert("ba$^") == ["B", "A"]


def test_a_fit_reads_the_whole_lexicon(spark, monkeypatch):
    """What single entries of 6,020 show is learned, and the table of contexts says what one model of all entries says."""
    r = random.Random(5)
    words = sorted({"".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randrange(3, 5))) for _ in range(7000)})[:6000]
    rare = [chr(945 + i) for i in range(17)]
    entries = [*((w, list(w.upper())) for w in words), *((f"{c}a{c}", [f"<{c}>", "A", f"<{c}>"]) for c in rare)]
    monkeypatch.setattr(g2p, "WORDS", 3, raising=False)
    asked = [*(f"b{c}" for c in rare), "badcab", None, "", "?!", "?αd"]
    model = g2p.fit(spark.createDataFrame(entries, "word string, phones array<string>"))
    got = {x.word: x.phones for x in g2p.convert_words(spark.createDataFrame([(w,) for w in asked], "word string"), model).collect()}
    assert got == {f"b{c}": ["B", f"<{c}>"] for c in rare} | {"badcab": list("BADCAB"), None: [], "": [], "?!": [], "?αd": ["<α>", "D"]}
    small = [(w, rule(w)) for w in ("lock", "box", "phone", "light", "lone", "gate", "ship")]
    whole, learned = g2p.Model(small), g2p.fit(spark.createDataFrame(small, "word string, phones array<string>"))
    asked = ["rock", "fox", "phonix", "tone", "nigh", "gale", "shine", "lolo"]
    assert {x.word: x.phones for x in g2p.convert_words(spark.createDataFrame([(w,) for w in asked], "word string"), learned).collect()} == {w: whole.convert(w) for w in asked}


def test_chances_sum_to_at_most_one():
    model = g2p.Model([(w, rule(w)) for w in ("lock", "box", "phone", "light", "lone")])
    units = list(model.counts[()])
    for h in ((("^", ()),), (("^", ()), ("l", ("l",))), (("x", ("K", "S")),)):
        assert math.fsum(model.chance(h, u, "o") for u in units) <= 1 + 1e-9


def test_phonemes_of_both_languages(spark):
    lexicon = spark.createDataFrame([("hello", ["HH", "AH0", "L", "OW1"]), ("HELLO", ["X"]), ("low", ["L", "OW1"])], "word string, phones array<string>")
    signs = spark.createDataFrame([("你好", 5.0, ["ni3", "hao3"])], "word string, weight double, readings array<string>")
    runs = spark.createDataFrame([(1, 0, "Hello"), (1, 1, "你好"), (1, 2, "lol"), (2, 0, "嗯")], "k int, pos int, text string")
    got = {r.k: r.phonemes for r in phonemes.phonemes(runs, "k", lexicon, fallback="learned", with_sp=True, chinese=signs).collect()}
    assert got[1][:10] == ["HH", "AH", "L", "OW", "sp", "n", "i", "h", "ao", "sp"] and got[1][10] == "L" and got[2] == []


def test_syllables_of_both_variants(spark):
    cases = [("r5", ("", ""), ("", "r5")), ("er2", ("", "er2"), ("", "er2")), ("yue4", ("", "ve4"), ("y", "ve4")), ("nve3", ("n", "ve3"), ("n", "ve3")), ("lue4", ("l", "ve4"), ("l", "ve4")), ("m2", ("", "em2"), ("", "em2")), ("zhir1", ("zh", "iiir1"), ("zh", "iiir1")), ("hng5", ("", ""), ("", "")), ("wanr2", ("", "uanr2"), ("", "uanr2")), ("quan2", ("q", "van2"), ("q", "van2")), ("gui4", ("g", "uei4"), ("g", "uei4"))]
    rows = spark.createDataFrame([(p,) for p, _, _ in cases], "p string").select("p", phonemes.split_pinyin(F.col("p")).alias("e"), phonemes.split_pinyin(F.col("p"), "train").alias("t"))
    assert {r.p: (tuple(r.e), tuple(r.t)) for r in rows.collect()} == {p: (e, t) for p, e, t in cases}
