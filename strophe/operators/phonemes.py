"""Phonemes and phoneme error rate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from strophe.operators import chinese as words_of
from strophe.operators import g2p

#: Words of digits met in English text (fixed value).
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def language_runs(c: Column) -> Column:
    """Runs of CJK (tag 0) and ASCII letters (tag 1) in order.

    A run of digits counts only after four English runs: it gives the word of its first digit.
    """
    runs = F.regexp_extract_all(c, F.lit(r"([一-鿿]+|[a-zA-Z]+|[0-9]+)"), F.lit(1))
    english = lambda x: x.rlike("^[a-zA-Z]")
    word = lambda x: F.element_at(F.array(*map(F.lit, DIGITS)), F.substring(x, 1, 1).cast("int") + 1)
    tagged = F.transform(runs, lambda x, i: F.when(
        x.rlike("^[0-9]"), F.when(F.size(F.filter(F.slice(runs, 1, i), english)) >= 4, F.struct(word(x).alias("text"), F.lit(1).alias("tag")))
    ).otherwise(F.struct(x.alias("text"), F.when(english(x), 1).otherwise(0).alias("tag"))))
    return F.filter(tagged, lambda x: x.isNotNull())


#: Syllables whose letters aren't their initial and final, as pattern and `initial final` (fixed values). A row for each spelling.
SPELLINGS = (
    ("([zcsr])i", "$1 ii"), ("([zcs]h)i", "$1 iii"),
    ("y(a|an|ang|ao|e|ong|ou)", " i$1"), ("y(i|in|ing)", " $1"), ("y[uv](|an|n)", " v$1"), ("yve", " ve"),
    ("wu", " u"), ("w(.*)", " u$1"), ("([jqx])u(.*)", "$1 v$2"),
    ("([^aeiouv]*)ui", "$1 uei"), ("([^aeiouv]*)iu", "$1 iou"), ("([^aeiouv]*)un", "$1 uen"), ("([^aeiouv]*)ue", "$1 ve"),
    ("([^aeiouv]*)([aeiouv].*)", "$1 $2"),
)
#: What one variant spells otherwise (fixed values): evaluation reads `yue` as a final alone.
EVALUATED = (("yue", " ve"),)


def split_pinyin(c: Column, variant: str = "eval") -> Column:
    """initial and final of a toned syllable, a final r and the tone staying on the final.

    A syllable without any vowel has neither; an r alone is a final in the training variant and nothing in the other.
    """
    tone = F.regexp_extract(c, r"(\d)$", 1)
    plain = F.regexp_replace(F.regexp_replace(c, r"\d$", ""), "^(n|ng|m)$", "e$1")
    r = F.when(plain.endswith("r"), "r").otherwise("")
    p = F.regexp_replace(plain, "r$", "")
    rows = (*EVALUATED, *SPELLINGS) if variant == "eval" else SPELLINGS
    found = F.coalesce(*(F.when(p.rlike(f"^{k}$"), F.regexp_replace(p, f"^{k}$", v)) for k, v in rows), F.when((p == "") & (r == "r") & F.lit(variant != "eval"), F.lit(" ")))
    return F.struct(F.coalesce(F.split_part(found, F.lit(" "), F.lit(1)), F.lit("")).alias("initial"), F.coalesce(F.concat(F.split_part(found, F.lit(" "), F.lit(2)), r, tone), F.lit("")).alias("final"))


def spell(word: str) -> list[str]:
    """Stand-in for grapheme to phoneme conversion: a symbol for each letter."""
    return [x.upper() for x in word if x.isalpha()]


def phonemes(runs: DataFrame, key: str, lexicon: DataFrame, fallback: Callable[[str], list[str]] | str = spell, with_sp: bool = False, chinese: DataFrame | None = None, variant: str = "eval") -> DataFrame:
    """(key, pos, text) runs to each key's phonemes in order, tones and stresses removed.

    Words come from the lexicon (word, phones) in lower case, the first by phones of equal ones; those it lacks go through `fallback`,
    once for each distinct word: a function, or "learned" for a model fitted on the lexicon. With `chinese`, a lexicon
    (word, weight, readings), runs of its characters are cut into words and read; without, they are words like others.
    """
    low = runs.withColumn("word", F.lower("text"))
    lexicon = lexicon.groupBy(F.lower("word").alias("word")).agg(F.min("phones").alias("phones"))
    is_chinese = F.col("word").rlike("^[一-鿿]+$") & F.lit(chinese is not None)
    missing = low.select("word").distinct().where(~is_chinese).join(lexicon, "word", "left_anti")
    if fallback == "learned":
        spelled = g2p.convert_words(missing, g2p.fit(lexicon))
    else:

        def convert(words: pd.Series) -> pd.Series:
            return words.map(fallback)

        spelled = missing.withColumn("phones", F.pandas_udf(convert, "array<string>")("word"))
    plain = lambda c: F.filter(F.transform(c, lambda x: F.regexp_replace(x, r"\d+", "")), lambda x: x != "")
    paused = lambda c: F.when(F.size(c) > 0, F.concat(c, F.array(F.lit("sp")))).otherwise(c) if with_sp else c
    known = lexicon.select("word", "phones").unionByName(spelled).select("word", paused(plain(F.col("phones"))).alias("p"))
    if chinese is not None:
        cut = words_of.cut_runs(low.where(is_chinese), chinese, "word")
        said = plain(words_of.spoken(F.col("words"), F.col("readings"), lambda x: split_pinyin(x, variant), with_sp))
        known = known.unionByName(cut.select(F.col("run").alias("word"), said.alias("p")))
    said = low.join(known, "word").select(key, "pos", "p")
    return said.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"])).alias("phonemes"))


def equal_length(ref: Column, hyp: Column) -> tuple[Column, Column]:
    """Both cut to the shorter's characters."""
    n = F.least(F.length(ref), F.length(hyp))
    return F.substring(ref, F.lit(1), n), F.substring(hyp, F.lit(1), n)


#: Symbols that one byte each can stand for, and that one character of the basic plane each can.
ONE_BYTE, ONE_CHARACTER = 95, 0xFFFF - 0x4DFF - 0x800


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def bit_distance(a: Sequence, b: Sequence, most: int | None = None) -> int:
    """Edit distance of two lists of any elements; beyond `most`, some number above it.

    A column of the table is two sets of bits (where it rises and falls from row to row), moved on by one element of b
    at a time in arithmetic on whole words; the loop stops where the rest can't bring the distance down to `most`.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    rows: dict = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    last, whole = 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, score = whole, 0, len(a)
    for i, x in enumerate(b):
        same = rows.get(x, 0)
        diagonal = ((same & up) + up ^ up) | same | down
        rise, fall = down | ~(diagonal | up) & whole, up & diagonal
        score += bool(rise & last) - bool(fall & last)
        if most is not None and score - (len(b) - 1 - i) > most:
            return score
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(diagonal | rise)) & whole, rise & diagonal & whole
    return score


@F.pandas_udf(IntegerType())
def _wide_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else bit_distance(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], dtype="Int32")


def list_distance(a: Column, b: Column) -> Column:
    """Edit distance of lists of any number of symbols.

    A pair's distinct elements become one character each: up to ONE_BYTE symbols are ASCII characters, for which distances
    are fastest, more are characters of the basic plane without its surrogates. Pairs with more elements than
    it has characters go through `bit_distance`.
    """
    wide = F.size(a) + F.size(b) > ONE_CHARACTER

    def distance(p: Column) -> Column:
        n = F.size(p["s"])

        def code(x: Column) -> Column:
            at = F.array_position(p["s"], x)
            character = F.decode(F.unhex(F.lpad(F.hex(at + F.when(at + 0x4DFF < 0xD800, 0x4DFF).otherwise(0x4DFF + 0x800)), 4, "0")), "UTF-16BE")
            return F.when(n <= ONE_BYTE, F.char(at + 31)).otherwise(character)

        line = lambda c: F.array_join(F.transform(c, code), "")
        return F.levenshtein(line(p["a"]), line(p["b"]))

    both = F.struct(F.when(~wide, a).alias("a"), F.when(~wide, b).alias("b"))
    narrow = _bound(both, lambda q: _bound(F.struct(q["a"].alias("a"), q["b"].alias("b"), F.array_distinct(F.concat(q["a"], q["b"])).alias("s")), distance))
    return F.when(wide, _wide_distance(F.when(wide, a), F.when(wide, b))).otherwise(narrow)


def phoneme_error_rate(ref: Column, hyp: Column) -> Column:
    """Distance by reference length; of an empty reference 1 if anything was heard, else 0."""
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) > 0, 1.0).otherwise(0.0)).otherwise(list_distance(ref, hyp) / F.size(ref))
