"""Chinese words and their readings: a word graph over a prefix trie, cut by unigram weights.

Each distinct run of characters is cut once. Words of the lexicon are edges of the run's graph, and a single
character is always one; the path of the largest sum of scores is taken, of equal sums the one whose first
different word is longer. Readings then come from the longest lexicon words inside each cut word, so a character of several readings
is read as its word says. A lexicon of up to MOST words is broadcast as a trie; of a larger one each run
is sent the words that occur in it, found by a join on its substrings.

Null and empty runs have no words; characters that no entry reads have a null reading; of entries of one word the
first by `weight`, then readings, counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a lexicon that is broadcast whole; characters of a word.
MOST, LONGEST = 1_000_000, 16
#: Scores are millionths of natural logarithms, so sums are exact.
UNIT = 1_000_000


class Trie:
    """Words by their characters; a node's entry is its score and readings."""

    def __init__(self, entries: Iterable[tuple[str, int, list[str] | None]]):
        self.root: dict = {}
        for word, score, readings in entries:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = (score, readings)

    def words(self, text: str, at: int) -> Iterator[tuple[int, int, list[str] | None]]:
        """Ends, scores and readings of the words that begin at a place."""
        node = self.root
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                return
            if "" in node:
                yield (end + 1, *node[""])


def cut(text: str, trie: Trie, unknown: int) -> list[str]:
    """The best path through the word graph."""
    best: list[tuple[int, int]] = [(0, 0)] * (len(text) + 1)
    for i in range(len(text) - 1, -1, -1):
        edges = {i + 1: unknown} | {end: score for end, score, _ in trie.words(text, i)}
        best[i] = max((score + best[end][0], end) for end, score in edges.items())
    out, i = [], 0
    while i < len(text):
        out.append(text[i : best[i][1]])
        i = best[i][1]
    return out


def read(word: str, trie: Trie) -> list[str | None]:
    """A reading for each character, by the longest words that have readings."""
    out: list[str | None] = []
    while len(out) < len(word):
        found = [(end, r) for end, _, r in trie.words(word, len(out)) if r and len(r) == end - len(out)]
        out += found[-1][1] if found else [None]
    return out


def scored(lexicon: DataFrame) -> tuple[DataFrame, int]:
    """(word, score, readings) of (word, weight, readings), and the score of a character that the lexicon lacks."""
    first = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("weight"), "readings"))
    words = lexicon.where((F.length("word") > 0) & (F.length("word") <= LONGEST) & (F.col("weight") > 0)).withColumn("__n", first).where("__n = 1").drop("__n")
    total = words.agg(F.sum("weight").cast("double").alias("t")).first().t or 1.0
    score = lambda c: F.round(F.log(c / F.lit(total)) * UNIT).cast("long")
    unknown = words.sparkSession.range(1).select(score(F.lit(1.0))).first()[0]
    return words.select("word", score(F.col("weight").cast("double")).alias("score"), "readings"), unknown


_CUT = "run string, words array<string>, readings array<array<string>>"


def _written(runs: list[str], tries: Iterable[Trie], unknown: int) -> pa.RecordBatch:
    words = [cut(r, t, unknown) for r, t in zip(runs, tries, strict=False)]
    readings = [[read(w, t) for w in ws] for ws, t in zip(words, tries, strict=False)]
    strings = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(words, strings), pa.array(readings, pa.list_(strings))], names=["run", "words", "readings"])


def cut_runs(runs: DataFrame, lexicon: DataFrame, col: str = "run", most: int = MOST) -> DataFrame:
    """(run, words, readings of each word) of each distinct run of characters, with a lexicon (word, weight, readings)."""
    words, unknown = scored(lexicon)
    distinct = runs.select(F.col(col).alias("run")).where(F.length("run") > 0).distinct()
    if words.count() <= most:
        shared = runs.sparkSession.sparkContext.broadcast([(r.word, r.score, r.readings) for r in words.collect()])  # at most `most` words

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(shared.value)
            for b in batches:
                yield _written(b.column(0).to_pylist(), [trie] * b.num_rows, unknown)

        return distinct.mapInArrow(whole, _CUT)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - i + 1)), lambda k: F.substring(F.col("run"), i, k))))
    pieces = distinct.select("run", F.explode(F.array_distinct(spans)).alias("word"))
    met = pieces.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("word", "score", "readings")).alias("entries"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tries = [Trie((e["word"], e["score"], e["readings"]) for e in entries or ()) for entries in b.column(1).to_pylist()]
            yield _written(b.column(0).to_pylist(), tries, unknown)

    return distinct.join(met, "run", "left").select("run", "entries").mapInArrow(own, _CUT)


def spoken(words: Column, readings: Column, split, with_sp: bool = False) -> Column:
    """Initials and finals of cut words in order, as `split` parts a syllable; after each word a pause, if wanted."""

    def one(of: Column) -> Column:
        parts = F.flatten(F.transform(F.filter(of, lambda x: x.isNotNull()), lambda x: F.array(split(x)["initial"], split(x)["final"])))
        parts = F.filter(parts, lambda x: x != "")
        return F.when(F.size(parts) > 0, F.concat(parts, F.array(F.lit("sp")))).otherwise(parts) if with_sp else parts

    return F.flatten(F.transform(readings, one))
