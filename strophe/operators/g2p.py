"""Letters to phones, learned from a lexicon.

Letters and phones of the entries are aligned by expectation maximisation over small units (one or two
letters with none to two phones). The entries, cut into their best units, say how likely a unit is where some letters lie ahead and
some units went before, with Dirichlet smoothing, and a word is converted by a beam search over its cuts. Letters are given, so cuts into
fewer units are not likelier for it. The fit reads all entries, in tasks: counts of units, whose number the letters and phones bound, are sent to
all tasks after each round; the counts of contexts stay a table, of which words get what their own letters can meet.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.shared import stored

#: Letters and phones of a unit; order of the n-grams; letters ahead, the unit's own among them; weight of a shorter context; open paths of the search.
SHAPES = ((1, 1), (1, 0), (2, 0), (2, 1), (1, 2))
ORDER, AHEAD, WEIGHT, BEAM = 4, 4, 0.5, 12
ROUNDS = 5
#: Expected counts are added up in whole parts of this size, so that no order of the entries changes them.
PART = 1e-10
#: Words that are converted together.
WORDS = 2000
Unit = tuple[str, tuple[str, ...]]


def _arcs(word: str, phones: tuple[str, ...]) -> Iterable[tuple[int, int, int, int, Unit]]:
    for i in range(len(word)):
        for j in range(len(phones) + 1):
            for a, b in SHAPES:
                if i + a <= len(word) and j + b <= len(phones):
                    yield i, j, i + a, j + b, (word[i : i + a], phones[j : j + b])


class _ByShape(dict):
    """At first each unit is as likely as its shape's number of symbols lets it be."""

    def __missing__(self, u: Unit) -> float:
        return 0.1 ** (abs(len(u[0]) - len(u[1])) + len(u[0]) + len(u[1]) - 1)


def _expected(entries: Iterable[tuple[str, Iterable[str]]], weight: dict[Unit, float]) -> Counter:
    """How often each unit is expected in the entries, in PARTs."""
    counts: Counter = Counter()
    for word, phones in entries:
        arcs = list(_arcs(word, tuple(phones)))
        end = (len(word), len(phones))
        ahead, back = {(0, 0): 1.0}, {end: 1.0}
        for i, j, k, e, u in arcs:
            if (i, j) in ahead:
                ahead[k, e] = ahead.get((k, e), 0.0) + ahead[i, j] * weight[u]
        for i, j, k, e, u in reversed(arcs):
            if (k, e) in back:
                back[i, j] = back.get((i, j), 0.0) + back[k, e] * weight[u]
        if arcs and (total := ahead.get(end, 0.0)):
            for i, j, k, e, u in arcs:
                if (i, j) in ahead and (k, e) in back:
                    counts[u] += round(ahead[i, j] * weight[u] * back[k, e] / total / PART)
    return counts


def _weights(counts: dict[Unit, int]) -> dict[Unit, float]:
    whole = sum(counts.values()) or 1
    return defaultdict(_least, {u: c / whole for u, c in counts.items() if c * PART > 1e-6})


def _least() -> float:
    return 1e-12


def _aligned(word: str, phones: tuple[str, ...], weight: dict[Unit, float]) -> list[Unit]:
    """The best units of an entry."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, j, k, e, u in _arcs(word, phones):
        if (i, j) in best:
            score = best[i, j][0] + math.log(weight[u])
            if (k, e) not in best or score > best[k, e][0]:
                best[k, e] = (score, (i, j, u))
    out, at = [], (len(word), len(phones))
    if at not in best:
        return []
    while best[at][1]:
        i, j, u = best[at][1]
        out.append(u)
        at = (i, j)
    return out[::-1]


def _contexts(history: tuple[Unit, ...], ahead: str, order: int) -> Iterable[tuple]:
    """Wider and wider: first more letters ahead (`$` is the end), then also more units before."""
    yield from ((ahead[:k],) for k in range(1, len(ahead) + 1))
    yield from ((*history[len(history) - k :], ahead) for k in range(1, min(len(history), order - 1) + 1))


def _seen(entries: Iterable[tuple[str, Iterable[str]]], weight: dict[Unit, float], order: int) -> Counter:
    """How often (context, unit) is in the best cuts of the entries."""
    counts: Counter = Counter()
    for spelled, phones in entries:
        path = [("^", ()), *_aligned(spelled, tuple(phones), weight)]
        word, at = "".join(u[0] for u in path[1:]) + "$", 0
        for i, u in enumerate(path[1:], 1):
            counts[(), u] += 1
            for h in _contexts(tuple(path[max(0, i + 1 - order) : i]), word[at : at + AHEAD], order):
                counts[h, u] += 1
            at += len(u[0])
    return counts


class Model:
    """What some entries, or the counts of some contexts, say of spellings."""

    def __init__(self, entries: Iterable[tuple[str, Iterable[str]]], rounds: int = ROUNDS, order: int = ORDER):
        entries, weight = list(entries), _ByShape()
        for _ in range(rounds):
            weight = _weights(_expected(entries, weight))
        seen = _seen(entries, weight, order)
        self._set({u for _, u in seen}, seen, order)

    @classmethod
    def of_counts(cls, units: Iterable[Unit], seen: dict[tuple, int], order: int = ORDER) -> Model:
        model = cls.__new__(cls)
        model._set(units, seen, order)
        return model

    def _set(self, units: Iterable[Unit], seen: dict[tuple, int], order: int) -> None:
        self.order = order
        self.counts: dict[tuple, Counter] = defaultdict(Counter)
        for (h, u), n in seen.items():
            self.counts[h][u] += n
        self.totals = {h: sum(c.values()) for h, c in self.counts.items()}
        self.of: dict[str, list[Unit]] = defaultdict(list)
        for u in sorted(units):
            self.of[u[0]].append(u)
        self.letters = {c for g in self.of for c in g}

    def _units(self, ahead: str) -> list[Unit]:
        """Those that can begin before these letters."""
        return [u for k in range(1, min(2, len(ahead)) + 1) for u in self.of.get(ahead[:k], ())]

    def chance(self, history: tuple[Unit, ...], unit: Unit, ahead: str) -> float:
        """Of a unit after others and at the letters ahead, which begin with its own; smoothed by smaller contexts."""
        units = self._units(ahead)
        p = 1.0 / len(units) if unit in units else 0.0
        for h in _contexts(history, ahead, self.order):
            if h in self.totals:
                p = (self.counts[h][unit] + WEIGHT * p) / (self.totals[h] + WEIGHT)
        return p

    def convert(self, word: str) -> list[str]:
        """The phones of the best cut found; letters that no entry has are left out."""
        word = "".join(c for c in word if c in self.letters)
        open_: list[dict[tuple, tuple[float, tuple]]] = [{} for _ in range(len(word) + 1)]
        open_[0][("^", ()),] = (0.0, ())
        for i in range(len(word)):
            ahead = (word[i:] + "$")[:AHEAD]
            for h, (score, phones) in sorted(open_[i].items(), key=lambda x: (-x[1][0], x[0]))[:BEAM]:
                for u in self._units(word[i : i + 2]):
                    s, k = score + math.log(self.chance(h, u, ahead)), i + len(u[0])
                    to = (*h, u)[1 - self.order :]
                    if to not in open_[k] or s > open_[k][to][0]:
                        open_[k][to] = (s, phones + u[1])
        return list(max(open_[-1].values())[1]) if open_[-1] else []


def _keys(word: str) -> set[str]:
    """Letters before and letters ahead of the contexts that a word can meet."""
    said, keys = "^" + word + "$", set()
    for at in range(1, len(said) - 1):
        ahead = said[at : at + AHEAD]
        keys.update("\0" + ahead[:k] for k in range(1, len(ahead) + 1))
        keys.update(said[max(0, at - k) : at] + "\0" + ahead for k in range(1, 2 * (ORDER - 1) + 1))
    return keys


def _key(context: tuple) -> str:
    return "".join(u[0] for u in context[:-1]) + "\0" + context[-1]


class Learned:
    """What a whole lexicon says of spellings: its units, and a table (key, context, unit, n) of the contexts."""

    def __init__(self, units: list[Unit], contexts: DataFrame):
        self.units, self.contexts = units, contexts


def _entries(pdf: pd.DataFrame) -> Iterator[tuple[str, tuple[str, ...]]]:
    return ((w, tuple(p)) for w, p in zip(pdf["word"], pdf["phones"], strict=True))


def _unit(letters: str, phones: Iterable[str]) -> Unit:
    return letters, tuple(phones)


def fit(lexicon: DataFrame, most: int | None = None) -> Learned | Model:
    """What all of (word, phones) say. With `most` a model of so many words at most, the same ones however the rows lie."""
    rows = lexicon.where((F.length("word") > 0) & F.col("phones").isNotNull()).select("word", "phones")
    if most is not None:
        return Model([(r.word, r.phones) for r in rows.orderBy(F.xxhash64("word"), "word", "phones").limit(most).collect()])
    rows = stored(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word"))
    sc, weight = rows.sparkSession.sparkContext, _ByShape()
    for _ in range(ROUNDS):
        shared = sc.broadcast(weight)

        def expected(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                yield pd.DataFrame([(a, list(b), n) for (a, b), n in _expected(_entries(pdf), shared.value).items()], columns=["letters", "phones", "n"])

        counts = rows.mapInPandas(expected, "letters string, phones array<string>, n long").groupBy("letters", "phones").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        weight = _weights({_unit(r.letters, r.phones): int(r.n) for r in counts.collect()})
    shared = sc.broadcast(weight)

    def seen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = _seen(_entries(pdf), shared.value, ORDER).items()
            yield pd.DataFrame([(_key(h) if h else None, json.dumps(h), json.dumps(u), n) for (h, u), n in found], columns=["key", "context", "unit", "n"])

    table = stored(rows.mapInPandas(seen, "key string, context string, unit string, n long").groupBy("key", "context", "unit").agg(F.sum("n").alias("n")))
    units = [_unit(*json.loads(r.unit)) for r in table.where("key IS NULL").select("unit").collect()]
    return Learned(units, table.where("key IS NOT NULL"))


def _context(said: str) -> tuple:
    *history, ahead = json.loads(said)
    return (*(_unit(*u) for u in history), ahead)


def convert_words(words: DataFrame, model: Learned | Model, col: str = "word") -> DataFrame:
    """(word, phones): one conversion for each distinct word."""
    words = words.select(F.col(col).alias("word")).distinct()
    if isinstance(model, Model):
        shared = words.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("array<string>")
        def convert(x: pd.Series) -> pd.Series:
            return x.map(lambda w: shared.value.convert(w) if w else [])

        return words.withColumn("phones", convert("word"))
    words = stored(words)
    units = words.sparkSession.sparkContext.broadcast(model.units)
    lots = words.withColumn("lot", F.pmod(F.xxhash64("word"), F.lit(max(1, -(-words.count() // WORDS)))))

    def met(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = {c for u, _ in units.value for c in u}
        for pdf in parts:
            found = {(lot, k) for lot, w in zip(pdf["lot"], pdf["word"], strict=True) if w for k in _keys("".join(c for c in w if c in letters))}
            yield pd.DataFrame(list(found), columns=["lot", "key"])

    needed = lots.select("lot", "word").mapInPandas(met, "lot long, key string").distinct().join(model.contexts, "key")

    def said(one: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        seen = {(_context(h), _unit(*json.loads(u))): n for h, u, n in zip(table["context"], table["unit"], table["n"], strict=True)}
        part = Model.of_counts(units.value, seen)
        return pd.DataFrame({"word": one["word"], "phones": [part.convert(w) if w else [] for w in one["word"]]})

    return lots.groupBy("lot").cogroup(needed.groupBy("lot")).applyInPandas(said, "word string, phones array<string>")
