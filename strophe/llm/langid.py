"""Language identification with a linear-chain conditional random field over words.

A text's words (runs of letters of the lower-cased text) carry emission features: affixes (the four
bytes at either end), byte trigrams that see the word's edges, and a lexicon of words seen when
learning. Labels are languages; transitions between neighbouring words are learned along with the
feature weights, so that code-switched text changes label where the evidence outweighs a switch. The
forward-backward recursion gives each word's marginals; their mean over all words is the document's
share of each language, the largest share is the prediction and its value the score.

The field is fitted by gradient ascent of the regularised log-likelihood on a bounded sample:
`per_language` learning rows of each language, those with the smallest seeded hash of id and text, of
`sample_chars` characters together at most (a longer text is never learned from). All languages share
`total_chars` characters, and the `languages` commonest are learned (of equal counts those that sort first), so the
sample and the broadcast tables (2 MB a language) are bounded whatever the labels are; rarer labels are never predicted.
Whole texts are labelled, however long. Recursions run over all words of a batch in step, longest text first.

Special cases: null texts and texts without a letter give `und` with score 0; a text with letters but
no languages to learn gives `und` too; ties go to the language that sorts first; rows and ids repeat
freely; an empty table gives no rows; extra columns may have any names but those that `carry` adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import crc_mod, in_step, store

TRIGRAMS, AFFIXES, LEXICON = 1 << 18, 1 << 16, 1 << 17
#: Bytes of text whose words are labelled together; a longer text makes a batch of its own.
BATCH_BYTES = 2 << 20
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes inside words: a-z and all bytes of non-ASCII characters; everything else is an edge.
_EDGE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Words:
    """Feature positions of a batch's words, in text order, and how many each text has."""

    trigram: np.ndarray
    first: np.ndarray  # where each word's trigrams begin
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray
    per_text: np.ndarray


def read_words(texts: list[str]) -> Words:
    chunks = [b"    " + t.lower().encode("utf-8", "surrogatepass").translate(_EDGE) + b"    " for t in texts]
    b = np.frombuffer(b"".join(chunks), dtype=np.uint8).astype(np.uint32)
    inside = b != 32
    start = np.nonzero(inside[1:] & ~inside[:-1])[0] + 1
    end = np.nonzero(inside[:-1] & ~inside[1:])[0] + 1  # one past
    of_text = np.cumsum([len(c) for c in chunks])
    ends = np.searchsorted(start, of_text)
    per_text = np.diff(ends, prepend=0)
    # trigrams centred on each byte of a word, its edges being spaces
    at = np.nonzero(inside)[0]
    tri = b[at - 1] + (b[at] << 8) + (b[at + 1] << 16)
    tri = (tri * np.uint32(2654435761)) >> np.uint32(14)
    first = np.searchsorted(at, start)
    four = lambda i: b[i] + (b[i + 1] << 8) + (b[i + 2] << 16) + (b[i + 3] << 24)
    prefix = (four(start) * np.uint32(2246822519)) >> np.uint32(16)
    suffix = (four(end - 4) * np.uint32(3266489917)) >> np.uint32(16)
    # a word's hash: the sum of its bytes times powers that depend on the place in the word
    place = (np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) if len(at) else at
    power = np.cumprod(np.full(256, 1000003, dtype=np.uint64))
    h = np.add.reduceat(b[at].astype(np.uint64) * power[np.minimum(place, 255)], first) if len(first) else np.zeros(0, np.uint64)
    lexicon = ((h * np.uint64(11400714819323198485)) >> np.uint64(47)).astype(np.int64)
    return Words(tri.astype(np.int64), first, prefix.astype(np.int64), suffix.astype(np.int64), lexicon, per_text)


@dataclass
class Field:
    languages: list[str]
    trigram: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray
    transition: np.ndarray  # log weights from label to label
    initial: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.first):
            return np.zeros((0, len(self.languages)), np.float32)
        return np.add.reduceat(self.trigram[w.trigram], w.first, axis=0) + self.prefix[w.prefix] + self.suffix[w.suffix] + self.lexicon[w.lexicon]


def forward_backward(emission: np.ndarray, per_text: np.ndarray, transition: np.ndarray, initial: np.ndarray, pairs: bool = False):
    """Marginals of every word in text order; with pairs, also expected transition counts and the log partition."""
    place, active = in_step(per_text)
    e = np.empty(emission.shape, dtype=np.float64)
    shift = emission.max(axis=1, keepdims=True)
    e[place] = np.exp(emission - shift)
    a, steps = np.exp(transition), len(active)
    begins = np.concatenate([[0], np.cumsum(active)])
    alpha, scale = np.empty_like(e), np.empty((len(e), 1))
    for t in range(steps):
        here = slice(begins[t], begins[t + 1])
        x = (np.exp(initial) if t == 0 else alpha[begins[t - 1] : begins[t - 1] + active[t]] @ a) * e[here]
        s = x.sum(axis=1, keepdims=True)
        alpha[here], scale[here] = x / s, s
    beta = np.ones_like(e)
    expected = np.zeros_like(a)
    for t in range(steps - 2, -1, -1):
        n, nxt = active[t + 1], slice(begins[t + 1], begins[t + 2])
        right = e[nxt] * beta[nxt] / scale[nxt]
        beta[begins[t] : begins[t] + n] = right @ a.T
        if pairs:
            expected += alpha[begins[t] : begins[t] + n].T @ right * a
    marginals = (alpha * beta)[place]
    return (marginals, expected, float(np.log(scale).sum() + shift.sum())) if pairs else marginals


def fit(texts: list[str], labels: list[str], rounds: int = 12, rate: float = 0.35, decay: float = 1e-3) -> Field:
    """Adaptive gradient ascent on the labelled texts' conditional log-likelihood."""
    languages = sorted(set(labels))
    n = len(languages)
    f = Field(languages, *(np.zeros((s, n), np.float32) for s in (TRIGRAMS, AFFIXES, AFFIXES, LEXICON)), np.zeros((n, n)), np.zeros(n))
    if not texts:
        return f
    w = read_words(texts)
    gold = np.repeat(np.array([languages.index(x) for x in labels]), w.per_text)
    chars = np.repeat(np.arange(len(w.first)), np.diff(w.first, append=len(w.trigram)))
    tables = [(f.trigram, w.trigram, chars), (f.prefix, w.prefix, slice(None)), (f.suffix, w.suffix, slice(None)), (f.lexicon, w.lexicon, slice(None))]
    rare = np.bincount(w.lexicon, minlength=LEXICON) < 3  # the lexicon is the words met at least three times
    squares = [np.full(t.shape, 1e-3, np.float32) for t, _, _ in tables] + [np.full((n, n), 1e-3)]
    opens = (np.cumsum(w.per_text) - w.per_text)[w.per_text > 0]
    opening, square = np.bincount(gold[opens], minlength=n), np.full(n, 1e-3)
    same = np.zeros((n, n))
    np.add.at(same, (gold[1:], gold[1:]), (np.repeat(np.arange(len(w.per_text)), w.per_text)[1:] == np.repeat(np.arange(len(w.per_text)), w.per_text)[:-1]).astype(float))
    for _ in range(rounds):
        marginals, expected, _ = forward_backward(f.emissions(w), w.per_text, f.transition, f.initial, pairs=True)
        diff = -marginals
        diff[np.arange(len(gold)), gold] += 1
        for (table, at, of), sq in zip(tables, squares, strict=False):
            g = np.stack([np.bincount(at, weights=diff[of, c], minlength=len(table)) for c in range(n)], axis=1) / len(gold) - decay * table / len(gold)
            if table is f.lexicon:
                g[rare] = 0
            sq += g.astype(np.float32) ** 2
            table += (rate * g / np.sqrt(sq + 1e-12)).astype(np.float32) * (g != 0)
        g = (same - expected) / len(gold) - 0.02 * f.transition
        squares[-1] += g**2
        f.transition += rate * g / np.sqrt(squares[-1])
        g = (opening - marginals[opens].sum(axis=0)) / max(1, len(opens)) - 0.02 * f.initial
        square += g**2
        f.initial += rate * g / np.sqrt(square)
    return f


def _learnable(docs: DataFrame, text_col: str, lang_col: str, learn) -> DataFrame:
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return rows if learn is None else rows.where(learn)


def can_learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", learn=None) -> bool:
    """Whether any row has a text and a language to learn from."""
    return not _learnable(docs, text_col, lang_col, learn).select(lang_col).limit(1).isEmpty()


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn, per_language: int, chars: int, total_chars: int, languages: int, seed: int) -> tuple[list[str], list[str]]:
    """Of each of the `languages` commonest labels the `per_language` rows of the smallest seeded hash, as far as their
    texts stay within `chars` and an equal share of `total_chars`.

    Two scans for any number of labels: one counts rows by language, one reads the rows whose hash lies
    under a bound that about twice as many pass (all, in a small language) and keeps the smallest by
    partition, then by language.
    """
    rows = _learnable(docs, text_col, lang_col, learn)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col, F.lit(seed)).alias("h")).where(F.length("text") <= chars)
    counts = store(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages))
    chars = min(chars, total_chars // max(1, counts.count()))
    order = Window.partitionBy("lang").orderBy("h", "text")

    def smallest(some: DataFrame) -> list:
        some = some.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
        return some.withColumn("upto", F.sum(F.length("text")).over(order)).where(F.col("upto") <= chars).orderBy("h", "lang", "text").collect()

    share = 2.0 * per_language / F.col("n")
    under = F.when(share >= 0.5, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    got = smallest(rows.join(counts.withColumn("under", under), "lang").where(F.col("h") <= F.col("under")).select("lang", "text", "h"))
    # a language of rows that are all alike may lie above its bound as a whole
    lost = [r.lang for r in counts.select("lang").collect() if r.lang not in {x.lang for x in got}]
    if lost:
        got += smallest(rows.where(F.col("lang").isin(*lost)))
    return [r.text for r in got], [r.lang for r in got]


def detect_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn=None, per_language: int = 250, sample_chars: int = 4_000_000,
    total_chars: int = 64_000_000, languages: int = 128, seed: int = 11, carry: bool = False,
) -> DataFrame:
    """Predictions for every row: id, lang_pred, score; with carry, all columns, __strophe_lang, __strophe_score.

    learn: predicate for rows whose text and language may be learned from; per_language, sample_chars: rows
    and characters of a language that the field is fitted on at most; total_chars, languages: characters and languages in all.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    field = fit(*_sample(docs, id_col, text_col, lang_col, learn, per_language, sample_chars, total_chars, languages, seed))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs if carry else docs.select(id_col, text_col)
    out = [f for f in rows.schema.fields if carry or f.name != text_col]
    named = ("__strophe_lang", "__strophe_score") if carry else ("lang_pred", "score")
    schema = StructType([*out, StructField(named[0], StringType()), StructField(named[1], DoubleType())])
    arrow, at = to_arrow_schema(schema), rows.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            pred: list[str] = []
            score: list[float] = []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < BATCH_BYTES):
                    size += len(texts[j] or "")
                    j += 1
                part = [t or "" for t in texts[i:j]]
                w = read_words(part)
                share = np.zeros((len(part), len(f.languages)))
                if len(w.first) and f.languages:
                    m = forward_backward(f.emissions(w), w.per_text, f.transition, f.initial)
                    has = np.nonzero(w.per_text)[0]
                    share[has] = np.add.reduceat(m, (np.cumsum(w.per_text) - w.per_text)[has], axis=0) / w.per_text[has, None]
                for t, s in zip(part, share, strict=True):
                    ok = len(s) and s.max() > 0 and _LETTER.search(t)
                    pred.append(f.languages[int(s.argmax())] if ok else "und")
                    score.append(min(1.0, float(s.max())) if ok else 0.0)
                i = j
            cols = [c for k, c in enumerate(b.columns) if carry or k != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=arrow)

    return rows.mapInArrow(label, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = detect_language(docs, learn=crc_mod("doc_id", 4) != 2)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
