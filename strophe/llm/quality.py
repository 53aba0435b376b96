"""Quality classifier: similarity-weighted voting of nearest labelled documents in a latent-semantic space.

A document's terms are pairs of neighbouring byte classes, hashed words, and how its words repeat
and how long they are. Terms are weighted by (1 + log tf) idf and projected by a truncated SVD. Idf,
projection and the labelled vectors are fitted on a bounded sample of labelled rows (`per_class` of
each label, those with the smallest seeded hash of their id); the labelled vectors are therefore of
proven size and are broadcast. Every document is then compared with all of them: exact cosine
products, block by block, keep the k most similar, and their labels vote with weight cosine^power.

Special cases: null and empty texts have no terms and score the share of label 1 in the sample; so
does every text if there are no labelled rows (then 0.5). Ties among neighbours are broken by
position in the sample. Repeated rows are scored each time. Labels given twice count as the larger.
Where ids repeat among the sampled documents, the sample holds the rows of the smallest ids. Whole texts are
scored, however long; an empty table gives no rows; extra columns may have any names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import crc_mod

#: Classes of bytes: each lower-case letter, each ASCII punctuation mark, and one class for each other kind.
_CLASS = np.zeros(256, dtype=np.int32)
for _b in range(256):
    _c = chr(_b)
    if "a" <= _c <= "z":
        _CLASS[_b] = 1 + _b - 97
    elif "A" <= _c <= "Z":
        _CLASS[_b] = 27
    elif _c.isdigit() and _b < 128:
        _CLASS[_b] = 28
    elif _b == 10:
        _CLASS[_b] = 29
    elif _b == 32:
        _CLASS[_b] = 30
    elif _b >= 128:
        _CLASS[_b] = 31
    elif 33 <= _b < 127:
        _CLASS[_b] = 32 + sum(1 for x in range(33, _b) if not chr(x).isalnum()) % 32
PAIRS, HASHED, SHAPES = 4096, 1024, 24
TERMS = PAIRS + HASHED + SHAPES


def term_counts(text: str | None) -> np.ndarray:
    """Counts of a whole text's terms."""
    out = np.zeros(TERMS, dtype=np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    c = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    out[:PAIRS] = np.bincount(c[:-1] * 64 + c[1:], minlength=PAIRS)
    w = raw.split()
    seen = Counter(w)
    at = np.fromiter((zlib.crc32(x) for x in seen), dtype=np.int64, count=len(seen)) % HASHED
    np.add.at(out, PAIRS + at, np.fromiter(seen.values(), dtype=np.float32, count=len(seen)))
    if w:
        same, n, shape = sum(map(eq, w, w[1:])), len(w), PAIRS + HASHED
        out[shape : shape + 16] = np.bincount(np.minimum(np.fromiter(map(len, w), dtype=np.int64, count=n), 15), minlength=16)
        out[shape + 16 + min(3, int(4 * same / n))] = 1 + same
        out[shape + 20 + min(3, int(4 * len(seen) / n))] = n
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; documents without terms stay zero."""
        x = np.log1p(counts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        v = x @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, k: int, power: float, block: int = 1024) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        v = self.embed(counts)
        best = np.full((len(v), 0), 0, dtype=np.float32)
        vote = np.zeros((len(v), 0), dtype=np.float32)
        for at in range(0, len(self.labels), block):
            sims = v @ self.vectors[at : at + block].T
            best = np.concatenate([best, sims], axis=1)
            vote = np.concatenate([vote, np.broadcast_to(self.labels[at : at + block], sims.shape)], axis=1)
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, vote = np.take_along_axis(best, top, 1), np.take_along_axis(vote, top, 1)
        weight = np.maximum(best, 0).astype(np.float64) ** power
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * vote).sum(axis=1) / np.maximum(total, 1e-300), self.prior)


def fit(counts: np.ndarray, labels: np.ndarray, dims: int = 64, seed: int = 7) -> Model:
    """Idf, SVD axes (randomised range finder with power steps) and labelled vectors of the sample."""
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, dims), np.float32), np.zeros((0, dims), np.float32), np.zeros(0, np.float32), 0.5)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = np.log1p(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    q = np.random.default_rng(seed).standard_normal((TERMS, min(dims + 16, len(x)))).astype(np.float32)
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    small = np.linalg.svd(x @ q, full_matrices=False)[2]
    axes = (q @ small.T)[:, :dims].astype(np.float32)
    m = Model(idf, axes, np.zeros((0, axes.shape[1]), np.float32), labels.astype(np.float32), float(labels.mean()))
    m.vectors = m.embed(counts).astype(np.float32)
    return m


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn=None,
    per_class: int = 1500, dims: int = 64, k: int = 8, power: float = 4.0, seed: int = 7,
) -> DataFrame:
    """docs' ids with score (0 to 1). learn: predicate over the id column for rows that may be learned from."""
    spark = docs.sparkSession
    named = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if learn is not None:
        named = named.where(learn)
    named = named.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__strophe_label"))
    order = [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]
    picked = [named.where(F.col("__strophe_label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [term_counts(t).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["id", "label", "counts"])

    sample = docs.select(F.col(id_col).alias("id"), text_col).join(picked.select(F.col(id_col).alias("id"), F.col("__strophe_label").alias("label")), "id").select("id", "label", text_col)
    rows = sample.mapInArrow(features, sample.select("id", "label").schema.add("counts", "binary")).orderBy("id", "counts").limit(2 * per_class).collect()
    counts = np.frombuffer(b"".join(r.counts for r in rows), dtype=np.float32).reshape(len(rows), TERMS)
    model = fit(counts, np.array([r.label for r in rows], dtype=np.int64), dims, seed)
    del rows, counts
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                s = m.score(np.stack([term_counts(t) for t in texts]), k, power)
                empty = np.array([not t for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(empty, m.prior, s), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(score, docs.select(id_col).schema.add("score", "double"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs, labels, learn=crc_mod("doc_id", 5) != 0)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
