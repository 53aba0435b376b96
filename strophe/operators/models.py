"""The model boundary: pluggable batch functions with deterministic stand-ins, and what wraps them.

A model is a function from a pandas Series (or frame) of inputs to outputs of the same length. It runs
in Arrow batches, once loaded for each worker. The stand-ins need no weights and give the same output
for the same input, so pipelines run and are tested without a GPU or a network.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions.jsonx import parsed

Model = Callable[[pd.Series], pd.Series]


def batch_map(df: DataFrame, col: str, out: str, kind: str, load: Callable[[], Model]) -> DataFrame:
    """`out` of a model over `col`; the model is loaded once for each task."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield model(b)

    return df.withColumn(out, run(col))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big")


def load_asr() -> Model:
    """One sentence for each path, in the tool's structured form."""
    return lambda s: s.map(lambda p: f"<|{('en', 'zh')[_digest(p) % 2]}|><asr>words of {p}")


def load_tagger() -> Model:
    """A JSON answer in a fenced block."""
    styles = ("rock", "folk", "jazz", "pop")
    return lambda s: s.map(lambda p: "```json\n" + json.dumps({"tags": [styles[_digest(p) % 4], styles[_digest(p) // 4 % 4]]}) + "\n```")


def load_embedder(dim: int = 64) -> Callable[[], Model]:
    """Unit vectors of hashed words."""

    def load() -> Model:
        def one(text: str) -> list[float]:
            v = [0.0] * dim
            for w in (text or "").split():
                h = _digest(w)
                v[h % dim] += 1.0 if h >> 32 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            return [x / n for x in v] if n else v

        return lambda s: s.map(one)

    return load


def load_similarity() -> Model:
    """A similarity in [0, 1] for each input."""
    return lambda s: s.map(lambda p: _digest(p) % 10_000 / 10_000)


def load_writer() -> Model:
    """A prompt's answer: a JSON list of songs, with a trailing comma as models give."""
    return lambda s: s.map(lambda p: '```json\n[{"description": "about ' + str(_digest(p) % 97) + '", "lyrics": "[00:10.00]la\\n[02:55.00]la\\n[03:10.00]end"},]\n```')


def tagged(df: DataFrame, load: Callable[[], Model] = load_tagger) -> DataFrame:
    """V02 with N01: style tags by path; answers without JSON drop."""
    out = batch_map(df, "path", "__answer", "string", load)
    return out.withColumn("tags", parsed(F.col("__answer"), "tags array<string>")["tags"]).drop("__answer").where(F.col("tags").isNotNull())


def generate_turns(turns: DataFrame, model: Callable[[list[tuple[str, str]]], str], conv: str = "conv_id") -> DataFrame:
    """Each assistant turn is generated from all turns before it; a failure is a status, not text.

    Columns: conv, turn, role, text. Conversations are independent, turns within one are not.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        history: list[tuple[str, str]] = []
        rows = []
        for r in pdf.sort_values("turn").itertuples():
            text, status, error = r.text, "given", None
            if r.role == "assistant":
                try:
                    text, status = model(history), "generated"
                except Exception as e:  # the model's own failures become rows
                    text, status, error = None, "failed", str(e)
            history.append((r.role, text))
            rows.append((pdf[conv].iloc[0], r.turn, r.role, text, status, error))
        return pd.DataFrame(rows, columns=[conv, "turn", "role", "text", "status", "error"])

    kind = dict(turns.dtypes)[conv]
    return turns.select(conv, "turn", "role", "text").groupBy(conv).applyInPandas(run, f"{conv} {kind}, turn long, role string, text string, status string, error string")
