"""Token lengths under a public byte-level BPE vocabulary, and how they are counted quickly.

The vocabulary is read on the driver from a path that the caller gives, and broadcast (its size is
fixed: one rank for each vocabulary entry), so executors need no local file. The splitting pattern
never joins what stands before a single space with the space, so words after a single space can be
encoded on their own: lengths of common words come from a table that each worker learns, and only
the rest of a text goes through the encoder. Texts where a space meets other white space are encoded
whole. The result is always the length of encoding the whole text.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's table of word lengths, and characters it is learned from.
COMMON_WORDS, LEARN_CHARS = 60_000, 4_000_000
_SPACE_RUN = re.compile(r" \s")
_counters: dict[str, TokenCounter] = {}


def default_vocabulary() -> str:
    """Path of the byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class TokenCounter:
    """Lengths of whole texts in tokens; special tokens' strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encode = tiktoken.Encoding("strophe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.common: dict[str, int] = {}

    def learn(self, texts: list[str | None]) -> None:
        seen: Counter[str] = Counter()
        chars = 0
        for t in texts:
            if t:
                seen.update(t[: LEARN_CHARS - chars].split(" "))
                chars += len(t)
                if chars >= LEARN_CHARS:
                    break
        del seen[""]
        self.common = {w: len(self.encode(f" {w}")) for w, n in seen.most_common(COMMON_WORDS) if n > 1}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.common or text[-1] == " " or _SPACE_RUN.search(text):
            return len(self.encode(text))
        first, *rest = text.split(" ")
        known = [*map(self.common.get, rest)]
        left = [w for w, n in zip(rest, known, strict=True) if n is None]
        return len(self.encode(first)) + sum(filter(None, known)) + (len(self.encode(f" {' '.join(left)}")) if left else 0)


def counter(key: str, ranks: dict[bytes, int], pattern: str) -> TokenCounter:
    if key not in _counters:
        _counters[key] = TokenCounter(ranks, pattern)
    return _counters[key]


def with_token_counts(docs: DataFrame, out_col: str, text_col: str = "text", drop_text: bool = False, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with out_col, the length of each whole text in tokens; null and empty texts have 0."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = StructType([*(f for f in docs.schema.fields if not (drop_text and f.name == text_col)), StructField(out_col, LongType())])
    arrow, at = to_arrow_schema(schema), docs.columns.index(text_col)
    key = f"{path}|{pattern}"

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(key, ranks.value, pattern)
        for b in batches:
            texts = b.column(at).to_pylist()
            if not c.common:
                c.learn(texts)
            cols = [x for i, x in enumerate(b.columns) if not (drop_text and i == at)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(map(c.count, texts), pa.int64())], schema=arrow)

    return docs.mapInArrow(lengths, schema)


def word_counts(col: str):
    """Words between ASCII white space, as a DataFrame expression."""
    return F.size(F.filter(F.split(F.coalesce(F.col(col), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
