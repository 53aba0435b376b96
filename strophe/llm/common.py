"""Helpers shared by the operators: shared-folder tables, row keys, text forms and folds."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.shared import folder

#: ASCII white space, the only characters that part words here.
WS = "\x20\x09\x0a\x0b\x0c\x0d"
_TO_SPACE = bytes(32 if chr(b) in WS else b for b in range(256))
_LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER_AND_SPACE = bytes(_LOWER_AZ[_TO_SPACE[b]] for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one of our own only where it is unset on a local master, as in tests."""
    return folder(spark)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later stages read it back instead of computing it again.

    Planned without adaptive changes, so that a partitioning by key that df ends with is kept and
    later joins on the key needn't shuffle it again.
    """
    spark = df.sparkSession
    folder(spark)
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        return df.select("*").checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; it goes when the session ends.

    The shuffles that led to it are dropped from the executors' disks as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strophe-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.select("*").write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col, m: int):
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8")) % F.lit(m)


def squeezed(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ASCII white space as one space; null is empty."""
    if not text:
        return b""
    b = text.encode("utf-8", "surrogatepass").translate(_TO_SPACE)
    while b"  " in b:
        b = b.replace(b"  ", b" ")
    return b


def words(text: str | None) -> list[bytes]:
    """Words of the text between runs of ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_AND_SPACE).split() if text else []


#: Words of at most so many bytes are hashed together; bytes of text hashed at a time.
_SHORT, _CHUNK = 64, 1 << 16
_BYTE = np.random.default_rng(71).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[32] = 0
_PLACE = np.random.default_rng(72).integers(0, 1 << 63, _SHORT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_TABLE = np.frombuffer(_LOWER_AND_SPACE, dtype=np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value with its bits spread over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (as `words` gives them) of all texts, one after another, and how many each text has.

    Works on the column's own bytes. A short word's hash is the sum over its bytes of a random number for
    the byte times one for its place, then mixed; a longer word's is xxhash64. Null texts have no words.
    """
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(offsets, dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    low = _LOWER_TABLE[np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    opens = low != 32
    shut = ~opens
    opens[1:] &= shut[:-1]
    at = ends[1:-1]
    at = at[at < len(low)]
    opens[at] = ~shut[at]  # a word never goes on over a text's end
    starts = np.nonzero(opens)[0]
    of_text = np.searchsorted(starts, ends)
    out = np.empty(len(starts), dtype=np.uint64)
    nexts = np.append(starts[1:], len(low))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _CHUNK)))
        wide_to = np.minimum(nexts[i:j], starts[i:j] + _SHORT)
        span = wide_to - starts[i:j]
        first = np.cumsum(span) - span
        place = np.arange(int(span.sum())) - np.repeat(first, span)
        b = low[place + np.repeat(starts[i:j], span)]
        out[i:j] = np.add.reduceat(_BYTE[b] * _PLACE[place], first)
        i = j
    long = np.nonzero((nexts - starts > _SHORT) & (starts + _SHORT < len(low)))[0]
    for k in long:
        if not shut[starts[k] + _SHORT - 1] and not shut[starts[k] + _SHORT]:
            word = low[starts[k] : nexts[k]].tobytes()
            out[k] = xxhash.xxh64_intdigest(word.rstrip(b" "))
    return mixed(out), np.diff(of_text)


def fold(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Components of n nodes under the edges (i, j): for each node the smallest node reachable.

    Hooking and pointer jumping on arrays; ends after a logarithmic number of rounds in practice.
    """
    root = np.arange(n)
    i, j = np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64)
    while len(i):
        a, b = root[i], root[j]
        live = a != b
        i, j, a, b = i[live], j[live], a[live], b[live]
        if not len(i):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def in_step(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words when laid out step by step over all texts, longest first; texts at each step."""
    rank = np.empty(len(per_text), dtype=np.int64)
    rank[np.argsort(-per_text, kind="stable")] = np.arange(len(per_text))
    longest = int(per_text.max(initial=0))
    active = len(per_text) - np.cumsum(np.bincount(per_text, minlength=longest + 1))[:longest]
    begins = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(int(per_text.sum())) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return begins[step] + np.repeat(rank, per_text), active


def binary(rows) -> pa.Array:
    return pa.array(rows, type=pa.binary())
