"""Recordings: a RIFF/PCM codec over binary files, level and length from files, sample-exact cuts, down-mixing and resampling.

Files are decoded in Arrow batches, one file at a time. Resampling works on blocks of samples with the edges
of their neighbours, so a recording of any length is spread over tasks and no task holds it whole.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Format tags of the container (fixed values).
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Zero crossings of the filter's sinc on each side.
ZEROS = 6


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit little-endian PCM of samples (frames, channels)."""
    data = np.ascontiguousarray(samples, dtype="<i2").tobytes()
    channels = samples.shape[1] if samples.ndim > 1 else 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, PCM, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(data))
    return head + data + b"\0" * (len(data) % 2)


def decode_wav(body: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (frames, channels) in [-1, 1) of PCM of 8 to 32 bits or 32 and 64 bit floats. Others raise."""
    if len(body) < 12 or body[:4] != b"RIFF" or body[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(body):
        kind, size = struct.unpack_from("<4sI", body, at)
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body, at + 8)
            if form[0] == EXTENSIBLE:
                form = (struct.unpack_from("<H", body, at + 32)[0], *form[1:])
        elif kind == b"data" and form:
            tag, channels, rate, _, frame, bits = form
            data = body[at + 8 : at + 8 + size]
            data = data[: len(data) // frame * frame]
            if tag == FLOAT and bits in (32, 64):
                x = np.frombuffer(data, dtype=f"<f{bits // 8}").astype(np.float64)
            elif tag == PCM and bits == 8:
                x = (np.frombuffer(data, dtype=np.uint8).astype(np.float64) - 128) / 128
            elif tag == PCM and bits == 24:
                b = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) - ((b[:, 2] >> 7) << 24)) / float(1 << 23)
            elif tag == PCM and bits in (16, 32):
                x = np.frombuffer(data, dtype=f"<i{bits // 8}") / float(1 << (bits - 1))
            else:
                raise ValueError(f"unknown sample format {tag}, {bits} bits")
            return rate, x.reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(x * 32768), -32768, 32767).astype("<i2")


_DECODED = "path string, size long, rate int, channels int, frames long, samples array<double>, error string"


def _decoded(batches: Iterator[pa.RecordBatch], mono: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.string()]
    for b in batches:
        for i in range(b.num_rows):
            path, body = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
            try:
                rate, x = decode_wav(body)
                row = [path, len(body), rate, x.shape[1], len(x), (x.mean(axis=1) if mono else x.reshape(-1)), None]
            except (ValueError, struct.error, ZeroDivisionError) as e:
                row = [path, len(body), None, None, None, None, str(e)]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split(" ")[0] for c in _DECODED.split(", ")])


def decoded(files: DataFrame, path: str = "path", body: str = "content", mono: bool = True) -> DataFrame:
    """(path, size, rate, channels, frames, samples, error) of audio files; channels are averaged, or interleaved.

    A file that can't be read has an error and no samples."""
    return files.select(path, body).mapInArrow(lambda it: _decoded(it, mono), _DECODED)


def read_audio(spark: SparkSession, path: str, mono: bool = True) -> DataFrame:
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path), mono=mono)


def seconds(frames: Column, rate: Column) -> Column:
    """Length to the millisecond."""
    return F.round(frames / rate, 3)


def encoded(recordings: DataFrame, name: str = "name", samples: str = "samples", rate: str = "rate") -> DataFrame:
    """(name, body) with mono samples in [-1, 1) as 16-bit files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [encode_wav(_clipped(np.asarray(x.as_py() or [], dtype=np.float64)), r.as_py()) for x, r in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.binary())], names=["name", "body"])

    return recordings.select(F.col(name).alias("name"), F.col(samples).cast("array<double>").alias("s"), F.col(rate).cast("int").alias("r")).mapInArrow(run, "name string, body binary")


def cut(recordings: DataFrame, longest_ms: int = 30_000, at: Column | None = None, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Recordings cut to their middle, or to the window at the share `at` of the slack; by the frame, bounds in whole ms."""
    n, r = F.size(samples), F.col(rate)
    length = F.round(n * 1000 / r).cast("long")
    start = F.floor(length / 2).cast("long") - longest_ms // 2 if at is None else F.floor((length - longest_ms + 1) * at).cast("long")
    start = F.when(length <= longest_ms, 0).otherwise(F.least(F.greatest(start, F.lit(0)), length - longest_ms))
    first = F.floor(start * r / 1000).cast("int")
    end = F.when(length <= longest_ms, n).otherwise(F.least(F.floor((start + longest_ms) * r / 1000).cast("int"), n))
    return recordings.withColumn(samples, F.slice(samples, first + 1, F.greatest(end - first, F.lit(0))))


# Resampling


class Polyphase:
    """A windowed sinc between rates, with one set of taps for each of the `up` phases of an output sample."""

    def __init__(self, source: int, target: int, zeros: int = ZEROS):
        g = math.gcd(source, target)
        self.up, self.down = target // g, source // g
        self.cutoff = min(1.0, self.up / self.down)
        self.reach = zeros / self.cutoff  # input samples on each side
        self.edge = math.ceil(self.reach)
        k = np.arange(-self.edge, self.edge + 1)
        phase = np.arange(self.up)[:, None] / self.up
        self.taps = self.response(phase - k[None, :])  # of output at offset phase from input sample 0 to input sample k

    def response(self, t: np.ndarray) -> np.ndarray:
        """The filter at t input samples from its middle."""
        window = np.where(np.abs(t) < self.reach, 0.5 + 0.5 * np.cos(np.pi * t / self.reach), 0.0)
        return self.cutoff * np.sinc(self.cutoff * t) * window

    def outputs(self, first: int, last: int) -> tuple[int, int]:
        """Output samples that belong to the input samples first .. last - 1."""
        return -(-first * self.up // self.down), -(-last * self.up // self.down)

    def block(self, before: np.ndarray, x: np.ndarray, after: np.ndarray, first: int) -> np.ndarray:
        """Output samples of a block that begins at input sample `first`, of up to `edge` samples before and after it."""
        pad = lambda n: np.zeros(max(0, n))
        wide = np.concatenate([pad(self.edge - len(before)), before[max(0, len(before) - self.edge) :], x, after[: self.edge], pad(self.edge - len(after))])
        low, high = self.outputs(first, first + len(x))
        m = np.arange(low, high) * self.down
        at = m // self.up - first  # input sample at or before each output
        return np.einsum("ij,ij->i", wide[at[:, None] + np.arange(2 * self.edge + 1)], self.taps[m % self.up])


def resampled_blocks(blocks: DataFrame, source: int, target: int, size: int, by: str = "name", block: str = "block", samples: str = "samples", zeros: int = ZEROS) -> DataFrame:
    """(by, block, samples) at another rate. Blocks hold `size` input samples each, the last one of a recording fewer.

    Each block is sent the edges of those around it; outputs stay with the block their moment falls into. A gap between
    blocks is silence. Rows with null samples are blocks without any.
    """
    p = Polyphase(source, target, zeros)
    reach = -(-p.edge // size)  # blocks that an edge covers
    near = range(-reach, reach + 1)
    rows = blocks.select(F.col(by).alias("__by"), F.col(block).cast("long").alias("__block"), F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>")).alias("__x"))
    piece = lambda d: F.col("__x") if d == 0 else (F.when(F.size("__x") > p.edge, F.slice("__x", F.size("__x") - p.edge + 1, F.lit(p.edge))).otherwise(F.col("__x")) if d > 0 else F.slice("__x", 1, p.edge))
    sent = rows.select("__by", F.explode(F.array(*(F.struct((F.col("__block") + d).alias("to"), F.lit(-d).alias("side"), piece(d).alias("x"), F.size("__x").alias("n")) for d in near))).alias("s")).select("__by", "s.*")
    cells = sent.groupBy("__by", "to").agg(F.sort_array(F.collect_list(F.struct("side", "x", "n"))).alias("parts")).where(F.exists("parts", lambda s: s["side"] == 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for to, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                line = np.zeros(size * (2 * reach + 1))
                own = 0
                for s in parts:
                    x, at = np.asarray(s["x"], dtype=np.float64), (s["side"] + reach) * size
                    if s["side"] < 0:  # the end of an earlier block
                        at += s["n"] - len(x)
                    own = len(x) if s["side"] == 0 else own
                    line[at : at + len(x)] = x
                mid = reach * size
                out.append(p.block(line[:mid], line[mid : mid + own], line[mid + own :], to * size))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], names=["__by", "to", "x"])

    kind = cells.schema["__by"].dataType.simpleString()
    return cells.mapInArrow(run, f"__by {kind}, to long, x array<double>").select(F.col("__by").alias(by), F.col("to").alias(block), F.col("x").alias(samples))


def in_blocks(recordings: DataFrame, size: int, by: str = "name", samples: str = "samples") -> DataFrame:
    """Recordings as rows (by, block, samples) of `size` samples."""
    n = F.greatest(F.ceil(F.size(samples) / size).cast("int"), F.lit(1))
    cut_ = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(samples, i * size + 1, F.lit(size)))
    return recordings.select(by, F.posexplode(cut_).alias("block", samples))
