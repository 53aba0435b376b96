"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest permitted length. Pieces of one length are
interchangeable, so the packing is decided on the exact histogram of piece lengths, which has at most
as many entries as the largest permitted length: longest first, pieces go to the open bins with the
least room that still takes them; if none does, bins open of the permitted length whose cost for each
token they would hold of such pieces is least; at the end each bin shrinks to the smallest permitted
length that holds its contents. The bins are those of placing the pieces one by one. The decision names
bins for ranges of ranks, and executors give each piece its rank among the pieces of its length by digit
histograms (`ranks.radix_ranks`), so a length that a third of the pieces have is ranked by many tasks.

Special cases: a document counts its tokens and one for its end, so null and empty texts take one
token; pieces of one length go by id (null first), then a hash of the text, then piece, whatever the
partitions; of bins with equal room the one of less capacity is filled first; equal rows are packed each, in any
order; texts of any length are packed whole; an empty table packs nothing. Extra columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import store
from strophe.llm.ranks import long_digits, radix_ranks
from strophe.llm.tokens import with_token_counts


@dataclass
class Plan:
    """Ranges of ranks with their bins, and ranges of bins with their final lengths."""

    spans: np.ndarray  # length, first rank, pieces per bin, first bin, offset of the first piece
    bins: np.ndarray  # first bin, final length


def plan_bins(histogram: dict[int, int], sizes: list[int], overhead: int = 64) -> Plan:
    """Best-fit decreasing over (length, count). A bin of size s costs s + overhead."""
    sizes = sorted(sizes)
    room: dict[tuple[int, int], list[list[int]]] = defaultdict(list)  # room left and capacity: [first bin, bins]
    rooms: list[tuple[int, int]] = []
    spans: list[tuple[int, int, int, int, int]] = []
    made = 0

    def give(left: int, first: int, bins: int, capacity: int) -> None:
        if not room[left, capacity]:
            insort(rooms, (left, capacity))
        room[left, capacity].append([first, bins])

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        most = sizes[-1] // length
        while n:
            at = bisect_left(rooms, (length, 0))
            if at < len(rooms):
                left, capacity = rooms[at]
                first, bins = room[left, capacity].pop()
                if not room[left, capacity]:
                    rooms.pop(at)
            else:
                cost = lambda s: ((s + overhead) / (min(s // length, n) * length), s)  # noqa: B023, E731
                capacity = left = min((s for s in sizes if s >= length), key=cost)
                # while pieces for the largest size are left, bins of the same size follow
                first, bins = made, max(1, (n - most) // (capacity // length) + 1)
                made += bins
            each = left // length
            full = min(bins, n // each)
            if full:
                spans.append((length, rank, each, first, capacity - left))
                give(left - each * length, first, full, capacity)
                rank, n = rank + full * each, n - full * each
            first, bins = first + full, bins - full
            if bins and 0 < n < each:
                spans.append((length, rank, n, first, capacity - left))
                give(left - n * length, first, 1, capacity)
                rank, n, first, bins = rank + n, 0, first + 1, bins - 1
            if bins:
                give(left, first, bins, capacity)
    final = sorted((first, min(s for s in sizes if s >= capacity - left)) for (left, capacity), groups in room.items() for first, _ in groups)
    return Plan(np.array(spans, dtype=np.int64).reshape(-1, 5), np.array(final, dtype=np.int64).reshape(-1, 2))


def pieces_of(docs: DataFrame, id_col: str, text_col: str, largest: int, **tokenizer) -> DataFrame:
    """id, mark (the text's hash), n_tokens, piece, start, length: whole documents, cut where they pass the largest length."""
    marked = docs.select(id_col, text_col, F.xxhash64(text_col).alias("mark"))
    counted = with_token_counts(marked, "n_tokens", text_col, drop_text=True, **tokenizer)
    counted = counted.withColumn("n_tokens", F.col("n_tokens") + 1)
    whole = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / largest))
    out = counted.withColumn("piece", F.explode(whole)).withColumn("start", F.col("piece") * largest)
    return out.withColumn("length", F.least(F.lit(largest).cast("long"), F.col("n_tokens") - F.col("start")))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = (512, 1024, 2048, 4096, 8192), overhead: int = 64, **tokenizer) -> DataFrame:
    """One row per piece: id, piece, start, length, bin_id, bin_size, bin_offset."""
    spark = docs.sparkSession
    pieces = store(pieces_of(docs, id_col, text_col, max(sizes), **tokenizer).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most max(sizes) entries
    plan = spark.sparkContext.broadcast(plan_bins(histogram, list(sizes), overhead))
    digits = [F.hex(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit("!")] if dict(docs.dtypes)[id_col] == "string" else [long_digits(F.col(id_col))]
    key = F.concat(*digits, long_digits(F.col("mark")), long_digits(F.col("piece")), long_digits(F.col("row")))
    ranked = radix_ranks(pieces, "length", key, total="").select(id_col, "piece", "start", "length", "rank")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, bins = plan.value.spans, plan.value.bins
        by = np.lexsort((spans[:, 1], spans[:, 0]))
        spans = spans[by]
        begins = np.searchsorted(spans[:, 0], np.arange(max(sizes) + 2))
        span_ranks = spans[:, 1] + spans[:, 0] * (1 << 48)
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            if not len(length):
                continue
            assert (begins[length + 1] > begins[length]).all()
            s = spans[np.searchsorted(span_ranks, length * (1 << 48) + rank, side="right") - 1]
            k = rank - s[:, 1]
            bin_id, offset = s[:, 3] + k // s[:, 2], s[:, 4] + k % s[:, 2] * length
            size = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(x, pa.int64()) for x in (bin_id, size, offset))], names=[id_col, "piece", "start", "length", "bin_id", "bin_size", "bin_offset"])

    schema = ranked.select(id_col, "piece", "start", "length").schema.add("bin_id", "long").add("bin_size", "long").add("bin_offset", "long")
    return ranked.mapInArrow(assign, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
