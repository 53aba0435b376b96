"""MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles. Documents of equal sets collapse first, within tasks
and then over the cluster, so copies cost nothing further. Each distinct set has MinHash samples; bands
of some of them are the keys of candidate buckets, and all of them are folded into an odd sketch: a
bitmap in which each sample flips one bit. The XOR of two sketches has as many bits as samples differ,
corrected for flips that meet, which estimates high similarities closely, and only pairs whose estimate
comes within four standard deviations of the threshold are confirmed, on full sets.

No group's pairs are emitted. Buckets are dealt in blocks of bounded size; a block gives the maximum
spanning forest of its estimates, a row for each document at most. Confirmed edges make components.
A second step takes only buckets that still hold more than one component, block by block and
block against block. It first marks documents with a passing estimate to another component, then
compares the marked ones on full sets inside the cells, each pair in the first band it shares, and gives
only links that join components, a row for each document at most. So within the buckets no link is
lost that could join components, however large they are, and no cell writes its pairs.

Special cases: null texts and texts without words have empty sets and stay alone; a text of fewer words
than a shingle has one, its whole sequence; repeated rows are members like others, and exactly one row
of a component is marked as staying for `near_dedup_rows`; a null id is larger than any other; whole texts count,
however long; an empty table gives no rows; extra columns may have any names but those that begin with __strophe,
which are ours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm.common import hashed_words, mixed, partitions, store
from strophe.llm.components import connected_components

SAMPLES, SKETCH_BITS = 256, 1024
#: Rows of a band at most; the chance that a pair at the threshold shares no band.
ROWS, MISS = 6, 5e-5
#: Members of a bucket that one block compares.
BLOCK = 512
#: Rows whose copies a task collapses at once.
BUFFER_ROWS, BUFFER_CHARS = 4096, 24 << 20
_U = np.uint64
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint64) * _U(2) + _U(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
RID, REP = "__strophe_rid", "__strophe_rep"
_LAST = (1 << 63) - 1


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles of k words as sorted 64-bit hashes; a shorter text's whole sequence is one."""
    h, per_text = hashed_words(texts)
    n = max(0, len(h) - k + 1)
    rolled = np.empty(n, dtype=np.uint64)
    for at in range(0, n, 1 << 15):
        end = min(n, at + (1 << 15))
        out = np.full(end - at, k, dtype=np.uint64)
        for i in range(k):
            out = mixed(out * _U(0x9E3779B97F4A7C15) + h[at + i : end + i])
        rolled[at:end] = out
    sets, begin = [], 0
    for m in per_text.tolist():
        if m >= k:
            x = np.sort(rolled[begin : begin + m - k + 1])
        else:
            x = np.full(min(m, 1), m, dtype=np.uint64)
            for i in range(m):
                x = mixed(x * _U(0x9E3779B97F4A7C15) + h[begin + i])
        new = np.ones(len(x), dtype=bool)
        new[1:] = x[1:] != x[:-1]
        sets.append(x[new])
        begin += m
    return sets


def samples(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set: least values of 32-bit linear maps of its hashes' high halves."""
    x = (s >> _U(32)).astype(np.uint32)
    low = np.full(SAMPLES, np.iinfo(np.uint32).max, dtype=np.uint32)
    each = np.empty((min(len(x), 256), SAMPLES), dtype=np.uint32)
    for at in range(0, len(x), 256):
        part = x[at : at + 256, None]
        here = each[: len(part)]
        np.multiply(part, _A, out=here)
        here += _B
        np.minimum(low, here.min(axis=0), out=low)
    return mixed(low.astype(np.uint64) + np.arange(SAMPLES, dtype=np.uint64) * _U(0xD1B54A32D192ED03))


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and their rows: as many rows as leave a pair at the threshold a chance of MISS at most to share no band."""
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
        if bands * rows <= SAMPLES:
            return max(1, bands), rows
    return SAMPLES, 1


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mixed(key * _U(0x9E3779B97F4A7C15) + low[r : bands * rows : rows])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> bytes:
    """Parity bitmap: each sample, told apart by its number, flips one bit."""
    odd = (np.bincount((low % _U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def similarity_by_bits() -> np.ndarray:
    """Estimated Jaccard similarity for each population count of the XOR."""
    z = np.minimum(np.arange(SKETCH_BITS + 1), SKETCH_BITS // 2 - 1)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(1 - 2 * z / SKETCH_BITS)


def _signed(batches: Iterator[pa.RecordBatch], names: list[str], id_col: str, text_col: str, k: int, bands: int, band_rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 36
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(names.index(text_col))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            held = np.cumsum(lengths[at : at + BUFFER_ROWS])
            end = at + max(1, int(np.searchsorted(held, BUFFER_CHARS)))
            part = batch.slice(at, min(end, batch.num_rows) - at)
            texts = part.column(names.index(text_col))
            ids = part.column(names.index(id_col)).to_pylist()
            sets = shingle_sets(texts, k)
            first: dict[bytes, int] = {}
            found = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            for i, (s, digest) in enumerate(zip(sets, found, strict=True)):
                j = first.get(digest) if len(s) else i
                if len(s) and (j is None or (_LAST if ids[i] is None else ids[i]) < (_LAST if ids[j] is None else ids[j])):
                    first[digest] = i
            n = part.num_rows
            rep = [key + (first[d] if len(s) else i) for i, (d, s) in enumerate(zip(found, sets, strict=True))]
            lead = np.zeros(n, dtype=bool)
            lead[list(first.values())] = True
            low = {i: samples(sets[i]) for i in np.nonzero(lead)[0].tolist()}
            alone = np.array([not len(s) for s in sets])
            cols = [texts.take(pa.array(np.arange(n), mask=~(lead | alone))) if c == text_col else part.column(j) for j, c in enumerate(names)]
            cols += [
                pa.array(range(key, key + n), pa.int64()), pa.array(rep, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([found[i] if i in low else None for i in range(n)], pa.binary()),
                pa.array([band_keys(low[i], bands, band_rows) if i in low else None for i in range(n)], pa.list_(pa.int64())),
                pa.array([odd_sketch(low[i]) if i in low else None for i in range(n)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
            key += n
            at += n


def _short_bands(bands: pa.Array) -> pa.Array:
    """Each row's band keys, 32 bits of each, as bytes: enough to tell whether two rows share a band."""
    n = len(bands)
    return pa.array([x.tobytes() for x in bands.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, -1)] if n else [], pa.binary())


def _with_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(rid, text) to (rid, hashes), for few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            sets = shingle_sets(part.column(1), k)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            hashes = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(sets).view(np.int64), pa.int64())).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), hashes], names=["rid", "hashes"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables in which runs of equal values of the first `keys` columns are whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(i)[held[-1].num_rows - 1].as_py() != c[0] for i, c in enumerate(cols)):
            change[0] = True
        at = np.nonzero(change)[0]
        if len(at):
            if at[-1] > 0:
                held.append(b.slice(0, at[-1]))
            yield pa.Table.from_batches(held).combine_chunks() if held else pa.Table.from_batches([], b.schema)
            held = [b.slice(at[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(t: pa.Table, keys: int) -> Iterator[tuple[int, int]]:
    change = np.zeros(t.num_rows, dtype=bool)
    for i in range(keys):
        c = t.column(i).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    at = np.concatenate([[0], np.nonzero(change)[0], [t.num_rows]])
    yield from zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def _sketches(t: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=np.uint64).reshape(t.num_rows, SKETCH_BITS // 64)


def _passes(sk: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray, least: float, threshold: float) -> np.ndarray:
    """Estimates of all pairs, -1 where they can't reach the threshold."""
    table = similarity_by_bits()
    out = np.full((len(sk), len(other)), -1.0)
    for at in range(0, len(sk), 64):
        bits = np.bitwise_count(sk[at : at + 64, None, :] ^ other[None, :, :]).sum(axis=2, dtype=np.int64)
        est = table[bits]
        a, b = size[at : at + 64, None], other_size[None, :]
        out[at : at + 64] = np.where((est >= least) & (np.minimum(a, b) >= threshold * np.maximum(a, b)), est, -1.0)
    return out


def _forest(batches: Iterator[pa.RecordBatch], least: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, rid, size, sketch), sorted: maximum spanning forests of the blocks' estimates."""
    for t in _runs(batches, 2):
        if not t.num_rows:
            continue
        rid, size, sk = t.column("rid").to_numpy(), t.column("size").to_numpy(), _sketches(t, "sketch")
        left, right = [], []
        for a, b in _groups(t, 2):
            m = b - a
            if m < 2:
                continue
            est = _passes(sk[a:b], size[a:b], sk[a:b], size[a:b], least, threshold)
            best, via = np.full(m, -1.0), np.full(m, -1)
            todo = np.ones(m, dtype=bool)
            for _ in range(m):
                v = int(np.where(todo, best, -2.0).argmax())
                todo[v] = False
                if best[v] > 0:
                    left.append(rid[a + via[v]])
                    right.append(rid[a + v])
                closer = todo & (est[v] > best)
                best[closer], via[closer] = est[v][closer], v
        if left:
            l, r = np.array(left), np.array(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(l, r)), pa.array(np.maximum(l, r))], names=["a", "b"])


def _cells(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Cells of rows sorted by (key, i, j): first row, the rows of block i and of block j, whether they are one block."""
    block, i, j = (t.column(c).to_numpy() for c in ("block", "i", "j"))
    for a, b in _groups(t, 3):
        yield a, a + np.nonzero(block[a:b] == i[a])[0], a + np.nonzero(block[a:b] == j[a])[0], bool(i[a] == j[a])


def _bands(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("bands").to_pylist()), dtype=np.int32).reshape(t.num_rows, -1)


def _first_shared(bands: np.ndarray, p: np.ndarray, q: np.ndarray, band: int) -> np.ndarray:
    """Whether `band` is the first that rows p and q share, so that a pair is settled in one cell only."""
    return (bands[p, : band + 1] == bands[q, : band + 1]).argmax(axis=1) == band


def _marked(batches: Iterator[pa.RecordBatch], least: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, block, rid, component, band, size, sketch, bands), sorted: those with a passing estimate to
    another component that this cell has to settle."""
    for t in _runs(batches, 3):
        if not t.num_rows:
            continue
        comp, size, band, sk, bands = *(t.column(c).to_numpy() for c in ("component", "size", "band")), _sketches(t, "sketch"), _bands(t)
        needed = np.zeros(t.num_rows, dtype=bool)
        for a, x, y, _ in _cells(t):
            passing = (_passes(sk[x], size[x], sk[y], size[y], least, threshold) > 0) & (comp[x][:, None] != comp[y][None, :])
            p, q = np.nonzero(passing)
            for lo in range(0, len(p), 1 << 16):
                u, v = x[p[lo : lo + (1 << 16)]], y[q[lo : lo + (1 << 16)]]
                mine = _first_shared(bands, u, v, int(band[a]))
                needed[u[mine]] = True
                needed[v[mine]] = True
        if needed.any():
            yield from t.filter(pa.array(needed)).combine_chunks().to_batches()


def _across(batches: Iterator[pa.RecordBatch], least: float, threshold: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, block, rid, component, band, size, sketch, bands, hashes), sorted: links that join components."""
    for t in _runs(batches, 3):
        if not t.num_rows:
            continue
        rid, comp, size, band, sk, bands = *(t.column(c).to_numpy() for c in ("rid", "component", "size", "band")), _sketches(t, "sketch"), _bands(t)
        sets = t.column("hashes").combine_chunks()
        left, right = [], []
        for a, x, y, same in _cells(t):
            est = _passes(sk[x], size[x], sk[y], size[y], least, threshold)
            p, q = np.nonzero((est > 0) & (comp[x][:, None] != comp[y][None, :]))
            if same:
                p, q = p[p < q], q[p < q]
            mine = _first_shared(bands, x[p], y[q], int(band[a]))
            p, q = p[mine], q[mine]
            up: dict[int, int] = {}

            def top(c: int, up: dict[int, int] = up) -> int:
                while up.setdefault(c, c) != c:
                    c = up[c]
                return c

            held: dict[int, np.ndarray] = {}
            for k in np.argsort(-est[p, q], kind="stable"):
                u, v = int(x[p[k]]), int(y[q[k]])
                cu, cv = top(int(comp[u])), top(int(comp[v]))
                if cu == cv:
                    continue
                for w in (u, v):
                    if w not in held:
                        held[w] = sets[w].values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(held[u], held[v], assume_unique=True))
                if 100 * both >= percent * (len(held[u]) + len(held[v]) - both):
                    up[max(cu, cv)] = min(cu, cv)
                    left.append(min(rid[u], rid[v]))
                    right.append(max(rid[u], rid[v]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows with RID, REP (a stored table), and per REP its component's smallest id and kept row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names, n, threshold = docs.columns, partitions(docs.sparkSession), percent / 100
    least = threshold - 4 * (threshold * (1 - threshold) / SAMPLES) ** 0.5
    bands, band_rows = bands_for(percent)
    extra = [(RID, T.LongType()), (REP, T.LongType()), ("__strophe_n", T.LongType()), ("__strophe_set", T.BinaryType()), ("__strophe_bands", T.ArrayType(T.LongType())), ("__strophe_sketch", T.BinaryType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(a, b) for a, b in extra)])
    arrow = to_arrow_schema(schema)
    rows = store(docs.mapInArrow(lambda it: _signed(it, names, id_col, text_col, k, bands, band_rows, arrow), schema))

    leads = rows.where(F.col("__strophe_set").isNotNull())
    # of each distinct set: its row of smallest id stands for it
    order = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(RID).alias("rid"))
    classes = leads.groupBy("__strophe_set").agg(F.min(order).alias("best"))
    of_lead = store(leads.select("__strophe_set", F.col(RID).alias("lead")).join(classes, "__strophe_set").select("lead", F.col("best.rid").alias("rid"), F.col("best.id").alias("id")))
    reps = of_lead.where("lead = rid").select("rid", "id")

    signed = leads.select(F.col(RID).alias("rid"), F.col("__strophe_n").alias("size"), F.col("__strophe_sketch").alias("sketch"), F.col("__strophe_bands").alias("bands")).join(reps.select("rid"), "rid", "left_semi")
    keyed = signed.select("rid", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    in_bucket = store(keyed.join(buckets, "key").select("key", "band", "rid", "members"))
    # ids are stored before they meet texts, so that the planner knows how many bytes it would broadcast
    active = store(in_bucket.select("rid").distinct())
    short = lambda it: (pa.RecordBatch.from_arrays([*b.columns[:3], _short_bands(b.column(3))], names=["rid", "size", "sketch", "bands"]) for b in it)
    sketched = store(signed.join(active, "rid", "left_semi").mapInArrow(short, "rid long, size long, sketch binary, bands binary"))
    texts = store(leads.select(F.col(RID).alias("rid"), text_col).join(active, "rid", "left_semi"))
    sets_of = lambda ids: texts.join(ids, "rid", "left_semi").mapInArrow(lambda it: _with_sets(it, k), "rid long, hashes array<long>")

    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = in_bucket.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("rid"), blocks).cast("int")})
    dealt = placed.join(sketched.select("rid", "size", "sketch"), "rid").select("key", "block", "rid", "size", "sketch").repartition(n, "key", "block").sortWithinPartitions("key", "block", "rid")
    likely = store(dealt.mapInArrow(lambda it: _forest(it, least, threshold), "a long, b long").distinct())
    paired = store(likely.select(F.col("a").alias("rid")).union(likely.select(F.col("b").alias("rid"))).distinct())
    sets = store(sets_of(paired))
    p = likely.join(sets.select(F.col("rid").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("hashes").alias("y")), "b")
    p = p.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sizes"))
    links = store(p.where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b"))
    first = store(connected_components(links))

    labelled = placed.join(first.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    mixed_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    still = store(labelled.join(mixed_keys, "key", "left_semi").select("key", "band", "blocks", "block", "rid", "component"))
    # block against block: a row goes to every cell (i, j), i <= j, of its bucket that has its block
    at = ["key", "i", "j"]
    spread = still.join(sketched, "rid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", "component", "band", "size", "sketch", "bands")
    inside = lambda rows: rows.repartition(n, *at).sortWithinPartitions(*at, "rid")
    marked = store(inside(spread).mapInArrow(lambda it: _marked(it, least, threshold), "key long, i int, j int, block int, rid long, component long, band int, size long, sketch binary, bands binary"))
    late_sets = sets_of(marked.select("rid").distinct())
    late = store(inside(marked.join(late_sets, "rid").select(*marked.columns, "hashes")).mapInArrow(lambda it: _across(it, least, threshold, percent), "a long, b long").distinct())
    joined = connected_components(links.unionByName(late)).withColumnRenamed("node", "rid")

    whole = store(reps.join(joined, "rid", "left").withColumn("component", F.coalesce("component", "rid")))
    best = whole.groupBy("component").agg(F.min(F.struct("id", "rid")).alias("best"))
    settled = whole.join(best, "component").select("rid", F.col("best.id").alias("component_id"), F.col("best.rid").alias("kept_rid"))
    return rows, of_lead.select("lead", "rid").join(settled, "rid").select(F.col("lead").alias(REP), "component_id", "kept_rid")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept. Links: 100 |A & B| >= percent |A | B|."""
    rows, settled = _classes(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col, k, percent)
    out = rows.select(id_col, RID, REP, F.col("__strophe_n").alias("n_shingles")).join(settled, REP, "left")
    component = F.when(F.col("kept_rid").isNull() | (F.col("component_id") == _LAST), F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(id_col, "n_shingles", component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"))


def near_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, with all their columns: one of each component, and all without shingles."""
    rows, settled = _classes(docs, id_col, text_col, k, percent)
    gone = store(settled.where(F.col(REP) != F.col("kept_rid")).select(F.col(REP).alias(RID)))
    return rows.where(F.col(RID) == F.col(REP)).join(gone, RID, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


#: Shared shingles counted by an inverted join, components by reachability: for small tables.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT i, j FROM p JOIN s a ON a.doc_id = i JOIN s b ON b.doc_id = j WHERE 100 * common >= 85 * (len(a.sh) + len(b.sh) - common)),
b AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
r AS (SELECT doc_id AS n, doc_id AS c FROM s UNION SELECT b.j, r.c FROM r JOIN b ON b.i = r.n)
SELECT doc_id, len(any_value(sh)) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM s JOIN r ON n = doc_id GROUP BY doc_id
"""
