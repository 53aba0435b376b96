"""Near-dedup of embeddings by sorted projection passes.

Each pass sorts the vectors by concatenated random hashes (signs of projections, most significant
first), so that vectors of small angle share long prefixes. All vectors that share the first `bits`
hashes of a pass, its cell, are compared with each other, whatever their number: a cell beyond BLOCK
vectors is compared in blocks against blocks. A pair at the threshold shares a cell with a chance that
depends on its angle alone, so the passes that keep its miss in all of them at the given probability
follow from `bits`, however dense the vectors stand. `bits` is the cheapest of some lengths by the sizes
of their cells, which are counted over all vectors; it moves work between passes and cells, not the miss.

Identical vectors collapse first, inside each task before anything moves, so one that a third of the rows share
is moved once for each task. A cell, or a pair of its blocks, emits a forest and each vector's number of links,
not pairs; a pair counts in the first pass whose cells it shares. Components of up to BLOCK vectors are then compared
inside by exact cosine, which also counts links that no cell holds; in larger ones the links found count.

Cosines are in double precision, of vectors scaled by powers of two, so none over- or underflows. Special cases: vectors that are null, zero, or hold null or
non-finite components link with nothing; vectors of different lengths don't link; repeated ids are
vectors of their own; at a cosine of exactly the threshold a pair links; rows of equal keys are compared
whatever their order; extra columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm.common import fold, partitions, store
from strophe.llm.components import connected_components
from strophe.llm.minhash_dedup import _groups, _runs

#: Vectors of a cell that evenly spread vectors aim at; bits of a key; vectors of a cell or component that one block holds.
WINDOW, BITS, BLOCK = 256, 62, 4096
#: Rows of a block whose products are formed at once.
TILE = 512
#: Passes that one shuffle sorts.
TOGETHER = 8
#: Comparisons that cost about as much as one more row that a pass moves. It chooses between equal results.
ROW = 1500


def passes_for(n: int, threshold: float, miss: float, bits: float | None = None) -> int:
    """Passes after which a pair at the threshold is missed with probability `miss` at most.

    Without `bits`, for n evenly spread vectors.
    """
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(0.0, math.log2(max(n, 1) / WINDOW)) + 1 if bits is None else bits
    return 1 if not bits else max(2, math.ceil(math.log(miss) / math.log1p(-(agree**bits))))


def _unit(values: pa.Array) -> np.ndarray:
    if not len(values):
        return np.zeros((0, 1))
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(values), -1)
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -exponent)  # exact: magnitudes below 1, the largest at least a half
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Planes:
    """Cells of unit vectors in each pass; a pass's planes follow from the seed."""

    def __init__(self, bits: int, seed: int):
        self.bits, self.seed, self.made = bits, seed, {}
        self.weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def cells(self, x: np.ndarray, number: int) -> np.ndarray:
        d = x.shape[1]
        if (number, d) not in self.made:
            self.made[number, d] = np.random.default_rng([self.seed, number, d]).standard_normal((d, BITS))[:, : self.bits]
        return ((x @ self.made[number, d]) > 0) @ self.weight


def _keys(batches: Iterator[pa.RecordBatch], first: int, count: int, bits: int, seed: int, carry: bool = True) -> Iterator[pa.RecordBatch]:
    """(rid, copies, size, vector) to (pass, size, cell) and, to carry, (rid, copies, vector), for passes first .. first + count - 1."""
    planes = _Planes(bits, seed)
    for b in batches:
        sizes = b.column(2).to_numpy()
        for d in np.unique(sizes):
            part = b.filter(pa.array(sizes == d)) if (sizes != d).any() else b
            x = _unit(part.column(3))
            for p in range(first, first + count):
                cols = {"pass": pa.array(np.full(len(x), p), pa.int32()), "size": part.column(2), "cell": pa.array(planes.cells(x, p), pa.int64())}
                yield pa.RecordBatch.from_pydict(cols | ({"rid": part.column(0), "copies": part.column(1), "vector": part.column(3)} if carry else {}))


def _bits(distinct: DataFrame, total: int, threshold: float, miss: float, seed: int) -> int:
    """The prefix length whose passes and cells cost least, by the cells of the first pass at each length."""
    least = max(0, math.ceil(math.log2(max(total, 1) / WINDOW)) - 2)
    lengths = [*range(least, min(BITS, least + 21) + 1, 3)]
    keyed = distinct.select("rid", "copies", "size", "vector").mapInArrow(lambda it: _keys(it, 0, 1, BITS, seed, carry=False), "pass int, size int, cell long")
    cut = keyed.select("size", F.explode(F.array(*map(F.lit, lengths))).alias("bits"), "cell").withColumn("cell", F.expr(f"shiftright(cell, {BITS} - bits)"))
    c = F.col("n").cast("double")
    cost = F.sum(c * c + ROW * c * F.ceil(c / BLOCK))
    costs = {r["bits"]: r["cost"] for r in cut.groupBy("size", "bits", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("bits").agg(cost.alias("cost")).collect()}
    return min(lengths, key=lambda b: costs[b] * passes_for(total, threshold, miss, b))


def _tiles(u: np.ndarray, v: np.ndarray, x: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the links between rows u and rows v of x: rows, rows, and whether each pair links. Within one block
    every pair comes once."""
    for at in range(0, len(u), TILE):
        left, right = u[at : at + TILE], v[at:] if same else v
        near = x[left] @ x[right].T >= threshold
        if same:
            near = np.triu(near, 1)
        yield left, right, near


def _linked(batches: Iterator[pa.RecordBatch], threshold: float, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (pass, size, cell, i, j, block, rid, copies, vector), sorted: of each cell of blocks a forest (a, b) of its
    pairs, and for each vector a the copies that it links to and no earlier pass has shown it."""
    planes = _Planes(bits, seed)
    for t in _runs(batches, 5):
        if not t.num_rows:
            continue
        rid, block, copies = (t.column(c).to_numpy() for c in ("rid", "block", "copies"))
        number, i, j = (t.column(c).to_numpy() for c in ("pass", "i", "j"))
        left, right, links = [], [], np.zeros(t.num_rows, dtype=np.int64)
        for a, b in _groups(t, 5):
            if b - a < 2:
                continue
            x = _unit(t.column("vector").slice(a, b - a).combine_chunks())
            u, v = np.nonzero(block[a:b] == i[a])[0], np.nonzero(block[a:b] == j[a])[0]
            root = np.arange(b - a)
            for part, other, near in _tiles(u, v, x, i[a] == j[a], threshold):
                p, q = np.nonzero(near)
                if not len(p):
                    continue
                # what the tiles before have joined stays joined
                root = fold(np.concatenate([part[p], root]), np.concatenate([other[q], np.arange(b - a)]), b - a)
                p, q = np.unique(p), np.unique(q)
                part, other, near = part[p], other[q], near[np.ix_(p, q)]
                for k in range(number[a]):
                    near &= planes.cells(x[part], k)[:, None] != planes.cells(x[other], k)
                links[a + part] += near @ copies[a + other]
                links[a + other] += near.T @ copies[a + part]
            leaf = np.nonzero(root != np.arange(b - a))[0]
            left.append(rid[a + root[leaf]])
            right.append(rid[a + leaf])
        some = np.nonzero(links)[0]
        edges = sum(map(len, left))
        if edges or len(some):
            nodes = np.concatenate([*left, rid[some]])
            others = pa.array(np.concatenate([*right, np.zeros(len(some), dtype=np.int64)]), pa.int64(), mask=np.arange(len(nodes)) >= edges)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), others, pa.array(np.concatenate([np.zeros(edges, dtype=np.int64), links[some]]))], names=["a", "b", "links"])


def _counts(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (component, i, j, block, rid, copies, vector), sorted: exact link counts of each cell of blocks."""
    for t in _runs(batches, 3):
        if not t.num_rows:
            continue
        rid, block, copies = (t.column(c).to_numpy() for c in ("rid", "block", "copies"))
        i, j = t.column(1).to_numpy(), t.column(2).to_numpy()
        links = np.zeros(t.num_rows, dtype=np.int64)
        for a, b in _groups(t, 3):
            x = _unit(t.column("vector").slice(a, b - a).combine_chunks())
            u, v = np.nonzero(block[a:b] == i[a])[0], np.nonzero(block[a:b] == j[a])[0]
            for part, other, near in _tiles(u, v, x, i[a] == j[a], threshold):
                links[a + part] += near @ copies[a + other]
                links[a + other] += near.T @ copies[a + part]
        yield pa.RecordBatch.from_arrays([t.column("rid").combine_chunks(), pa.array(links)], names=["rid", "links"])


def _against(rows: DataFrame) -> DataFrame:
    """A row for each pair of blocks (i, j) that the row's block is in, of as many `blocks` as it has."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, vector) to (id, row, local, vector): equal vectors of a task name its first row; only that keeps the vector."""
    first: dict[bytes, int] = {}
    for b in batches:
        vectors, rows = b.column(2), b.column(1).to_pylist()
        values = vectors.values.to_numpy(zero_copy_only=False)
        offsets = vectors.offsets.to_numpy()
        local = []
        for row, valid, start, end in zip(rows, vectors.is_valid().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            local.append(first.setdefault(hashlib.blake2b(values[start:end].tobytes(), digest_size=16).digest(), row) if valid else None)
        local = pa.array(local, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), local, pc.if_else(pc.fill_null(pc.equal(local, b.column(1)), False), vectors, pa.scalar(None, vectors.type))], names=["id", "row", "local", "vector"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = 1e-4, seed: int = 5) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    n = partitions(spark)
    # single-precision vectors are stored and moved as they are, and widened where they are compared
    kind = "float" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull) else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    read = store(vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.when(F.coalesce(finite, F.lit(False)), v).alias("vector")))
    rows = store(read.mapInArrow(_collapsed, f"id long, row long, local long, vector array<{kind}>"))
    # identical vectors: the row of the smallest id stands for them
    least = F.coalesce("id", F.lit((1 << 63) - 1))
    counted = rows.where("local IS NOT NULL").groupBy("local").agg(F.count(F.lit(1)).alias("copies"), F.min(least).alias("least"), F.min("id").alias("min_id"))
    heads = rows.where("vector IS NOT NULL").select("local", "vector").join(counted, "local")
    same = heads.groupBy("vector").agg(F.min(F.struct("least", "local")).alias("best"), F.sum("copies").alias("copies"), F.min("min_id").alias("min_id"), F.collect_list("local").alias("locals"))
    whole = store(same.select(F.col("best.local").alias("rid"), "min_id", "copies", F.size("vector").alias("size"), "vector", "locals"))
    distinct = whole.drop("locals")
    total = distinct.count()
    found: DataFrame | None = None
    bits = _bits(distinct, total, threshold, miss, seed) if total > 1 else 0
    needed = passes_for(total, threshold, miss, bits)
    for first in range(0, needed if total > 1 else 0, TOGETHER):
        count = min(TOGETHER, needed - first)
        keyed = lambda schema, carry, f=first, c=count: distinct.select("rid", "copies", "size", "vector").mapInArrow(lambda it: _keys(it, f, c, bits, seed, carry), schema)
        at = ["pass", "size", "cell"]
        large = store(keyed("pass int, size int, cell long", False).groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
        rows_at = keyed(f"pass int, size int, cell long, rid long, copies long, vector array<{kind}>", True).join(large, at, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = _against(rows_at).select(*at, "i", "j", "block", "rid", "copies", "vector").repartition(n, *at, "i", "j").sortWithinPartitions(*at, "i", "j", "rid")
        these = store(dealt.mapInArrow(lambda it: _linked(it, threshold, bits, seed), "a long, b long, links long").groupBy("a", "b").agg(F.sum("links").alias("links")))
        found = these if found is None else found.unionByName(these)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    comp = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rid")
    comp = store(comp)
    sizes = store(comp.groupBy("component").agg(F.count(F.lit(1)).alias("members")))
    small = sizes.where(F.col("members") <= BLOCK).select("component")
    members = distinct.join(comp.join(small, "component"), "rid").withColumns({"i": F.lit(0), "j": F.lit(0), "block": F.lit(0)})
    cells = members.select("component", "i", "j", "block", "rid", "copies", "vector").repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "rid")
    inside = cells.mapInArrow(lambda it: _counts(it, threshold), "rid long, links long")
    across = found.where("b IS NULL").select(F.col("a").alias("rid"), "links").join(comp.join(sizes.where(F.col("members") > BLOCK), "component").select("rid"), "rid")
    linked = inside.unionByName(across).groupBy("rid").agg(F.sum("links").alias("links"))
    ids = whole.drop("vector")
    least = ids.join(comp, "rid").groupBy("component").agg(F.min("min_id").alias("component_min"))
    of = comp.join(least, "component").select("rid", "component_min")
    settled = ids.join(linked, "rid", "left").join(of, "rid", "left")
    settled = settled.select(F.explode("locals").alias("local"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_min", "min_id").alias("component_id"))
    out = rows.where("local IS NOT NULL").select("id", "local").join(settled, "local").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("local IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs and reachability: for small tables of finite vectors.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT e.j, r.c FROM r JOIN e ON e.i = r.n),
l AS (SELECT i, count(*) AS n_links FROM e GROUP BY 1)
SELECT vec_id, coalesce(any_value(n_links), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM v JOIN r ON n = vec_id LEFT JOIN l ON i = vec_id GROUP BY vec_id
"""
