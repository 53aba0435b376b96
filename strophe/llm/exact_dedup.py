"""Exact dedup by distributed MSD radix partitioning.

Texts are equal when they are identical after each run of ASCII white space has become one space;
null counts as the empty text. Documents are split by successive bytes, from the front:

1. within each task, a radix recursion over bounded buffers collapses copies, so that a text that a
   third of all rows share leaves a task once per buffer and no group is ever gathered;
2. over the cluster, one sum of bytes by the leading digit shows which prefixes hold more than a leaf
   may; only those are split by the next, four times longer digit, until every leaf is small or its
   texts have ended. A leaf's bound is fixed, and grows only where the list of prefixes that are split
   would pass MAX_NODES, so neither a task's memory nor the driver's list follows the data;
3. documents with the same leaf meet in one partition, where the recursion goes on byte by byte to
   the end of the texts. No digest decides equality; a hash of the leaf only picks the partition.

Results for special cases: empty and null texts are one group; repeated rows (same id, same text)
stay separate rows of one group, of which one is kept; a null id is never smaller than another;
an empty table gives an empty result; extra columns may have any names that don't begin with
`__strophe`; very long texts differ or equal by their whole length.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm.common import partitions, squeezed, store

#: Bytes of the first digit of the distributed split; each further digit is four times as long.
FIRST_DIGIT = 64
#: Bytes of text that a task holds before it collapses copies and lets the rest go.
BUFFER_BYTES = 32 << 20
#: Bytes of text that a leaf holds; prefixes of one level that the driver lists (8 bytes each).
LEAF_BYTES, MAX_NODES = 32 << 20, 1_000_000
RID, REP, ROWS, NODE, SIZE = "__strophe_rid", "__strophe_rep", "__strophe_rows", "__strophe_node", "__strophe_size"
_LAST = 1 << 63


def radix_groups(bodies: list[bytes], at: int = 0, digit: int = 16) -> Iterator[list[int]]:
    """Groups of equal byte strings: split by successive digits until single or ended."""
    open_groups = [(list(range(len(bodies))), at, digit)]
    while open_groups:
        group, pos, width = open_groups.pop()
        if len(group) == 1:
            yield group
            continue
        parts: dict[bytes, list[int]] = defaultdict(list)
        for i in group:
            parts[bodies[i][pos : pos + width]].append(i)
        for piece, members in parts.items():
            if len(members) == 1 or len(piece) < width:  # single, or all have ended within the digit
                yield members
            else:
                open_groups.append((members, pos + width, min(4 * width, 1 << 16)))


def _level(depth: int) -> tuple[int, int]:
    """First byte and width of the digit at a depth of the distributed split."""
    width = FIRST_DIGIT * 4**depth
    return (width - FIRST_DIGIT) // 3, width


def _collapse(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Input rows with RID, the row of the same task's buffer that stands for them, its group's size, first digit and bytes."""
    key = TaskContext.get().partitionId() << 36
    held: list[pa.RecordBatch] = []
    bodies: list[bytes] = []
    size = 0

    def flush():
        nonlocal key, held, bodies, size
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column(id_col).to_pylist()
        n = len(ids)
        rep, rows = [0] * n, [0] * n
        for group in radix_groups(bodies):
            best = min(group, key=lambda i: (_LAST if ids[i] is None else ids[i], i))
            for i in group:
                rep[i] = key + best
            rows[best] = len(group)
        cols = []
        for name in names:
            c = table.column(name)
            if name == text_col:  # only the row that stands for its copies goes on with its text
                c = pa.array([t if r else None for t, r in zip(c.to_pylist(), rows, strict=True)], type=c.type)
            cols.append(c)
        cols += [pa.array(c, pa.int64()) for c in (range(key, key + n), rep, rows, [_node(b, 0, 0) for b in bodies], map(len, bodies))]
        out = pa.Table.from_arrays(cols, schema=schema)
        key, held, bodies, size = key + n, [], [], 0
        return out.to_batches(max_chunksize=4096)

    for batch in batches:
        start = 0
        for i, text in enumerate(batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
            bodies.append(b := squeezed(text))
            size += len(b) + 64
            if size > BUFFER_BYTES:
                held.append(batch.slice(start, i + 1 - start))
                start = i + 1
                yield from flush()
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield from flush()


def _node(body: bytes, depth: int, parent: int) -> int:
    """The trie node of a body's prefix up to the digit at a depth, below the node of the digits before."""
    first, width = _level(depth)
    return xxhash.xxh64_intdigest(body[first : first + width], seed=parent % (1 << 64)) - _LAST


def _leaf(body: bytes, heavy: list[set[int]]) -> int:
    """The node at which a body stops: the first that isn't heavy, or in which it has ended."""
    node, depth = _node(body, 0, 0), 0
    while depth < len(heavy) and node in heavy[depth] and len(body) > sum(_level(depth)):
        depth += 1
        node = _node(body, depth, node)
    return node


def _heavy(reps: DataFrame, text_col: str, leaf_bytes: int) -> list[list[int]]:
    """For each depth the nodes that hold more bytes than a leaf may, of texts that go on after the digit."""
    total = reps.agg(F.sum(SIZE)).first()[0] or 0
    most = max(leaf_bytes, total // MAX_NODES)
    heavy: list[list[int]] = []
    at = reps.select(F.col(NODE).alias("node"), F.col(SIZE).alias("size"))
    while True:
        sums = at.where(F.col("size") > sum(_level(len(heavy)))).groupBy("node").agg(F.sum("size").alias("bytes"))
        found = [r.node for r in sums.where(F.col("bytes") > most).select("node").collect()]  # MAX_NODES at most
        if not found:
            return heavy
        heavy.append(found)
        first = F.broadcast(reps.sparkSession.createDataFrame([(x,) for x in heavy[0]], f"{NODE} long"))  # MAX_NODES at most
        deeper = reps.select(NODE, text_col).join(first, NODE, "left_semi").select(text_col)
        at = deeper.mapInArrow(lambda it, h=list(heavy): _nodes(it, h), "node long, size long")


def _nodes(batches: Iterator[pa.RecordBatch], heavy: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Texts to their nodes one level below the heavy ones, without those that stop above."""
    sets = [set(x) for x in heavy]
    for b in batches:
        node, size = [], []
        for t in b.column(0).to_pylist():
            body, depth = squeezed(t), 0
            x = _node(body, 0, 0)
            while depth < len(sets) and x in sets[depth] and len(body) > sum(_level(depth)):
                depth += 1
                x = _node(body, depth, x)
            if depth == len(sets):
                node.append(x)
                size.append(len(body))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int64())], names=["node", "size"])


def _placed(batches: Iterator[pa.RecordBatch], levels: list[list[int]]) -> Iterator[pa.RecordBatch]:
    levels = [set(x) for x in levels]
    for b in batches:
        bodies = [squeezed(t) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bodies, pa.binary()), pa.array([_leaf(x, levels) for x in bodies], pa.int64())], schema=_PLACED)


_PLACED = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("rows", pa.int64()), ("body", pa.binary()), ("leaf", pa.int64())])
_GROUP = pa.schema([(REP, pa.int64()), ("keep_rid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, sorted by leaf, to one row for each: the group's kept row, its size and digest.

    The bodies of a run of leaves are held until they pass the buffer; then copies are folded, so that
    what stays is the distinct texts of the leaf at hand.
    """
    bodies: list[bytes] = []
    members: list[list[tuple[int, int | None, int]]] = []
    size, leaf = 0, None

    def fold():
        nonlocal bodies, members, size
        b, m = [], []
        for g in radix_groups(bodies):
            b.append(bodies[g[0]])
            m.append([x for i in g for x in members[i]])
        bodies, members, size = b, m, sum(map(len, b)) + 64 * len(b)

    def out():
        fold()
        rows = []
        for b, group in zip(bodies, members, strict=True):
            best = min(group, key=lambda x: (_LAST if x[1] is None else x[1], x[0]))
            n, digest = sum(x[2] for x in group), hashlib.sha256(b).hexdigest()
            rows += [(x[0], best[0], best[1], n, digest) for x in group]
        bodies.clear()
        members.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _GROUP, strict=True)], schema=_GROUP)

    limit = BUFFER_BYTES
    for batch in batches:
        for rid, key, rows, body, where in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if size > limit:
                if where != leaf:
                    yield out()
                    size, limit = 0, BUFFER_BYTES
                else:
                    fold()
                    limit = max(BUFFER_BYTES, 2 * size)
            leaf = where
            bodies.append(body)
            members.append([(rid, key, rows)])
            size += len(body) + 64
    if bodies:
        yield out()


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with RID and REP (a stored table), and for each REP its group's kept row, id, size and digest."""
    spark = docs.sparkSession
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in (RID, REP, ROWS, NODE, SIZE))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    rows = store(docs.mapInArrow(lambda it: _collapse(it, id_col, text_col, names, arrow), schema))
    n = partitions(spark)
    reps = rows.where(F.col(ROWS) > 0)
    levels = spark.sparkContext.broadcast(_heavy(reps, text_col, LEAF_BYTES))
    placed = reps.select(RID, F.col(id_col).cast("long").alias("id"), ROWS, F.col(text_col)).mapInArrow(lambda it: _placed(it, levels.value), "rid long, id long, rows long, body binary, leaf long")
    groups = placed.repartition(n, "leaf").sortWithinPartitions("leaf").mapInArrow(_settle, f"{REP} long, keep_rid long, keep_id long, group_size long, text_sha256 string")
    return rows, groups


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows, groups = _groups(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col)
    return rows.select(id_col, RID, REP).join(groups, REP).select(id_col, "keep_id", "group_size", (F.col(RID) == F.col("keep_rid")).alias("kept"), "text_sha256")


def exact_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each group the one with the smallest id."""
    rows, groups = _groups(docs, id_col, text_col)
    # ids are stored before they meet texts, so that the planner knows how many bytes it would broadcast
    gone = store(groups.where(F.col(REP) != F.col("keep_rid")).select(F.col(REP).alias(RID)))
    return rows.where(F.col(RID) == F.col(REP)).join(gone, RID, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
