"""Merkle manifest of a dataset: a trie over radix ranks for each group, and one over the groups' roots.

A row's leaf is the digest of its fields. Leaves of a group (source) are ranked by id with digit histograms
(`ranks.radix_ranks`), with no sort over all rows. A rank's digits in the base of the fanout are the row's
key in the trie: nodes that share all digits but the last are one run, and the digest of the run stands for
their common prefix. Prefixes of three digits less are reduced at a time, so a block is at most fanout ** 3
nodes, however large a group is, and each step leaves a 4096th of the nodes. On the way down each block
gets the siblings above it, and each row its proof.

Special cases: a null field counts as `-`; null ids come first; rows of equal ids go by leaf, equal rows in
any order, each with a place of its own; a null source is a group of its own and comes first; an empty
text is a value of length 0; texts count whole; an empty table gives no rows. Extra columns, whatever their
names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import crc_mod, store
from strophe.llm.lm_scoring import _CRC as CRC
from strophe.llm.ranks import long_digits, radix_ranks, text_digits

FANOUT = 16
#: Digits of a rank that one block covers.
DIGITS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _above(c: Column, levels: int = 1) -> Column:
    """Nodes left of c after some levels of runs."""
    for _ in range(levels):
        c = F.floor((c + (FANOUT - 1)) / FANOUT).cast("long")
    return c


def _runs(h: Column, n: Column) -> Column:
    """Digests of the runs of h, nodes of one block; n nodes are left in the whole group at this level."""
    run = lambda i: F.sha2(F.array_join(F.slice(h, i * FANOUT + 1, F.lit(FANOUT)), ""), 256)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / FANOUT).cast("int")), run)).otherwise(h)


def _hashed(blocks: DataFrame) -> DataFrame:
    """Digests of the block's nodes at each level, h0 to the one prefix left."""
    out = blocks.withColumn("h0", F.transform("nodes", lambda x: x["hash"]))
    for level in range(DIGITS):
        out = out.withColumn(f"h{level + 1}", _runs(F.col(f"h{level}"), _above(F.col("n"), level)))
    return out


def _siblings(h: Column, i: Column) -> Column:
    """Digests left and right of node i in its run."""
    first = F.floor(i / FANOUT).cast("int") * FANOUT
    side = lambda start, size: F.array_join(F.slice(h, start, size), "")
    return F.struct(side(first + 1, i - first).alias("left"), side(i + 2, first + (FANOUT - 1) - i).alias("right"))


def build(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Levels of blocks, lowest first, of (grp, rank, n, hash, payload); n is the group's size and `most` the largest."""
    levels = []
    while True:
        kept = [c for c in nodes.columns if c not in ("grp", "n", "rank", "hash")]
        cells = nodes.groupBy("grp", F.floor(F.col("rank") / FANOUT**DIGITS).cast("long").alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "hash", *kept))).alias("nodes"))
        levels.append(store(cells))
        if most <= FANOUT**DIGITS:
            return levels
        nodes = _hashed(levels[-1]).select("grp", F.col("block").alias("rank"), _above(F.col("n"), DIGITS).alias("n"), F.col(f"h{DIGITS}")[0].alias("hash"))
        most = -(-most // FANOUT**DIGITS)


def tops(levels: list[DataFrame]) -> DataFrame:
    """grp and the root of its trie."""
    return _hashed(levels[-1]).select("grp", F.col(f"h{DIGITS}")[0].alias("top"))


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest nodes with `path`, the siblings of each hashed level up to and with those of `above` (grp, path, columns to hand on)."""
    given = [c for c in above.columns if c not in ("grp", "path")]
    above = above.withColumn("rank", F.lit(0).cast("long"))
    for blocks in reversed(levels):
        cells = _hashed(blocks).join(above.withColumnRenamed("rank", "block"), ["grp", "block"])

        def placed(node: Column, i: Column) -> Column:
            own = []
            for level in range(DIGITS):
                at = F.floor(i / FANOUT**level).cast("int")
                own.append(F.when(_above(F.col("n"), level) > 1, F.array(_siblings(F.col(f"h{level}"), at))).otherwise(F.array().cast("array<struct<left:string,right:string>>")))
            return F.struct(node.alias("node"), F.concat(*own, F.col("path")).alias("path"))

        kept = [c for c in blocks.schema["nodes"].dataType.elementType.names if c != "rank"]
        above = cells.select("grp", *given, F.inline(F.transform("nodes", placed))).select("grp", *given, "node.rank", *(f"node.{c}" for c in kept), "path")
        if blocks is not levels[0]:
            above = above.drop("hash")
    return above


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None, changes: Column | None = None) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of `fields` in their order. Where `changes` holds, the fields named in `changed` are replaced
    before the leaf is folded with the original siblings: `verified` then says whether the change goes unseen.
    """
    spark = docs.sparkSession
    leaf = digest(*(field(F.col(c)) for c in fields))
    other = digest(*(field((changed or {}).get(c, F.col(c))) for c in fields))
    tampered = F.when(F.coalesce(changes, F.lit(False)), other) if changes is not None else F.lit(None).cast("string")
    group = text_digits(F.col(group_col).cast("string"))
    rows = store(docs.select(F.col(id_col).cast("long").alias("id"), group.alias("grp"), leaf.alias("hash"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("row")))
    key = F.concat(long_digits(F.col("id")), F.col("hash"), long_digits(F.col("row")))
    ranked = radix_ranks(rows, "grp", key, total="n").drop("row")
    most = rows.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    levels = build(ranked, most)
    # the groups' roots are nodes of a trie of their own
    groups = store(tops(levels).select(F.lit("").alias("all"), "grp", "top"))
    upper_nodes = radix_ranks(groups, "all", F.col("grp"), total="n").select(F.col("all").alias("grp"), "rank", "n", F.col("top").alias("hash"), F.col("grp").alias("of"))
    upper = build(upper_nodes, groups.count())
    root = tops(upper).first()
    none = spark.range(1).select(F.lit("").alias("grp"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = descend(upper, none).select(F.col("of").alias("grp"), F.col("hash").alias("subroot"), "path")
    out = descend(levels, above)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("tampered", "hash"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    out = out.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", F.lit(root.top if root else "").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": F.translate("text", _UPPER, _LOWER)}, changes=crc_mod("doc_id", 5) == 0)


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


#: Trees level by level, for tables whose ids aren't null.
ORACLE = f"""
WITH RECURSIVE f AS (SELECT doc_id, source, concat({', '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars')))}) AS head, {_field('text')} AS body,
  {_field(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS other, {CRC} % 5 = 0 AS hit FROM documents),
l AS (SELECT doc_id, source, sha256(head || body) AS leaf, CASE WHEN hit THEN sha256(head || other) ELSE sha256(head || body) END AS now,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM f),
t AS (SELECT source, 0 AS lvl, i, n, leaf AS h FROM l
  UNION ALL SELECT source, lvl + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, lvl, i // 16),
s AS (SELECT 0 AS lvl, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, source FROM t WHERE n = 1
  UNION ALL SELECT lvl + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)), NULL FROM s WHERE n > 1 GROUP BY lvl, i // 16),
up AS (SELECT a.source, a.h AS subroot, a.i, d.lvl FROM s a, (SELECT DISTINCT lvl FROM s WHERE n > 1) d WHERE a.lvl = 0),
p AS (SELECT l.source, l.i, t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < l.i // (16 ** t.lvl)::BIGINT), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > l.i // (16 ** t.lvl)::BIGINT), '') AS b
    FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source AND t.n > 1 AND t.i // 16 = l.i // (16 ** (t.lvl + 1))::BIGINT GROUP BY ALL),
q AS (SELECT up.source, up.lvl, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < up.i // (16 ** s.lvl)::BIGINT), '') AS a, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > up.i // (16 ** s.lvl)::BIGINT), '') AS b
    FROM up JOIN s ON s.lvl = up.lvl AND s.i // 16 = up.i // (16 ** (s.lvl + 1))::BIGINT GROUP BY up.source, up.lvl),
w AS (SELECT source, i, lvl, a, b FROM p UNION ALL SELECT l.source, l.i, 100 + q.lvl, q.a, q.b FROM l JOIN q ON l.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source, i ORDER BY lvl) AS step FROM w),
z AS (SELECT source, i, 0 AS step, now AS h FROM l UNION ALL SELECT k.source, k.i, k.step, sha256(k.a || z.h || k.b) FROM z JOIN k ON k.source IS NOT DISTINCT FROM z.source AND k.i = z.i AND k.step = z.step + 1),
e AS (SELECT source, i, arg_max(h, step) AS folded_root FROM z GROUP BY ALL),
g AS (SELECT source, i, string_agg(a || b, '' ORDER BY step) AS sides FROM k GROUP BY ALL),
r AS (SELECT h AS root FROM s WHERE n = 1)
SELECT doc_id, leaf, up.subroot, root, sha256(coalesce(sides, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l CROSS JOIN r JOIN (SELECT source, h AS subroot FROM s WHERE lvl = 0) up ON up.source IS NOT DISTINCT FROM l.source
JOIN e ON e.source IS NOT DISTINCT FROM l.source AND e.i = l.i LEFT JOIN g ON g.source IS NOT DISTINCT FROM l.source AND g.i = l.i
"""
