import hashlib
import random
import zlib

import pytest

from strophe.llm import merkle
from strophe.llm.common import crc_mod, store
from strophe.llm.ranks import long_digits, radix_ranks, text_digits

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    for h in tree[:-1]:
        a = i // 16 * 16
        yield "".join(h[a:i]), "".join(h[i + 1 : a + 16])
        i //= 16


def plain(rows):
    """Rows (of FIELDS) to sorted results, by trees in memory."""
    lower = {c: c + 32 for c in range(65, 91)}
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    for rs in by.values():
        rs.sort(key=lambda x: x[:3])
    trees = {s: levels([x[2] for x in rs]) for s, rs in by.items()}
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in names])
    root, out = top[-1][0] if rows else "", []
    for s, rs in by.items():
        for i, (_, _, leaf, r) in enumerate(rs):
            sides = [*path(trees[s], i), *path(top, names.index(s))]
            proof = H(*(a + b for a, b in sides))
            folded = leaf
            if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0:
                folded = leaf_of((*r[:4], r[4] if r[4] is None else r[4].translate(lower)))
            for a, b in sides:
                folded = H(a, folded, b)
            out.append((r[0], leaf, trees[s][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def made(docs):
    from pyspark.sql import functions as F

    changed = {"text": F.translate("text", merkle._UPPER, merkle._LOWER)}
    return sorted((tuple(r) for r in merkle.manifest(docs, FIELDS, changed=changed, changes=crc_mod("doc_id", 5) == 0).collect()), key=str)


@pytest.mark.parametrize("n", [1, 17, 257, 700])
def test_manifest_equals_trees_in_memory(spark, n):
    """Groups of many sizes, null ids, sources and texts, repeated ids and rows, sources that are prefixes of others."""
    rnd = random.Random(n)
    rows = [(rnd.choice([i, i, i, -i * (1 << 40), 5, None]), rnd.choice(["a", "a", "a", "ab", "", None, "é"]), rnd.choice(["en", None]), rnd.choice([i, None]), rnd.choice([None, "", "Ab\nC", f"T{i}", "É" * 3000])) for i in range(n)]
    rows += rows[: n // 4]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = made(docs)
    assert [r[:4] for r in got] == [r[:4] for r in plain(rows)] and got == plain(rows)


def test_one_group_over_several_blocks(spark, monkeypatch):
    """Blocks of 16 leaves, buckets of 4: the trie has several levels of blocks."""
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(radix_ranks, "__defaults__", ("rank", "total", 4, 1))
    rows = [(i * i * 7 - 50, "a" if i % 3 else "b", "en", i, f"Text {i}") for i in range(300)] + [(9, "a", "en", 1, f"same id {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert made(docs) == plain(rows)


def test_manifest_of_no_rows_and_other_columns(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, grp string, hash string, n long, row long, rank long"
    docs = spark.createDataFrame([(1, "a", "b", 2, "C", "x", "y", 1, 2, 3)], schema)
    assert made(docs) == plain([(1, "a", "b", 2, "C")])
    assert made(docs.limit(0)) == []


@pytest.mark.parametrize(("bucket", "digits"), [(4096, 3), (5, 1), (3, 2), (1, 3)])
def test_ranks_equal_a_sort(spark, bucket, digits):
    """A third of rows in one group, most of them with keys that begin alike; nulls; one key long beyond the rest."""
    rnd = random.Random(bucket)
    rows = [(rnd.choice("aaabcdefg"), rnd.choice([i, 7, 7, None, -i, 1 << 62]), rnd.choice(["x", "xy", None, "", "long" * 60]), i) for i in range(400)]
    df = store(spark.createDataFrame(rows, "g string, v long, s string, row long").repartition(4))
    from pyspark.sql import functions as F

    key = F.concat(long_digits(F.col("v")), text_digits(F.col("s")), F.lit("!"), long_digits(F.col("row")))
    got = {r.row: (r["rank"], r.total) for r in radix_ranks(df, "g", key, bucket=bucket, digits=digits).collect()}
    for g in "abcdefg":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), r[3]))
        assert [got[r[3]] for r in mine] == [(i, len(mine)) for i in range(len(mine))]


def test_query_equals_trees_in_memory(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    got = merkle.query(spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
