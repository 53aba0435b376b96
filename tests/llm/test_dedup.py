import hashlib
import random
import re

import numpy as np
import pytest

from strophe.llm import embedding_dedup, exact_dedup, minhash_dedup
from strophe.llm.components import connected_components
from strophe.llm.embedding_dedup import near_vectors, passes_for

SCHEMA = "doc_id long, text string, lang string, rid long, leaf string, size double, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "x", 1.0, 2) for i, t in rows], SCHEMA).repartition(3)


def corpus():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([2, 5, 60, 90]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, rows[3][1].replace(" ", "\n ")), (3, rows[3][1]), (None, rows[5][1]), (None, "lonely null")]
    rows += [(1000 + i, "boiler plate " * 40 + f"tail {i % 7}") for i in range(60)]
    rows += [(2000, "very long " * 60_000), (2001, "very long " * 60_000), (2002, "very long " * 60_000 + "x")]
    return rows


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_radix_groups_by_equality():
    r = random.Random(1)
    bodies = [bytes(r.choice([97, 98]) for _ in range(r.choice([0, 3, 15, 16, 17, 80]))) for _ in range(300)] * 2
    got = sorted(sorted(g) for g in exact_dedup.radix_groups(bodies))
    want = {}
    for i, b in enumerate(bodies):
        want.setdefault(b, []).append(i)
    assert got == sorted(want.values())


@pytest.mark.parametrize("buffer", [200, exact_dedup.BUFFER_BYTES])
def test_exact_dedup(spark, monkeypatch, buffer):
    monkeypatch.setattr(exact_dedup, "BUFFER_BYTES", buffer)
    rows = corpus()
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append(i)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert len(by) == len(groups)
    for t, ids in groups.items():
        rs = by[hashlib.sha256(t.encode()).hexdigest()]
        keep = min((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in rs} == {keep} and {r.group_size for r in rs} == {len(ids)} and sum(r.kept for r in rs) == 1


def test_heavy_prefixes_are_split(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAF_BYTES", 1 << 20)
    rows = [(i, "p" * 700 + str(i % 50)) for i in range(5000)]
    # long texts under one header that differ at their ends only
    rows += [(10_000 + i, "header " * 3000 + f"{i % 900:06d}" + "tail" * 100) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = []
    heavy = exact_dedup._heavy

    def seen(*args):
        found.append(heavy(*args))
        return found[-1]

    monkeypatch.setattr(exact_dedup, "_heavy", seen)
    got = exact_dedup.exact_dedup(df).collect()
    sets, leaves = [set(x) for x in found[0]], {}
    for t in {t for _, t in rows}:
        leaves[x] = leaves.get(x := exact_dedup._leaf(t.encode(), sets), 0) + len(t)
    assert len(sets) == 4 and max(leaves.values()) <= 1 << 20
    assert sum(r.kept for r in got) == 950 and {r.group_size for r in got if r.doc_id < 10_000} == {100} and {r.group_size for r in got if r.doc_id >= 10_000} == {1, 2}


def test_exact_rows_keep_columns(spark):
    df = frame(spark, corpus())
    got = exact_dedup.exact_dedup_rows(df)
    assert got.columns == df.columns
    assert got.count() == len({squeeze(t) for _, t in corpus()}) and got.where("text is null").count() <= 1


def brute(rows, k, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 512), (5, 80, 4)])
def test_near_dedup(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = corpus()
    got = minhash_dedup.near_dedup(frame(spark, rows), k=k, percent=percent).collect()
    sets, comp = brute(rows, k, percent)
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((i if i is not None else -1, len(s), least.get(c) if least.get(c) is not None else -1) for (i, _), s, c in zip(rows, sets, comp, strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == want
    kept = minhash_dedup.near_dedup_rows(frame(spark, rows), k=k, percent=percent)
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(set(comp))


def test_odd_sketch_estimates_high_similarity():
    r = np.random.default_rng(2)
    table = minhash_dedup.similarity_by_bits()
    errors = []
    for _ in range(40):
        a = r.integers(0, 1 << 62, 600, dtype=np.uint64)
        b = np.concatenate([a[:540], r.integers(0, 1 << 62, 60, dtype=np.uint64)])
        x, y = (np.frombuffer(minhash_dedup.odd_sketch(minhash_dedup.samples(np.unique(s))), dtype=np.uint64) for s in (a, b))
        errors.append(table[int(np.bitwise_count(x ^ y).sum())] - 540 / 660)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def test_components_distributed_rounds(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(60)] + [(300, i) for i in range(301, 340)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for finish in (0, 10**6):
        got = {x.node: x.component for x in connected_components(df, finish).collect()}
        root = {}

        def find(i):
            while root.setdefault(i, i) != i:
                i = root[i]
            return i

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {x: find(x) for x in linked}


@pytest.mark.parametrize("block", [8, embedding_dedup.BLOCK])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(5)
    x = r.standard_normal((120, 16))
    x[40:60] = x[39] + 0.1 * r.standard_normal((20, 16))
    x[60:65] = x[2]
    rows = [(i, v.astype(float).tolist(), "c") for i, v in enumerate(x)]
    rows += [(500, None, "c"), (501, [0.0] * 16, "c"), (502, [float("nan")] * 16, "c"), (503, [1.0] * 15 + [None], "c"), (504, [1.0] * 8, "c")]
    got = {g.vec_id: g for g in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rid string")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = list(range(120))
    for _ in range(120):
        comp = [min([comp[i], *(comp[j] for j in np.nonzero(near[i])[0])]) for i in range(120)]
    for i in range(120):
        assert got[i].n_links == near[i].sum() and got[i].component_id == comp[i] and got[i].kept == (comp[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 505))
    assert passes_for(10**9, 0.9, 1e-3) > passes_for(10**5, 0.9, 1e-3)


def linked(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        least = np.array([min(comp[i], comp[near[i]].min(initial=comp[i])) for i in range(len(x))])
        if (least == comp).all():
            return near.sum(axis=1), comp
        comp = least


def test_near_vectors_in_a_dense_group(spark):
    """3,000 pairs at cosine 0.905 inside a group of cosine about 0.75: each is missed with 0.0001 at most."""
    r = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    n, group, pairs = 9000, 8000, 3000
    x = unit(r.standard_normal((n, 64)))
    x[:group] = unit(0.75**0.5 * x[0] + 0.25**0.5 * x[:group])
    away = r.standard_normal((pairs, 64))
    away = unit(away - (away * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    x[pairs : 2 * pairs] = 0.905 * x[:pairs] + (1 - 0.905**2) ** 0.5 * away
    links, comp = linked(x)
    assert (links[:pairs] >= 1).all()
    got = {g.vec_id: g for g in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)).collect()}
    wrong = [i for i in range(n) if (got[i].n_links, got[i].component_id, got[i].kept) != (links[i], comp[i], comp[i] == i)]
    assert len(wrong) <= 4, len(wrong)


def test_vectors_of_extreme_size_repeated_ids_and_the_threshold(spark):
    """Magnitudes whose squares over- or underflow, denormals; a cosine of exactly the threshold; ids that repeat."""
    base = [1.0, 2.0, -1.0, 0.5]
    far = [-2.0, 1.0, 1.0, 2.0]  # at right angles to base
    rows = [(i, [x * size for x in base]) for i, size in enumerate((1.0, 1e200, 1e-200, 1e308 / 2, 2.0**-1070))]
    rows += [(10, [x * 1e-200 for x in far]), (11, [x * 1e200 for x in far]), (12, [3.0, 4.0, 0.0, 0.0]), (13, [1.0, 0.0, 0.0, 0.0]), (13, [0.0, 0.0, 0.0, 7e-310]), (13, [0.0, 0.0, 0.0, 7e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((g.vec_id, g.n_links, g.component_id, g.kept) for g in near_vectors(df).collect())
    assert got == sorted([(i, 4, 0, i == 0) for i in range(5)] + [(10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True), (13, 0, 13, True), (13, 1, 13, True), (13, 1, 13, True)])
    same = {g.vec_id: g.n_links for g in near_vectors(df.where("vec_id IN (12, 13)"), threshold=0.6).collect()}
    assert same[12] == 1  # 3/5 against (1, 0, 0, 0) is the threshold itself


@pytest.mark.parametrize("block", [64, embedding_dedup.BLOCK])
def test_a_shared_vector_and_a_chain(spark, monkeypatch, block):
    """A third of the rows are one vector; a chain of neighbours is one component; links come from the cells or the component."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    turn = np.arange(900) * 0.2
    plane = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    x = np.concatenate([np.c_[plane * 0.6, np.outer(np.ones(900), [0.8]), turn[:, None] * 0.08], np.tile([[0.0, 0.0, -1.0, 0.0]], (450, 1))])
    links, comp = linked(x)
    assert np.bincount(comp).max() > 128
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {g.vec_id: g for g in near_vectors(df, miss=1e-9).collect()}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(x))] == [(links[i], comp[i], comp[i] == i) for i in range(len(x))]


@pytest.mark.parametrize("f", [lambda d: exact_dedup.exact_dedup(d), lambda d: exact_dedup.exact_dedup_rows(d), lambda d: minhash_dedup.near_dedup(d), lambda d: minhash_dedup.near_dedup_rows(d)])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
