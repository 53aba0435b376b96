import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strophe.operators import dedup, similarity, vocab


def texts(n):
    r = random.Random(6)
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randrange(0, 30))] + [r.choice(rare) for _ in range(r.randrange(1, 40))]
        rows.append((i, " ".join(words)))
        if i % 5 == 0:
            words[r.randrange(len(words))] = "changed"
            rows += [(1000 + i, " ".join(words)), (2000 + i, rows[-1][1])]
    return [*rows, (9000, None), (9001, ""), (9002, "the of"), (9003, " \n")]


def plain(rows, threshold):
    counts = {i: Counter(w for w in re.split(r"[ \t\n\v\f\r]+", (t or "").lower()) if w) for i, t in rows}
    counts = {i: c for i, c in counts.items() if c}
    df = Counter(w for c in counts.values() for w in c)
    vectors = {}
    for i, c in counts.items():
        v = {w: n * math.log(len(counts) / df[w]) for w, n in c.items() if df[w] < len(counts)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {w: x / norm for w, x in v.items()}
    return {(i, j): s for i in vectors for j in vectors if i < j and (s := sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items())) > threshold}


@pytest.mark.parametrize("block", [4, similarity.BLOCK])
@pytest.mark.parametrize("threshold", [0.3, 0.85])
def test_pairs_equal_all_pairs(spark, block, threshold):
    """Copies, near copies, texts without words; words of many vectors in blocks. Few pairs are compared."""
    rows = texts(120)
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    vectors = similarity.word_vectors(similarity.word_counts(df, "id", F.col("text"))).cache()
    want = plain(rows, threshold)
    got = {(r.i, r.j): r.cos for r in similarity.similar_pairs(vectors, threshold, block).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 60
    n = vectors.count()
    if threshold > 0.5:
        assert similarity.candidates(vectors, threshold, block).count() < n * (n - 1) / 20


def test_few_shared_words_are_not_compared(spark):
    r = random.Random(8)
    rows = [(i, " ".join([*(["shared"] if i < 80 else []), *r.sample([f"w{k}" for k in range(150)], 40)])) for i in range(400)]
    vectors = similarity.word_vectors(similarity.word_counts(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"))).cache()
    assert similarity.candidates(vectors, 0.8).count() < 400 * 399 / 2 / 10 and similarity.similar_pairs(vectors, 0.8).count() == len(plain(rows, 0.8))


def test_first_kept_never_makes_pairs_of_copies(spark, monkeypatch):
    """The kept set of a plain walk over all pairs; edges are those of different vectors only."""
    rows = [x for x in texts(40) if x[1]] + [(5000 + k, f"copy of one text {k % 2}") for k in range(60)]
    pairs, kept = plain(rows, 0.6), []
    for i in sorted(i for i, _ in rows):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    asked, keep = [], dedup.greedy_keep
    monkeypatch.setattr(dedup, "greedy_keep", lambda nodes, edges, *a, **b: asked.append(edges.count()) or keep(nodes, edges, *a, **b))
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    gone = {x.id for x in similarity.first_kept(similarity.word_vectors(similarity.word_counts(df, "id", F.col("text"))), 0.6).collect()}
    assert sorted({i for i, _ in rows} - gone) == kept and asked[0] < len(pairs) - 600


@pytest.mark.parametrize("step", [9, 40])
def test_first_kept_by_steps(spark, step, monkeypatch):
    """Steps in order of the ids keep what a walk over all pairs keeps, and none makes the pairs of all vectors."""
    rows = [x for x in texts(40) if x[1]] + [(5000 + k, f"copy of one text {k % 2}") for k in range(30)]
    pairs, kept = plain(rows, 0.5), []
    for i in sorted(i for i, _ in rows):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    asked, keep = [], dedup.greedy_keep
    monkeypatch.setattr(dedup, "greedy_keep", lambda nodes, edges, *a, **b: asked.append((nodes.count(), edges.count())) or keep(nodes, edges, *a, **b))
    vectors = similarity.word_vectors(similarity.word_counts(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text")))
    gone = {x.id for x in similarity.first_kept(vectors, 0.5, step).collect()}
    assert sorted({i for i, _ in rows} - gone) == kept and len(asked) > 1 and max(n for n, _ in asked) < 2 * step


@pytest.mark.parametrize("rows", [5, 1000])
def test_pairs_are_neither_shuffled_nor_stored(spark, rows, monkeypatch):
    """Similar vectors' copies become pairs in the task that compares them, a bounded number at a time."""
    monkeypatch.setattr(similarity, "ROWS", rows)
    said = [(i, " ".join([*(f"w{k}" for k in range(30)), "x" if i % 2 else "y"])) for i in range(20)] + [(100 + i, f"other {i}") for i in range(9)]
    vectors = similarity.word_vectors(similarity.word_counts(spark.createDataFrame(said, "id long, text string"), "id", F.col("text")))
    got = similarity.similar_pairs(vectors, 0.5)
    want = plain(said, 0.5)
    found = [(r.i, r.j) for r in got.collect()]
    assert sorted(found) == sorted(want) and len(want) == 190
    assert "i#" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_no_texts(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert similarity.similar_pairs(similarity.word_vectors(similarity.word_counts(none, "id", F.col("text"))), 0.5).count() == 0


def test_special_tokens_are_found_first_and_longest():
    r = random.Random(5)
    for _ in range(500):
        tokens = {"".join(r.choice("ab[]") for _ in range(r.randrange(1, 5))): i for i in range(r.randrange(1, 6))}
        text = "".join(r.choice("ab[]c") for _ in range(r.randrange(0, 30)))
        pattern = re.compile("|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True)))
        want, at = [], 0
        for m in pattern.finditer(text):
            want.append((text[at : m.start()], m.group()))
            at = m.end()
        assert list(vocab.Specials(tokens).parts(text)) == [*want, (text[at:], None)]
    assert list(vocab.Specials({}).parts("ab")) == [("ab", None)]


def test_byte_encoder_round_trips(spark):
    import public_tokenizers as public

    load = vocab.byte_encoder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, {"[verse]": 50_300, "[verse][x]": 50_301})
    rows = [(1, "a [verse]b[verse][x] c"), (2, None), (3, ""), (4, "é中😀 [vers [verse"), (5, "long " * 50_000)]
    got = spark.createDataFrame(rows, "i long, t string").withColumn("ids", vocab.byte_ids(F.col("t"), load)).withColumn("back", vocab.byte_text(F.col("ids"), load)).withColumn("spaced", vocab.byte_text(F.col("ids"), load, spaced=True)).collect()
    by = {r.i: r for r in got}
    assert all(by[i].back == (t or "") for i, t in rows) and [x for x in by[1].ids if x >= 50_300] == [50_300, 50_301]
    assert by[1].spaced == "a  [verse] b [verse][x]  c" and by[2].ids == [] and by[4].ids and by[4].spaced == rows[3][1]
    assert load().decode(load().encode("[verse][x]")[:0]) == ""
    with pytest.raises(ValueError, match="id of another"):
        vocab.byte_encoder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, {"[x]": 7})()


def test_only_a_piece_of_a_batch_is_python_objects():
    batches = [pa.array([str(i) for i in range(n)]) for n in (1, 0, 10_000)]
    pieces = list(vocab._pieces(iter(batches)))
    assert max(map(len, pieces)) <= vocab.PIECE and [x for p in pieces for x in p] == [x for b in batches for x in b.to_pylist()]


def test_greedy_by_steps_equals_a_walk(spark):
    """Also over many steps and blocks; edges of all vectors at once are never asked for."""
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in r.sample(range(10_000), 400)]
    unit = {i: [a / math.sqrt(sum(b * b for b in x)) for a in x] for i, x in rows}
    kept = []
    for i in sorted(unit):
        if not any(sum(a * b for a, b in zip(unit[i], unit[j], strict=True)) > 0.7 for j in kept):
            kept.append(i)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(x.vec_id for x in dedup.greedy_similar(df, 0.7, step=90).collect()) == kept
    assert sorted(x.vec_id for x in dedup.greedy_similar(df, 0.7).collect()) == kept
    edges = [sorted((e.i, e.j) for e in dedup.similarity_edges(df, 0.7, block=b).collect()) for b in (None, 64)]
    assert edges[0] == edges[1] and len(set(edges[0])) == len(edges[0])


def test_a_piece_of_long_rows_is_bounded_in_bytes():
    """Rows of very different lengths, texts and lists: a piece has a megabyte at most unless it is one row."""
    texts = [("x" * n) for n in (0, 300_000, 5, 3_000_000, 400_000, 400_000, 400_000, 1) * 20]
    for rows in (pa.array(texts), pa.array([[len(t)] * (len(t) // 10) for t in texts], pa.list_(pa.int32())), pa.array([["[verse]", t] for t in texts])):
        for at in (0, 7):  # a slice's bytes are its own, not its buffers'
            pieces = list(vocab._pieces(iter([rows.slice(at)])))
            assert [x for p in pieces for x in p] == rows.slice(at).to_pylist()
            assert all(len(p) == 1 or pa.array(p, rows.type).nbytes <= vocab.PIECE_BYTES for p in pieces)


def test_line_ids_of_odd_lines(spark):
    """Null lines have no ids, a null line is an empty one; only spaces around a line go; a marked line with spaces is plain text."""
    cases = [(None, None), ([], []), ([None], [511]), (["  "], [511]), ([" ab "], [97, 98, 511]), (["\ta"], [9, 97, 511]), (["[stop]", "[end]"], [511, 511, 501, 511]), ([" [end]"], [*map(ord, "[end]"), 511])]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i long, lines array<string>")
    got = df.withColumn("ids", vocab.line_ids(F.col("lines"), lambda: lambda text: [*map(ord, text)])).collect()
    assert {r.i: r.ids for r in got} == {i: ids for i, (_, ids) in enumerate(cases)}


def test_line_ids_over_pieces(spark):
    """Lines of more rows than a piece holds, and rows without lines or with empty ones, in bounded pieces."""
    rows = [(i, ["[verse]", "a" * (i % 5), "[space]"] if i % 7 else []) for i in range(300)]

    def load():
        return lambda text: [1] * len(text)

    got = spark.createDataFrame(rows, "i long, lines array<string>").coalesce(1).withColumn("ids", vocab.line_ids(F.col("lines"), load)).collect()
    assert {r.i: r.ids for r in got} == {i: [503, 511, *[1] * (i % 5), 511, 512, 511] if i % 7 else [] for i, _ in rows}
