import collections
import random

import pytest
from pyspark.sql import functions as F

from strophe.llm import mixing, packing
from strophe.llm.tokens import with_token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt int, rank string, t int, piece int"


def docs(spark, n=300):
    r = random.Random(2)
    rows = [(i, "word " * r.choice([0, 1, 3, 40, 400]) + f"n{i}", r.choice(["en", "en", "de", None]), r.choice(["src0"] * 6 + ["src1", "src2", "src7", None]), 1, 2, "x", 3, 4) for i in range(n)]
    rows += [(1000, None, "en", "src1", 0, 2, "x", 3, 4), (1001, "", "de", "src2", 0, 2, "x", 3, 4), (5, "again", "en", "src0", 0, 2, "x", 3, 4), (None, "null id", "en", "src0", 0, 2, "x", 3, 4)]
    rows += [(2000, "long text " * 9000, "en", "src0", 0, 2, "x", 3, 4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_best_fit(lengths, sizes, overhead):
    left = collections.Counter(lengths)
    bins = []
    for length in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] - b[1] >= length]
        if fit:
            b = min(fit, key=lambda b: (b[0] - b[1], b[0]))
        else:
            n = left[length]
            b = [min((s for s in sizes if s >= length), key=lambda s: ((s + overhead) / (min(s // length, n) * length), s)), 0]
            bins.append(b)
        b[1] += length
        left[length] -= 1
    return collections.Counter(min(s for s in sizes if s >= used) for _, used in bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_packs_validly_and_as_piece_by_piece(seed):
    r = random.Random(seed)
    sizes = r.choice([[16, 32, 64], [64], [10, 64], [7, 30, 33, 64]])
    lengths = [min(64, r.choice([r.randint(1, 64), r.randint(1, 9), 11])) for _ in range(r.choice([1, 10, 300, 1500]))]
    plan = packing.plan_bins(collections.Counter(lengths), sizes, 2)
    used = collections.defaultdict(list)
    covered = collections.Counter()
    per = collections.Counter(lengths)
    spans = sorted(map(tuple, plan.spans))
    for i, (length, rank, each, first, offset) in enumerate(spans):
        end = spans[i + 1][1] if i + 1 < len(spans) and spans[i + 1][0] == length else per[length]
        for k in range(end - rank):
            used[first + k // each].append((offset + k % each * length, length))
            covered[length] += 1
    assert covered == per
    final = sorted(map(tuple, plan.bins))
    size_of = lambda b: next(s for first, s in reversed(final) if first <= b)
    for b, parts in used.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size_of(b) == min(s for s in sizes if s >= at)
    assert collections.Counter(size_of(b) for b in used) == plain_best_fit(lengths, sizes, 2)


def test_pack_gives_the_same_bins_however_rows_lie(spark):
    df = docs(spark)
    assert df.groupBy("doc_id").count().where("count > 1").count()
    packed = lambda d: collections.Counter(map(tuple, packing.pack(d, sizes=(64, 256, 1024)).collect()))
    want = packed(df)
    for other in (df.coalesce(1), df.repartition(7, "doc_id"), df.repartition(211), df.orderBy(F.rand(3))):
        assert packed(other) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert packed(df) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pack_places_every_token_once(spark):
    df = docs(spark)
    sizes = (128, 512, 1024)
    got = packing.pack(df, sizes=sizes).collect()
    lengths = [r.n + 1 for r in with_token_counts(df, "n").collect()]
    assert sum(g.length for g in got) == sum(lengths) and max(g.length for g in got) <= 1024
    bins = collections.defaultdict(list)
    for g in got:
        bins[g.bin_id].append((g.bin_offset, g.length, g.bin_size))
    for parts in bins.values():
        at = 0
        for offset, length, size in sorted(parts):
            assert offset == at and size in sizes and size == parts[0][2]
            at += length
        assert at <= parts[0][2]
    pieces = sorted((g.piece, g.start, g.length) for g in got if g.doc_id == 2000)
    assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(s == 1024 * p for p, s, _ in pieces)


def share_out(budget, weights, most):
    given, left = [0.0] * len(weights), budget
    open_ = [i for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit >= most[i]]
        for i in full or open_:
            given[i] = most[i] if full else weights[i] * unit
            left -= most[i] if full else 0
        open_ = [i for i in open_ if i not in full] if full else []
    return given


def plain_budgets(tokens, weights, budget, epochs):
    """Budgets by a walk down the tree, for comparison."""
    weight = lambda node: weights.get(node, 1.0)
    able = lambda leaf: all(weight(leaf[:d]) > 0 for d in range(1, len(leaf) + 1))
    below = lambda node: sorted({leaf[: len(node) + 1] for leaf in tokens if leaf[: len(node)] == node and len(leaf) > len(node)})
    most = lambda node: sum(n * epochs for leaf, n in tokens.items() if leaf[: len(node)] == node and able(leaf))
    out, todo = {}, [((), min(budget, most(())))]
    while todo:
        node, has = todo.pop()
        if node in tokens:
            out[node] = int(has + 1e-6)
            continue
        nodes = below(node)
        todo += zip(nodes, share_out(has, [weight(c) for c in nodes], [most(c) for c in nodes]), strict=True)
    return out


LEVELS = ["__strophe_domain", "__strophe_lang", "__strophe_source"]


def budgets(spark, tokens, weights, share, epochs):
    df = spark.createDataFrame([(*k, n) for k, n in tokens.items()], ", ".join(f"{c} string" for c in LEVELS) + ", tokens long")
    return {tuple(r[:3]): r.budget for r in mixing.leaf_budgets(df, LEVELS, weights, share, epochs).collect()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    tokens = {("a", "x", "1"): 100, ("a", "y", "2"): 1000, ("b", "x", "3"): 1000}
    assert budgets(spark, tokens, {}, 1000 / 2100, 1) == {("a", "x", "1"): 100, ("a", "y", "2"): 400, ("b", "x", "3"): 500}
    assert budgets(spark, tokens, {("a",): 9.0}, 2000 / 2100, 1) == {("a", "x", "1"): 100, ("a", "y", "2"): 1000, ("b", "x", "3"): 900}
    assert sum(budgets(spark, tokens, {}, 10**6, 2).values()) == 4200
    assert budgets(spark, tokens, {("b",): 0.0}, 10**6, 1)[("b", "x", "3")] == 0


def test_budgets_match_a_walk_down_the_tree(spark):
    r = random.Random(12)
    for _ in range(4):
        tokens = {(f"d{r.randrange(3)}", r.choice(["en", "de", "unknown"]), f"s{i}"): r.choice([0, 1, 7, 500, 10_000]) for i in range(25)}
        weights = {("d0",): r.choice([0.0, 2.0]), ("d1", "en"): 5.0, ("d1", "de"): 0.0, ("d2", "en", "s3"): 9.0}
        share, epochs = r.choice([0.01, 0.5, 1.3, 9.0]), r.choice([1, 2])
        want = plain_budgets(tokens, weights, share * sum(tokens.values()), epochs)
        got = budgets(spark, tokens, weights, share, epochs)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


WEIGHTED = {("web",): 3.0, ("books", "en"): 2.0}


def drawn(df, **options):
    return collections.Counter((g.doc_id, g.domain, g.lang, g.source, g.n_tokens, g.epoch) for g in mixing.mix(df, weights=WEIGHTED, **options).collect())


@pytest.mark.parametrize("share", [0.05, 0.6, 5.0])
def test_mix_fills_leaves_with_epochs_and_a_prefix(spark, share):
    df = docs(spark)
    keyed = df.withColumn("key", F.xxhash64("doc_id", "text", F.col("doc_id").isNull()))
    leaves = collections.defaultdict(list)
    for r in with_token_counts(keyed, "n").withColumn("d", mixing.domain_of_source(F.coalesce("source", F.lit("unknown")))).collect():
        leaves[(r.d, r.lang or "unknown", r.source or "unknown")].append((r.doc_id, r.n + 1, r.key))
    budget = plain_budgets({k: sum(x[1] for x in v) for k, v in leaves.items()}, WEIGHTED, share * sum(x[1] for v in leaves.values() for x in v), 2)
    want = collections.Counter()
    for leaf, rows in leaves.items():
        full, rest = divmod(budget[leaf], sum(x[1] for x in rows))
        place = {k: p for k, p in spark.createDataFrame([(x[2],) for x in rows], "k long").select("k", F.xxhash64(F.lit(17), F.lit(full).cast("long"), "k")).collect()}
        taken = 0
        for i, (doc, n, key) in enumerate(sorted(rows, key=lambda x: (place[x[2]] % 2**64, x[2]))):
            taken += n
            for epoch in range(full + (taken <= rest)):
                want[(doc, *leaf, n, epoch)] += 1
    assert drawn(df, budget_share=share) == want


def test_mix_draws_the_same_however_rows_lie(spark):
    df = docs(spark)
    want = drawn(df, budget_share=0.4)
    for other in (df.coalesce(1), df.repartition(7, "doc_id"), df.repartition(211), df.orderBy(F.rand(3))):
        assert drawn(other, budget_share=0.4) == want


def test_mix_rows_and_empty_tables(spark):
    df = docs(spark, 40)
    assert mixing.mix(df, rows=True).columns == df.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and packing.pack(empty).count() == 0


CLASHING = ["rid", "row", "leaf", "block", "component", "size", "bands", "key", "epoch", "lang_pred", "score", "token"]


def texts(n):
    r = random.Random(9)
    words = {"en": "the of house water stone and tion er", "de": "der und haus wasser schön ung keit über"}
    rows = []
    for i in range(n):
        lang = r.choice(list(words))
        w = [r.choice(words[lang].split()) + r.choice(words[lang].split()) for _ in range(r.choice([3, 40, 90]))]
        rows.append((i, " ".join(w), r.choice([lang, lang, None]), r.choice(["src0", "src1", None])))
        if i % 4 == 0:  # exact and near copies
            rows.append((1000 + i, "  ".join(w), lang, "src2"))
            rows.append((2000 + i, " ".join([*w, "end"]), lang, "src3"))
    return [*rows, (3000, None, "en", "src0"), (3001, "", None, None), (3002, "123 ...", "en", "src1"), (5, rows[5][1], "en", "src1"), (None, "no id but words", "en", None), (3003, "long text goes on " * 20_000, "en", "src0")]


def test_pipeline_stages_match_plain_ones(spark):
    import corpus_pipeline as p
    from strophe.llm.common import squeezed, words

    rows = texts(60)
    df = spark.createDataFrame([(*x, len(x[1] or ""), *range(len(CLASHING))) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)).repartition(3)
    kept = [df]
    for name, stage in p.STAGES:
        kept.append(stage(spark, kept[-1], "").cache())
        assert name == "packing" or kept[-1].columns == df.columns, name
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "mixing", "packing"]
    told, exact, near, mixed, _ = ([(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] if "text" in x.columns else None for x in kept[1:])
    assert collections.Counter(told) == collections.Counter((i, t) for i, t, _, _ in rows if t and any(c.isalpha() for c in t))
    least = {}
    for i, t in told:
        b = squeezed(t)
        least[b] = min(least.get(b, 1 << 62), 1 << 62 if i is None else i)
    assert sorted((1 << 62 if i is None else i, squeezed(t)) for i, t in exact) == sorted((i, b) for b, i in least.items())
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (words(t) for _, t in exact)]
    root = list(range(len(exact)))
    for i in range(len(exact)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    groups = collections.defaultdict(list)
    for (i, _), g in zip(exact, root, strict=True):
        groups[g].append(1 << 62 if i is None else i)
    assert sorted(1 << 62 if i is None else i for i, _ in near) == sorted(map(min, groups.values())) and len(near) < len(exact)
    assert set(mixed) <= set(near) and max(collections.Counter(mixed).values()) <= 2
    assert collections.Counter(mixed) == collections.Counter((r.doc_id, r.text) for r in mixing.mix(kept[3].repartition(5), rows=True).collect())
    lengths = [r.n + 1 for r in with_token_counts(kept[4].select("text"), "n").collect()]
    assert kept[5].agg(F.sum("length")).first()[0] == sum(lengths)


def test_pipeline_without_rows_or_languages(spark):
    import corpus_pipeline as p

    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in p.STAGES:
        assert stage(spark, empty, "").count() == 0
    unlabelled = docs(spark, 20).withColumn("lang", F.lit(None).cast("string"))
    assert p.STAGES[0][1](spark, unlabelled, "").count() == unlabelled.count()
