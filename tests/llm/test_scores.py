import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from strophe.llm import langid, licenses, lm_scoring, quality, token_counts
from strophe.llm.common import crc_mod, hashed_words, words
from strophe.llm.tokens import TokenCounter, default_pattern, default_vocabulary, read_ranks

EXTRA = "doc_id long, text string, lang string, source string, id long, score string, label int, row int, pos int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2, 3, 4) for i, t, lang in rows], EXTRA).repartition(5)


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 200, "blocks_per_shard": 1, "fan": 3}])
def test_lm_scores_match_brute_force(spark, sizes):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(vocab[: r.choice([3, 30])]) for _ in range(r.randint(0, 40))), "en") for i in range(200)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "zzz W1 w2\t w3", "en"), (502, "zzz W1 w2\t w3", "en"), (None, "w1 w2", "en")]
    rows += [(503, "w1 w2 w3 " * 20_000, "en")]
    got = lm_scoring.lm_scores(docs(spark, rows), learn=crc_mod("doc_id", 7) != 2, **sizes).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "</s>"]
    counts = collections.Counter()
    for i, t, _ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            w = tokens(t)
            counts.update(tuple(w[j : j + n]) for n in (1, 2, 3) for j in range(len(w) - n + 1))
    n_all = sum(c for g, c in counts.items() if len(g) == 1)
    n_distinct = sum(len(g) == 1 for g in counts)

    def p(h, w):
        if not h:
            return (counts[(w,)] + 1) / (n_all + n_distinct + 1)
        return (counts[(*h, w)] + 4.0 * p(h[1:], w)) / (counts[h] + 4.0)

    want = collections.Counter()
    for i, t, _ in rows:
        w = tokens(t)
        s = sum(math.log10(p(tuple(w[max(0, j - 2) : j]), x)) for j, x in enumerate(w))
        b = sum(math.log10(p((), x)) for x in w)
        want[(i, len(w), sum(counts[(x,)] > 0 for x in w), n_all, round(b, 6), round(s, 6))] += 1
    assert collections.Counter((g.doc_id, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6), round(g.score, 6)) for g in got) == want
    # the arcs of a state and what its failure arc reaches sum to one
    known = {g[0] for g in counts if len(g) == 1}
    for h in [("w1",), ("w1", "w2"), ("nope",)]:
        assert abs(sum(p(h, w) for w in known) + p(h, "unseen") - 1) < 1e-9


def test_hashed_words_are_words():
    r = random.Random(2)
    texts = [None, "", " ", "a", "A b", "ab", "x" * 64, "x" * 65, "x" * 65 + "  ", "y" * 300 + " z", "é\tÉ\n  q ", "x" * 64 + " " + "x" * 65]
    texts += ["".join(r.choice("ab \t\nAé") for _ in range(r.randint(0, 150))) for _ in range(500)]
    for column in (pa.array(texts), pa.array(texts, pa.large_string())[5:], pa.array(texts[:1], pa.string()), pa.array([], pa.string())):
        hashes, per_text = hashed_words(column)
        said = [words(t) for t in column.to_pylist()]
        assert per_text.tolist() == [len(x) for x in said]
        flat = [w for x in said for w in x]
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_token_lengths_and_histogram(spark):
    c = TokenCounter(read_ranks(default_vocabulary()), default_pattern())
    c.common = {"a": 1, "the": 1}
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice(["a", " ", "\n", "\t", "!", "'s", " the", "1", "é", "\r\n", "<|endoftext|>"]) for _ in range(r.randint(0, 9)))
        assert c.count(t) == len(c.encode(t)), repr(t)
    texts = [None, "", "one", "the cat sat", "the cat sat", "x " * 5000]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs(spark, [(i, t, "en") for i, t in enumerate(texts)])))
    lengths = [len(c.encode(t or "")) for t in texts]
    for row in sums.collect():
        limit = row.n_tokens
        assert row.truncated_total == sum(min(x, limit) for x in lengths) and row.docs_at_least == sum(x >= limit for x in lengths)
        assert row.total_tokens == sum(lengths) and row.cut_docs == sum(x > limit for x in lengths) and row.tokens_at_least == sum(x for x in lengths if x >= limit)
    for limit in (0, 2, 700, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(sums, 0.5) == sorted(lengths)[2] and token_counts.quantile(sums, 1.0) == max(lengths)


WORDS = {"en": "the of and ing tion er house water", "de": "der und schön ung keit haus wasser über", "fr": "le été où ment eaux maison que"}


def talk(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) + r.choice(["", "", r.choice(WORDS[lang].split())]) for _ in range(n))


def test_language_of_held_out_and_mixed_texts(spark):
    r = random.Random(6)
    rows = [(i, talk(r, lang, r.randint(5, 60)), lang) for i, lang in enumerate(list(WORDS) * 60)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 ... !", "fr"), (1003, "Ä", None), (1004, (talk(r, "de", 70) + " " + talk(r, "en", 20)), "de")]
    rows += [(1005, talk(r, "fr", 40_000), "fr"), (1005, talk(r, "fr", 5), "fr")]  # very long, and an id that repeats
    found = langid.detect_language(docs(spark, rows), learn=crc_mod("doc_id", 4) != 2).collect()
    assert len(found) == len(rows) and [g.lang_pred for g in found if g.doc_id == 1005] == ["fr", "fr"]
    got = {g.doc_id: g for g in found}
    held = [(i, lang) for i, _, lang in rows if i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred in WORDS and got[1004].lang_pred == "de" and 0.5 < got[1004].score < 0.95
    assert all(0 <= g.score <= 1 for g in got.values())


def test_language_sample_is_bounded_and_reads_all_languages(spark):
    rows = [(i, "one two three " + "x" * (i % 50), f"l{i % 30}") for i in range(3000)]
    rows += [(9, "always the same text", "same")] * 2000 + [(10_000, "long " * 500, "l0")]  # a language of one repeated row; a text beyond the bound
    texts, langs = langid._sample(docs(spark, rows), "doc_id", "text", "lang", None, 20, 1000, 64_000_000, 128, 11)
    counts = collections.Counter(langs)
    assert set(counts) == {f"l{i}" for i in range(30)} | {"same"} and max(counts.values()) <= 20
    assert all(sum(len(t) for t, x in zip(texts, langs, strict=True) if x == lang) <= 1000 for lang in counts)
    assert langid._sample(docs(spark, rows).repartition(13), "doc_id", "text", "lang", None, 20, 1000, 64_000_000, 128, 11) == (texts, langs)
    few, told = langid._sample(docs(spark, rows), "doc_id", "text", "lang", None, 20, 1000, 1000, 2, 11)
    counted = collections.Counter(r[2] for r in rows if r[1] and r[2])
    assert set(told) <= {x for x, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:2]} and 0 < sum(map(len, few)) <= 1000


def test_forward_backward_matches_enumeration():
    import itertools

    r = np.random.default_rng(0)
    lengths, e, a, b = np.array([3, 1, 0, 4]), r.standard_normal((8, 3)), r.standard_normal((3, 3)), r.standard_normal(3)
    got, _, log_z = langid.forward_backward(e, lengths, a, b, pairs=True)
    want, total, at = np.zeros_like(e), 0.0, 0
    for n in lengths[lengths > 0]:
        x, z = e[at : at + n], 0.0
        m = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(b[path[0]] + sum(x[i, c] for i, c in enumerate(path)) + sum(a[p, q] for p, q in itertools.pairwise(path)))
            z += w
            for i, c in enumerate(path):
                m[i, c] += w
        want[at : at + n], total, at = m / z, total + np.log(z), at + n
    assert np.allclose(got, want) and abs(log_z - total) < 1e-9


def test_quality_votes(spark):
    r = random.Random(8)
    good = lambda: talk(r, "en", 40).capitalize() + "."
    bad = lambda: r.choice([lambda: "BUY!! " * 30, lambda: " | ".join(talk(r, "en", 20).split()), lambda: "$$$ %%% " * 20])() + talk(r, "en", 5)
    rows = [(i, good() if i % 2 else bad(), "en") for i in range(300)] + [(900, None, "en"), (901, "", "en"), (1, good(), "en"), (902, good() * 3000, "en")]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(300)] + [(5, 1, "y"), (None, 1, "z"), (7, None, "z")], "doc_id long, quality int, text string")
    got = quality.quality_scores(docs(spark, rows), labels, learn=crc_mod("doc_id", 5) != 0).collect()
    held = [(g.score >= 0.3) == (g.doc_id % 2 == 1) for g in got if g.doc_id < 300 and zlib.crc32(str(g.doc_id).encode()) % 5 == 0]
    assert len(got) == len(rows) and np.mean(held) > 0.95
    assert all(0 <= g.score <= 1 for g in got)
    none = quality.quality_scores(docs(spark, rows[:4]), labels.limit(0)).collect()
    assert {g.score for g in none} == {0.5}


def test_exact_neighbours_whatever_the_block():
    r = np.random.default_rng(1)
    counts = r.poisson(0.05, (200, quality.TERMS)).astype(np.float32)
    m = quality.fit(counts[:150], r.integers(0, 2, 150), dims=16)
    sims = m.embed(counts[150:]) @ m.vectors.T
    top = np.argsort(-sims, axis=1)[:, :8]
    w = np.maximum(np.take_along_axis(sims, top, 1), 0).astype(float) ** 4
    want = (w * m.labels[top]).sum(1) / w.sum(1)
    for block in (7, 64, 1024):
        assert np.allclose(m.score(counts[150:], 8, 4.0, block), want, atol=1e-5)


#: Wordings that the classifier wasn't fitted on.
HELD_OUT = [
    ("mit", "This project is distributed under the terms of the MIT license."), ("mit", "The code is available under the MIT License, see LICENSE."),
    ("apache", "This library is licensed under the Apache License 2.0."), ("apache", "Distributed under the Apache License, Version 2.0; see the file."),
    ("gpl", "This package is free software under the GNU General Public License, version 2 or later."), ("lgpl", "It is licensed under the GNU Lesser General Public License, version 3 or any later one."),
    ("agpl", "The server is licensed under the GNU Affero General Public License, version 3."), ("bsd", "This code is released under the BSD 3-Clause License."),
    ("cc-by", "This article is licensed under a Creative Commons Attribution 4.0 International License."), ("cc-by-nc", "This image is licensed under CC BY-NC 4.0 by its author."),
    ("cc-by-sa", "Text of this page is available under the Creative Commons Attribution-ShareAlike License."), ("cc0", "The data set is released under CC0 1.0 Universal."),
    ("mpl", "The add-on is licensed under the Mozilla Public License, version 2.0."), ("proprietary", "Copyright 2020. All rights reserved."),
    ("unknown", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("unknown", "This program and the accompanying materials are made available under the Eclipse Public License v2.0."), ("unknown", "The library is licensed under the zlib License."),
    ("none", "He lost his license on the way to the general store."), ("none", "The public library has a copy of the version."), ("none", "Warranty claims are handled by the shop."),
    ("none", "The software is free and everyone may use it at work."), ("none", "Reading this book was a pleasure, and the author deserves thanks for the permission to quote."),
]
MIT = """Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:"""


def plain_scan(text, least=0.5, overlap=0.6):
    """The scan in plain Python."""
    families, weights, bias, temperature = licenses.fit()
    found = collections.defaultdict(list)
    for paragraph in regex.split(licenses.BREAK, text or ""):
        grams = set(licenses.features(paragraph))
        if len({w for w in grams if " " not in w} & set(licenses._speaking())) < licenses.LEAST_WORDS:
            continue
        z = (sum((np.round(weights[g], 9) for g in grams & weights.keys()), np.zeros(len(families))) + bias) / temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = families[int(p[:-2].argmax())]
        share = max(len(grams & set(licenses.features(t))) / len(set(licenses.features(t))) for t in licenses.TEMPLATES[best])
        if 1 - p[-1] >= least:
            sure = p[:-2].max() >= least and share >= overlap
            found[best if sure else "unknown"].append(p[:-2].max() if sure else 1 - p[-1])
    if not found:
        return "none", 0.0, 0, 0, []
    family = min(found, key=lambda f: (f == "unknown", -len(found[f]), f))
    return family, round(max(found[family]), 6), len(found[family]), sum(map(len, found.values())), sorted(found)


def test_license_scan_matches_plain_python(spark):
    filler = "Anat with by of nteres.\nThe lorem driver of the public house."
    prose = "Here stands much more prose than notice, and it goes on for a good while before the point comes, " * 2
    texts = [None, "", filler, MIT, f"{filler}\n\n{MIT}\n\n{filler}", f"{prose}and this work is licensed under the GNU General Public License, version 3. {prose}", "-- licensed under the apache license, version 2.0 --"]
    texts += ["Released under the MIT License.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "# SPDX-License-Identifier: MIT\nimport this", "-mit-", "license " * 50_000, filler * 20_000 + "\nLicensed under the MIT License."]
    texts += [t for _, t in HELD_OUT] + [f"{filler}\n{t}\n{filler}" for ts in licenses.TEMPLATES.values() for t in ts] + [texts[3]]
    rows = [(i // 2, t, "en") for i, t in enumerate(texts)]  # ids repeat
    got = sorted((g.doc_id, g.family, round(g.confidence, 6), g.n_paragraphs, g.n_licensed, g.families) for g in licenses.scan_licenses(docs(spark, rows)).collect())
    want = sorted((i, *plain_scan(t)) for i, t, _ in rows)
    assert [(*g[:2], *g[3:]) for g in got] == [(*w[:2], *w[3:]) for w in want]
    assert all(abs(g[2] - w[2]) < 1e-5 for g, w in zip(got, want, strict=True))


def test_license_families_of_wordings_not_trained_on():
    assert [(f, t) for f, t in HELD_OUT if plain_scan(t)[0] != f] == []
    assert {t for _, t in HELD_OUT}.isdisjoint({*licenses.OTHERS, *licenses.EVERYDAY, *(t for ts in licenses.TEMPLATES.values() for t in ts)})
    assert plain_scan(MIT)[0::2][:2] == ("mit", 1)  # wrapped lines are one paragraph
    bsd = "1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer."
    assert plain_scan(bsd)[0] == "bsd" and plain_scan(bsd)[2] == 1


@pytest.mark.parametrize("f", [
    lambda d: lm_scoring.lm_scores(d), lambda d: token_counts.suffix_sums(token_counts.length_histogram(d)), lambda d: langid.detect_language(d),
    lambda d: licenses.scan_licenses(d), lambda d: quality.quality_scores(d, d.select("doc_id", F.lit(1).alias("quality"))),
])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], EXTRA)).count() == 0
