import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strophe.llm import bpe

PIECES = ["a", "b", "e", "t", "h", "'", "s", "re", "!", " ", "\n", "É", "é", "é", "́", "中", "文", "𝒳", "1", "²", "İ", "Σ", "ß", "Ǆ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<", " ", "　", "가", "가", "क़", "😀", "\x00", "\x85", "Ᲊ", "ﬁ", "A", "'ll", "'VE"]


@pytest.fixture(scope="module")
def both():
    path = bpe.default_tokenizer()
    return bpe.Encoder(bpe._read(path)), Tokenizer.from_file(path)


def ids_of(e, text):
    return np.frombuffer(b"".join(e.pieces(text)), "<u4").tolist()


@pytest.mark.parametrize("piece", [3, 7, 50, 1 << 16])
def test_pieces_of_any_size_encode_as_the_library(both, piece, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", piece)
    rnd = random.Random(piece)
    for _ in range(600):
        for some in (PIECES, PIECES[:8] + PIECES[11:13]):
            text = "".join(rnd.choice(some) for _ in range(rnd.randrange(1, 70)))
            assert ids_of(both[0], text) == both[1].encode(text, add_special_tokens=False).ids, text


def test_very_long_words_keep_a_bounded_window(both, monkeypatch):
    e, lib = both
    rnd = random.Random(4)
    sizes = []
    emit = bpe.Word._emit
    monkeypatch.setattr(bpe.Word, "_emit", lambda self: (sizes.append(len(self.last)), emit(self))[1])
    texts = [unit * 3000 for unit in ("a", "ab", "!", "the", "ing", "ha", "é", "!?", "中", "lol", "'", "0", "ñ😀")]
    texts += ["".join(rnd.choice(some) for _ in range(100_000)) for some in ("abcdefghijklmnopqrstuvwxyzé", "etaoinshr")]
    for text in texts:
        assert ids_of(e, text) == lib.encode(text, add_special_tokens=False).ids
    assert max(sizes) <= 2 * e.t.lookahead + 1026


def test_lookahead_and_pairs_hold_for_small_merge_lists():
    """Against plain merging: whatever follows, tokens that end before the lookahead stay; pairs decide the encoding."""
    rnd = random.Random(8)
    for _ in range(60):
        letters = "abc"
        vocab = {t: i for i, t in enumerate([*letters, *(c + "</w>" for c in letters)])}
        merges = []
        while len(merges) < 12:
            a, b = rnd.choice([t for t in vocab if not t.endswith("</w>")]), rnd.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        t = bpe.Transducer(bpe.Merges(vocab, merges))

        def plain(word, merges=merges, vocab=vocab):
            s = [*word[:-1], word[-1] + "</w>"]
            while True:
                found = [(merges.index((x, y)), i) for i, (x, y) in enumerate(zip(s, s[1:], strict=False)) if (x, y) in merges]
                if not found:
                    return [vocab[x] for x in s]
                _, i = min(found)
                s[i : i + 2] = [s[i] + s[i + 1]]

        for _ in range(60):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 30)))
            w = bpe.Word(t)
            w.feed(text.encode())
            assert np.frombuffer(w.close(), "<u4").tolist() == plain(text)
        text = "".join(rnd.choice(letters) for _ in range(60))
        ends = lambda s: set(np.cumsum([t.m.size[i] for i in plain(s)]).tolist())
        for n in range(t.lookahead + 1, 50):  # a last plain byte stays back, so a prefix's tokens are those read so far
            w = bpe.Word(t)
            w.feed(text[: n + 1].encode())
            at = set(np.cumsum([t.m.size[i] for i in w._path()]).tolist())
            for rest in ("", *letters, "abcabc", "ccba"):
                assert {x for x in at if x <= n - t.lookahead} == {x for x in ends(text[: n + 1] + rest) if x <= n - t.lookahead}


def test_decoder_takes_bytes_in_any_parts(both):
    e, lib = both
    text = "Hello <|endoftext|> it's Éa!!! 中文 😀 x"
    raw = b"".join(e.pieces(text))
    ids = np.frombuffer(raw, "<u4").tolist()
    tokens = {i: t for t, i in lib.get_vocab().items()}
    for size in (1, 3, 4, 9, 1000):
        d, t = bpe.Decoder(tokens), bpe.Decoder(tokens, text_form=True)
        parts = [raw[i : i + size] for i in range(0, len(raw), size)]
        assert "".join(map(d.feed, parts)) + d.close() == lib.decode(ids, skip_special_tokens=False)
        assert "".join(map(t.feed, parts)) + t.close() == "hello <|endoftext|>it 's éa !!! 中文 😀 x "


def test_encode_and_decode_rows(spark, both):
    """Nulls, empty texts, ties, repeated rows, an empty table, names of the columns made inside."""
    long = "wordsthatdontend" * 20_000
    rows = [(1, "Hello there", "x"), (2, None, "x"), (3, "", "y"), (None, "Hello there", None), (1, "Hello there", "x"), (5, long, "z"), (6, "<|endoftext|>", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    out = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r["rank"] or "") for r in out) == sorted((a or 0, b or "", c or "") for a, b, c in rows)
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        want = both[1].encode(r.text or "", add_special_tokens=False).ids
        assert ids == want and r.decoded == both[1].decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    assert bpe.decode(bpe.encode(docs.where("doc_id = 6")), text_form=True, out_col="plain").first().plain == "<|endoftext|>"


def test_query_equals_the_library_on_whole_documents(spark, both):
    import hashlib

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = bpe.query(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(got.dtypes)["n_tokens"] == "bigint"
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert got.where(F.col("n_tokens").isNull()).count() == 0
