"""BPE encoding and decoding by a streaming transducer of bounded lookahead.

A word's bytes are read one at a time. After each byte the transducer knows the last token of the
encoding of all it has read: of the vocabulary's tokens that end there (found by an automaton with failure
links) exactly one may follow the last token of the prefix before it, for a list of tokens is the
encoding of its text if and only if each adjacent pair is the encoding of its own. What is read later
can change tokens near the end only: each further token to the left is lost to a merge of later rank than
the one before, so the longest chain of such merges (`sufficient_lookahead`, 721 bytes for the 49k
vocabulary) bounds how far back a change reaches. Tokens that end before that are emitted at once, and
the window behind them is dropped: memory doesn't grow with the word. The last byte of a word, which
carries the end-of-word mark, is held back until the word's end is known.

Texts are read in pieces cut at white space; a run without white space is fed in parts of bounded length
with the state of the splitting pattern (kind of the open word, characters held back) carried over. Only
a run of combining marks is held whole, as their normal form needs all of them. Common words come from
a bounded table that each worker learns. Characters below U+0250 are split by a pattern over the classes
that the library gives; other pieces are normalised and split by the library itself.

Decoding is a state machine from bytes to text: four bytes make an id, an id its token; the text form
passes the tokens' bytes through an incremental UTF-8 decoder.

Special cases: null and empty texts have no tokens and decode to the empty text; special tokens' strings
in a text are those tokens, as the library has it; texts of any length are encoded whole; repeated rows
are encoded each; null ids stay; an empty table gives an empty result; extra columns may have any names
but the two new ones'.
"""

from __future__ import annotations

import codecs
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from tokenizers import Tokenizer

#: Characters of a piece; words of a worker's table, and their longest length; token pairs remembered.
PIECE, WORDS, LONG, PAIRS = 1 << 16, 400_000, 256, 2_000_000
#: Characters that are in normal form wherever they stand, and of which classes are asked once.
_SIMPLE = 0x250
_END = "</w>"


def default_tokenizer() -> str:
    """Path of the word-end vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of() -> dict[str, int]:
    """Bytes by the characters that stand for them: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Tokens as byte strings (plain or ending a word), the merge that makes each, and what follows from them."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = _END):
        byte_of = _byte_of()
        self.plain: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.size: dict[int, int] = {}
        for token, i in vocab.items():
            ends = len(token) > len(suffix) and token.endswith(suffix)
            b = bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token))
            (self.final if ends else self.plain)[b] = i
            self.size[i] = len(b)
        self.rank: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.rule: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if made in self.parts or max(self.rank[x], self.rank[y]) >= r or (self.size[x] > 1 and x not in self.parts) or (self.size[y] > 1 and y not in self.parts):
                raise ValueError(f"merge {r} doesn't make a new token of earlier ones")
            self.parts[made], self.rank[made], self.rule[x, y] = (x, y), r, r
        # a token may stand alone if its own merges make it of its bytes
        self.sound = {i for i, n in self.size.items() if n == 1}
        for made, (x, y) in self.parts.items():
            if x in self.sound and y in self.sound and self._apart(x, y):
                self.sound.add(made)
        self.longest = max(self.size.values())

    def _apart(self, u: int, v: int) -> bool:
        """Do no two symbols merge across the boundary of u and v before both are whole? Merges are undone latest
        first; of equal ones the left is done first."""
        while True:
            ru, rv = self.rank[u], self.rank[v]
            if max(ru, rv) < 0:
                return True
            if ru > rv:
                u, limit = self.parts[u][1], ru
            else:
                v, limit = self.parts[v][0], rv + 1
            if self.rule.get((u, v), limit) < limit:
                return False

    def adjacent(self, u: int, v: int) -> bool:
        """Is [u, v] the encoding of its own text?"""
        return (u, v) not in self.rule and self._apart(u, v)

    def sufficient_lookahead(self) -> int:
        """Bytes after which no token changes, whatever follows.

        A merge (v, p) that more text prevents or adds reaches |v| bytes to the left; the next to the left is of a
        later rank, and its right part begins with v.
        """
        text = {i: b for table in (self.plain, self.final) for b, i in table.items()}
        reach: dict[bytes, int] = defaultdict(int)
        for (v, p), _ in sorted(self.rule.items(), key=lambda x: x[1]):
            t = text[p]
            plain = p == self.plain.get(t)  # v doesn't end a word
            here = self.size[v] + max((reach.get(t[:k], 0) for k in range(1, len(t) + plain)), default=0)
            reach[text[v]] = max(reach[text[v]], here)
        return max(reach.values(), default=1)


class Transducer:
    """Words to ids: an automaton over the vocabulary, made as it is met, and a table of allowed pairs."""

    def __init__(self, merges: Merges):
        self.m, self.lookahead = merges, merges.sufficient_lookahead()
        self.heads = {b[:k] for table in (merges.plain, merges.final) for b in table for k in range(1, len(b) + 1)}
        # a state is the longest end of what was read that begins a token; keys are state << 8 | byte and token << 32 | token
        self.states, self.read = {b"": 0}, [b""]
        self.steps: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        self.ends: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}

    def _tokens(self, table: dict[bytes, int], b: bytes) -> list[tuple[int, int]]:
        found = ((len(b) - k, table[b[k:]]) for k in range(len(b)) if b[k:] in table)
        return [(n, i) for n, i in found if i in self.m.sound]

    def step(self, state: int, byte: int) -> tuple[int, list[tuple[int, int]]]:
        """The next state, and the plain tokens that end here, longest first."""
        longer = self.read[state] + bytes((byte,))
        while longer and longer not in self.heads:
            longer = longer[1:]
        if longer not in self.states:
            self.states[longer] = len(self.read)
            self.read.append(longer)
        found = self.steps[state << 8 | byte] = self.states[longer], self._tokens(self.m.plain, longer)
        return found

    def end(self, state: int, byte: int) -> list[tuple[int, int]]:
        """The tokens that end a word here."""
        found = self.ends[state << 8 | byte] = self._tokens(self.m.final, self.read[state] + bytes((byte,)))
        return found

    def pair(self, u: int, v: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        ok = self.pairs[u << 32 | v] = self.m.adjacent(u, v)
        return ok


class Word:
    """One word being read: for each boundary since the last emitted one, the last token of the encoding up to it."""

    def __init__(self, t: Transducer):
        self.t, self.state, self.held = t, 0, b""
        self.last: list[int] = [-1]
        self.out: list[int] = []

    def _choose(self, candidates: list[tuple[int, int]]) -> int:
        """The one token that ends here and may follow the last one before it; none is before a word's begin."""
        last, n, pairs = self.last, len(self.last), self.t.pairs
        for size, token in candidates:
            if size <= n:
                before = last[-size]
                if before < 0:
                    return token
                ok = pairs.get(before << 32 | token)
                if ok or (ok is None and self.t.pair(before, token)):
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def feed(self, b: bytes) -> None:
        """Read bytes; the last one stays back, as it may end the word."""
        b = self.held + b
        self.held = b[-1:]
        steps, pairs, state, last = self.t.steps, self.t.pairs, self.state, self.last
        window, n = 2 * self.t.lookahead + 1024, len(self.last)
        for byte in b[:-1]:
            state, candidates = steps.get(state << 8 | byte) or self.t.step(state, byte)
            for size, token in candidates:
                if size <= n and ((before := last[-size]) < 0 or pairs.get(before << 32 | token)):
                    last.append(token)
                    break
            else:  # a pair is met for the first time
                last.append(self._choose(candidates))
            n += 1
            if n > window:
                self._emit()
                n = len(last)
        self.state = state

    def _path(self) -> list[int]:
        tokens, at, size = [], len(self.last) - 1, self.t.m.size
        while at > 0:
            tokens.append(self.last[at])
            at -= size[self.last[at]]
        return tokens[::-1]

    def _emit(self) -> None:
        """Emit what no later byte changes, and drop the window behind it."""
        stable, at = len(self.last) - 1 - self.t.lookahead, 0
        for token in self._path():
            if at + self.t.m.size[token] > stable:
                break
            at += self.t.m.size[token]
            self.out.append(token)
        del self.last[:at]

    def taken(self) -> bytes:
        """Ids emitted so far, little-endian; they are gone from here."""
        ids, self.out = np.array(self.out, dtype="<u4").tobytes(), []
        return ids

    def close(self) -> bytes:
        """The word ends: ids that were not taken yet."""
        if self.held:
            byte = self.held[0]
            found = self.t.ends.get(self.state << 8 | byte)
            self.last.append(self._choose(self.t.end(self.state, byte) if found is None else found))
        self.out += self._path()
        return self.taken()


class Encoder:
    """Texts to ids under a tokenizer file of this kind: NFC, white space dropped, lower case, split words, merges."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.tokenizer = Tokenizer.from_str(content)
        self.normal, self.split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.t = Transducer(Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"]))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("|".join(f"({re.escape(s)})" for s in marks)) if marks else None
        self.mark_ids = [np.array([self.special[s]], dtype="<u4").tobytes() for s in marks]
        self.opens = {s[0] for s in marks}
        self.longest_mark = max(map(len, marks), default=0)
        self.common: dict[str, bytes] = {}
        byte_of = _byte_of()
        self.byte_of = {ord(c): b for c, b in byte_of.items()}
        # classes below _SIMPLE, as the library splits; lower case keeps these characters below it or isn't simple
        kinds = {"a": [], "0": [], "!": []}
        for c in map(chr, range(_SIMPLE)):
            if self.normal(c) != c.lower() or max(map(ord, c.lower())) >= _SIMPLE or len(c.lower()) > 1:
                if not c.isspace():
                    kinds.setdefault("odd", []).append(c)
            for kind in self._kind(c):
                kinds[kind].append(c)
        one = lambda kind: "".join(map(re.escape, kinds[kind]))
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{one('a')}]+|[{one('0')}]|[{one('!')}]+").findall
        self.complex = re.compile(f"[{one('odd') if 'odd' in kinds else ''}{chr(_SIMPLE)}-\U0010ffff]").search

    def _kind(self, c: str) -> str:
        """a: letter, 0: number, !: neither; nothing for white space."""
        if not self.split(c):
            return ""
        return "a" if len(self.split(f"a{c}")) == 1 else "!" if len(self.split(f"!{c}")) == 1 else "0"

    def _raw(self, piece: str) -> bytes:
        return bytes(map(self.byte_of.__getitem__, map(ord, piece)))

    def _word(self, word: str) -> bytes:
        w = Word(self.t)
        w.feed(word.encode())
        ids = w.close()
        if len(self.common) < WORDS and len(word) <= LONG:
            self.common[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        """Ids of a piece between white space, without special tokens."""
        if self.complex(text):
            found = []
            for piece, _ in self.split(self.normal(text)):
                w = Word(self.t)
                w.feed(self._raw(piece))
                found.append(w.close())
            return b"".join(found)
        words = self.words(text.lower())
        found = list(map(self.common.get, words))
        if None in found:
            found = [self.common.get(w) or self._word(w) if f is None else f for w, f in zip(words, found, strict=True)]
        return b"".join(found)

    def _marked(self, text: str) -> Iterator[tuple[str, bytes]]:
        """Text before each special token, and its id; at last the rest."""
        at = 0
        if self.marks and any(c in text for c in self.opens):
            for m in self.marks.finditer(text):
                yield text[at : m.start()], self.mark_ids[m.lastindex - 1]
                at = m.end()
        yield text[at:], b""

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids of the whole text, piece by piece, little-endian."""
        at = 0
        while at < len(text):
            to = at + PIECE
            if to < len(text):
                to = max(text.rfind(" ", at, to), text.rfind("\n", at, to)) + 1
                if to <= at:
                    at, found = yield from self._unbroken(text, at)
                    continue
            for part, mark in self._marked(text[at:to]):
                yield self._whole(part) + mark
            at = to

    def _unbroken(self, text: str, at: int) -> Iterator[bytes]:
        """Ids from `at` up to white space, fed in parts; returns where it ended."""
        end = re.compile(r"[ \n]").search(text, at)
        end = end.start() if end else len(text)
        run = Run(self)
        while at < end:
            to = min(end, at + PIECE)
            yield run.feed(text[at:to])
            at = to
        yield run.close()
        return end, True


class Run:
    """Text without white space being read in parts: raw characters held back, the open word and its kind."""

    def __init__(self, e: Encoder):
        self.e, self.raw, self.text, self.kind = e, "", "", ""
        self.word: Word | None = None

    def feed(self, part: str) -> bytes:
        raw, out = self.raw + part, []
        # what may still be the beginning of a special token stays back, and marks that join what they follow
        keep = len(raw)
        tail = max(0, len(raw) - self.e.longest_mark + 1)
        for i in range(tail, len(raw)):
            if raw[i] in self.e.opens and any(s.startswith(raw[i:]) for s in self.e.special):
                keep = i
                break
        keep = _joint(raw, keep)
        if self.e.marks:
            keep = next((m.start() for m in self.e.marks.finditer(raw) if m.start() < keep < m.end()), keep)
        self.raw = raw[keep:]
        for before, mark in self.e._marked(raw[:keep]):
            out.append(self._read(before))
            if mark:
                out += [self._finish(), mark]
        return b"".join(out)

    def close(self) -> bytes:
        out = []
        for before, mark in self.e._marked(self.raw):
            out += [self._read(before), self._finish(), mark]
        return b"".join(out)

    def _read(self, part: str) -> bytes:
        """Words that are sure to be over are encoded; one that may go on stays open."""
        self.text += self.e.normal(part) if part else ""
        return self._split(False)

    def _finish(self) -> bytes:
        ids = self._split(True)
        if self.word:
            ids += self.word.close()
        self.word, self.kind, self.text = None, "", ""
        return ids

    def _split(self, over: bool) -> bytes:
        text, out, e = self.text, [], self.e
        lead = len(self.kind)
        pieces = e.split(self.kind + text)
        done = 0  # characters of text that are read
        for piece, (start, end) in pieces:
            start, end = max(0, start - lead), end - lead
            first = bool(self.word) and start == 0 and done == 0
            if not over and end > len(text) - 2:  # may go on
                if first or end - start > 3:
                    # a run of three or more characters is no contraction: read all but two of them
                    stop = len(text) - 2
                    if stop > start:
                        w = self.word if first else Word(e.t)
                        if self.word and not first:
                            out.append(self.word.close())
                        w.feed(text[start:stop].encode())
                        out.append(w.taken())
                        self.word = w
                        self.kind = "!" if e._kind(text[start]) == "!" else "a"
                        done = stop
                break
            if first:
                if end > 0:
                    self.word.feed(text[start:end].encode())
                out.append(self.word.close())
                self.word, self.kind = None, ""
            else:
                if self.word:
                    out.append(self.word.close())
                    self.word, self.kind = None, ""
                w = Word(e.t)
                w.feed(text[start:end].encode())
                out.append(w.close())
            done = end
        self.text = text[done:] if not over else ""
        return b"".join(out)


def _joint(text: str, keep: int) -> int:
    """The last place up to `keep` where text may be cut without changing its normal form: before a plain character
    below U+0300 or an ideograph."""
    while 0 < keep:
        if keep < len(text):
            c = ord(text[keep])
            if c < 0x300 or 0x3400 <= c < 0xA000:
                return keep
        keep -= 1
    return 0


class Decoder:
    """Bytes of ids to text. Without a word mark given, tokens stand as the library prints them, parted by spaces."""

    def __init__(self, tokens: dict[int, str], text_form: bool = False, suffix: str = _END):
        self.tokens, self.text_form, self.pending, self.started = tokens, text_form, b"", False
        if text_form:
            byte_of = _byte_of()
            raw = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
            self.raw = {i: raw(t.removesuffix(suffix)) + b" " * t.endswith(suffix) for i, t in tokens.items()}
            self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, b: bytes) -> str:
        b = self.pending + b
        whole = len(b) & ~3
        self.pending = b[whole:]
        ids = np.frombuffer(b[:whole], dtype="<u4").tolist()
        if self.text_form:
            return self.utf8.decode(b"".join(map(self.raw.__getitem__, ids)))
        text = " ".join(map(self.tokens.__getitem__, ids))
        text = f" {text}" if self.started and ids else text
        self.started |= bool(ids)
        return text

    def close(self) -> str:
        return self.utf8.decode(b"", final=True) if self.text_form else ""


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, content: str) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _with_column(df: DataFrame, name: str, kind, make: Callable[[], Callable[[pa.Array], pa.Array]], of: str) -> DataFrame:
    """df with a column made of another in Arrow batches."""
    schema = StructType([*df.schema.fields, StructField(name, kind)])
    arrow, at = to_arrow_schema(schema), df.columns.index(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, f(part.column(at))], schema=arrow)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with out_col: the ids of each whole text as little-endian unsigned 32-bit integers.

    The tokenizer file is read on the driver and broadcast (its size is fixed), so executors need no local file.
    """
    path = path or default_tokenizer()
    content = docs.sparkSession.sparkContext.broadcast(_read(path))

    def make() -> Callable[[pa.Array], pa.Array]:
        e = _encoder(path, content.value)
        return lambda texts: pa.array([b"".join(e.pieces(t)) if t else b"" for t in texts.to_pylist()], pa.binary())

    return _with_column(docs, out_col, BinaryType(), make, text_col)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None, text_form: bool = False) -> DataFrame:
    """rows with out_col: their ids decoded, as the library prints them or (text_form) as text with a space after each word."""
    spec = json.loads(_read(path or default_tokenizer()))
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
    shared = rows.sparkSession.sparkContext.broadcast((tokens, spec["model"]["end_of_word_suffix"]))

    def make() -> Callable[[pa.Array], pa.Array]:
        tokens, suffix = shared.value

        def text(ids: bytes | None) -> str:
            d = Decoder(tokens, text_form, suffix)
            parts = (d.feed(ids[i : i + PIECE]) for i in range(0, len(ids or b""), PIECE))
            return "".join(parts) + d.close()

        return lambda ids: pa.array(map(text, ids.to_pylist()), pa.string())

    return _with_column(rows, out_col, StringType(), make, ids_col)


def query(spark, sf_dir: str) -> DataFrame:
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text"))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
