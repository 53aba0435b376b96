"""Token ids of texts and structure lines, with pluggable encoders."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of structure lines for the lyric model (fixed values).
STRUCTURE = {
    "[start]": 500, "[end]": 501, "[intro]": 502, "[verse]": 503, "[chorus]": 504, "[outro]": 505, "[inst]": 506,
    "[solo]": 507, "[bridge]": 508, "[hook]": 509, "[break]": 510, "[stop]": 511, "[space]": 512,
}

Encode = Callable[[str], list[int]]


def letters(text: str) -> list[int]:
    """A number for each letter: the least an encoder can be."""
    return [ord(c) % 500 for c in text if c.isalnum()]


class Specials:
    """An automaton with failure links that finds special tokens in one pass, the first one first, of those that begin
    alike the longest."""

    def __init__(self, tokens: dict[str, int]):
        self.tokens = {t: i for t, i in tokens.items() if t}
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.ends, self.depth = [0], [""], [0]
        for token in self.tokens:
            state = 0
            for c in token:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append("")
                    self.depth.append(self.depth[state] + 1)
                state = self.next[state][c]
            self.ends[state] = token
        queue = [*self.next[0].values()]
        for state in queue:  # by depth; the longest token that ends at a state
            self.ends[state] = self.ends[state] or self.ends[self.fail[state]]
            for c, child in self.next[state].items():
                up = self.fail[state]
                while up and c not in self.next[up]:
                    up = self.fail[up]
                self.fail[child] = self.next[up].get(c, 0)
                queue.append(child)

    def parts(self, text: str) -> Iterator[tuple[str, str | None]]:
        """Plain text and the special token after it, at last the rest with none."""
        at, state, found = 0, 0, None  # found: begin and end of the best token so far
        i = 0
        while i < len(text):
            c = text[i]
            while state and c not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(c, 0)
            i += 1
            if token := self.ends[state]:
                begin = i - len(token)
                if found is None or begin < found[0] or (begin == found[0] and i > found[1]):
                    found = (begin, i)
            # nothing that is still open began at or before the token found
            if found and (not state or i - self.depth[state] > found[0]):
                yield text[at : found[0]], text[found[0] : found[1]]
                at = i = found[1]
                state, found = 0, None
        if found:
            yield text[at : found[0]], text[found[0] : found[1]]
            yield from self.parts(text[found[1] :])
        else:
            yield text[at:], None


class ByteEncoder:
    """Byte-pair merges of a public vocabulary, and back; ids of special tokens stand beside it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, specials: dict[str, int]):
        import tiktoken

        if {*ranks.values()} & {*specials.values()}:
            raise ValueError("a special token has the id of another token")
        self.plain = tiktoken.Encoding("strophe-vocab", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.specials = Specials(specials)
        self.names = {i: t for t, i in specials.items()}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for plain, token in self.specials.parts(text or ""):
            out += self.plain.encode_ordinary(plain)
            if token is not None:
                out.append(self.specials.tokens[token])
        return out

    def decode(self, ids: list[int] | None, spaced: bool = False) -> str:
        """The text; spaced: a space on either side of each special token but the text's begin, as the lyric models print them."""
        out, run = [], []
        for i in [*(ids or []), None]:
            if i is None or i in self.names:
                out.append(self.plain.decode_bytes(run).decode("utf-8", "replace"))
                run = []
                if i is not None:
                    out.append(f" {self.names[i]} " if spaced else self.names[i])
            else:
                run.append(i)
        return "".join(out)


def byte_encoder(path: str, pattern: str, specials: dict[str, int]) -> Callable[[], ByteEncoder]:
    """A loader of ByteEncoder; the file is read on the driver, and its ranks (a fixed size) go with the function."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}

    def load() -> ByteEncoder:
        key = (path, tuple(sorted(specials.items())))
        if key not in _ENCODERS:
            _ENCODERS[key] = ByteEncoder(ranks, pattern, specials)
        return _ENCODERS[key]

    return load


_ENCODERS: dict[tuple, ByteEncoder] = {}


#: Rows that are encoded or decoded at a time, and bytes of them unless one row has more: only these are Python objects.
PIECE, PIECE_BYTES = 64, 1 << 20


def _pieces(batches: Iterator[pa.Array]) -> Iterator[list]:
    for b in batches:
        at = 0
        while at < len(b):
            piece = b.slice(at, PIECE)
            while len(piece) > 1 and piece.nbytes > PIECE_BYTES:
                piece = piece.slice(0, len(piece) // 2)
            at += len(piece)
            yield piece.to_pylist()


def byte_ids(c: Column, load: Callable[[], ByteEncoder]) -> Column:
    """ids of whole texts under a byte-pair vocabulary; special tokens stand for themselves and are never cut. Null has none."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = load()
        for piece in _pieces(batches):
            yield pa.array([e.encode(x) for x in piece], pa.list_(pa.int32()))

    return run(c)


def byte_text(ids: Column, load: Callable[[], ByteEncoder], spaced: bool = False) -> Column:
    """the texts of ids, the way back."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = load()
        for piece in _pieces(batches):
            yield pa.array([e.decode(x, spaced) for x in piece], pa.string())

    return run(ids)


def text_ids(c: Column, specials: dict[str, int], load: Callable[[], Encode] = lambda: letters) -> Column:
    """ids of a text by any encoder, in which special tokens stand for themselves and are never cut."""
    found = Specials(specials)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()

        def one(text: str | None) -> list[int]:
            return [i for plain, token in found.parts(text or "") for i in (*encode(plain), *((specials[token],) if token is not None else ()))]

        for piece in _pieces(batches):
            yield pa.array([one(x) for x in piece], pa.list_(pa.int32()))

    return run(c)


def extended(vocabulary: dict[str, int], tokens: list[str]) -> dict[str, int]:
    """The vocabulary with new tokens numbered after its largest id."""
    new = [t for t in dict.fromkeys(tokens) if t not in vocabulary]
    first = max(vocabulary.values(), default=-1) + 1
    return vocabulary | {t: first + i for i, t in enumerate(new)}


def line_ids(lines: Column, load: Callable[[], Encode] = lambda: letters) -> Column:
    """F32: ids of lyric lines, structure lines by their number, each line closed by a stop. Made in one step: an expression around the
    encoder's output would be repeated wherever the ids are used."""
    stop = STRUCTURE["[stop]"]

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()

        def one(line: str | None) -> list[int]:
            if line in STRUCTURE:
                return [STRUCTURE[line], stop]
            return [*(encode(text) if (text := (line or "").strip(" ")) else ()), stop]

        for piece in _pieces(batches):
            yield pa.array([None if v is None else [i for x in v for i in one(x)] for v in piece], pa.list_(pa.int32()))

    return run(lines)


def song_id(prefix: Column, *numbers: Column) -> Column:
    """identifiers with six and four digits: `prefix_000001_0002`."""
    widths = ("%06d", "%04d")
    return F.concat_ws("_", prefix, *(F.format_string(w, n) for w, n in zip(widths, numbers, strict=False)))


def masked_logits(logits: Column, start: int, end: int) -> Column:
    """Ids in [start, end) get minus infinity."""
    return F.transform(logits, lambda x, i: F.when((i >= start) & (i < end), F.lit(float("-inf"))).otherwise(x))
