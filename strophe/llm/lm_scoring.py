"""LM scoring with a weighted backoff automaton over smoothed n-grams.

States are contexts (n-grams of up to order - 1 tokens met in training, and the root); the arc of a
met n-gram hw carries (c(hw) + mu p(w | h')) / (c(h) + mu), and a state's failure arc leads to the
context one token shorter with weight mu / (c(h) + mu). The root's arcs are add-one unigrams, with
one arc for every unknown token. Weights of a state's arcs and of what its failure arc reaches sum to
one. A text is scored by one traversal from left to right that carries the state of each document
and adds log10 weights; the documents of a block move in step.

The model is never gathered in one place, and every n-gram counts:

1. tasks cut their documents into blocks of bounded size, with local token numbers;
2. for each order, a block asks about its distinct n-grams. Those with a part that no other block
   has, in learning rows or others, can't occur elsewhere, so their counts are known already; the
   others go, with the block's own counts, to shards by the hash of the n-gram, are summed there and
   come back. A frequent n-gram is one entry from each block, so no key is hot. A shard sums a fixed
   number of blocks' worth of n-grams; beyond FAN shards, the blocks go in groups that are summed by
   FAN shards each, and the groups' sums are summed in a second level by finer shards, so a block
   never sends more than FAN messages and messages stay in proportion to the blocks;
3. each block then holds the part of the automaton that its texts can reach, as tables of weight and
   next state for each place and state, and traverses it.

N-grams are compared by 64-bit hashes of their tokens (hashed words, then mixing). Special cases: null
and empty texts have one token, the end; rows repeat freely; without learning rows every token is
unknown; an empty table gives no rows; a null id counts as the empty text for the fold; whole texts are scored, a
very long one as a block of its own; extra columns may have any names. `query` rounds both scores to six decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import crc_mod, cut, hashed_words, in_step, mixed, partitions, store

#: Tokens of a block; a longer document makes a block of its own.
BLOCK_TOKENS = 1 << 19
#: Blocks' worth of n-grams that one shard sums; shards that one block or group sends to.
BLOCKS_PER_SHARD, FAN = 16, 4096
#: Characters of text whose blocks one task holds the messages of.
TASK_CHARS = 64 << 20


def pack(a: np.ndarray) -> bytes:
    """Compressed byte planes: all lowest bytes, then all next ones, and so on."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


#: The hash of the end token; a word's hash is its value only by chance.
_END = np.uint64(0x9FB21C651E98DF25)
_BLOCK = "block long, ids array<long>, learn binary, lengths binary, tokens binary, hashes binary"


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's number among them."""
    by = np.argsort(x)
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[by[1:]] != x[by[:-1]]
    number = np.empty(len(x), dtype=np.int64)
    number[by] = np.cumsum(new) - 1
    return x[by[new]], number


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """(id, text, learn) rows to blocks of numbered tokens."""
    key = TaskContext.get().partitionId() << 32
    words: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    ids: list[int | None] = []
    learn: list[bool] = []
    count = 0

    def block():
        nonlocal key, words, lengths, ids, learn, count
        hashes, tokens = _numbered(np.concatenate(words))
        row = [
            pa.array([key], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
            *(pa.array([pack(a)], pa.binary()) for a in (np.array(learn, dtype=np.uint8), np.concatenate(lengths).astype(np.int32), tokens.astype(np.int32), hashes)),
        ]
        key, words, lengths, ids, learn, count = key + 1, [], [], [], [], 0
        return pa.RecordBatch.from_arrays(row, names=["block", "ids", "learn", "lengths", "tokens", "hashes"])

    for b in batches:
        chars = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < b.num_rows:  # texts of about a block's size are read at a time
            end = max(begin + 1, int(np.searchsorted(chars, (chars[begin - 1] if begin else 0) + 4 * block_tokens)))
            part = b.slice(begin, end - begin)
            h, per_text = hashed_words(part.column(1))
            of_text = np.cumsum(per_text)
            with_ends = np.insert(h, of_text, _END)
            lengths.append(per_text + 1)
            words.append(with_ends)
            ids += part.column(0).to_pylist()
            learn += part.column(2).to_pylist()
            count += len(with_ends)
            begin = end
            if count >= block_tokens:
                yield block()
    if ids:
        yield block()


def _mix(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(context * np.uint64(0x9E3779B97F4A7C15) + token + np.uint64(0xD1B54A32D192ED03))


def _digit(keys: np.ndarray, parts: int, skip: int = 1) -> np.ndarray:
    """Which of `parts` equal ranges of 64-bit keys each is in; with `skip` ranges before, the next digit inside one of them."""
    high = keys >> np.uint64(32)
    if skip > 1:
        high = (high * np.uint64(skip)) & np.uint64(0xFFFFFFFF)
    return ((high * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Grams:
    """A block's distinct n-grams of one order: number at each place (-1: none), key and counts.

    Counts have two rows: in learning rows, and in the others; `local` in the block, `all` everywhere.
    """

    def __init__(self, at: np.ndarray, keys: np.ndarray, local: np.ndarray, settled: np.ndarray):
        self.at, self.keys, self.local, self.settled = at, keys, local, settled
        self.all = local.copy()

    @property
    def total(self) -> np.ndarray:
        return self.all[0]

    def asked(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the n-grams to ask about, in the order of their keys, and where each shard's begin."""
        i = np.nonzero(~self.settled)[0]
        i = i[np.argsort(self.keys[i])]  # sorted keys have compressible high bytes
        return i, np.searchsorted(_digit(self.keys[i], shards), np.arange(shards + 1))

    def answer(self, shards: int, answers: list[tuple[int, bytes]]) -> None:
        i, begins = self.asked(shards)
        for shard, packed in answers or []:
            self.all[:, i[begins[shard] : begins[shard + 1]]] = unpack(packed, np.int64).reshape(2, -1)


class Block:
    def __init__(self, row: dict):
        self.number, self.ids = row["block"], row["ids"]
        self.learn = unpack(row["learn"], np.uint8).astype(bool)
        self.lengths = unpack(row["lengths"], np.int32).astype(np.int64)
        self.tokens = unpack(row["tokens"], np.int32).astype(np.int64)
        self.hashes = unpack(row["hashes"], np.uint64)
        self.learned = np.repeat(self.learn, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.orders: list[Grams] = []

    def next_order(self) -> Grams:
        if not self.orders:
            local = np.stack([np.bincount(self.tokens[x], minlength=len(self.hashes)) for x in (self.learned, ~self.learned)])
            g = Grams(self.tokens, self.hashes, local, np.zeros(len(self.hashes), dtype=bool))
        else:
            low = self.orders[-1]
            context = np.concatenate([[-1], low.at[:-1]])
            context[self.starts] = -1
            ok = np.nonzero(context >= 0)[0]
            pairs, inverse = _numbered(context[ok] * len(self.hashes) + self.tokens[ok])
            at = np.full(len(self.tokens), -1, dtype=np.int64)
            at[ok] = inverse
            local = np.stack([np.bincount(inverse[x[ok]], minlength=len(pairs)) for x in (self.learned, ~self.learned)])
            head, token = np.divmod(pairs, max(1, len(self.hashes)))
            tail = np.empty(len(pairs), dtype=np.int64)
            tail[inverse] = low.at[ok]
            alone = (low.all == low.local).all(axis=0)  # no other block has it
            g = Grams(at, _mix(low.keys[head], self.hashes[token]), local, alone[head] | alone[tail])
        self.orders.append(g)
        return g

    def score(self, n_all: int, n_distinct: int, mu: float) -> dict[str, np.ndarray]:
        """Columns of the result for the block's documents."""
        one = self.orders[0]
        known = one.total[one.at] > 0
        p = (one.total + 1.0)[one.at] / (n_all + n_distinct + 1)
        base = np.log10(p)
        arcs, fails, has = [base], [np.zeros(len(p))], [np.ones(len(p), dtype=bool)]
        for low, high in zip(self.orders, self.orders[1:], strict=False):
            context = np.concatenate([[-1], low.at[:-1]])
            context[self.starts] = -1
            c_h = np.where(context >= 0, low.total[context], 0)
            c_hw = np.where(high.at >= 0, high.total[high.at], 0)
            p = (c_hw + mu * p) / (c_h + mu)
            arcs.append(np.log10(p))
            fails.append(np.log10(mu / (c_h + mu)))
            has.append(c_hw > 0)
        # what each state does at each place: its own arc, or else its failure arc's weight and what the shorter state does
        top = len(self.orders) - 1
        gain, after = [arcs[0]], [np.where(known, min(1, top), 0).astype(np.int8)]  # an unknown token leads back to the root
        for m in range(1, top + 1):
            gain.append(np.where(has[m], arcs[m], fails[m] + gain[m - 1]))
            after.append(np.where(has[m], np.int8(min(m + 1, top)), after[m - 1]))
        place, active = in_step(self.lengths)
        gains, afters = np.empty((len(place), top + 1)), np.empty((len(place), top + 1), dtype=np.int8)
        gains[place], afters[place] = np.stack(gain, axis=1), np.stack(after, axis=1)
        longest_first = np.argsort(-self.lengths, kind="stable")
        total = np.zeros(len(self.lengths))
        state = np.zeros(len(self.lengths), dtype=np.int64)  # tokens of the context that each document is in
        flat_gain, flat_after, begin, width = gains.ravel(), afters.ravel(), 0, top + 1
        for n in active.tolist():
            arc = np.arange(begin * width, (begin + n) * width, width) + state[:n]
            total[:n] += flat_gain[arc]
            state[:n] = flat_after[arc]
            begin += n
        score = np.empty_like(total)
        score[longest_first] = total
        sums = lambda a: np.add.reduceat(a, self.starts)
        return {"n_tokens": self.lengths, "n_known": sums(known.astype(np.int64)), "base_score": sums(base), "score": score}


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of a shard's messages, their summed counts in learning rows and others, and each message's places."""
    keys = [unpack(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(x, np.int64).reshape(2, -1) for x in table.column("counts").to_pylist()], axis=1)
    distinct, number = _numbered(np.concatenate(keys))
    total, others = (np.bincount(number, weights=c, minlength=len(distinct)).astype(np.int64) for c in counts)
    return distinct, total, others, np.split(number, np.cumsum([len(k) for k in keys])[:-1])


_ANSWER = "block long, shard int, totals binary, known long, occurrences long"
_ASKED = "shard int, block long, keys binary, counts binary"


def _answers(blocks: list[int], shard: int, rows: list[bytes], total: np.ndarray) -> pa.Table:
    """A row for each message, and one (-1) with how many n-grams learning rows have and how often."""
    n = len(rows)
    return pa.table({
        "block": pa.array([*blocks, -1], pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int32()), "totals": pa.array([*rows, None], pa.binary()),
        "known": pa.array([None] * n + [int((total > 0).sum())], pa.int64()), "occurrences": pa.array([None] * n + [int(total.sum())], pa.int64()),
    })


def _sum_shard(table: pa.Table) -> pa.Table:
    """Sums the counts of equal n-grams over the messages of a shard (of one second-level shard, where there is one)."""
    _, total, others, parts = _merged(table)
    return _answers(table.column("block").to_pylist(), table.column("shard")[0].as_py(), [pack(np.concatenate([total[p], others[p]])) for p in parts], total)


def _sum_group(table: pa.Table, shards: int, groups: int) -> pa.Table:
    """A group's sums for a shard, one message for each second-level shard of it."""
    distinct, total, others, _ = _merged(table)
    begins = np.searchsorted(_digit(distinct, groups, shards), np.arange(groups + 1))
    full = [i for i in range(groups) if begins[i] < begins[i + 1]]
    cut_at = [slice(begins[i], begins[i + 1]) for i in full]
    n = len(full)
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()] * n, pa.int32()), "sub": pa.array(full, pa.int32()), "block": pa.array([table.column("group")[0].as_py()] * n, pa.int64()),
        "keys": pa.array([pack(distinct[c]) for c in cut_at], pa.binary()), "counts": pa.array([pack(np.concatenate([total[c], others[c]])) for c in cut_at], pa.binary()),
    })


def _hand_down(asked: pa.Table, sums: pa.Table) -> pa.Table:
    """A group's messages to a shard and the whole sums of its distinct n-grams, by second-level shard: the answers."""
    if not asked.num_rows:
        return _answers([], 0, [], np.zeros(0, np.int64)).slice(0, 0)
    _, _, _, parts = _merged(asked)
    sums = sums.sort_by("sub")
    whole = np.concatenate([unpack(x, np.int64).reshape(2, -1) for x in sums.column("totals").to_pylist()], axis=1)
    rows = [pack(whole[:, p].ravel()) for p in parts]
    return _answers(asked.column("block").to_pylist(), asked.column("shard")[0].as_py(), rows, np.zeros(0, np.int64)).slice(0, len(rows))


def _summed(asked: DataFrame, shards: int, groups: int) -> DataFrame:
    """Answers to messages (shard, block, keys, counts): in one level, or by groups of blocks and then over the groups."""
    if groups == 1:
        return asked.groupBy("shard").applyInArrow(_sum_shard, _ANSWER)
    asked = store(asked.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("long")))
    by_group = asked.groupBy("group", "shard").applyInArrow(lambda t: _sum_group(t, shards, groups), "shard int, sub int, block long, keys binary, counts binary")

    def both(t: pa.Table) -> pa.Table:
        return _sum_shard(t).append_column("sub", pa.array([t.column("sub")[0].as_py()] * (t.num_rows + 1), pa.int32()))

    whole = store(by_group.groupBy("shard", "sub").applyInArrow(both, f"{_ANSWER}, sub int"))
    sums = whole.where("block >= 0").withColumnRenamed("block", "group")
    down = asked.groupBy("group", "shard").cogroup(sums.groupBy("group", "shard")).applyInArrow(_hand_down, _ANSWER)
    return down.unionByName(whole.where("block < 0").drop("sub"))


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn=None, order: int = 3, mu: float = 4.0,
    block_tokens: int = BLOCK_TOKENS, blocks_per_shard: int = BLOCKS_PER_SHARD, fan: int = FAN,
) -> DataFrame:
    """For every row: id, learned, n_tokens, n_known, train_tokens, base_score, score.

    learn: predicate for the rows that the model is estimated from; order: tokens of the longest n-gram.
    Sizes of blocks and shards move work and memory, not results.
    """
    spark = docs.sparkSession
    flagged = docs.select(F.col(id_col).cast("long").alias("id"), text_col, F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)).alias("learn"))
    chars = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(partitions(spark), -(-chars // TASK_CHARS))
    blocks = cut(flagged.mapInArrow(lambda it: _blocks(it, block_tokens), _BLOCK).repartition(n, "block"))
    needed = max(n, -(-blocks.select("block").count() // blocks_per_shard))
    shards, groups = min(needed, fan), -(-needed // fan)
    answers: list[DataFrame] = []

    def ready(row: dict, upto: int) -> Block:
        b = Block(row)
        for k in range(upto):
            b.next_order().answer(shards, [(x["shard"], x["totals"]) for x in row[f"r{k}"] or []])
        return b

    def with_answers() -> DataFrame:
        out = blocks
        for k, a in enumerate(answers):
            got = a.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "totals")).alias(f"r{k}"))
            out = out.join(got, "block", "left")
        return out

    def ask(upto: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    b = ready(batch.slice(at, 1).to_pylist()[0], upto)
                    g = b.next_order()
                    i, begins = g.asked(shards)
                    full = np.nonzero(begins[1:] > begins[:-1])[0].tolist()
                    parts = [i[begins[s] : begins[s + 1]] for s in full]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(full, pa.int32()), pa.array([b.number] * len(full), pa.int64()),
                        pa.array([pack(g.keys[p]) for p in parts], pa.binary()), pa.array([pack(g.local[:, p].ravel()) for p in parts], pa.binary()),
                    ], names=["shard", "block", "keys", "counts"])

        return rows

    for k in range(order):
        answers.append(store(_summed(with_answers().mapInArrow(ask(k), _ASKED), shards, groups)))
    ends = answers[0].where("block < 0").agg(F.sum("known"), F.sum("occurrences")).first()
    n_distinct, n_all = ends[0] or 0, ends[1] or 0
    schema = f"`{id_col}` long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                b = ready(batch.slice(at, 1).to_pylist()[0], order)
                s = b.score(n_all, n_distinct, mu)
                yield pa.RecordBatch.from_arrays([
                    pa.array(b.ids, pa.int64()), pa.array(b.learn, pa.bool_()), pa.array(s["n_tokens"], pa.int64()), pa.array(s["n_known"], pa.int64()),
                    pa.array(np.full(len(b.ids), n_all), pa.int64()), pa.array(s["base_score"], pa.float64()), pa.array(s["score"], pa.float64()),
                ], names=[id_col, "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers().mapInArrow(traverse, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = lm_scores(docs, learn=crc_mod("doc_id", 7) != 2)
    # six decimals: the order of summation shows beyond them
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", *(F.round(c, 6).alias(c) for c in ("base_score", "score")))


#: crc32 of the id as text, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, u: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295), 4294967295)"""
#: Smoothed trigrams in closed form; `>` stands for the end, which no word equals, as they all get a letter in front.
ORACLE = f"""
WITH t AS (SELECT doc_id, crc32_mod7 <> 2 AS learned, list_append(list_transform(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: 'w' || x), '>') AS w
  FROM (SELECT *, {_CRC} % 7 AS crc32_mod7 FROM documents)),
k AS (SELECT doc_id, learned, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT *, lag(c) OVER d AS b, lag(c, 2) OVER d AS a FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
one AS (SELECT c, count(*) AS n FROM g WHERE learned GROUP BY 1),
two AS (SELECT b, c, count(*) AS n FROM g WHERE learned AND b IS NOT NULL GROUP BY 1, 2),
three AS (SELECT a, b, c, count(*) AS n FROM g WHERE learned AND a IS NOT NULL GROUP BY 1, 2, 3),
z AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS v FROM one),
p AS (SELECT g.doc_id, g.learned, one.n AS n1, z.total, (coalesce(one.n, 0) + 1) / (z.total + z.v + 1) AS p1,
  CASE WHEN g.b IS NULL THEN NULL ELSE coalesce(h1.n, 0) END AS c1, coalesce(two.n, 0) AS n2, CASE WHEN g.a IS NULL THEN NULL ELSE coalesce(h2.n, 0) END AS c2, coalesce(three.n, 0) AS n3
  FROM g CROSS JOIN z LEFT JOIN one ON g.c = one.c LEFT JOIN one h1 ON g.b = h1.c LEFT JOIN two ON g.b = two.b AND g.c = two.c
  LEFT JOIN two h2 ON g.a = h2.b AND g.b = h2.c LEFT JOIN three ON g.a = three.a AND g.b = three.b AND g.c = three.c),
q AS (SELECT *, CASE WHEN c1 IS NULL THEN p1 ELSE (n2 + 4.0 * p1) / (c1 + 4.0) END AS p2 FROM p),
s AS (SELECT *, CASE WHEN c2 IS NULL THEN p2 ELSE (n3 + 4.0 * p2) / (c2 + 4.0) END AS p3 FROM q)
SELECT doc_id, NOT any_value(learned) AS held_out, count(*) AS n_tokens, count(n1) AS n_known, any_value(total) AS train_tokens,
  round(sum(log10(p1)), 6) AS base_score, round(sum(log10(p3)), 6) AS score FROM s GROUP BY doc_id
"""
