"""Repair of conversation structure by least-cost edits.

A conversation's role initials must read `(s?(ua)+)?`. Keep costs 0, Rerole (to user or assistant) 1, Delete 2
and is forced on blank and repeated turns, Insert (an empty turn of user or assistant, anywhere) 5; a truncated
turn that stays costs 5 more. A backward pass gives the least cost to go at each turn from each state of the
grammar; a forward walk takes, among the edits that keep to that cost, the ASCII-least initial. A state allows
one role for each initial, so the walk gives the ASCII-least audit.

Conversations of up to BLOCK turns are solved in one piece, many to a task. Longer ones are ranked by digit
histograms and cut into blocks: each block is a four-by-four matrix of least costs (min, plus); the products
from the end give each block its costs to go, with which its walk is a map of entry to exit states; these
composed from the front give each block its entry state, and all blocks are walked in parallel. Only a few
numbers of each block meet in one task. Text that a turn repeats is found by grouped minima of places.
The report streams turns in order and holds one at a time; a digest of a whole conversation is a sequential thing
by its definition, so its text passes through one task, without being gathered there.

Special cases: null roles and texts count as one space, so such texts are blank; null turns come first; turns
of equal number go by role, then text; null conversation ids are one conversation; empty texts are blank; texts
are compared whole; repeated rows repeat a turn; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import WS, partitions, store
from strophe.llm.lm_scoring import _CRC
from strophe.llm.minhash_dedup import _groups, _runs
from strophe.llm.ranks import long_digits, radix_ranks

#: Turns that are solved in one piece.
BLOCK = 4096
#: States: nothing read, after s, after u, after a. The state that a rerole or an insert leads to, and the role it gives.
NEXT, GIVEN = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: States that the initials of kept turns lead to.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FAR = 1 << 40
Costs = tuple[int, int, int, int]


def _inserted(c0: int, c1: int, c2: int, c3: int) -> Costs:
    """Costs to go with turns inserted first, where that is cheaper."""
    c2, c3 = min(c2, INSERT + c3), min(c3, INSERT + c2)
    return min(c0, INSERT + c2), min(c1, INSERT + c2), c2, c3


#: Costs to go after the last turn.
END = _inserted(0, FAR, FAR, 0)


@dataclass
class Block:
    """Turns of one conversation, in order: initials of the roles, must they go, are they truncated."""

    initials: list[str]
    gone: list[bool]
    open: list[bool]

    def before(self, after: Costs, initial: str, gone: bool, cut: bool) -> Costs:
        if gone:
            return _inserted(*(DELETE + c for c in after))
        extra = TRUNCATED * cut
        best = [min(DELETE + after[s], REROLE + extra + after[NEXT[s]], extra + after[KEPT[s][initial]] if initial in KEPT[s] else FAR) for s in range(4)]
        return _inserted(*best)

    def to_go(self, end: Costs) -> list[Costs]:
        """Costs to go before each turn, and at the end."""
        out = [end]
        for i in range(len(self.initials) - 1, -1, -1):
            out.append(self.before(out[-1], self.initials[i], self.gone[i], self.open[i]))
        return out[::-1]

    def matrix(self) -> list[list[int]]:
        """Least costs from each state before the block to each state after it."""
        columns = [self.to_go(tuple(0 if s == t else FAR for s in range(4)))[0] for t in range(4)]
        return [[columns[t][s] for t in range(4)] for s in range(4)]

    def walk(self, state: int, to_go: list[Costs], last: bool) -> tuple[list[tuple[str, int, str | None]], int]:
        """Edits (initial, turn's place or -1, role given) from a state, and the state they end in."""
        edits: list[tuple[str, int, str | None]] = []
        i, n = 0, len(self.initials)
        while i < n or (last and to_go[n][state]):
            now, given = to_go[i][state], GIVEN[state]
            if i < n and now == DELETE + to_go[i + 1][state]:
                edits.append(("D", i, None))
                i += 1
            elif now == INSERT + to_go[i][NEXT[state]]:
                edits.append(("I", -1, given))
                state = NEXT[state]
            else:
                kept = KEPT[state].get(self.initials[i])
                if kept is not None and now == TRUNCATED * self.open[i] + to_go[i + 1][kept]:
                    edits.append(("K", i, None))
                    state = kept
                else:
                    edits.append(("R", i, given))
                    state = NEXT[state]
                i += 1
        return edits, state


_TURNS = "conv string, block long, step long, turn long, initial string, fault string, edit string, role string, text string"
_COLS = ["conv", "block", "turn", "role", "text", "initial", "blank", "open", "first"]


def _block(t: pa.Table, a: int, b: int) -> tuple[Block, list[str]]:
    """Rows a to b of a table of _COLS as a block, and their faults."""
    part = {c: t.column(c).slice(a, b - a).to_pylist() for c in ("role", "text", "initial", "blank", "open", "first")}
    seen: set[tuple[str, str]] = set()
    faults = []
    for role, text, blank, cut, first in zip(part["role"], part["text"], part["blank"], part["open"], part["first"], strict=True):
        if first is None:
            first = (role, text) not in seen
            seen.add((role, text))
        faults.append("blank" if blank else "duplicate" if not first else "truncated" if cut else "")
    return Block(part["initial"], [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults]), faults


def _written(t: pa.Table, a: int, block: Block, faults: list[str], edits: list[tuple[str, int, str | None]]) -> pa.RecordBatch:
    turn, role, text = (t.column(c).slice(a, len(faults)).to_pylist() for c in ("turn", "role", "text"))
    rows = []
    for edit, i, given in edits:
        if edit == "I":
            rows.append((None, None, None, edit, given, ""))
        else:
            gone = edit == "D"
            rows.append((turn[i], block.initials[i], faults[i], edit, None if gone else given or role[i], None if gone else text[i]))
    n = len(rows)
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = [pa.int64(), *[pa.string()] * 5]
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([t.column("conv")[a].as_py()] * n, pa.string()), pa.array([t.column("block")[a].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), *arrays], names=[c.split(" ")[0] for c in _TURNS.split(", ")])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations, sorted: their edited turns."""
    for t in _runs(batches, 1):
        made = []
        for a, b in _groups(t, 1) if t.num_rows else ():
            block, faults = _block(t, a, b)
            edits, _ = block.walk(0, block.to_go(END), True)
            made.append(_written(t, a, block, faults, edits))
        yield from pa.Table.from_batches(made).combine_chunks().to_batches() if made else ()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _runs(batches, 2):
        for a, b in _groups(t, 2) if t.num_rows else ():
            costs = [c for row in _block(t, a, b)[0].matrix() for c in row]
            yield pa.RecordBatch.from_pylist([{"conv": t.column("conv")[a].as_py(), "block": t.column("block")[a].as_py(), "costs": costs}])


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs to go after each block of one conversation, from its matrices; is it the last?"""
    pdf = pdf.sort_values("block", ascending=False)
    after, out = np.array(END), []
    for m in pdf["costs"]:
        out.append(after)
        after = (np.asarray(m).reshape(4, 4) + after).min(axis=1)
    return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "end": [x.tolist() for x in out], "last": np.arange(len(out)) == 0})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the costs after them, sorted: the state in which a walk from each state leaves."""
    for t in _runs(batches, 2):
        for a, b in _groups(t, 2) if t.num_rows else ():
            block, _ = _block(t, a, b)
            to_go = block.to_go(tuple(t.column("end")[a].as_py()))
            out = [block.walk(s, to_go, False)[1] if to_go[0][s] < FAR else 0 for s in range(4)]
            yield pa.RecordBatch.from_pylist([{"conv": t.column("conv")[a].as_py(), "block": t.column("block")[a].as_py(), "exits": out}])


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of one conversation is entered."""
    pdf = pdf.sort_values("block")
    state, out = 0, []
    for exits in pdf["exits"]:
        out.append(state)
        state = int(exits[state])
    return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "entry": out})


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _runs(batches, 2):
        for a, b in _groups(t, 2) if t.num_rows else ():
            block, faults = _block(t, a, b)
            edits, _ = block.walk(t.column("entry")[a].as_py(), block.to_go(tuple(t.column("end")[a].as_py())), t.column("last")[a].as_py())
            yield _written(t, a, block, faults, edits)


def repaired_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per turn and edit: conv (the id as text, 1 in front, or 0 if null), block, step (order), turn, initial and fault
    before the repair, edit, and role and text after it (null where deleted). Rows of a conversation
    of one block are together and in order in their partition."""
    spark = rows.sparkSession
    n = partitions(spark)
    order = [F.asc_nulls_first("turn"), "role", "text"]
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    conv = F.when(F.col(id_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(id_col).cast("string")))
    bare = F.btrim("text", F.lit(WS))
    turns = rows.select(conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    turns = turns.withColumns({"initial": F.substring("role", 1, 1), "blank": bare == "", "open": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    turns = store(turns.withColumn("row", F.monotonically_increasing_id()))
    long = store(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("conv"))
    whole = turns.join(long, "conv", "left_anti").withColumns({"block": F.lit(0).cast("long"), "first": F.lit(None).cast("boolean")})
    out = whole.select(*_COLS).repartition(n, "conv").sortWithinPartitions("conv", *order).mapInArrow(_solve, _TURNS)
    if long.isEmpty():
        return out
    key = F.concat(long_digits(F.col("turn")), F.hex(F.encode("role", "UTF-8")), F.lit("!"), F.hex(F.encode("text", "UTF-8")), F.lit("!"), long_digits(F.col("row")))
    placed = store(radix_ranks(store(turns.join(long, "conv")), "conv", key, rank="place", total="", bucket=block))
    earliest = placed.groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("is_first"))
    cells = placed.join(earliest, ["conv", "place"], "left").withColumns({"block": F.floor(F.col("place") / block).cast("long"), "first": F.col("is_first").isNotNull()})
    cells = store(cells.select(*_COLS, "place"))
    dealt = lambda df, *more: df.select(*_COLS, *more, "place").repartition(n, "conv", "block").sortWithinPartitions("conv", "block", "place")
    ends = store(dealt(cells).mapInArrow(_matrices, "conv string, block long, costs array<long>").groupBy("conv").applyInPandas(_ends, "conv string, block long, end array<long>, last boolean"))
    after = cells.join(ends, ["conv", "block"])
    entries = dealt(after, "end").mapInArrow(_exits, "conv string, block long, exits array<long>").groupBy("conv").applyInPandas(_entries, "conv string, block long, entry int")
    walked = dealt(after.join(store(entries), ["conv", "block"]), "end", "last", "entry").mapInArrow(_walked, _TURNS)
    return out.unionByName(walked.repartition(n, "conv").sortWithinPartitions("conv", "block", "step"))


_REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


class _Report:
    """One conversation's report, turn by turn."""

    def __init__(self, conv: str):
        self.conv, self.audit, self.digest, self.faults = conv, [], hashlib.sha256(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.low = self.high = self.before = None
        self.distinct = self.illegal = self.cost = 0
        self.initial: str | None = None
        self.begun = False

    def read(self, turn: int | None, initial: str | None, fault: str | None, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        self.cost += _COST[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = initial
            if turn is not None:
                self.distinct += turn != self.before
                self.low = turn if self.low is None else self.low
                self.high = self.before = turn
        if edit != "D":
            self.digest.update(f"{chr(10) * self.begun}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edited turns in order: a report for each conversation. One turn is held at a time."""
    names = [c.split(" ")[0] for c in _REPORT.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    now: _Report | None = None
    done: list[tuple] = []

    def written() -> pa.RecordBatch:
        cols = zip(*done, strict=True) if done else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault", "edit", "role", "text")]
        for conv, *rest in zip(*cols, strict=True):
            if now is None or now.conv != conv:
                if now:
                    done.append(now.row())
                now = _Report(conv)
            now.read(*rest)
        yield written()
        done = []
    if now:
        done.append(now.row())
        yield written()


def report(rows: DataFrame, turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per id of `rows`: faults, cost, audit and digest of its repaired `turns`; zeros where it has none."""
    ids = rows.select(id_col, F.when(F.col(id_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(id_col).cast("string"))).alias("conv")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = {c: F.lit(0).cast("long") for c in counts} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    found = ids.join(turns.mapInArrow(_reports, _REPORT), "conv", "left")
    return found.select(id_col, *(F.coalesce(c, other).alias(c) for c, other in empty.items()))


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults put in by the checksum of id and turn: dropped, emptied, without full stops, twice, or said by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(rows.select("conv_id"), repaired_turns(damaged(rows)))


#: Costs to go turn by turn from the end, then the walk, as recursive queries.
ORACLE = f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.replace("CAST(doc_id AS VARCHAR)", "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM o WHERE kind <> 0),
m AS (SELECT *, row_number() OVER c - 1 AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, trim(text, E' \\t\\n\\x0b\\x0c\\r') AS bare, left(role, 1) AS c0,
  lag(left(role, 1)) OVER c AS c1 FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
x AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM m),
y AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more,
  CASE WHEN fault IN ('blank', 'duplicate') OR c0 <> 's' THEN 1000000 ELSE 0 END AS ns, CASE WHEN fault IN ('blank', 'duplicate') OR c0 <> 'u' THEN 1000000 ELSE 0 END AS nu,
  CASE WHEN fault IN ('blank', 'duplicate') OR c0 <> 'a' THEN 1000000 ELSE 0 END AS na, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE 1 END AS r FROM x),
n AS (SELECT conv_id, count(*) AS n FROM y GROUP BY 1),
b AS (SELECT conv_id, n AS i, 0 AS v0, 10 AS v1, 5 AS v2, 0 AS v3 FROM n
  UNION ALL SELECT conv_id, i, least(o0, 5 + o2, 10 + o3), least(o1, 5 + o2, 10 + o3), least(o2, 5 + o3), least(o3, 5 + o2) FROM (
    SELECT b.conv_id, y.i, least(2 + v0, more + ns + v1, more + nu + v2, more + r + v2) AS o0, least(2 + v1, more + nu + v2, more + r + v2) AS o1,
      least(2 + v2, more + na + v3, more + r + v3) AS o2, least(2 + v3, more + nu + v2, more + r + v2) AS o3 FROM b JOIN y ON y.conv_id IS NOT DISTINCT FROM b.conv_id AND y.i = b.i - 1)),
v AS (SELECT conv_id, i, unnest([0, 1, 2, 3]) AS s, unnest([v0, v1, v2, v3]) AS v FROM b),
-- for each turn and state the first edit that keeps to the least cost
e AS (SELECT v.conv_id, v.i, v.s, CASE v.s WHEN 2 THEN 3 ELSE 2 END AS given, CASE WHEN y.i IS NULL AND v.v = 0 THEN '' WHEN y.i IS NOT NULL AND v.v = 2 + w.v THEN 'D' WHEN v.v = 5 + g.v THEN 'I'
    WHEN v.s = 0 AND c0 = 's' AND NOT gone AND v.v = more + w1.v THEN 'K' WHEN (CASE v.s WHEN 2 THEN 'a' ELSE 'u' END) = c0 AND NOT gone AND v.v = more + w2.v THEN 'K' ELSE 'R' END AS edit,
    CASE WHEN v.s = 0 AND c0 = 's' THEN 1 WHEN v.s = 2 THEN 3 ELSE 2 END AS kept, y.role, y.text
  FROM v LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM v.conv_id AND y.i = v.i LEFT JOIN v w ON w.conv_id IS NOT DISTINCT FROM v.conv_id AND w.i = v.i + 1 AND w.s = v.s
  LEFT JOIN v w1 ON w1.conv_id IS NOT DISTINCT FROM v.conv_id AND w1.i = v.i + 1 AND w1.s = 1 LEFT JOIN v w2 ON w2.conv_id IS NOT DISTINCT FROM v.conv_id AND w2.i = v.i + 1 AND w2.s = CASE v.s WHEN 2 THEN 3 ELSE 2 END
  LEFT JOIN v g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i AND g.s = CASE v.s WHEN 2 THEN 3 ELSE 2 END),
a AS (SELECT conv_id, 0 AS i, 0 AS s, '' AS audit, '' AS repaired FROM n
  UNION ALL SELECT a.conv_id, CASE WHEN edit = 'I' THEN a.i ELSE a.i + 1 END, CASE edit WHEN 'D' THEN a.s WHEN 'K' THEN kept ELSE given END, audit || edit,
    repaired || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN E'\\n' || role || ':' || text WHEN 'R' THEN E'\\n' || CASE given WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || text ELSE E'\\n' || CASE given WHEN 3 THEN 'assistant' ELSE 'user' END || ':' END
  FROM a JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id AND e.i = a.i AND e.s = a.s WHERE edit <> ''),
f AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(repaired, length(audit)) AS repaired FROM a GROUP BY 1),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (c1 || c0 NOT IN ('su', 'ua', 'au')) AS illegal FROM y GROUP BY 1)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(v0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(repaired, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) z LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id
LEFT JOIN (SELECT conv_id, v0 FROM b WHERE i = 0) b0 ON b0.conv_id IS NOT DISTINCT FROM z.conv_id
"""
