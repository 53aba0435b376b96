import hashlib
import heapq
import random
import re
import zlib

import pytest

from strophe.llm import conversations as cv

WS = " \t\n\v\f\r"


def plain(rows):
    """(turn, role, text) of one conversation after damage: the report by best-first search over (cost, audit)."""
    rows = sorted(((t, r or " " if r is None else r, x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, found = [(0, "", 0, "", "")], set()
    while True:
        cost, audit, i, initials, out = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            break
        shape = initials if len(initials) < 2 else "s" * (initials[0] == "s") + "ua" + "u" * (len(initials.lstrip("s")) % 2)
        if (i, shape) in found:
            continue
        found.add((i, shape))
        nexts = [("I", i, role, 5, f"{role}:") for role in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            nexts.append(("D", i + 1, "", 2, None))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                nexts.append(("K", i + 1, role, more, f"{role}:{text}"))
                nexts += [("R", i + 1, other, 1 + more, f"{other}:{text}") for other in ("user", "assistant")]
        for edit, j, role, more, written in nexts:
            now = initials + role[:1]
            if edit != "D" and (not role or not re.fullmatch("s?(ua)*u?", now)):
                continue
            heapq.heappush(queue, (cost + more, audit + edit, j, now, out if written is None else f"{out}\x00{written}"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    repaired = out[1:].replace("\x00", "\n")
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())


def plainly_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def reports(rows):
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    return {conv: plain(r) for conv, r in by.items()}


TEXTS = ["Hi.", "Yes!", "No?", "cut", "", " \t", "Hi. ", "x.\ny", "Well. ", None, "é.", "a", "Hi.\v"]
ROLES = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "User", "ubot"]


def some(seed, convs, turns):
    rnd = random.Random(seed)
    return [(c, rnd.choice([t, t, t, t + 3, None]), rnd.choice(ROLES), rnd.choice(TEXTS)) for c in range(convs) for t in range(rnd.randrange(1, turns))]


@pytest.mark.parametrize("block", [4096, 3])
def test_repair_equals_a_search_over_all_edits(spark, block):
    """Nulls, blank and repeated turns, ties, roles of other names; in one piece and cut into blocks of three turns."""
    rows = some(block, 60, 14)
    want = reports(rows)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = cv.report(docs, cv.repaired_turns(docs, block=block)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_blocks_of_a_long_conversation_equal_one_piece(spark):
    """One conversation holds most rows, and many turns of it are alike."""
    rnd = random.Random(5)
    rows = [(7, t, rnd.choice(ROLES), rnd.choice([*TEXTS, f"{t}.", f"{t}!", str(t)])) for t in range(3000)] + some(9, 5, 6)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    one = {r.conv_id: r for r in cv.report(docs, cv.repaired_turns(docs)).collect()}
    many = {r.conv_id: r for r in cv.report(docs, cv.repaired_turns(docs, block=64)).collect()}
    assert one == many and len(one) == 6 and len(one[7].audit) >= 3000


def test_turns_hold_the_grammar_and_the_edits(spark):
    rows = some(11, 30, 10)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {}
    for r in cv.repaired_turns(docs).collect():
        found.setdefault(r.conv, []).append(r)
    for turns in found.values():
        turns.sort(key=lambda r: r.step)
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns if r.edit != "D"))
        assert all(r.edit == "D" for r in turns if r.fault in ("blank", "duplicate"))


def test_empty_and_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, block string, conv string, rank string"
    odd = spark.createDataFrame([(None, None, None, None, "x", "y", "z"), (None, None, "user", "Hi.", "x", "y", "z"), (1, 1, "user", "Hi." * 100_000, "x", "y", "z")], schema)
    got = {r.conv_id: r for r in cv.report(odd, cv.repaired_turns(odd)).collect()}
    assert tuple(got[None])[1:] == plain([(None, None, None), (None, "user", "Hi.")])
    assert tuple(got[1])[1:] == plain([(1, "user", "Hi." * 100_000)])
    assert cv.report(odd.limit(0), cv.repaired_turns(odd.limit(0))).count() == 0
    lost = cv.report(odd, cv.repaired_turns(odd.where("conv_id = 1"))).where("conv_id IS NULL").first()
    assert tuple(lost)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_equals_plain_damage_and_search(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | reports(plainly_damaged(rows))
    got = cv.query(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want
