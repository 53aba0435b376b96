"""Speech spans by hysteresis, as a parallel scan over blocks of frames.

The detector is a finite automaton: whether a span is open, and the flags held since its last switch, of which the
last `ring` - 1 are looked at with the next. A block of frames is a map of states to states. All blocks' maps
are made in parallel, a recording's maps composed in order give each block its first state, and
all blocks are then replayed in parallel. A recording of any length meets in one task only as a number for each state and block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.shared import cut, ranked

#: Frames of a block.
BLOCK = 4096


@lru_cache
def automaton(ring: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For flag and state: the next state, is it a switch, and frames held then (that of a switch among them).

    A state is open * 2 ** ring + the held flags as bits under a leading one. More than `least` flags that differ from
    the span's side make a switch, after which none are held.
    """
    half = 1 << ring
    nexts, turns = np.zeros((2, 2 * half), dtype=np.int32), np.zeros((2, 2 * half), dtype=bool)
    held_at = np.zeros((2, 2 * half), dtype=np.int32)
    for state in range(2 * half):
        is_open, held = divmod(state, half)
        n = max(held.bit_length() - 1, 0)
        for flag in (0, 1):
            bits = (held - (1 << n) << 1 | flag) if held else flag
            count = bits.bit_count()
            turn = (n + 1 - count if is_open else count) > least
            held_at[flag, state], turns[flag, state] = n + 1, turn
            kept = min(n + 1, ring - 1)
            nexts[flag, state] = (1 - is_open) * half + 1 if turn else is_open * half + (1 << kept | bits & ((1 << kept) - 1))
    return nexts, turns, held_at


def block_map(flags: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """The state each state leads to over a block's flags."""
    distinct, of = np.arange(nexts.shape[1]), np.arange(nexts.shape[1])
    for i, f in enumerate(flags):
        distinct = nexts[int(f)][distinct]
        if i % 8 == 7 and len(distinct) > 4:  # states soon meet
            distinct, at = np.unique(distinct, return_inverse=True)
            of = at[of]
    return distinct[of].astype(np.int32)


def later_blocks(placed: DataFrame, path: str) -> DataFrame:
    """The frames of paths of more than one block: only their blocks need maps, a path's first block begins closed."""
    return placed.join(placed.where("block > 0").select(path).distinct(), path, "left_semi")


def voiced_spans(frames: DataFrame, path: str = "path", ring: int = 10, share: float = 0.9, frame_s: float = 0.03, block: int = BLOCK) -> DataFrame:
    """Speech spans by hysteresis over a ring of frames that clears at each switch; (-1, -1) if there is none.

    Columns: path, ts, is_speech (null counts as silence); frames of a path are taken by ts. Every path with a frame has a row.
    """
    least, first = share * ring, 1
    kind = dict(frames.dtypes)[path]
    rows = frames.select(path, "ts", F.coalesce("is_speech", F.lit(False)).alias("flag"))
    placed = cut(ranked(rows, "ts", "at", by=path).withColumn("block", F.floor(F.col("at") / block)).select(path, "block", "at", "ts", "flag"))

    def same(pdf: pd.DataFrame, n: int) -> pd.Series:
        return pd.Series([pdf[path].iloc[0]] * n, dtype=object if kind == "string" else pdf[path].dtype)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        nexts, _, _ = automaton(ring, least)
        flags = pdf.sort_values("at")["flag"].to_numpy()
        return pd.DataFrame({path: same(pdf, 1), "block": [pdf["block"].iloc[0]], "map": [block_map(flags, nexts).tobytes()]})

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = first, []
        pdf = pdf.sort_values("block")
        for m in pdf["map"]:
            out.append(state)
            state = int(np.frombuffer(m, dtype=np.int32)[state])
        return pd.DataFrame({path: same(pdf, len(out)), "block": pdf["block"].tolist(), "state": out})

    known = later_blocks(placed, path).groupBy(path, "block").applyInPandas(maps, f"{path} {kind}, block long, map binary").groupBy(path).applyInPandas(entries, f"{path} {kind}, block long, state int")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        nexts, turns, held = automaton(ring, least)
        pdf = pdf.sort_values("at")
        state, out = int(pdf["state"].iloc[0]), []
        half = 1 << ring
        for at, ts, flag in zip(pdf["at"].tolist(), pdf["ts"].tolist(), pdf["flag"].tolist(), strict=True):
            f = int(flag)
            if turns[f, state]:
                out.append((at, None, ts + frame_s) if state >= half else (at, at + 1 - int(held[f, state]), None))
            state = int(nexts[f, state])
        return pd.DataFrame({path: same(pdf, len(out)), "at": [x[0] for x in out], "from": pd.array([x[1] for x in out], dtype="Int64"), "end": pd.array([x[2] for x in out], dtype="Float64")})

    entered = placed.join(known, [path, "block"], "left").withColumn("state", F.coalesce("state", F.lit(first)))
    turned = cut(entered.groupBy(path, "block").applyInPandas(replay, f"{path} {kind}, at long, from long, end double"))
    switches = ranked(turned, "at", "n", by=path).withColumn("span", F.floor(F.col("n") / 2).cast("int"))
    begins = switches.where(F.col("from").isNotNull()).select(path, "span", F.col("from").alias("at"))
    begins = placed.select(path, "at", F.col("ts").alias("start")).join(begins, [path, "at"]).select(path, "span", "start")
    whole = placed.groupBy(path).agg((F.max("ts") + frame_s).alias("last"))
    ends = switches.where(F.col("end").isNotNull()).select(path, "span", "end")
    spans = begins.join(ends, [path, "span"], "left")
    found = whole.join(spans, path, "left")
    none = F.col("start").isNull()
    return found.select(path, F.coalesce("span", F.lit(0)).alias("span"), F.coalesce("start", F.lit(-1.0)).alias("start"), F.when(none, -1.0).otherwise(F.coalesce("end", "last")).alias("end"))
