"""Time-coded lyrics: three readings of `[mm:ss.xx]text`, validity and stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions.text import strip

#: A time stamp as lyric files write it (fixed value).
STAMP = r"\[([0-9]{1,2}):([0-9]{1,2})(?:[.:]([0-9]{1,3}))?\]"
#: The same with the minutes of recordings of 100 minutes and more.
LONG_STAMP = STAMP.replace("{1,2}", "{1,6}", 1)
#: The strict stamps of valid files, and those that are stripped (fixed values).
STRICT, STRIPPED = r"\[(\d{2}):(\d{2})(?:\.(\d{2}))?\]", r"\[\d{2}:\d{2}(?:\.\d+)?\]"
#: Seconds a valid file's last stamp comes at least after the start, and at most after the one before (fixed values).
LAST_S, GAP_S = 170.0, 35.0


def _seconds(minute: Column, second: Column, fraction: Column, hundredths: bool) -> Column:
    f = F.coalesce(fraction.try_cast("int"), F.lit(0)).cast("double")
    part = F.when(F.length(fraction) == 2, f / 100).otherwise(f / 1000) if hundredths else f / 1000
    return minute.cast("int") * 60 + second.cast("int") + part


def _lines(c: Column, text_pattern: str, hundredths: bool, stamp: str = STAMP) -> Column:
    whole = stamp + text_pattern
    m, s, f, t = (F.regexp_extract_all(c, F.lit(whole), F.lit(i)) for i in (1, 2, 3, 4))
    z = F.arrays_zip(m.alias("m"), s.alias("s"), f.alias("f"), t.alias("t"))
    return F.transform(z, lambda x: F.struct(_seconds(x["m"], x["s"], x["f"], hundredths).alias("start_s"), strip(x["t"]).alias("text")))


def lines_to_bracket(c: Column, stamp: str = STAMP) -> Column:
    """Text ends at the next bracket; fractions are thousandths whatever their digits; empty texts go."""
    return F.filter(_lines(c, r"([^\[]*)", hundredths=False, stamp=stamp), lambda x: x["text"] != "")


def lines_to_stamp(c: Column) -> Column:
    """Text ends at the next stamp; two digits are hundredths, one or three thousandths; empty texts stay."""
    marked = F.regexp_replace(c, STAMP, "\u0001$0")
    return _lines(marked, "([^\u0001]*)", hundredths=True)


def stamps(c: Column) -> Column:
    """Times of `[dd:dd]` and `[dd:dd.dd]` in seconds."""
    m, s, f = (F.regexp_extract_all(c, F.lit(STRICT), F.lit(i)) for i in (1, 2, 3))
    z = F.arrays_zip(m.alias("m"), s.alias("s"), f.alias("f"))
    return F.transform(z, lambda x: x["m"].cast("int") * 60 + x["s"].cast("int") + F.coalesce(x["f"].try_cast("int"), F.lit(0)) / 100.0)


def strip_stamps(c: Column) -> Column:
    """T04."""
    return F.regexp_replace(c, STRIPPED, "")


def is_valid(c: Column, least_s: float = LAST_S, gap_s: float = GAP_S) -> Column:
    """Two stamps at least, the last no earlier than least_s and no more than gap_s after the one before."""
    t = stamps(c)
    return F.coalesce((F.size(t) >= 2) & (F.try_element_at(t, F.lit(-1)) >= least_s) & (F.try_element_at(t, F.lit(-1)) - F.try_element_at(t, F.lit(-2)) <= gap_s), F.lit(False))
