"""Audio tokens and codec codes: time arithmetic and array functions (25 tokens a second)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE, SAMPLE_RATE = 25, 48_000
#: Codecs: codebook size, codebooks, first id, last id (fixed values).
CODECS = {
    "dac16k": (1024, 4, 32022, 36117), "dac44k": (1024, 9, 36118, 45333), "xcodec": (1024, 12, 45334, 57621),
    "semantic/s": (16384, 1, 59158, 75541), "semantic/a": (8192, 1, 75542, 83733),
}


def token_index(seconds: Column, n: Column | None = None) -> Column:
    """Seconds to a token index, truncated; clamped to [0, n] if n is given."""
    i = (seconds * RATE).cast("int")
    return i if n is None else F.least(F.greatest(i, F.lit(0)), n.cast("int"))


def token_slice(tokens: Column, start_s: Column, end_s: Column) -> Column:
    """Tokens of [start, end), clamped."""
    a, b = token_index(start_s, F.size(tokens)), token_index(end_s, F.size(tokens))
    return F.slice(tokens, a + 1, F.greatest(b - a, F.lit(0)))


def audio_text(tokens: Column) -> Column:
    """`[SOA]<AUDIO_n>...[EOA]`; joined as one list, without a step for each token."""
    said = lambda x: F.when(F.size(x) > 0, F.concat(F.lit("<AUDIO_"), F.array_join(x.cast("array<string>"), "><AUDIO_"), F.lit(">"))).otherwise(F.when(x.isNotNull(), ""))
    return F.concat(F.lit("[SOA]"), F.transform(F.array(tokens), said)[0], F.lit("[EOA]"))


def inner(a: Column) -> Column:
    """Without the first and last element."""
    return F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0)))


def samples_of_tokens(n: Column) -> Column:
    """Samples that n tokens last."""
    return F.floor(n / F.lit(RATE) * SAMPLE_RATE).cast("long")


def token_count(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    """Tokens that so many samples encode to."""
    return F.floor(samples / F.lit(rate) * RATE).cast("long") + 1


def offset_codes(codes: Column, codec: str) -> Column:
    """Codebook-major rows of codes to global ids; out-of-range codes raise."""
    size, _, first, _ = CODECS[codec]
    check = F.forall(codes, lambda row: F.forall(row, lambda x: (x >= 0) & (x < size)))
    ids = F.transform(codes, lambda row, k: F.transform(row, lambda x: x + k * size + first))
    return F.when(F.assert_true(check, F.lit(f"code outside codebook of {size}")).isNull(), ids)


def restore_codes(ids: Column, codec: str) -> Column:
    """The inverse of offset_codes."""
    size, _, first, _ = CODECS[codec]
    return F.transform(ids, lambda row, k: F.transform(row, lambda x: x - k * size - first))


def interleave(codes: Column) -> Column:
    """K rows of T codes to one row of T * K, frame by frame."""
    frames = F.transform(F.sequence(F.lit(1), F.size(codes[0])), lambda t: F.transform(codes, lambda row: F.element_at(row, t)))
    return F.when(F.size(codes[0]) > 0, F.flatten(frames)).otherwise(F.slice(codes[0], 1, 0))


def deinterleave(flat: Column, k: int) -> Column:
    """The inverse of interleave."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda r: F.filter(flat, lambda x, i: F.pmod(i, F.lit(k)) == r))


def codec_of(ids: Column) -> Column:
    """The codec whose range holds all ids; null if none does."""
    out = F.lit(None).cast("string")
    for name, (_, _, lo, hi) in CODECS.items():
        out = F.coalesce(out, F.when((F.array_min(ids) >= lo) & (F.array_max(ids) <= hi), name))
    return out


def split_tracks(tokens: Column) -> tuple[Column, Column]:
    """Even and odd places as two tracks; an odd last token goes."""
    even = F.slice(tokens, 1, F.size(tokens) - F.pmod(F.size(tokens), F.lit(2)))
    return F.filter(even, lambda x, i: F.pmod(i, F.lit(2)) == 0), F.filter(even, lambda x, i: F.pmod(i, F.lit(2)) == 1)


def blocks(tokens: Column, frames: int = 300) -> Column:
    """Whole blocks of six seconds at 50 frames, then the remainder if there is one."""
    starts = F.filter(F.sequence(F.lit(0), F.size(tokens), F.lit(frames)), lambda s: s < F.size(tokens))
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, frames))


def frame_starts(n: Column, size: int) -> Column:
    """Starts of frames that end strictly before n; an exact last frame is dropped."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(0)), F.lit(size)), lambda s: s + size < n)


def tail(tokens: Column, k: int) -> Column:
    """The last k tokens, all if there are fewer."""
    return F.slice(tokens, F.greatest(F.size(tokens) - k + 1, F.lit(1)), k)


def repair_by_mode(codes: Column, size: int = 1024) -> Column:
    """Codes outside [0, size) become the row's most frequent value (first seen of equals; it may be invalid itself)."""
    seen = F.array_distinct(codes)
    counts = F.transform(seen, lambda v: F.size(F.filter(codes, lambda x: x == v)))
    mode = F.element_at(seen, F.array_position(counts, F.array_max(counts)).cast("int"))
    return F.when(F.size(codes) > 0, F.transform(codes, lambda x: F.when((x < 0) | (x >= size), mode).otherwise(x))).otherwise(codes)


def rms_db(samples: Column) -> Column:
    """Level of samples in decibels."""
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples)
    return 20 * F.log10(F.sqrt(mean) + 1e-8)


def has_vocal(samples: Column, least_db: float = -35.0) -> Column:
    """Louder than the limit; null or empty (unreadable) is false."""
    return F.coalesce(F.when(F.size(samples) > 0, rms_db(samples) > least_db), F.lit(False))


def cut_bounds(duration: Column, longest: float = 30.0, at: Column | None = None) -> tuple[Column, Column]:
    """The whole of a short recording, else its middle (or a window at the share `at` of the slack)."""
    start = F.when(duration <= longest, F.lit(0.0)).otherwise((duration - longest) * (F.lit(0.5) if at is None else at))
    return start, F.when(duration <= longest, duration).otherwise(start + longest)


def cosine(a: Column, b: Column) -> Column:
    """M06, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def limited(samples: Column, threshold: float = 0.8) -> Column:
    """Scaled down to the threshold where the peak passes it."""
    peak = F.array_max(F.transform(samples, F.abs))
    return F.when(peak > threshold, F.transform(samples, lambda x: x / (peak / threshold))).otherwise(samples)


def fake_stereo(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    """The track beside itself, delayed by ten milliseconds and at 0.8 of its level; the delay is silent."""
    delay = int(0.01 * rate)
    late = F.transform(samples, lambda x, i: F.when(i < delay, 0.0).otherwise(F.try_element_at(samples, (i - delay + 1).cast("int")) * 0.8))
    return F.array(samples, late)


def cross_faded(a: Column, b: Column, overlap: int) -> Column:
    """Two pieces joined over `overlap` samples (two at least), the first fading out linearly while the second fades in."""
    head, tail_ = F.slice(a, F.lit(1), F.size(a) - overlap), F.slice(a, F.size(a) - overlap + 1, F.lit(overlap))
    rise = lambda i: i / F.lit(float(overlap - 1))
    mixed = F.transform(F.arrays_zip(tail_.alias("x"), F.slice(b, 1, overlap).alias("y")), lambda p, i: p["x"] * (1 - rise(i)) + p["y"] * rise(i))
    return F.concat(head, mixed, F.slice(b, F.lit(overlap + 1), F.greatest(F.size(b) - overlap, F.lit(0))))
