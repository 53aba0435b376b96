"""Text functions of the song corpus as Catalyst expressions; IDs are those of the operator inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space that trims and splits must know; the JVM's \s is ASCII only (fixed value).
SPACE = r"\s\x1c-\x1f\u0085   -     　"
#: Symbols that become blanks before phoneme comparison (fixed value).
SIGNALS = r"[ ,。\"，:;&—'.\]\[()?\n-]"
#: Symbols that become breaks in lyrics for baseline models (fixed value).
BREAKS = r"[,。\"，:;&—‘'.\]\[()?\n-]"
#: Sentence ends after which cleaned text breaks its line (fixed value).
ENDS = r"[.,!?:;，。！？；]"
#: Lines of a transcription tool's log (fixed values).
ASR_LOG = (
    "Loaded wav duration:", "DETECTED LANGUAGE", "Detected Language:", "FULL TRANSCRIPTION OF", "Wav duration is longer than",
    "Silero VAD model for segmenting", "saved to", "Retry", "status_code", "Throttling.RateQuota",
)


#: The same white space as single characters (fixed value).
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(WHITE))


def file_stem(path: Column) -> Column:
    """base name without its last extension; a name without a dot is unchanged."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def last_number(path: Column) -> Column:
    """the last run of digits in the stem as long, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(file_stem(path), F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("bigint")


def clean_lyrics(c: Column) -> Column:
    """bracketed marks within a line go, line breaks and runs of blanks become one blank."""
    bare = F.regexp_replace(c, r"\[[^\n]*?\]", "")
    return strip(F.regexp_replace(bare, f"[{SPACE}]+", " "))


def clean_newlines(c: Column) -> Column:
    """one line broken after sentence ends; blanks after apostrophes and doubled blanks go."""
    lines = F.transform(F.split(F.regexp_replace(strip(c), "\r\n?", "\n"), "\n"), strip)
    joined = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    broken = F.regexp_replace(joined, f"({ENDS})[{SPACE}]*", "$1\n")
    tight = F.regexp_replace(F.regexp_replace(broken, f"'[{SPACE}]+", "'"), "[ \t]+", " ")
    return F.coalesce(strip(F.array_join(F.transform(F.split(tight, "\n"), strip), "\n")), F.lit(""))


def signal_filter(c: Column) -> Column:
    """comparison symbols become blanks, runs of blanks one; ends are not trimmed."""
    return F.regexp_replace(F.regexp_replace(c, SIGNALS, " "), " {2,}", " ")


def broken_lyrics(c: Column, mark: str = ".") -> Column:
    """symbols become `mark`, runs collapse, one trailing mark goes."""
    quoted = "\\." if mark == "." else mark
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, BREAKS, mark), f"(?:{quoted}){{2,}}", mark), f"{quoted}\\z", "")


def normalise_tags(c: Column) -> Column:
    """tags of a list; stripped, lower case, non-empty; what follows a first colon (may be empty)."""
    parts = F.filter(F.transform(F.split(c, "[,，.]"), lambda t: F.lower(strip(t))), lambda t: t != "")
    return F.transform(parts, lambda t: F.regexp_replace(t, "^[^:]*:", ""))


def section_tag(c: Column) -> Column:
    """`[tag]` of `[Tag 1 (x)][desc:...`; lower case, no digits, no parentheses; pre-chorus is chorus."""
    raw = F.lower(F.substring(c, F.lit(2), F.greatest(F.instr(c, "[desc:") - 3, F.lit(0))))
    bare = strip(F.regexp_replace(F.regexp_replace(raw, r"\d+", ""), r"\([^)]*\)", ""))
    return F.concat(F.lit("["), F.when(bare == "pre-chorus", "chorus").otherwise(bare), F.lit("]"))


def section_lyrics(c: Column, mark: str = ".") -> Column:
    """Lyrics between `[lyrics:` and `][phoneme:` with F06 breaks; empty without a block."""
    start, end = F.instr(c, "[lyrics:\n"), F.instr(c, "][phoneme:")
    body = F.substring(c, start + 9, F.when(end == 0, F.length(c) - 1).otherwise(end - 1) - start - 8)
    return F.when(start == 0, F.lit("")).otherwise(broken_lyrics(body, mark))


def structure_label(c: Column) -> Column:
    """verse, chorus and bridge labels unified; others in lower case."""
    low = F.lower(c)
    return F.when(low.startswith("verse"), "[verse]").when(low.contains("chorus"), "[chorus]").when(low.contains("bridge"), "[bridge]").otherwise(F.concat(F.lit("["), low, F.lit("]")))


def lrc_lines(c: Column) -> Column:
    """time-coded lyrics as a list of lines with unified structure labels, framed by start and end."""
    stamp = r"\[\d{2}:\d{2}(?:\.\d+)?\]"
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")
    one = lambda x: F.when(x.rlike(r"^\[[^\]]+\]$") & ~x.rlike("^" + stamp), structure_label(strip(F.substring(x, F.lit(2), F.length(x) - 2)))).otherwise(strip(F.regexp_replace(x, stamp, "")))
    return F.concat(F.array(F.lit("[start]"), F.lit("[intro]")), F.filter(F.transform(lines, one), lambda x: x != ""), F.array(F.lit("[end]")))


def between(c: Column, start: str, end: str) -> Column:
    """text between two marks; a missing start mark counts as standing one before the text, a missing end as the last character."""
    s, e = F.instr(c, start), F.instr(c, end)
    begin = s + len(start)
    stop = F.when(e == 0, F.length(c) - 1).otherwise(e - 1)
    return F.substring(c, begin, F.greatest(stop - begin + 1, F.lit(0)))


def style_line(c: Column) -> Column:
    """what follows `following style:` up to the line's end, stripped; empty if absent."""
    return strip(F.regexp_extract(c, "following style:([^\n]*)", 1))


def lyric_blocks(c: Column) -> Column:
    """`[tag]` blocks, each as the tag line, its content and an empty line."""
    pattern = r"\[([^\]]+)\]([^\[]*)"
    tags, texts = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(tags, texts, lambda t, x: F.concat(F.lit("["), t, F.lit("]\n"), strip(x), F.lit("\n\n")))


def bracket_section(c: Column) -> Column:
    """the first bracket's content that starts with a letter and holds only label characters; null if none."""
    return F.nullif(strip(F.regexp_extract(c, r"\[([A-Za-z][A-Za-z0-9\s\-\(\)]*)\]", 1)), F.lit(""))


def section_key(c: Column) -> Column:
    """F16: for matching: no blanks, lower case, no trailing digits."""
    return F.regexp_replace(F.lower(F.replace(c, F.lit(" "), F.lit(""))), r"\d+$", "")


def clean_description(c: Column) -> Column:
    """stripped, without a leading `[desc]` and without outer brackets."""
    bare = strip(F.regexp_replace(strip(c), r"^\[desc\]", ""))
    return F.when(bare.startswith("[") & bare.endswith("]"), strip(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)


def described(c: Column) -> Column:
    """the first `[dsec:...]` or `[desc:...]`, over lines, stripped; null if there is none or it is empty."""
    return F.nullif(strip(F.regexp_extract(c, r"(?s)\[(?:dsec|desc):(.*?)\]", 1)), F.lit(""))


def section_name(c: Column) -> Column:
    """the bracket before a description, else a leading bracket, else `Unknown`."""
    near = r"\[(.*?)\]\[(?:dsec|desc):"
    lead = r"^\[(.*?)\]"
    name = strip(F.regexp_extract(c, lead, 1))
    return F.when(c.rlike(near), strip(F.regexp_extract(c, near, 1))).when(c.rlike(lead) & ~name.isin("dsec", "desc"), name).otherwise("Unknown")


def filename_genre(c: Column, longest: int = 80) -> Column:
    """F19 with W11: a safe name of the leading tags that fit, blanks as hyphens; `Unknown` if empty."""
    safe = strip(F.regexp_replace(F.regexp_replace(c, '[<>:"/\\\\|?*\\x00-\\x1f]', "_"), "^_+|_+$", ""))
    tags = F.transform(F.split(safe, ","), strip)
    fit = F.aggregate(
        tags, F.struct(F.lit("").alias("s"), F.lit(0).alias("n"), F.lit(True).alias("go"), F.lit(0).alias("k")),
        lambda a, t: F.when(a["go"] & (a["n"] + F.length(t) + 1 <= longest), F.struct(F.when(a["k"] == 0, t).otherwise(F.concat(a["s"], F.lit(","), t)).alias("s"), (a["n"] + F.length(t) + 1).alias("n"), F.lit(True).alias("go"), (a["k"] + 1).alias("k")))
        .otherwise(F.struct(a["s"].alias("s"), a["n"].alias("n"), F.lit(False).alias("go"), a["k"].alias("k"))),
    )
    kept = F.when(safe.contains(","), F.when(fit["k"] > 0, fit["s"]).otherwise(tags[0])).otherwise(safe)
    return F.when(c.isNull() | (c == ""), "Unknown").otherwise(F.replace(F.substring(kept, 1, longest), F.lit(" "), F.lit("-")))


def phoneme_lyrics(c: Column) -> Column:
    """lyrics of a `[lyrics:` block without brackets, as sentences; null without a block."""
    start = F.instr(c, "[lyrics:")
    body = F.substring(c, start + 8, F.greatest(F.length(c) - start - 8, F.lit(0)))
    bare = F.regexp_replace(F.regexp_replace(body, r"\[.*?\]", ""), r"[\[\]]", "")
    return F.when(start > 0, F.split(bare, "\n"))


def asr_text(c: Column) -> Column:
    """a transcription tool's output without log lines, markers and segment counts."""
    log = "|".join(x.replace(".", r"\.") for x in ASR_LOG)
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: (x != "") & ~x.rlike(log))
    full = F.transform(lines, lambda x: F.when(x.contains("Full Transcription:"), strip(F.regexp_replace(x, "^.*?Full Transcription:", ""))).otherwise(x))
    done = F.transform(full, lambda x: F.when(x.contains("Segmenting done, total segments") & x.contains("segments:"), strip(F.regexp_extract(strip(F.regexp_replace(x, "^.*?segments:", "")), r"^\d+\s*(.*)", 1))).otherwise(x))
    return strip(F.array_join(F.filter(done, lambda x: x != ""), " "))


def asr_sentences(c: Column) -> Column:
    """structured transcription as (lang, lyric) sentences: language between the first bars, lyric after the last `>`."""
    return F.transform(F.split(c, " <"), lambda x: F.struct(
        F.regexp_extract(F.regexp_replace(x, r"^[^|]*\|", ""), r"^([^|]*)", 1).alias("lang"), F.regexp_replace(x, r"(?s)^.*>", "").alias("lyric")))


def is_cjk(c: Column) -> Column:
    """one character of the basic block or extension A."""
    return c.rlike(r"^[一-鿿㐀-䶿]\z")


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[一-鿿]")


def count_cjk(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, r"[一-鿿]", ""))


def count_other(c: Column) -> Column:
    """characters that are neither CJK, ASCII letters nor white space."""
    rest = F.regexp_replace(c, "[a-zA-Z \n]+", "")  # most of a text, by a class that is quickly tested
    return F.length(F.regexp_replace(rest, f"[\\u4e00-\\u9fffa-zA-Z{SPACE}]", ""))


def audio_tags(c: Column) -> Column:
    """the audio tokens of a turn as one string."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(<AUDIO_\d+>)"), F.lit(1)), "")


def audio_codes(c: Column) -> Column:
    """the audio tokens of a turn as integers."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"<AUDIO_(\d+)>"), F.lit(1)), lambda x: x.cast("int"))


def pretty_bytes(c: Column, largest: str = "TB") -> Column:
    """bytes in units of 1024 with two decimals; from the largest unit on, all in that one."""
    x = c.cast("double")
    units = ("B", "KB", "MB", "GB", "TB")[: ("B", "KB", "MB", "GB", "TB").index(largest) + 1]
    said = [F.concat(F.format_string("%.2f", x / 1024.0**i), F.lit(f" {unit}")) for i, unit in enumerate(units)]
    out = said[-1]
    for i in reversed(range(len(units) - 1)):
        out = F.when(x < 1024.0 ** (i + 1), said[i]).otherwise(out)
    return out


def pretty_speed(c: Column) -> Column:
    return F.concat(pretty_bytes(c), F.lit("/s"))


def segment_prompt(c: Column) -> Column:
    """F33."""
    return F.replace(c, F.lit("[start_of_segment]"), F.lit(""))


def is_ascii_punctuation(c: Column) -> Column:
    """The text is a substring of the ASCII punctuation sequence, the empty text included."""
    return F.lit("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").contains(c)


def has_cjk_punctuation(c: Column) -> Column:
    """Y03."""
    return c.rlike(r"[。，？！；：“”‘’《》〈〉【】『』—…、（）]")


def clock_stamp(seconds: Column) -> Column:
    """`[mm:ss.00]` of whole seconds."""
    return F.format_string("[%02d:%02d.00]", F.floor(seconds / 60).cast("int"), F.pmod(seconds, F.lit(60)).cast("int"))


def spoken_duration(clock: Column) -> Column:
    """`3.15` as `3分15秒`."""
    return F.concat(F.replace(clock, F.lit("."), F.lit("分")), F.lit("秒"))


def clock_seconds(clock: Column) -> Column:
    """Seconds of `m.ss`."""
    parts = F.split(clock, r"\.")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def style_prelude(style: Column) -> Column:
    """the request that opens a conversation (fixed sentences, which outputs must match)."""
    return F.concat(F.lit("Please generate a song in the following style:"), style, F.lit(".\nNext, I will tell you the requirements and lyrics for the song fragment to be generated, section by section.\n"))
