"""Row-to-row operators with carried state, as windows; grouped pandas only where state can't be a window."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import lrc, text, tokens
from strophe.operators.relational import valid_label
from strophe.shared import ranked


def line_spans(lines: DataFrame, song: str, pos: str, start: str, total_s: Column) -> DataFrame:
    """A line ends where the next one starts, the last at the end of the recording."""
    return lines.withColumn("end_s", F.coalesce(F.lead(start).over(Window.partitionBy(song).orderBy(pos)), total_s))


def sections(lines: DataFrame, song: str, pos: str = "pos", start: str = "start_s", line: str = "text", total: str = "total_s") -> DataFrame:
    """Sections opened by lines with a bracketed label; earlier lines drop, later ones append.

    The last section ends at a trailing stamp without text if there is one, else with the recording.
    Columns: song, sec (from 0), label, start_s, end_s, text, outro_s (the trailing stamp, or null).
    """
    w = Window.partitionBy(song).orderBy(pos)
    whole = Window.partitionBy(song)
    label = text.bracket_section(F.col(line))
    marked = lines.withColumns({"__label": label, "__last": F.max_by(F.struct(F.col(line).alias("t"), F.col(start).alias("s")), F.col(pos)).over(whole)})
    marked = marked.withColumns({"sec": F.count("__label").over(w) - 1, "__outro": F.when(text.strip(F.col("__last.t")) == "", F.col("__last.s"))})
    parts = marked.where("sec >= 0").groupBy(song, "sec").agg(
        F.min_by("__label", pos).alias("label"), F.min_by(start, pos).alias("start_s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, line))), lambda x: x[line]), "\n").alias("text"),
        F.first("__outro").alias("outro_s"), F.first(total).alias("__total"),
    )
    end = F.coalesce(F.lead("start_s").over(Window.partitionBy(song).orderBy("sec")), F.col("outro_s"), F.col("__total"))
    return parts.withColumns({"end_s": end, "text": lrc_free(F.col("text"))}).drop("__total")


def lrc_free(c: Column) -> Column:
    return F.regexp_replace(c, lrc.STAMP, "")


def middle_descriptions(descs: Column) -> Column:
    """Descriptions that belong to labelled sections: without first and last, or without the first of two."""
    return F.when(F.size(descs) > 2, F.slice(descs, 2, F.greatest(F.size(descs) - 2, F.lit(0)))).when(F.size(descs) == 2, F.slice(descs, 2, 1)).otherwise(F.slice(descs, 1, 0))


def segments(words: DataFrame, song: str, pos: str = "pos") -> DataFrame:
    """Segments of aligned words (success, word, startS, endS): a valid bracketed label opens one.

    The intended form: a segment holds what follows its label, ends with its last word (0 if it has
    none), and the last open segment counts. Words before the first label drop; an invalid label closes
    nothing and adds its word.
    """
    w = Window.partitionBy(song).orderBy(pos)
    raw = F.regexp_extract("word", r"^\[([^\]]*)\]", 1)
    opens = F.col("word").startswith("[") & valid_label(raw)
    ok = words.where("success").withColumns({"__opens": opens, "__label": F.when(opens, raw)})
    ok = ok.withColumn("seg", F.count("__label").over(w) - 1).where("seg >= 0")
    piece = F.when(F.col("__opens"), F.substring(F.col("word"), F.length("__label") + 4, F.length("word"))).otherwise(F.col("word"))
    return ok.withColumn("__piece", piece).groupBy(song, "seg").agg(
        F.min_by("__label", pos).alias("label"), F.min_by("startS", pos).alias("start"), F.coalesce(F.max_by("endS", F.when(~F.col("__opens"), F.col(pos))), F.lit(0.0)).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, F.col("__piece").alias("p")))), lambda x: x["p"]), "").alias("word"),
    )


def strict_segments(words: DataFrame, song: str, pos: str = "pos") -> DataFrame:
    """W03 as its users have it, quirks included, over the segments that valid labels open.

    A segment comes out once for every bracketed word after its opening one, as far as the next valid label,
    and always in its final state; the one still open at the song's end therefore only if an invalid label
    followed it. That one ends where the song's last word ends, spoken or not, and repeats its last word.
    """
    w = Window.partitionBy(song).orderBy(pos)
    inside = F.regexp_extract("word", r"(?s)^\[(.*?)(?:\]|.\z)", 1)  # without a closing bracket, all but the last character
    bracket = F.col("word").startswith("[")
    after = F.when(F.instr("word", "]") > 0, F.instr("word", "]") + 2).otherwise(F.lit(2))
    ok = words.where("success").withColumns({"__bracket": bracket, "__label": F.when(bracket & valid_label(inside), inside)})
    ok = ok.withColumns({"__seg": F.count("__label").over(w), "__text": F.when(F.col("__label").isNotNull(), F.substring(F.col("word"), after, F.length("word"))).otherwise(F.col("word"))}).where("__seg > 0")
    spoken = F.when(F.col("__label").isNull(), F.col(pos))
    parts = ok.groupBy(song, "__seg").agg(
        F.max("__label").alias("label"), F.min_by("startS", pos).alias("start"), F.coalesce(F.max_by("endS", spoken), F.lit(0.0)).alias("__end"), F.max_by("word", pos).alias("__last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "__text"))), lambda x: x["__text"]), "").alias("__said"), F.count_if(F.col("__bracket") & F.col("__label").isNull()).alias("__times"),
    )
    open_ = F.lead("__seg").over(Window.partitionBy(song).orderBy("__seg")).isNull()
    parts = parts.withColumn("__open", open_).join(words.groupBy(song).agg(F.max_by("endS", pos).alias("__stop")), song)
    times = F.col("__times") + F.when(F.col("__open"), 0).otherwise(1)
    out = parts.where(times > 0).select(
        song, "__seg", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("__nth"), "label", "start",
        F.when(F.col("__open"), F.col("__stop")).otherwise(F.col("__end")).alias("end"), F.when(F.col("__open"), F.concat("__said", "__last")).otherwise(F.col("__said")).alias("word"),
    )
    place = F.row_number().over(Window.partitionBy(song).orderBy("__seg", "__nth")).cast("long") - 1
    return out.select(song, place.alias("seg"), "label", "start", "end", "word")


def parsed_lyrics(lines: DataFrame, song: str, pos: str = "pos", start: str = "start_s", line: str = "text") -> DataFrame:
    """Kind (meta or lyric), key and value of parsed lines: metadata at colons, unstructured heads and
    translations (same time as the lyric before) dropped."""
    w = Window.partitionBy(song).orderBy(pos)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    meta = F.col(line).contains(":") | F.col(line).contains("：")
    slash = F.col(line).contains("/")
    # a lyric has been kept before once a line without a slash has come
    m = lines.withColumns({"__meta": meta, "__seen": F.coalesce(F.max(F.when(~meta & ~slash, 1)).over(upto), F.lit(0))})
    m = m.where(F.col("__meta") | (F.col("__seen") == 1) | ~slash)
    same = F.lag(start).over(Window.partitionBy(song, "__meta").orderBy(pos)) == F.col(start)
    m = m.withColumn("__same", F.coalesce(same, F.lit(False))).where(F.col("__meta") | ~F.col("__same"))
    at = F.when(F.col(line).contains(":"), F.instr(F.col(line), ":")).otherwise(F.instr(F.col(line), "："))
    key = F.when(F.col("__meta"), text.strip(F.substring(F.col(line), F.lit(1), at - 1)))
    value = F.when(F.col("__meta"), text.strip(F.substring(F.col(line), at + 1, F.length(line)))).otherwise(F.col(line))
    return m.select(song, pos, F.when(F.col("__meta"), "meta").otherwise("lyric").alias("kind"), key.alias("key"), value.alias("value"), F.col(start).alias("start_s"))


def chunk_prompts(turns: DataFrame, conv: str, turn: str = "turn", role: str = "role", content: str = "text", prompt: Column | None = None, audio: Column | None = None) -> DataFrame:
    """Assistant turns with audio that consume the last unused prompt before them.

    Columns added: text_prompt, section_name, flat_index (running over the consumed), sub_idx (over all audio turns).
    """
    w = Window.partitionBy(conv).orderBy(turn)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = F.when(F.col(role) == "user", text.described(F.col(content)) if prompt is None else prompt)
    a = (F.col(role) == "assistant") & ((text.audio_tags(F.col(content)) != "") if audio is None else audio)
    s = F.struct(F.col(turn).alias("turn"), p.alias("prompt"), text.section_name(F.col(content)).alias("section"))
    m = turns.withColumns({"__p": F.when(p.isNotNull(), s), "__a": F.when(a, F.col(turn))})
    m = m.withColumns({"__last": F.last("__p", ignorenulls=True).over(before), "__prev": F.last("__a", ignorenulls=True).over(before)})
    audio_turns = m.where(F.col("__a").isNotNull()).withColumn("sub_idx", F.row_number().over(w) - 1)
    used = audio_turns.where(F.col("__last").isNotNull() & (F.col("__prev").isNull() | (F.col("__last.turn") > F.col("__prev"))))
    used = used.withColumns({"text_prompt": F.col("__last.prompt"), "section_name": F.col("__last.section"), "flat_index": F.row_number().over(w) - 1})
    return used.drop("__p", "__a", "__last", "__prev")


def sample_offsets(chunks: DataFrame, song: str, order: str, n_tokens: Column, total_samples: Column) -> DataFrame:
    """Sample ranges one after another, clamped to the recording; what starts after its end drops."""
    w = Window.partitionBy(song).orderBy(order)
    dur = tokens.samples_of_tokens(n_tokens)
    begin = F.coalesce(F.sum(dur).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumns({"start_sample": begin, "__dur": dur}).where(F.col("start_sample") < total_samples).withColumn("end_sample", F.least(F.col("start_sample") + F.col("__dur"), total_samples)).drop("__dur")


def greedy_prefix(df: DataFrame, group: str, order: str, content: str, limit: int = 1600) -> DataFrame:
    """Leading non-empty contents whose joined length stays within the limit."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    length = F.sum(F.length(content) + 1).over(w) - 1
    return df.where(F.col(content) != "").withColumn("joined_length", length).where(F.col("joined_length") <= limit)


def batch_ids(df: DataFrame, order: str, size: int) -> DataFrame:
    """Groups of `size` rows in order."""
    return ranked(df, order, "__rank").withColumn("batch", F.floor(F.col("__rank") / size)).drop("__rank")


def request_rate(log: DataFrame, ts: str = "ts", seconds: int = 10, by: str | None = None) -> DataFrame:
    """Requests in the half-open window of `seconds` that ends with each one.

    A global window would need all rows in one task, so the log is cut into buckets of the window's
    length: each request also goes, as a copy, to the next bucket, and only originals are reported.
    """
    span = seconds * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    keys = [by] if by else []
    own = log.withColumns({"__us": us, "__bucket": F.floor(us / span), "__own": F.lit(True)})
    both = own.unionByName(own.withColumns({"__bucket": F.col("__bucket") + 1, "__own": F.lit(False)}))
    w = Window.partitionBy(*keys, "__bucket").orderBy("__us").rangeBetween(-(span - 1), 0)
    return both.withColumn("in_window", F.count(F.lit(1)).over(w)).where("__own").drop("__us", "__bucket", "__own")


def admission(times: DataFrame, by: str, ts_s: str = "ts_s", limit: int = 10, seconds: float = 10.0, slack: float = 0.05) -> DataFrame:
    """When a limiter lets each request through; recursive, so grouped pandas per client."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sent: list[float] = []
        out = []
        now = float("-inf")
        for t in pdf.sort_values(ts_s)[ts_s]:
            now = max(now, t)
            sent = [s for s in sent if now - s < seconds]
            if len(sent) >= limit:
                now = sent[-limit] + seconds + slack
                sent = [s for s in sent if now - s < seconds]
            sent.append(now)
            out.append((pdf[by].iloc[0], t, now))
        return pd.DataFrame(out, columns=[by, ts_s, "admitted_s"])

    return times.groupBy(by).applyInPandas(run, f"{by} {dict(times.dtypes)[by]}, {ts_s} double, admitted_s double")


def history_prompts(turns: DataFrame, conv: str, turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """For each assistant turn, all earlier turns as its prompt.

    The prompts themselves grow with the turns before them, so a conversation's output is quadratic in its text: for
    conversations of a chat's length, not for whole logs.
    """
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    said = F.concat(F.col(role), F.lit(": "), F.col(content))
    return turns.withColumn("history", F.array_join(F.collect_list(said).over(w), "\n")).where(F.col(role) == "assistant")
