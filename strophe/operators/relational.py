"""Filters, joins, aggregates, limits and set operations of the song corpus; IDs are the inventory's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.text import count_other, file_stem, last_number, strip
from strophe.shared import cumulated, ranked

#: Symbols that become blanks before lyric languages are counted (fixed value).
LYRIC_SYMBOLS = "'￥·′´（），。？\"!@#$%^&*()?./,=+_— ！…《》<>0123456789～※~;－・、☆｜△【】＃「」‖{}[]-"

# Filters and projections


def filter_lang(df: DataFrame, langs: Sequence[str], col: str = "lang") -> DataFrame:
    """Rows whose language is listed; null is not."""
    return df.where(F.col(col).isin(*langs))


def filter_length(df: DataFrame, lo: float, hi: float, col: str = "duration") -> DataFrame:
    """Inclusive bounds, -1 for none."""
    keep = F.lit(True)
    if lo != -1:
        keep &= F.col(col) >= lo
    if hi != -1:
        keep &= F.col(col) <= hi
    return df.where(keep)


def filter_existing(df: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is in a file listing."""
    return df.join(listing.select(path), path, "left_semi")


def valid_label(c: Column, longest: int = 30) -> Column:
    """Not blank, at most `longest` characters stripped, and no time stamp."""
    s = strip(c)
    return (s != "") & (F.length(s) <= longest) & ~(c.contains(":") & c.contains("."))


def split_by_index(df: DataFrame, col: str = "idx", half: int = 50) -> DataFrame:
    """1..half are cn, half+1..2*half are en, renumbered from 0; others go."""
    i = F.col(col)
    lang = F.when(i.between(1, half), "cn").when(i.between(half + 1, 2 * half), "en")
    return df.withColumns({"lang_part": lang, "new_idx": F.when(lang == "cn", i - 1).otherwise(i - half - 1)}).where(F.col("lang_part").isNotNull())


def with_fields(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which all the fields are non-empty."""
    keep = F.lit(True)
    for c in cols:
        keep &= F.coalesce(F.col(c) != "", F.lit(False))
    return df.where(keep)


def prompts_only(df: DataFrame, turn: str = "turn", role: str = "role") -> DataFrame:
    """Turns after the first that aren't the assistant's."""
    return df.where((F.col(turn) > 0) & (F.col(role) != "assistant"))


def polyphones(df: DataFrame, readings: DataFrame, char: str = "char") -> DataFrame:
    """P10: rows whose character has more than one reading."""
    return df.join(readings.where(F.size("readings") > 1).select(char), char, "left_semi")


def lyric_or_translation(lyric: Column, translated: Column) -> Column:
    """The translation only where the lyric is the empty string."""
    return F.when(lyric == "", translated).otherwise(lyric)


def longer_lyric(lyric: Column, translated: Column) -> Column:
    """The longer of both; a tie is the lyric's."""
    return F.when(F.length(translated) > F.length(lyric), translated).otherwise(lyric)


def choose_tag(song_id: Column, omni: Column, style: Column, omni_sim: Column, style_sim: Column) -> Column:
    """Omni for cn songs, else the more similar; omni if they can't be compared, style on a tie."""
    return F.when(song_id.contains("cn"), omni).when(omni_sim > style_sim, omni).when(omni_sim <= style_sim, style).otherwise(omni)


def choose_intro(omni1: Column, omni2: Column, sim1: Column, sim2: Column) -> Column:
    """The first only if strictly more similar."""
    return F.when(sim1 > sim2, omni1).otherwise(omni2)


def choose_description(descs: Column, sims: Column, too_short: str = "音频过短") -> Column:
    """The description of the first largest similarity; the marker for short audio is empty."""
    best = F.element_at(descs, F.array_position(sims, F.array_max(sims)).cast("int"))
    return F.when(best == too_short, "").otherwise(best)


def truthy_or(first: Column, other: Column) -> Column:
    """The empty string counts as missing."""
    return F.coalesce(F.nullif(first, F.lit("")), other)


def generation_stage(files: DataFrame, song: str = "song", name: str = "name") -> DataFrame:
    """Which stages a song's files complete, and the stage to resume at (4: all done)."""
    part = lambda stage: F.array_sort(F.collect_set(F.when(F.col(name).startswith(f"stage{stage}/"), file_stem(F.col(name)))))
    g = files.groupBy(song).agg(part(1).alias("s1"), part(2).alias("s2"), F.bool_or(F.col(name).startswith("stage3/")).alias("stage3"))
    one = F.size("s1") >= 2
    two = one & (F.size(F.array_except("s1", "s2")) == 0)
    out = g.select(song, one.alias("stage1"), two.alias("stage2"), "stage3")
    return out.withColumn("resume", F.when(F.col("stage3"), 4).when(F.col("stage2"), 3).when(F.col("stage1"), 2).otherwise(1))


def api_state(status: Column) -> Column:
    """P20: what a service's status means."""
    return F.when(status.isin("succeeded", "SUCCESS"), "success").when(status.isin("preparing", "queued", "running", "PENDING", "TEXT_SUCCESS", "FIRST_SUCCESS"), "processing").when(status.isNull(), "new").otherwise("failed")


def prompt_source(audio: Column, kind: Column, kinds: Sequence[str]) -> Column:
    """Audio, a typed automatic prompt, or none; both at once and unknown types raise."""
    both = audio.isNotNull() & kind.isNotNull()
    check = F.assert_true(~both & (kind.isNull() | kind.isin(*kinds)), F.lit("give an audio path or a known prompt type"))
    return F.when(check.isNull(), F.when(audio.isNotNull(), "audio").when(kind.isNotNull(), "auto").otherwise("none"))


# Joins


def drop_finished(raw: DataFrame, saved: DataFrame, key: str, field: str) -> DataFrame:
    """Rows without a saved row of the key whose field is present."""
    return raw.join(saved.where(F.col(field).isNotNull()).select(key).distinct(), key, "left_anti")


def drop_done_files(raw: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file stem has no output."""
    stems = done.select(file_stem(F.col(path)).alias("__stem")).distinct()
    return raw.join(stems, file_stem(raw[path]) == stems["__stem"], "left_anti")


def fill_missing(audio: DataFrame, transcribed: DataFrame, filler: DataFrame, key: str = "file_idx") -> DataFrame:
    """Transcriptions with those of audio that had none added."""
    missing = audio.join(transcribed.select(key), key, "left_anti").select(key)
    return transcribed.unionByName(filler.join(missing, key, "left_semi"), allowMissingColumns=True)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of equal keys the row of the last order."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order))
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of equal keys the row of the first order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def match_music(music: DataFrame, lyrics: DataFrame, path: str = "path", order: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """Music files and the last lyric of the file name `name - artist.mp3`; and what has no lyric."""
    named = lyrics.withColumn("__file", F.concat(F.replace(F.col("name"), F.lit(" "), F.lit("")), F.lit(" - "), F.col("artist"), F.lit(".mp3")))
    last = last_wins(named, ["__file"], [order])
    files = music.withColumn("__file", F.element_at(F.split(path, "/"), -1))
    return files.join(last, "__file").drop("__file"), files.join(last.select("__file"), "__file", "left_anti").drop("__file")


def with_descriptions(meta: DataFrame, desc: DataFrame, tokens: DataFrame) -> DataFrame:
    """Metadata with its description by song and track, where the token file exists."""
    track = lambda df: df.withColumn("track_index", F.coalesce("track_index", F.lit(0)))
    return track(meta).withColumn("stem", file_stem(F.col("src_path"))).join(track(desc), ["song_id", "track_index"]).join(tokens, "stem")


def offset_join(hyp: DataFrame, gt: DataFrame, index: Column, offset: int = 0) -> DataFrame:
    """Hypotheses with the truth of file index `index + offset`."""
    return hyp.withColumn("__at", index + offset).join(gt.withColumnRenamed("file_index", "__at"), "__at").withColumnRenamed("__at", "file_index")


def with_prompt(df: DataFrame, prompts: DataFrame, idx: str = "idx") -> DataFrame:
    """The prompt at the row's position; positions outside the list drop the row."""
    listed = prompts.select(F.posexplode("prompts").alias(idx, "prompt"))
    return df.join(listed, idx)


def zip_in_order(left: DataFrame, right: DataFrame, left_order: str, right_order: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows paired by their number in each order, as far as the shorter goes (within `by`, if given)."""

    def number(df: DataFrame, order: str) -> DataFrame:
        return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(order))) if by else ranked(df, order, "__nth")

    return number(left, left_order).join(number(right, right_order), [*by, "__nth"])


def zip_guarded(left: DataFrame, right: DataFrame, by: str, left_order: str, right_order: str) -> DataFrame:
    """zip_in_order for groups of the same size on both sides only."""
    size = lambda df, n: df.groupBy(by).agg(F.count(F.lit(1)).alias(n))
    same = size(left, "l").join(size(right, "r"), by).where("l = r").select(by)
    return zip_in_order(left.join(same, by, "left_semi"), right, left_order, right_order, [by])


def pair_stems(files: DataFrame, path: str = "path") -> DataFrame:
    """Vocal and instrumental files of one song."""
    vocal, other = files.where(F.col(path).contains("_vtrack")), files.where(F.col(path).contains("_itrack"))
    return vocal.select(F.col(path).alias("vocal")).join(other.select(F.col(path).alias("instrumental"), F.replace(F.col(path), F.lit("_itrack"), F.lit("_vtrack")).alias("vocal")), "vocal")


# Aggregates


def label_counts(segments: DataFrame, labels: str = "labels") -> DataFrame:
    """A01."""
    return segments.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    """Rows by value, such as normalised tags or decided languages."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def label_combinations(segments: DataFrame, labels: str = "labels") -> DataFrame:
    """Counts of ordered label lists; empty lists are skipped."""
    return segments.where(F.size(labels) > 0).groupBy(F.array_join(labels, " | ").alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def language_vote(sentences: DataFrame, key: str, least_words: int = 5, least_sentences: int = 5) -> DataFrame:
    """Languages of enough long sentences in order of appearance: none is pure, several are multi.

    Columns: key, pos, lang, text. English words part at white space, other texts count characters.
    """
    words = F.when(F.col("lang") == "en", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).otherwise(F.length("text"))
    votes = sentences.where(words >= least_words).groupBy(key, "lang").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    kept = votes.where(F.col("n") >= least_sentences).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "lang"))).alias("v"))
    langs = F.transform("v", lambda x: x["lang"])
    decided = F.when(F.size("v") == 1, langs[0]).otherwise(F.concat(F.lit("multi: "), F.array_join(langs, " ")))
    return sentences.select(key).distinct().join(kept, key, "left").select(key, F.coalesce(decided, F.lit("pure")).alias("vote"))


def lyric_language(lines: Column, word_limit: int = 3, val_limit: int = 5) -> Column:
    """Zh, en, ez (both), nan or instrument of a song's lines; both limits are strict."""
    # every value that is named more than once is bound, so that it is worked out once
    parts = lambda x, bare: F.struct(count_other(bare).alias("other"), (F.length(x) - F.length(bare)).alias("cjk"), F.size(F.split(bare, " ", -1)).alias("parts"))
    one = lambda v: F.transform(F.array(v), lambda x: F.transform(F.array(F.regexp_replace(x, "[一-鿿]+", "")), lambda bare: parts(x, bare))[0])[0]
    counted = F.transform(F.filter(lines, lambda x: ~(x.contains("<nop>") & (strip(x) == "<nop>"))), lambda x: one(F.translate(x, LYRIC_SYMBOLS, " " * len(LYRIC_SYMBOLS))))
    add = lambda a, c: F.struct(
        (a["nan"] + F.when(c["other"] > word_limit, 1).otherwise(0)).alias("nan"), (a["zh"] + F.when((c["other"] <= word_limit) & (c["cjk"] > word_limit), 1).otherwise(0)).alias("zh"),
        (a["en"] + F.when((c["other"] <= word_limit) & (c["parts"] > word_limit), 1).otherwise(0)).alias("en"))
    some = lambda n: n > val_limit
    name = lambda a: F.when(some(a["nan"]), "nan").when(some(a["zh"]) & some(a["en"]), "ez").when(some(a["zh"]), "zh").when(some(a["en"]), "en").otherwise("instrument")
    return F.aggregate(counted, F.struct(F.lit(0).alias("nan"), F.lit(0).alias("zh"), F.lit(0).alias("en")), add, name)


def mean_or(df: DataFrame, col: str, empty: float, name: str) -> DataFrame:
    """A07 (PER, 1.0 when empty), A08 (similarity, 0.0)."""
    return df.agg(F.coalesce(F.avg(col), F.lit(empty)).alias(name), F.count(F.lit(1)).alias("count"))


def aesthetics(files: DataFrame, scores: DataFrame, model: str = "model", parts: Sequence[str] = ("CE", "CU", "PC", "PQ")) -> DataFrame:
    """Means by part and their sum; the count is that of files, scored or not."""
    means = scores.groupBy(model).agg(*(F.avg(p).alias(p) for p in parts))
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return files.groupBy(model).agg(F.count(F.lit(1)).alias("count")).join(means, model, "left").withColumn("Score", total)


def merge_languages(metrics: DataFrame) -> DataFrame:
    """(model, metric, value) means over `_cn` and `_en` of a base model."""
    return metrics.groupBy(F.regexp_replace("model", "_(cn|en)$", "").alias("model"), "metric").agg(F.avg("value").alias("value"))


def metric_report(metrics: DataFrame) -> DataFrame:
    """A11 with the rows it merges: by language and base model, and by base model alone."""
    split = metrics.withColumns({"base": F.regexp_replace("model", "_(cn|en)$", ""), "part": F.regexp_extract("model", "_(cn|en)$", 1)})
    return split.groupingSets([[F.col("base"), F.col("part"), F.col("metric")], [F.col("base"), F.col("metric")]], "base", "part", "metric").agg(F.avg("value").alias("value"))


def best_values(metrics: DataFrame, lower: str = "PER") -> DataFrame:
    """The best value of each metric, lowest for PER."""
    return metrics.groupBy("metric").agg(F.when(F.col("metric") == lower, F.min("value")).otherwise(F.max("value")).alias("best"))


def mark_best(metrics: DataFrame, lower: str = "PER") -> DataFrame:
    """Cells within 1e-9 of their metric's best."""
    return metrics.join(best_values(metrics, lower), "metric", "left").withColumn("is_best", F.abs(F.col("value") - F.col("best")) < 1e-9).drop("best")


def metric_table(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per model, the metrics in a fixed order."""
    return metrics.groupBy("model").pivot("metric", list(order)).agg(F.first("value"))


def run_report(log: DataFrame) -> DataFrame:
    """Success counts, tracks, times, speed, polls and efficiency of a run log in one aggregate."""
    ok = F.col("success")
    of = lambda c: F.when(ok, F.col(c))
    r = log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_fail"),
        F.coalesce(F.sum(of("tracks_count")), F.lit(0)).alias("tracks"), F.avg(of("tracks_count")).alias("avg_tracks"),
        F.avg(of("wait_time")).alias("avg_wait"), F.min(of("wait_time")).alias("min_wait"), F.max(of("wait_time")).alias("max_wait"),
        F.sum(of("download_time")).alias("sum_download"), F.avg(of("download_time")).alias("avg_download"), F.sum(of("total_time")).alias("sum_total"),
        F.sum(of("download_bytes")).alias("bytes"), F.sum(of("poll_count")).alias("polls"), F.avg(of("poll_count")).alias("avg_polls"),
    )
    return r.withColumns({"songs_per_minute": F.col("n_success") / (F.try_divide("sum_total", F.lit(60.0))), "efficiency": F.try_divide(F.col("max_wait"), F.col("sum_total")) * 100})


def state_counts(log: DataFrame, state: str = "state", states: Sequence[str] = ("success", "processing", "already", "failed", "skipped")) -> DataFrame:
    """A15."""
    return log.agg(*(F.count_if(F.col(state) == s).alias(s) for s in states))


def mean_of_first(df: DataFrame, order: str, n: int, *cols: str) -> DataFrame:
    """Means over the first n rows in file order."""
    return df.orderBy(order).limit(n).agg(*(F.avg(c).alias(f"avg_{c}") for c in cols))


def polyphone_accuracy(judged: DataFrame) -> DataFrame:
    """(char, expected, predicted, row_idx): right, total and share."""
    ok = F.col("expected") == F.col("predicted")
    return judged.agg(F.count_if(ok).alias("right"), F.count(F.lit(1)).alias("total"), F.avg(ok.cast("int")).alias("accuracy"))


def corrections(judged: DataFrame, old: DataFrame) -> DataFrame:
    """Correct readings of wrong predictions, the last winning, merged over an older dictionary."""
    new = last_wins(judged.where("expected <> predicted"), ["char"], ["row_idx"]).select("char", F.col("expected").alias("reading"))
    return new.unionByName(old.join(new, "char", "left_anti").select("char", "reading"))


def distinct_in_order(df: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values with the place of their first appearance."""
    return df.groupBy(col).agg(F.min(order).alias("first"))


def latest(df: DataFrame, col: str, time: str) -> DataFrame:
    """A21, L08."""
    return df.agg(F.max_by(col, time).alias(col))


def counters(df: DataFrame, keep: Column, *by: str) -> DataFrame:
    """Rows in all, kept and skipped; a condition that is null skips."""
    ok = F.coalesce(keep, F.lit(False))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


def extremes(values: Column) -> Column:
    """The largest and smallest of a list."""
    return F.struct(F.array_max(values).alias("max"), F.array_min(values).alias("min"))


def fitting_files(files: DataFrame, order: str, size: str, most_bytes: int, per: int) -> DataFrame:
    """Files in order with their number and the size up to them, as far as the first check (after each `per`
    files) that finds more than `most_bytes`."""
    placed = cumulated(ranked(files, order, "__at"), "__at", size, "total_bytes").withColumn("count", F.col("__at") + 1)
    over = placed.where((F.col("count") % per == 0) & (F.col("total_bytes") > most_bytes)).agg(F.min("count").alias("__stop"))  # one row
    return placed.crossJoin(over).where(F.col("__stop").isNull() | (F.col("count") <= F.col("__stop"))).drop("__at", "__stop")


# Order, limits and samples


def first_rows(df: DataFrame, n: int, row_idx: str = "row_idx") -> DataFrame:
    """By file order."""
    return df.where(F.col(row_idx) < n)


def sort_by_index(df: DataFrame, col: str = "file_idx", missing: int = 999999) -> DataFrame:
    """Null indices last."""
    return df.orderBy(F.coalesce(F.col(col), F.lit(missing)))


def by_count(counts: DataFrame, n: str = "n", first: str | None = None) -> DataFrame:
    """Largest counts first, ties by first appearance where it is known."""
    return counts.orderBy(F.col(n).desc(), *([F.col(first)] if first else []))


def sort_by_path_number(df: DataFrame, path: str = "path") -> DataFrame:
    """By the last number in the file name, paths without one last."""
    return df.orderBy(last_number(F.col(path)).asc_nulls_last(), path)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """The named columns in order, absent or null ones by their default; lists joined by commas."""
    kinds = dict(df.dtypes)

    def one(name: str, default: object) -> Column:
        if name not in kinds:
            return F.lit(default).alias(name)
        c = F.array_join(F.transform(name, lambda x: x.cast("string")), ", ") if kinds[name].startswith("array") else F.col(name)
        return (c if default is None else F.coalesce(c, F.lit(default))).alias(name)

    return df.select(*(one(k, v) for k, v in defaults.items()))


def keys_only_left(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Key sets' difference."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def keys_in_both(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Key sets' intersection."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")


def target_files(songs: DataFrame, index: str = "idx", half: int = 50) -> DataFrame:
    """The file of each song entry (from 1): the first half zh, the rest en, both numbered from 1."""
    i = F.col(index)
    folder = F.when(i <= half, "zh").otherwise("en")
    return songs.withColumn("target", F.concat(folder, F.lit("/song_"), F.when(i <= half, i).otherwise(i - half).cast("string"), F.lit(".jsonl")))


def update_targets(files: DataFrame, songs: DataFrame, prompt: str = "prompt", index: str = "idx", path: str = "path") -> DataFrame:
    """Files with the prompt of their song entry; entries without a prompt change nothing."""
    new = target_files(songs.where(F.coalesce(F.col(prompt) != "", F.lit(False))), index).select(F.col("target").alias(path), F.col(prompt).alias("__prompt"))
    return files.join(new, path, "left").withColumn(prompt, F.coalesce("__prompt", prompt)).drop("__prompt")


def _draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def sample_k(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """K rows without replacement, the same for the same seed."""
    return df.orderBy(_draw(key, seed), key).limit(k)


def sample_pool(df: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """Each row's draw when `count` rows at a time are taken without replacement; a last incomplete draw is null."""
    placed = ranked(df.withColumn("__h", _draw(key, seed)), ["__h", key], "pool_rank")
    whole = F.floor(F.col("__total") / count) * count
    total = placed.agg(F.count(F.lit(1)).alias("__total"))  # one row
    return placed.crossJoin(total).withColumn("draw", F.when(F.col("pool_rank") < whole, F.floor(F.col("pool_rank") / count))).drop("__h", "__total")


def random_int(key: Column, lo: Column, hi: Column, seed: int) -> Column:
    """A whole number in [lo, hi] that the key and the seed determine, by twelve digits of a digest."""
    drawn = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 12), 16, 10).cast("long")
    return lo + F.pmod(drawn, hi - lo + 1)


def lyric_duration(lyrics: Column, key: Column, seed: int) -> Column:
    """0.4 to 0.7 seconds for each character (CJK) or word."""
    n = F.when(lyrics.rlike("[一-鿿]"), F.length(F.replace(lyrics, F.lit("\n"), F.lit("")))).otherwise(F.size(F.filter(F.split(lyrics, r"\s+"), lambda w: w != "")))
    return random_int(key, (n * 0.4).cast("long"), (n * 0.7).cast("long"), seed)
