"""Sources: JSON lines, JSON, text, listings and side tables, read with Spark's own readers.

File order is data here: every line gets `row_idx`, its place in the input, from a text scan. Places
go by (file, line); lines are numbered per block of a file and shifted by block totals, not by a global sort.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions.text import file_stem, strip
from strophe.operators.relational import first_wins, last_wins
from strophe.shared import cut
from strophe.sources.archives import opened


#: Blocks of files whose first places are sent to all tasks.
FEW_BLOCKS = 100_000


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file, row_idx: the lines of text files; row_idx counts all lines in file order.

    The files are read twice and cut in the same way both times, once to count the lines of each block.
    """
    meta = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id")]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), *meta)
    blocks = cut(spark.read.text(path).select(*meta).groupBy("__path", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first")))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("__path", "__block", "__first", before.alias("__before"))  # one row for each block of a file
    starts = F.broadcast(starts) if blocks.count() <= FEW_BLOCKS else starts  # else each task of the join would get whole blocks
    out = lines.join(starts, ["__path", "__block"])
    return out.select("value", "file", (F.col("__before") + F.col("__id") - F.col("__first")).alias("row_idx"))


def jsonl(spark: SparkSession, path: str, schema: str, limit: int = -1) -> DataFrame:
    """Typed JSON lines with row_idx; the first `limit` lines unless -1."""
    return tolerant_jsonl(spark, path, schema, (), keep_bad=False, limit=limit)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), max_count: int = -1, keep_bad: bool = False, limit: int = -1) -> DataFrame:
    """Blank and bad lines are skipped but keep their row_idx; `required` fields must be present.

    max_count: the first so many valid rows; keep_bad: bad lines stay, as `bad_line` (S07's quarantine).
    """
    lines = numbered_lines(spark, path).where(strip(F.col("value")) != "")
    lines = lines if limit == -1 else lines.where(F.col("row_idx") < limit)
    good = F.try_parse_json("value").isNotNull() & strip(F.col("value")).startswith("{")
    rows = lines.withColumn("__v", F.when(good, F.from_json("value", schema)))
    if keep_bad:
        return rows.select("row_idx", "file", "__v.*", F.when(~good, F.col("value")).alias("bad_line"))
    out = rows.where(good).select("row_idx", "file", "__v.*")
    for c in required:
        out = out.where(F.col(c).isNotNull())
    return out if max_count == -1 else out.orderBy("row_idx").limit(max_count)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document or array of them; a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


#: Bytes and files that a task holds when it reads whole files.
HELD, FILES = 16_777_216, 1000


def _glob(pattern: str) -> re.Pattern:
    """A pattern of names as Hadoop writes it."""
    out, depth, inside = "", 0, False
    for at, c in enumerate(pattern):
        if inside:
            out += "^" if c in "!^" and pattern[at - 1] == "[" else "\\\\" if c == "\\" else c
            inside = c != "]"
        elif c == "[":
            out, inside = out + c, True
        elif c in "{}" or (c == "," and depth):
            depth += {"{": 1, "}": -1, ",": 0}[c]
            out += {"{": "(?:", "}": ")", ",": "|"}[c]
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
    return re.compile(out, re.DOTALL)


def _below(spark: SparkSession, base: str, root: str, patterns: Sequence[str]) -> DataFrame:
    """path, in the file system, of the files that the patterns name, one for each level below a folder. Folders are listed in tasks."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.range(1).select(F.lit(root).alias("path"))
    for level, pattern in enumerate(patterns, 1):
        kind = fs.FileType.File if level == len(patterns) else fs.FileType.Directory

        def children(batches: Iterator[pa.RecordBatch], name=_glob(pattern), kind=kind) -> Iterator[pa.RecordBatch]:
            disk, _ = opened(base)
            for b in batches:
                for folder in b.column(0).to_pylist():
                    inside = disk.get_file_info(fs.FileSelector(folder))
                    paths = [f.path for f in inside if f.type == kind and f.base_name[0] not in "._" and name.fullmatch(f.base_name)]
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

        found = found.mapInArrow(children, "path string").repartition(n)
    return found


def _bodies(base: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, _ = opened(base)
        names, bodies, held = [], [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with disk.open_input_stream(path) as f:
                    bodies.append(f.read())
                names.append(path)
                held += len(bodies[-1])
                if held >= HELD or len(names) >= FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["path", "body"])
                    names, bodies, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["path", "body"])

    return read


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """S03. Files that a pattern names are listed and read in tasks, empty ones too, so the driver holds no file's name.

    A path without a pattern, or in a file system that pyarrow can't open, is read by Spark's own reader.
    """
    parts = path.split("/")
    first = next((i for i, x in enumerate(parts) if any(c in x for c in "*?[{")), None)
    base = "/".join(parts[:first])
    try:
        disk, root = opened(base) if first and base else (None, "")
    except (pa.ArrowException, OSError):
        disk, root = None, ""
    if disk is None:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    whole = base if "://" in base else f"file://{base.removeprefix('file:')}"
    before = whole.rstrip("/").removesuffix(root.rstrip("/"))
    rows = _below(spark, base, root, parts[first:]).mapInArrow(_bodies(base), "path string, body binary")
    return rows.select(F.col("body").cast("string").alias("text"), F.concat(F.lit(before), "path").alias("path"))


def listing(spark: SparkSession, path: str, pattern: str = "{*.mp3,*.wav}") -> DataFrame:
    """Files below a folder, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime").orderBy("path")


def descriptions(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The last record of each (song_id, track_index), and the bad lines."""
    rows = tolerant_jsonl(spark, path, schema, keep_bad=True)
    good = rows.where(F.col("bad_line").isNull()).drop("bad_line").withColumn("track_index", F.coalesce("track_index", F.lit(0)))
    return last_wins(good, ["song_id", "track_index"], ["row_idx"]), rows.where(F.col("bad_line").isNotNull()).select("file", "row_idx", "bad_line")


def suffix_of(path: Column) -> Column:
    """The number at the end of a description file's stem, null if there is none."""
    return F.regexp_extract(file_stem(path), r"_(\d+)$", 1).try_cast("int")


def json_or_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character that isn't blank."""
    first = spark.read.text(path).where(strip(F.col("value")) != "").limit(1).collect()
    if first and first[0].value.lstrip().startswith("["):
        return spark.read.schema(schema).json(path, multiLine=True)
    return jsonl(spark, path, schema)


def row_range(df: DataFrame, start: int, end: int = -1) -> DataFrame:
    """Rows [start, end) in file order; -1 for all that follow."""
    return df.where((F.col("row_idx") >= start) & (F.lit(end == -1) | (F.col("row_idx") < end)))


def field_of_tracks(spark: SparkSession, path: str, field: str, kind: str = "string") -> DataFrame:
    """One field of a folder of track files, by song and track; other fields aren't read."""
    rows = spark.read.schema(f"song_id string, track_index int, {field} {kind}").json(path, multiLine=True)
    return rows.select(F.concat_ws("_", "song_id", "track_index").alias("id"), field)


#: Aligned words of a track file.
TRACK = "song_id string, track_index int, timestamped_lyrics struct<alignedWords:array<struct<success:boolean,word:string,startS:double,endS:double>>>"


def aligned_words(spark: SparkSession, path: str) -> DataFrame:
    """song_id, track_index, pos and the aligned word, one row each."""
    t = spark.read.schema(TRACK).json(path, multiLine=True)
    return t.select("song_id", "track_index", F.posexplode("timestamped_lyrics.alignedWords").alias("pos", "w")).select("song_id", "track_index", "pos", "w.*")


LINE_END = "\r\n|\r|\n"


def names_language(text: Column) -> Column:
    """Whether a lyric text's first line is the name of a language."""
    return F.lower(strip(F.split(text, LINE_END)[0])).isin("chinese", "english", "zh", "en")


def lyric_files(spark: SparkSession, path: str) -> DataFrame:
    """Lyric texts without a leading language line, their lines joined by blanks."""
    lines = F.transform(F.split("text", LINE_END), strip)
    kept = F.when(names_language(F.col("text")), F.slice(lines, 2, F.size(lines))).otherwise(lines)
    return whole_text(spark, path).select("path", F.array_join(F.filter(kept, lambda x: x != ""), " ").alias("lyrics"))


def metric_files(spark: SparkSession, path: str) -> DataFrame:
    """(model, metric, value) of metric files, details excluded; by file name the last wins."""
    rows = spark.read.schema("model string, metrics map<string,double>, count long").option("recursiveFileLookup", "true").json(path, multiLine=True)
    rows = rows.withColumn("__file", F.col("_metadata.file_path")).where(~F.col("__file").contains("_details"))
    long = rows.select("model", "__file", F.explode("metrics").alias("metric", "value"))
    return last_wins(long, ["model", "metric"], ["__file"]).drop("__file")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Word (lower case) and phones; the first entry wins."""
    parts = F.split(F.regexp_replace("value", r"\s+$", ""), r"\s+")
    rows = numbered_lines(spark, path).where(F.col("value") != "").select("row_idx", F.lower(parts[0]).alias("word"), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))).alias("phones"))
    return first_wins(rows, ["word"], ["row_idx"]).drop("row_idx")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """Stem and tokens of a Parquet side table."""
    return spark.read.schema("stem string, tokens array<int>").parquet(path)


def _decoded_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                x = np.load(io.BytesIO(body or b""), allow_pickle=False)
                if x.dtype.kind not in "biuf":
                    raise ValueError(f"no numbers: {x.dtype}")
                shape, whole, real, error = list(x.shape), x.dtype.kind != "f", x.ravel(), None
            except (ValueError, EOFError, OSError) as e:
                shape, whole, real, error = None, None, None, str(e)
            longs = real.astype(np.int64) if whole else None
            floats = real.astype(np.float64) if whole is False else None
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([path, shape, longs, floats, error], kinds, strict=True)], names=["path", "shape", "tokens", "values", "error"])


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, shape, tokens, values, error) of .npy files: whole numbers as tokens, others as values, in C order.

    A file that holds no array of numbers has an error and nothing else.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = files.mapInArrow(_decoded_arrays, "path string, shape array<int>, tokens array<long>, values array<double>, error string")
    return found.withColumn("stem", file_stem(F.col("path")))


def json_items(spark: SparkSession, path: str, schema: str, most: int = -1) -> DataFrame:
    """The items of a JSON array with their place (idx), the first `most` unless -1; a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"idx int, {schema}")
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("idx", "item"))
    return (items if most == -1 else items.where(F.col("idx") < most)).select("idx", "item.*")


#: States of a task that has ended, and of one that is under way (fixed values).
ENDED, UNDER_WAY = ("succeeded", "failed", "timeouted", "cancelled"), ("preparing", "queued", "running", "streaming", "reviewing")


def previous_results(spark: SparkSession, path: str) -> DataFrame:
    """(path, api_response, status, processed) of earlier outputs, a JSON file each.

    Processed are tasks that have ended or are under way; a file that can't be parsed is not, and has no response.
    """
    response = F.get_json_object("text", "$.api_response")
    rows = whole_text(spark, path).withColumn("api_response", F.when(F.try_parse_json("text").isNotNull(), response))
    rows = rows.withColumn("status", F.get_json_object("api_response", "$.status"))
    return rows.select("path", "api_response", "status", F.coalesce(F.col("status").isin(*ENDED, *UNDER_WAY), F.lit(False)).alias("processed"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Lyrics by file index; bad rows and null indices drop, the last wins."""
    rows = tolerant_jsonl(spark, path, "file_index bigint, lyrics string", ["file_index"])
    return last_wins(rows, ["file_index"], ["row_idx"]).select("file_index", "lyrics")


def prompt_list(spark: SparkSession, path: str) -> DataFrame:
    """Idx and prompt of a JSON array of strings."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("prompts"))
    return text.select(F.posexplode("prompts").alias("idx", "prompt"))


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """Conversations with song_idx, the line's place in its file whether or not lines before it parse; `mulan_*` files excluded."""
    lines = numbered_lines(spark, path).where(~F.col("file").startswith("mulan_"))
    starts = lines.groupBy("file").agg(F.min("row_idx").alias("__first"))
    good = F.try_parse_json("value").isNotNull() & strip(F.col("value")).startswith("{")
    rows = lines.where(good).join(starts, "file").withColumn("__v", F.from_json("value", "messages array<struct<role:string,content:string>>"))
    return rows.select("file", (F.col("row_idx") - F.col("__first")).alias("song_idx"), F.col("__v.messages").alias("messages"))


def long_turns(chats: DataFrame, key: str = "song_idx") -> DataFrame:
    """Messages in long form: key, turn, role, text."""
    return chats.select("file", key, F.posexplode("messages").alias("turn", "m")).select("file", key, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))
