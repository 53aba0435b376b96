"""Sinks: JSON lines, JSON, CSV logs, twin and split outputs, dead letters and reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line, non-ASCII kept; appends are whole task commits."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_json(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One JSON array, for reports of a few rows: gathered in one task, not on the driver, which reads `most` and one more. More raise."""
    one = df.limit(most + 1).agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"pretty": "true"}).alias("value"), F.count(F.lit(1)).alias("n"))
    check = F.assert_true(F.col("n") <= most, F.lit(f"a JSON document holds {most} rows at most, write JSON lines"))
    one.select(F.when(check.isNull(), F.col("value")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Vectors as a table; similarities are kept as edges, never as a matrix."""
    df.select(id_col, vector_col).write.mode("overwrite").parquet(path)


def write_twins(df: DataFrame, messages_path: str, meta_path: str, messages: str = "messages", order: str = "row_idx") -> None:
    """Messages only and metadata only, both in the same order by the row's place."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order)
    write_jsonl(rows.select(order, messages), messages_path)
    write_jsonl(rows.drop(messages), meta_path)


def append_log(df: DataFrame, path: str) -> None:
    """CSV rows with a header."""
    df.write.mode("append").option("header", True).csv(path)


def append_history(metrics: DataFrame, path: str) -> None:
    """The time and every model's metrics as one record."""
    models = metrics.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    record = models.agg(F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias("models"))
    record.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "models").write.mode("append").json(path)


def write_shards(df: DataFrame, path: str, order: str, group_size: int) -> None:
    """Groups of sorted names, one folder each."""
    from strophe.operators.ordered import batch_ids

    batch_ids(df, order, group_size).write.mode("overwrite").partitionBy("batch").parquet(path)


def write_each(df: DataFrame, path: str, key: str, kind: str = "json") -> None:
    """A folder for each value of the key."""
    df.write.mode("overwrite").partitionBy(key).format(kind).save(path)


def write_metrics(summary: DataFrame, details: DataFrame, path: str) -> None:
    """An aggregate and its details side by side."""
    write_json(summary, f"{path}/summary")
    write_jsonl(details, f"{path}/summary_details")


def with_status(df: DataFrame, error: str = "error") -> DataFrame:
    """Failures as a status column, never mixed into the text."""
    return df.withColumn("status", F.when(F.col(error).isNull(), "ok").otherwise("failed"))


def read_failures(lines: DataFrame, value: str = "value", mark: str = "__VLLM_FAIL__") -> DataFrame:
    """Older outputs mark failed rows with a prefix; the row without it and its status."""
    failed = F.col(value).startswith(mark)
    return lines.withColumns({"status": F.when(failed, "failed").otherwise("ok"), value: F.when(failed, F.substring(F.col(value), F.lit(len(mark) + 1), F.length(value))).otherwise(F.col(value))})


def manifest(files: DataFrame, split: DataFrame) -> DataFrame:
    """The copies to make: source path and target name by new index."""
    return split.join(files, "path").select("path", F.concat("lang_part", F.lit("/"), F.format_string("%06d", F.col("new_idx")), F.regexp_extract("path", r"(\.[^.]*)$", 1)).alias("target"))


def count_warnings(sections: DataFrame, expected: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Songs whose section count differs from their descriptions', as a table."""
    return sections.join(expected, list(keys)).where("n_sections <> n_descriptions")


def updated(df: DataFrame, changes: DataFrame, key: str, col: str) -> DataFrame:
    """`col` replaced where the key has a change."""
    return df.join(changes.select(key, F.col(col).alias("__new")), key, "left").withColumn(col, F.coalesce("__new", col)).drop("__new")
