"""Reports: metric tables as Markdown and run logs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strophe.operators.relational import mark_best

#: Metrics in the order of their columns (fixed value).
METRICS = ("CE", "CU", "PC", "PQ", "Score", "Coherence", "Musicality", "Memorability", "Clarity", "Naturalness", "Mulan-T", "PER")


@F.pandas_udf(StringType())
def _four_decimals(values: pd.Series) -> pd.Series:
    """Four decimals of the binary value; the JVM's formatter rounds the shortest decimal, which differs on ties.

    A report has one value for each model and metric, so the Python step is small.
    """
    return values.map(lambda x: f"{x:.4f}", na_action="ignore")


def markdown_rows(metrics: DataFrame, order: Sequence[str] = METRICS) -> DataFrame:
    """One Markdown row for each model: four decimals, the best of each metric bold, `-` for none."""
    value = _four_decimals(F.col("value"))
    cell = mark_best(metrics).withColumn("cell", F.when(F.col("is_best"), F.concat(F.lit("**"), value, F.lit("**"))).otherwise(value))
    wide = cell.groupBy("model").pivot("metric", list(order)).agg(F.first("cell"))
    cells = [F.coalesce(F.col(f"`{m}`"), F.lit("-")) for m in order]
    return wide.select("model", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("model"), *cells), F.lit(" |")).alias("row"))


def markdown_table(metrics: DataFrame, order: Sequence[str] = METRICS, title: str = "Results") -> str:
    """The table, models by name. The report has a row for each model, so it is gathered."""
    head = "| " + " | ".join(["Model", *order]) + " |\n| " + " | ".join(["---"] * (len(order) + 1)) + " |"
    return "\n".join(["## " + title, "", head, *(r.row for r in markdown_rows(metrics, order).orderBy("model").collect())])
