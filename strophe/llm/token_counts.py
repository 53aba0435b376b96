"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram then answer totals,
quantiles and totals after truncation for every context limit without another look at the documents.
The histogram has a row for each distinct length, so its size follows the longest text and not the
number of documents. The suffix sums go over blocks of lengths first, so no window needs all rows.

Special cases: null and empty texts count as length 0; an empty table has an empty histogram, totals
of 0 and null quantiles; repeated rows count each time; whole texts are counted, however long; extra columns
may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import store
from strophe.llm.tokens import with_token_counts

#: Lengths that one window of suffix sums spans.
BLOCK = 1024


def length_histogram(docs: DataFrame, text_col: str = "text", **tokenizer) -> DataFrame:
    """n_tokens, n_docs: one row per distinct encoded length."""
    counted = with_token_counts(docs.select(text_col), "n_tokens", text_col, drop_text=True, **tokenizer)
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with what holds at each length L taken as context limit.

    docs_at_least, tokens_at_least: documents of L or more tokens and their tokens; total_docs and
    total_tokens: of all; truncated_total: tokens left when every document is cut at L; cut_docs: how
    many lose tokens; cdf: share of documents of at most L tokens.
    """
    # lengths and their blocks both come from the histogram: a row for each distinct length, stored so that texts are counted once
    h = store(histogram).withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "tokens": F.col("n_tokens") * F.col("n_docs")})
    down = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(down), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(down), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = h.withColumns({"docs_in": F.sum("n_docs").over(inside), "tokens_in": F.sum("tokens").over(inside)}).join(blocks, "block")
    s = s.withColumns({"docs_at_least": F.col("docs_in") + F.col("later_docs"), "tokens_at_least": F.col("tokens_in") + F.col("later_tokens")})
    return s.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        (F.col("docs_at_least") - F.col("n_docs")).alias("cut_docs"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("cdf"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at any limit, observed as a length or not."""
    r = sums.agg(
        F.sum(F.when(F.col("n_tokens") < limit, F.col("n_tokens") * F.col("n_docs"))).alias("short"),
        F.sum(F.when(F.col("n_tokens") >= limit, F.col("n_docs"))).alias("cut"),
    ).first()
    return (r.short or 0) + limit * (r.cut or 0)


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents don't exceed."""
    return sums.where(F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs") >= F.lit(q) * F.col("total_docs")).agg(F.min("n_tokens")).first()[0]


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
