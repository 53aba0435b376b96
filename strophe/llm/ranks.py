"""Exact ranks inside groups by hierarchical digit histograms, without a global sort.

Keys are strings of hexadecimal digits in which the wanted order is bytewise. Rows are counted by group; a
group, and later a bucket, of more than BUCKET rows is counted again by longer prefixes of its keys, until
no bucket is larger. Counts before a prefix are summed among the children of its parent (at most
16 ** DIGITS of them) and added to the parent's own, level by level; only rows of one bucket are ever sorted
together. Digits that all keys of the large buckets share are skipped. Histograms stay in Spark; the
driver sees three numbers for each round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import store

#: Rows of a bucket that are sorted together; digits that one level of a histogram adds at most.
BUCKET, DIGITS = 4096, 3


def long_digits(c: Column) -> Column:
    """A long's place as 17 digits, null first."""
    return F.when(c.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))


def text_digits(c: Column) -> Column:
    """A string's place by its UTF-8 bytes, null first; it ends below any byte."""
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.hex(F.encode(c, "UTF-8"))))


def _shared(low: Column, high: Column, longest: int) -> Column:
    """Digits that two keys begin with alike, up to `longest`."""
    at = F.sequence(F.lit(0), F.lit(longest))
    return F.array_max(F.transform(at, lambda k: F.when(F.substring(low, F.lit(1), k) == F.substring(high, F.lit(1), k), k)))


def radix_ranks(rows: DataFrame, group: str, key: Column, rank: str = "rank", total: str = "total", bucket: int = BUCKET, digits: int = DIGITS) -> DataFrame:
    """rows with each row's place (from 0) by key among the rows of its group, and the group's size.

    `rows` is read several times, so it should be stored; `group` has no nulls and `key` no repeats in a group;
    columns that begin with __rank are ours.
    """
    keyed = rows.select(F.col(group).alias("__rank_g"), key.alias("__rank_k"))
    k = F.col("__rank_k")
    count = [F.count(F.lit(1)).alias("__rank_n"), F.min(k).alias("__rank_low"), F.max(k).alias("__rank_high")]
    top = store(keyed.groupBy("__rank_g").agg(*count).withColumn("__rank_p", F.lit("")).withColumn("__rank_before", F.lit(0).cast("long")))
    found, done = top, rows.withColumns({"__rank_g": F.col(group), "__rank_p": F.lit("")})
    final, inside = top.where(F.col("__rank_n") <= bucket), keyed.withColumn("__rank_p", F.lit(""))
    depth = 0
    while True:
        large = found.where(F.col("__rank_n") > bucket)
        # keys are compared over the next 64 digits at a time, however long they are
        low, high = (F.substring(c, depth + 1, 64) for c in ("__rank_low", "__rank_high"))
        seen = large.agg(F.max("__rank_n").alias("n"), F.min(_shared(low, high, 64)).alias("shared")).first()
        if seen.n is None:
            break
        more = max(1, math.ceil(math.log(seen.n / bucket, 16)))
        depths = [depth + seen.shared + min(more, d) for d in range(digits, more + digits, digits)]
        mark = large.select("__rank_g", "__rank_p", F.lit(True).alias("__rank_deeper"))
        inside = inside.join(mark.drop("__rank_deeper"), ["__rank_g", "__rank_p"]).withColumn("__rank_p", F.substring(k, 1, depths[-1]))
        parent_of = lambda at: F.substring("__rank_p", 1, at)
        deepest = store(inside.groupBy("__rank_g", "__rank_p").agg(*count))
        above = large.select("__rank_g", F.col("__rank_p").alias("__rank_parent"), "__rank_before")
        for at, was in zip(depths, [depth, *depths], strict=False):
            level = deepest if at == depths[-1] else deepest.groupBy("__rank_g", parent_of(at).alias("__rank_p")).agg(F.sum("__rank_n").alias("__rank_n"))
            earlier = Window.partitionBy("__rank_g", "__rank_parent").orderBy("__rank_p").rowsBetween(Window.unboundedPreceding, -1)
            level = level.withColumn("__rank_parent", parent_of(was)).withColumn("__rank_own", F.coalesce(F.sum("__rank_n").over(earlier), F.lit(0)))
            level = level.join(above, ["__rank_g", "__rank_parent"]).withColumn("__rank_before", F.col("__rank_before") + F.col("__rank_own"))
            above = level.select("__rank_g", F.col("__rank_p").alias("__rank_parent"), "__rank_before")
        found = store(level.select(*top.columns))
        done = done.join(mark, ["__rank_g", "__rank_p"], "left").withColumn("__rank_p", F.when(F.col("__rank_deeper"), F.substring(key, 1, depths[-1])).otherwise(F.col("__rank_p"))).drop("__rank_deeper")
        final = final.unionByName(found.where(F.col("__rank_n") <= bucket))
        depth = depths[-1]
    final = final.select("__rank_g", "__rank_p", "__rank_before")
    if total:  # by bucket, so that a large group's rows needn't meet in a join on the group
        final = final.join(top.select("__rank_g", F.col("__rank_n").alias(total)), "__rank_g")
    done = done.join(final, ["__rank_g", "__rank_p"])
    done = done.withColumn("__rank_k", key)
    place = F.row_number().over(Window.partitionBy("__rank_g", "__rank_p").orderBy("__rank_k"))
    done = done.withColumn(rank, F.col("__rank_before") + place - 1)
    return done.drop("__rank_g", "__rank_p", "__rank_k", "__rank_before")
