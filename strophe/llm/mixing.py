"""Mixing sources to target weights by hierarchical budgeting.

Sources hang in a tree of domains, languages and sources. A token budget goes from the root down in
proportion to the weights of a node's children. A child can take no more than its documents give in
the permitted number of epochs; what it can't take goes to its siblings by their weights, and only
what all of them can't take was never given to their parent, so it has gone to the parent's siblings.
Each leaf's budget is filled with whole epochs and a prefix of one further epoch. An epoch is a
permutation of the leaf's documents that the seed, the epoch, the id and the text of a document
determine, so files and partitions don't matter; the prefix ends before the first document that would
pass the budget.

The tree is a table with a row for each leaf with documents, and budgets are shared out level by level
in Spark: among a node's children in the order of what a unit of weight could take, totals of those
before give each child's share. Nothing is gathered, so leaves may be as many as hosts. Prefixes are
cut by totals over ranges of the permutation first, so only the range in which a budget ends is
sorted, whatever share of the rows a source has.

Special cases: null languages and sources are leaves of their own, named `unknown`; null and empty
texts count one token (the end); rows of one id and text come one after another, one of them first by
a row number that only tells them apart; whole texts are counted, however long; extra columns may have
any names that don't begin with `__strophe`; nodes without a weight have weight 1; a weight of 0 takes
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import store
from strophe.llm.tokens import with_token_counts

#: Ranges of a permutation that are totalled before any is sorted.
RANGES = 4096

#: Production mixture: weights of tree nodes, by path.
WEIGHTS: dict[tuple[str, ...], float] = {
    ("web",): 4.0, ("books",): 3.0, ("forums",): 2.0, ("code",): 1.0,
    **{(d, lang): w for d in ("web", "books", "forums", "code") for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))},
}


def domain_of_source(source: Column) -> Column:
    """The production tree's domains: sources are dealt to them by the number in their name."""
    number = F.coalesce(F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, ("web", "books", "forums", "code"))), F.pmod(number, F.lit(4)) + 1)


def _weight(path: list[Column], weights: dict[tuple[str, ...], float]) -> Column:
    """The configured weight of the node at a path, else 1."""
    here = {k: float(w) for k, w in weights.items() if len(k) == len(path)}
    if not here:
        return F.lit(1.0)
    table = F.create_map(*(F.lit(x) for k, w in here.items() for x in ("\x00".join(k), w)))
    return F.coalesce(F.try_element_at(table, F.concat_ws("\x00", *path)), F.lit(1.0))


def shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Rows (parent, name, w, most, budget of the parent) with `given`: the budget in proportion to the weights, none
    above its most, shortages going to the others.

    In the order of most / w a child is full if its proportion of what those before leave reaches its
    most; the first that isn't sets the unit for all after it.
    """
    w, most = F.col("w"), F.col("most").cast("double")
    open_ = (w > 0) & (most > 0)
    ratio = F.when(open_, most / w)
    rows = nodes.withColumn("__ratio", ratio)
    by = Window.partitionBy(*parent).orderBy(F.col("__ratio").asc_nulls_last(), name)
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent).orderBy(F.col("__ratio").desc_nulls_first(), F.col(name).desc()).rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("budget") - F.coalesce(F.sum(F.when(open_, most)).over(before), F.lit(0.0))
    rows = rows.withColumn("__unit", F.when(open_, F.greatest(left, F.lit(0.0)) / F.sum(F.when(open_, w)).over(onward)))
    # the unit only grows along the full ones, so the first short one's is the least that a short one can have
    short = F.first(F.when(F.col("__unit") < F.col("__ratio"), F.col("__unit")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    given = F.when(~open_, 0.0).otherwise(F.coalesce(w * short, most))
    return rows.withColumn("given", F.least(given, most)).drop("__ratio", "__unit")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], float], budget_share: float, epochs: int) -> DataFrame:
    """Leaves (levels, tokens) with `budget`: whole tokens for each."""
    can = F.lit(True)
    for d in range(1, len(levels) + 1):
        can &= _weight([F.col(c) for c in levels[:d]], weights) > 0
    root = "__strophe_root"
    capable = leaves.withColumns({root: F.lit(0), "can": F.when(can, F.col("tokens") * epochs).otherwise(F.lit(0))})
    above = capable.groupBy(root).agg(F.least(F.lit(float(budget_share)) * F.sum("tokens"), F.sum("can").cast("double")).alias("budget"))
    for d in range(1, len(levels) + 1):
        path, parent = [root, *levels[:d]], [root, *levels[: d - 1]]
        nodes = capable.groupBy(*path).agg(F.sum("can").alias("most")).join(above, parent)
        shared = shared_out(nodes.withColumn("w", _weight([F.col(c) for c in path[1:]], weights)), parent, path[-1])
        above = shared.select(*path, F.col("given").alias("budget"))
    above = above.drop(root)
    return leaves.join(above.withColumn("budget", F.floor(F.col("budget") + 1e-6)), levels)


def mix(
    docs: DataFrame, budget_share: float = 0.6, weights: dict[tuple[str, ...], float] | None = None, epochs: int = 2, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain=domain_of_source, rows: bool = False, **tokenizer,
) -> DataFrame:
    """One row per chosen document and epoch: id, domain, lang, source, n_tokens, epoch; with rows, the columns of docs.

    budget_share: tokens of the mixture as a share of all tokens.
    """
    spark = docs.sparkSession
    named = ["__strophe_domain", "__strophe_lang", "__strophe_source"]
    unknown = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    base = docs if rows else docs.select(id_col, text_col, lang_col, source_col)
    # an id and a text have one place in an epoch wherever their row lies
    base = base.withColumn("__strophe_key", F.xxhash64(id_col, text_col, F.col(id_col).isNull()))
    counted = with_token_counts(base, "__strophe_tokens", text_col, drop_text=not rows, **tokenizer)
    counted = store(counted.withColumns({
        "__strophe_tokens": F.col("__strophe_tokens") + 1, "__strophe_row": F.monotonically_increasing_id(),
        named[0]: domain(unknown(F.col(source_col))), named[1]: unknown(F.col(lang_col)), named[2]: unknown(F.col(source_col)),
    }))
    leaves = counted.groupBy(*named).agg(F.sum("__strophe_tokens").alias("tokens"))
    plan = store(leaf_budgets(leaves, named, WEIGHTS if weights is None else weights, budget_share, epochs))
    plan = plan.select(*named, F.floor(F.col("budget") / F.col("tokens")).alias("__strophe_full"), (F.col("budget") % F.col("tokens")).alias("__strophe_rest"))
    planned = counted.join(plan, named)
    # the place in the permutation of the epoch that is taken in part
    place = F.xxhash64(F.lit(seed), F.col("__strophe_full"), F.col("__strophe_key"))
    planned = planned.withColumns({"__strophe_place": place, "__strophe_range": F.shiftrightunsigned(place, 64 - RANGES.bit_length() + 1).cast("int")})
    totals = planned.groupBy(*named, "__strophe_range", "__strophe_rest").agg(F.sum("__strophe_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*named).orderBy("__strophe_range"))
    ends = totals.withColumn("upto", upto).where(F.col("upto") > F.col("__strophe_rest"))
    ends = ends.groupBy(*named).agg(F.min_by(F.struct(F.col("__strophe_range").alias("at"), (F.col("upto") - F.col("t")).alias("before")), "__strophe_range").alias("__strophe_end"))
    ranged = planned.join(store(ends), named)  # one row for each leaf
    last = ranged.where(F.col("__strophe_range") == F.col("__strophe_end.at"))
    running = F.sum("__strophe_tokens").over(Window.partitionBy(*named).orderBy("__strophe_place", "__strophe_key", "__strophe_row").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("__strophe_in", F.col("__strophe_end.before") + running <= F.col("__strophe_rest"))
    rest = ranged.where(F.col("__strophe_range") != F.col("__strophe_end.at")).withColumn("__strophe_in", F.col("__strophe_range") < F.col("__strophe_end.at"))
    times = F.col("__strophe_full") + F.col("__strophe_in").cast("long")
    chosen = rest.unionByName(last).where(times > 0).withColumn("__strophe_epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    if rows:
        return chosen.select(*docs.columns)
    return chosen.select(id_col, F.col(named[0]).alias("domain"), F.col(named[1]).alias("lang"), F.col(named[2]).alias("source"), F.col("__strophe_tokens").alias("n_tokens"), F.col("__strophe_epoch").alias("epoch"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
