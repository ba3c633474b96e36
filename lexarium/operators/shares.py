"""Word-weighted shares rolled up a hierarchy, and statistics over them.

Shares are long tables (entity, topic, share).  A topic that an entity lacks
counts as zero; instead of filling a dense grid at the finest level, means divide
sums by the number of entities, and grids are only made at the level that is reported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def full_shares(rows: DataFrame, entity: Sequence[str], topic: str, words: str, digits: int = 5) -> DataFrame:
    """Share of each topic in its entity's words; all words count, whatever their topic."""
    sums = rows.groupBy(*entity, topic).agg(F.sum(words).alias("words"))
    return sums.withColumn("_total", F.sum("words").over(W.partitionBy(*entity))).withColumn("share", rounded_ratio("words", "_total", digits)).drop("_total")


def rounded_ratio(num: str, den: str, digits: int, scale: int = 0) -> Column:
    """num / den / 10^scale rounded half up to ``digits`` places in whole-number arithmetic, so that ties are exact; num and den are long and not negative."""
    unit = 10 ** (digits - scale)
    return F.expr(f"(2L * {unit}L * `{num}` + `{den}`) div (2L * `{den}`)") / F.lit(10.0**digits)


def mean_over(shares: DataFrame, child: Sequence[str], parent: Sequence[str], topic: str, digits: int = 5) -> DataFrame:
    """Mean share of a parent's children, each child counting alike and absent topics as zero.

    Rounded shares are summed as whole numbers, so the sum does not depend on its order.
    """
    unit = 10**digits
    sizes = shares.select(*parent, *child).distinct().groupBy(*parent).agg(F.count("*").alias("n_children"))
    sums = shares.groupBy(*parent, topic).agg(F.sum(F.round(F.col("share") * unit).cast("long")).alias("s"))
    return sums.join(sizes, list(parent)).select(*parent, topic, rounded_ratio("s", "n_children", digits, digits).alias("share"), "n_children")


def grid(shares: DataFrame, entity: Sequence[str], topic: str) -> DataFrame:
    """A row for each entity and topic, zero where there is none.

    Only as many rows as entities times topics; the topics are a reviewed dimension.
    """
    topics = shares.select(topic).distinct().agg(F.collect_set(topic).alias("_all"))
    have = shares.groupBy(*entity).agg(F.map_from_entries(F.collect_list(F.struct(topic, "share"))).alias("_m"))
    return have.crossJoin(F.broadcast(topics)).select(*entity, F.explode("_all").alias(topic), "_m").withColumn("share", F.coalesce(F.try_element_at("_m", F.col(topic)), F.lit(0.0))).drop("_m")


def adjust(df: DataFrame, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add q: the least p n / rank from each rank up, at most 1."""
    every = W.partitionBy(*keys)
    df = df.withColumn("_rank", F.row_number().over(every.orderBy(p))).withColumn("_n", F.count("*").over(every))
    up = every.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(up))).drop("_rank", "_n")


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), parts: int = 4096) -> DataFrame:
    """Each distinct value of each group once: rank_low, rank_mean (of rows that share it), n_tie and n of the group.

    No group is sorted in one task: values are counted, dealt to ranges of equal width between
    a group's ends, and counts of the ranges before are added (two-level prefix sums).  Nulls are left out.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_tie"))
    ends = counts.groupBy(*keys).agg(F.min(x).alias("_min"), F.max(x).alias("_max"), F.sum("n_tie").alias("n"))
    both = counts.join(ends, keys) if keys else counts.crossJoin(F.broadcast(ends))  # one row
    # rises with the value; one range where all are equal
    spot = F.when(F.col("_max") > F.col("_min"), F.floor((x - F.col("_min")) / (F.col("_max") - F.col("_min")) * (parts - 1))).otherwise(0).cast("int")
    ranged = both.withColumn("_part", spot)
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("n_tie").alias("_s"))
    start = sums.select(*keys, "_part", F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    low = F.col("_start") + F.coalesce(F.sum("n_tie").over(within), F.lit(0)) + 1
    return ranged.join(start, [*keys, "_part"]).select(*keys, value, low.alias("rank_low"), (low + (F.col("n_tie") - 1) / 2).alias("rank_mean"), "n_tie", "n")


def _ties(ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """t, the sum of t^3 - t over ties, and n of each group."""
    t = F.col("n_tie").cast("double")
    return ranks.groupBy(*keys).agg(F.sum(t * t * t - t).alias("t"), F.max("n").alias("n"))


def kruskal(df: DataFrame, value: str, group: str, keys: Sequence[str]) -> DataFrame:
    """Kruskal-Wallis H with tie correction, for each key; null if all values are equal."""
    ranks = value_ranks(df, value, keys)
    m = df.groupBy(*keys, value, group).agg(F.count("*").alias("m"))
    by = m.join(ranks, [*keys, value]).groupBy(*keys, group).agg(F.sum(F.col("rank_mean") * F.col("m")).alias("r"), F.sum("m").alias("m"), F.max("n").alias("n"))
    h = by.groupBy(*keys).agg((12 / (F.max("n") * (F.max("n") + 1)) * F.sum(F.col("r") * F.col("r") / F.col("m")) - 3 * (F.max("n") + 1)).alias("raw"), F.count("*").alias("groups"))
    c = 1 - F.col("t") / (F.pow("n", F.lit(3)) - F.col("n"))
    return h.join(_ties(ranks, keys), list(keys)).select(*keys, "n", "groups", F.when(c > 0, F.col("raw") / c).alias("h"))


def mann_whitney(df: DataFrame, value: str, is_first: Column, keys: Sequence[str]) -> DataFrame:
    """U of the rows marked as first against the others, with the z score of the normal approximation."""
    ranks = value_ranks(df, value, keys)
    m = df.withColumn("_a", is_first).groupBy(*keys, value).agg(F.count_if(F.col("_a")).alias("a"), F.count_if(~F.col("_a")).alias("b"))
    u = m.join(ranks, [*keys, value]).groupBy(*keys).agg(F.sum(F.when(F.col("a") > 0, F.col("rank_mean") * F.col("a"))).alias("ra"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    u = u.join(_ties(ranks, keys).drop("n"), list(keys))
    n = F.col("n1") + F.col("n2")
    u = u.withColumn("u", F.col("ra") - F.col("n1") * (F.col("n1") + 1) / 2)
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("t") / (n * (n - 1)))
    return u.select(*keys, "n1", "n2", "u", F.when(var > 0, (F.col("u") - F.col("n1") * F.col("n2") / 2) / F.sqrt(var)).alias("z"))


def percent_below(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """Add the share in percent of the group's values that are strictly less."""
    ranks = value_ranks(df, value, keys).select(*keys, value, ((F.col("rank_low") - 1) / F.col("n") * 100).alias(name))
    return df.join(ranks, [*keys, value], "left")


def top_with_rest(df: DataFrame, keys: Sequence[str], topic: str, share: str, n: int, rest: str = "other") -> DataFrame:
    """The n largest topics of each group and one row for the remainder."""
    order = W.partitionBy(*keys).orderBy(F.desc(share), topic)
    named = df.withColumn("_r", F.row_number().over(order)).withColumn("label", F.when(F.col("_r") <= n, F.col(topic)).otherwise(F.lit(rest)))
    return named.groupBy(*keys, "label").agg(F.round(F.sum(share), 5).alias("share"), F.min("_r").cast("long").alias("position"))


def leave_one_out(df: DataFrame, value: str, keys: Sequence[str]) -> Column:
    """Mean of the group's other values; null in a group of one."""
    w = W.partitionBy(*keys)
    n = F.count("*").over(w)
    return F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1))


def resampled(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    """Bootstrap, permutation or same-size draws of a group in one seeded Python function per group.

    Groups are tables of works by topic, a reviewed dimension; the draws of a group need all of it.
    """
    return df.groupBy(key).applyInPandas(run, schema)
