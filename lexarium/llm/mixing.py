"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled by a hash.  A copy of a document finishes
at the virtual time (words of its source up to and with it) / (the source's
target); a second round of the queue repeats the source.  Within a copy each word
has its own finish time, counted the same way.  The line of all sources is sorted by
finish time and cut where the budget is spent.  That place needs no sum over the line:
sources spend their targets evenly, all of them at virtual time 1, and the targets
add up to the budget, so the words that finish by then are those before the cut (a budget in
whole words: a source's last part of a word is left).  The queue of copies is range-sorted by
finish time (``queue``); the copy that is in service at the cut gives the words before it.

Targets share the budget by weight; a target stops at ``most`` times its
source's size, and what is left over is shared again by weight until no target is above.

No source is gathered: running sums are taken in buckets of the shuffle order,
about 4,096 rows each, with the sums of the buckets before added (a prefix scan over
source x bucket).  Sources are ranked the same way, by ranges, so there may be any number
of them.  Only ids and sizes are moved, texts are joined once by ``mixed_rows``.

Cases: a null or blank text has size 0 and is never taken; a null source is a
source of its own, last in order; repeated rows are queued one by one; rows whose id
more than one in 512 rows share, or that have none, are shuffled row by row instead of id by id; rows of one id
with different texts are documents of their own; ties in the shuffle go by id, then size, equal finish times by id; if all
sizes are 0, targets are 0; very long texts are counted whole; an empty table gives an empty one; further columns
stay unless they bear the name of an added one, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import stash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Rows of a bucket, about.
BUCKET = 4096


def words_in(name: str = "text") -> Column:
    """Number of words: each becomes one letter, and white space goes."""
    flat = F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(flat, " \t\n\x0b\f\r", "")).cast("long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with rank (from 0) in an order of all its rows: by ranges, whose sizes are added up."""
    parts = stash(df.repartitionByRange(*order).withColumn("_lx_part", F.spark_partition_id()), "ranges")
    within = W.partitionBy("_lx_part").orderBy(*order)
    sizes = parts.groupBy("_lx_part").agg(F.count("*").alias("n"))  # one row for each range
    before = W.orderBy("_lx_part").rowsBetween(W.unboundedPreceding, -1)
    start = sizes.select("_lx_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_lx_start"))
    both = parts.withColumn("rank", F.row_number().over(within)).join(start, "_lx_part")
    return both.withColumn("rank", F.col("rank") + F.col("_lx_start") - 1).drop("_lx_part", "_lx_start")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """skey, source_size and target of sources given as (skey, source, source_size), one row a source."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    listed = ranked(sizes, F.col("source").asc_nulls_last()).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("weight", weight)
    w = stash(listed, "sources")
    budget = (w.agg(F.sum("source_size")).first()[0] or 0) * share
    # what each weight gets while sources that this takes past their caps have those instead; it only rises
    level, above = -1.0, F.lit(False)
    while True:
        row = w.agg(F.sum(F.when(above, F.col("cap"))).alias("c"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        new = (budget - (row.c or 0.0)) / row.w if row.w else float("inf")
        if new <= level or new == float("inf"):
            level = max(level, new)
            break
        level = new
        above = F.col("cap") / F.col("weight") < F.lit(level)
    return w.select("skey", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, finish (of the first copy), first_taken and second_taken.

    ``docs`` has doc_id, source and size.  ``most`` is 2: two rounds of each queue.
    """
    total = docs.count()
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = lambda *more: F.md5(F.concat(ident, F.lit(":" + seed), *more).cast("binary"))
    digits = next(k for k in range(2, 16) if 16**k * BUCKET >= total)
    rows = docs.withColumn("_lx_skey", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))))
    # fewer than 512 ids, whatever the data
    shared = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") * 512 > max(total, 8 * BUCKET)).select(F.col("doc_id").alias("_lx_hot"))
    rows = rows.withColumn("_lx_row", F.monotonically_increasing_id()).join(F.broadcast(shared), F.col("doc_id") == F.col("_lx_hot"), "left")
    alone = F.col("doc_id").isNotNull() & F.col("_lx_hot").isNull()
    rows = rows.withColumn("_lx_order", F.when(alone, text()).otherwise(text(F.lit("#"), F.col("_lx_row").cast("string")))).drop("_lx_row", "_lx_hot")
    rows = stash(rows.withColumn("_lx_bucket", F.substring("_lx_order", 1, digits)), "mix-rows")
    buckets = stash(rows.groupBy("_lx_skey", "_lx_bucket").agg(F.sum("size").alias("words"), F.min("source").alias("source")), "mix-buckets")
    sources = buckets.groupBy(F.col("_lx_skey").alias("skey")).agg(F.sum("words").alias("source_size"), F.min("source").alias("source"))
    before = W.partitionBy("_lx_skey").orderBy("_lx_bucket").rowsBetween(W.unboundedPreceding, -1)
    aims = targets(sources, weights, share, most)
    start = buckets.select("_lx_skey", "_lx_bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_lx_start"))
    info = start.join(aims, start._lx_skey == aims.skey).drop("skey")
    joined = rows.drop("source_size", "target", "finish", "first_taken", "second_taken").join(info, ["_lx_skey", "_lx_bucket"])
    upto = W.partitionBy("_lx_skey", "_lx_bucket").orderBy("_lx_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    cum = F.col("_lx_start") + F.sum("size").over(upto)
    line = joined.withColumn("_lx_end", cum).withColumn("finish", F.when(F.col("target") > 0, F.col("_lx_end") / F.col("target")))
    # words of a copy that lie before the cut
    goal = F.floor(F.col("target") + 1e-6).cast("long")
    part = lambda begun: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - begun))
    return line.withColumns({"first_taken": part(F.col("_lx_end") - F.col("size")), "second_taken": part(F.col("source_size") + F.col("_lx_end") - F.col("size"))}).drop("_lx_skey", "_lx_order", "_lx_bucket", "_lx_start", "_lx_end")


def queue(docs: DataFrame, **params) -> DataFrame:
    """The cut line of copies (copy 0 or 1, words taken), range-sorted by finish time."""
    rows = mix(docs, **params)
    copies = F.array(F.struct(F.lit(0).alias("copy"), F.col("finish").alias("at"), F.col("first_taken").alias("words")), F.struct(F.lit(1).alias("copy"), (F.col("finish") + F.col("source_size") / F.col("target")).alias("at"), F.col("second_taken").alias("words")))
    line = rows.withColumn("_lx_c", F.explode(copies)).filter("_lx_c.words > 0")
    return line.withColumns({"copy": F.col("_lx_c.copy"), "finish": F.col("_lx_c.at"), "words": F.col("_lx_c.words")}).drop("_lx_c", "first_taken", "second_taken").orderBy("finish", "doc_id", "copy")


def per_document(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row."""
    slim = stash(docs.select("doc_id", "source", words_in().alias("size")), "sizes")
    return mix(slim, **params).select("doc_id", "size", "source_size", "target", (F.col("first_taken") + F.col("second_taken")).alias("taken"))


def mixed_rows(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mix: a row for each copy, a copy in service at the cut shortened to the words taken.

    Texts are moved once, to the words taken of rows with their contents; equal rows are moved as one.
    """
    names = docs.columns
    packed = docs.select(F.col("doc_id").alias("_lx_id"), F.xxhash64(*names).alias("_lx_key"), F.struct(*names).alias("_lx_row"))  # so that no name clashes
    slim = stash(packed.select(F.col("_lx_id").alias("doc_id"), "_lx_key", F.col("_lx_row.source").alias("source"), words_in("_lx_row.text").alias("size")), "sizes")
    copies = F.explode(F.array("first_taken", "second_taken"))
    taken = mix(slim, **params).select(F.col("doc_id").alias("_lx_id"), "_lx_key", "size", copies.alias("words")).filter("words > 0")
    # equal copies of equal rows as one, and those of a row side by side
    kinds = taken.groupBy("_lx_id", "_lx_key", "size", "words").agg(F.count("*").alias("n"))
    plan = kinds.groupBy("_lx_id", "_lx_key").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("words", "n"))).alias("c"))
    rows = packed.groupBy("_lx_id", "_lx_key").agg(F.first("_lx_row").alias("_lx_row"))
    same = rows._lx_id.eqNullSafe(plan._lx_id) & (rows._lx_key == plan._lx_key)
    line = rows.join(plan, same).select("_lx_row", "size", F.explode("c").alias("c")).select("_lx_row", "size", "c.words", F.explode(F.sequence(F.lit(1).cast("long"), "c.n")))
    text = F.col("_lx_row.text")
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    cut = F.when(F.col("words") < F.col("size"), first_words).otherwise(text)
    return line.select(*(cut.alias(n) if n == "text" else F.col(f"_lx_row.`{n}`").alias(n) for n in names))


#: DuckDB SQL for ``per_document`` with the default parameters.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size, md5(concat(CAST(doc_id AS VARCHAR), ':mix')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
w AS (SELECT arg_min(level, cap / weight) AS water FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(cap, coalesce(water, CAST('inf' AS DOUBLE)) * weight) AS target FROM l LEFT JOIN w ON true),
c AS (SELECT d.doc_id, size, source_size, target, CAST(floor(target + 1e-6) AS BIGINT) AS goal, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS begun FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, goal - begun)) + greatest(0, least(size, goal - source_size - begun)) AS BIGINT) AS taken FROM c
"""
