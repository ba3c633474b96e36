"""Near-dedup by the Jaccard similarity of word shingles: SimHash, banded MinHash, exact checks.

Three bits of a SimHash reach only texts that are nearly equal, so its groups
are one kind of bucket here, and 25 bands of 5 MinHash values are the others: a pair at
similarity s shares a band with probability 1 - (1 - s^5)^25, 0.99995 at 0.8.

Buckets are not paired.  First each text meets the leader of each of its
buckets, the text with the most company in all its buckets, so the original of a group
of copies comes before the copies; pairs are checked exactly on their sets of shingle
hashes, and those that pass are links.  The texts of buckets that hold several components
then go through an exact join on the rarest shingles: with sizes x <= y, an
overlap o is enough if o >= t / (1 + t) (x + y), so two such texts share a shingle among the
first x - o + 1 and y - o + 1 of theirs, rarest first.  In a large group of
copies those are the traces of edits, not what all copies share.  Texts meet
by shingle and class of size; of the texts that meet, the ones in the component that
most of them are in are never set against each other.  So every pair that shares a bucket is in one
component or was judged exactly.

Cases: texts are told apart by a key of their contents and rows without a doc_id
count like others; a null or blank text has one empty shingle, texts of fewer
words a single one; very long texts are taken whole; of repeated rows one stays; an empty table gives an empty
one; further columns are kept as they are.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from . import simhash
from .shared import components, join_counted, stash, text_bytes, tidy, unstash

_BANDS, _ROWS, _LEADERS = 25, 5, 1
#: Sizes of a class differ by this factor at most.
_CLASS = 1.05
_draw = np.random.default_rng(42)
_FACTORS = _draw.integers(0, 1 << 63, _BANDS * _ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, _BANDS * _ROWS, np.uint64)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Distinct XXH64 of a text's word shingles, ascending."""
    words = text.lower().split()  # of bytes: A-Z alone change, ASCII blanks alone split
    n = max(len(words) - width + 1, 1)
    joined = map(b" ".join, zip(*(words[i : i + n] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band of MinHash values."""
    least = np.full(_BANDS * _ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        least = np.minimum(least, (_FACTORS[:, None] * part + _SHIFTS[:, None]).min(1))
    rows = least.reshape(_BANDS, _ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64)


def _arrays(docs: DataFrame, make) -> DataFrame:
    """(key, hs): ``make`` of each text's bytes."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                made = [make(x) for x in b.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                hs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), hs], names=["key", "hs"])

    return docs.select("key", text_bytes().alias("text")).mapInArrow(run, "key long, hs array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of keys those whose sets have a Jaccard similarity of ``least`` or more, written."""
    one = pairs.join(sets.select(F.col("key").alias("b"), F.col("hs").alias("hb")), "b")
    both = one.join(sets.select(F.col("key").alias("a"), F.col("hs").alias("ha")), "a")
    shared = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("n"), (F.size("ha") + F.size("hb")).alias("m"))
    return stash(shared.filter(F.col("n") >= least * (F.col("m") - F.col("n"))).select("a", "b"), "near-links")


def rare_pairs(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of texts that may have a similarity of ``least`` or more, whole: by their rarest shingles.

    ``sets`` has key, root and hs; texts of one root are not paired.
    """
    each = stash(sets.select("key", F.explode("hs").alias("h")), "near-shingles")
    common = stash(each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "near-common")
    listed = join_counted(each, common, ["h"], "n").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("common"))
    # shingles that occur once come first and meet nobody
    rows = sets.select("key", "root", F.size("hs").alias("m")).join(listed, "key")
    share = least / (1 + least)
    need = lambda other: F.lit(share) * (F.col("m") + other) - 1e-6
    size_class = lambda x: F.floor(F.log(x) / float(np.log(_CLASS)) + 1e-9).cast("int")
    places = rows.select("key", "root", "m", F.posexplode("common").alias("i", "s"), (F.col("m") - F.size("common")).alias("u"))
    places = places.select("key", "root", "m", "s.h", (F.col("m") - F.col("u") - F.col("i")).alias("left"))
    # partners of a shorter text are longer, so it needs the shorter list
    short = places.filter(F.col("left") >= need(F.col("m"))).withColumn("cls", size_class(F.col("m"))).withColumn("long", F.lit(False))
    classes = F.sequence(size_class(F.greatest(F.col("m") * least, F.lit(1.0))), size_class(F.col("m")))
    lower = F.greatest(F.pow(F.lit(_CLASS), F.col("cls")) * (1 - 1e-9), F.col("m") * least)
    long = places.withColumn("cls", F.explode(classes)).filter(F.col("left") >= need(lower)).withColumn("long", F.lit(True))
    names = ["h", "cls", "key", "root", "m", "left", "long"]
    lists = stash(short.select(names).union(long.select(names)), "near-lists")
    by_root = lists.groupBy("h", "cls", "root").agg(F.count("*").alias("c"))
    most = by_root.groupBy("h", "cls").agg(F.count("*").alias("kinds"), F.sum("c").alias("n"), F.max(F.struct("c", "root")).getField("root").alias("major"))
    most = stash(most.filter("kinds > 1").select("h", "cls", "n", "major"), "near-most")
    met = stash(join_counted(lists, most, ["h", "cls"], "n").withColumn("own", F.col("root") == F.col("major")).select(*names, "own"), "near-lists-met")
    x = met.filter("NOT long").select("h", "cls", F.col("key").alias("a"), F.col("root").alias("ra"), F.col("m").alias("ma"), F.col("left").alias("la"), F.col("own").alias("oa"))
    y = met.filter("long").select("h", "cls", F.col("key").alias("b"), F.col("root").alias("rb"), F.col("m").alias("mb"), F.col("left").alias("lb"), F.col("own").alias("ob"))
    enough = (F.col("ra") != F.col("rb")) & ((F.col("ma") < F.col("mb")) | ((F.col("ma") == F.col("mb")) & (F.col("a") < F.col("b")))) & (F.least("la", "lb") >= F.lit(share) * (F.col("ma") + F.col("mb")) - 1e-6)
    on = ["h", "cls"]
    pairs = x.join(y.filter("NOT ob"), on).filter(enough).union(x.filter("NOT oa").join(y.filter("ob"), on).filter(enough))
    out = stash(pairs.select("a", "b").distinct(), "near-pairs")
    unstash(each, common, lists, most, met)
    return out


def near_texts(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """(key, root) of texts that have a near copy; root is the same within a component.

    ``docs`` has key (that of the text) and text.
    """
    spark = docs.sparkSession
    groups = simhash.near_groups(docs.select(F.col("key").alias("doc_id"), "text"), width=width)
    bucket = groups.select(F.col("doc_id").alias("key"), F.xxhash64(F.lit("simhash"), "component_id").alias("band"))
    every = stash(_arrays(docs, lambda x: bands(shingles(x, width))).selectExpr("key", "explode(hs) AS band").union(bucket).distinct(), "near-bands")
    shared = stash(every.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "near-shared")
    met = stash(join_counted(every, shared, ["band"], "n"), "near-met")
    unstash(every, shared)
    known = stash(met.groupBy("key").agg(F.sum("n").alias("company")), "near-known")
    texts = docs.groupBy("key").agg(F.first("text").alias("text")).join(known, "key", "left_semi")
    sets = stash(_arrays(texts, lambda x: shingles(x, width)), "near-sets")
    tidy(spark)
    # greatest company first, then greatest key
    order = W.partitionBy("band").orderBy(F.desc("company"), F.desc("key"))
    ranked = met.join(known, "key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= _LEADERS)
    leaders = stash(ranked.select("band", F.col("key").alias("b"), "n"), "near-leaders")
    pairs = join_counted(met.drop("n"), leaders, ["band"], "n").filter("key <> b").select(F.col("key").alias("a"), "b").distinct()
    links = _alike(pairs, sets, least)
    roots = stash(components(links), "near-roots")
    tidy(spark)
    rooted = stash(met.join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("root")), "near-rooted")
    mixed = stash(rooted.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band", "n"), "near-mixed")
    open_ = stash(join_counted(rooted, mixed, ["band"], "n", "left_semi").select("key", "root").distinct(), "near-open")
    more = rare_pairs(sets.join(open_, "key"), least)
    late = _alike(more, sets, least)
    out = components(links.union(late)).select(F.col("node").alias("key"), "root")
    unstash(met, known, sets, leaders, links, roots, rooted, mixed, open_, more, late)
    return out


def one_per_group(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, rows without one last."""
    names = docs.columns
    keyed = docs.select(*names, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_lx_key"))
    roots = near_texts(keyed.select(F.col("_lx_key").alias("key"), "text"), least, width)
    firsts = keyed.groupBy(F.col("_lx_key").alias("key")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"))).alias("f"))
    group = firsts.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct("f.no", "f.id", "key")).alias("f"))
    keep = group.select(F.col("f.key").alias("_lx_k"), F.col("f.id").alias("_lx_d"))
    rows = keyed.groupBy("doc_id", "_lx_key").agg(F.min(F.struct(*(c for c in names if c != "doc_id"))).alias("_lx_row"))
    kept = rows.join(keep, (F.col("_lx_key") == F.col("_lx_k")) & F.col("doc_id").eqNullSafe(F.col("_lx_d")), "left_semi")
    return kept.select(*(F.col(c) if c == "doc_id" else F.col("_lx_row").getField(c).alias(c) for c in names))
