"""Clusters of vectors: centroids, typical members, agreement with a second clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W, functions as F

from ..functions.stats import cosine
from ..operators import topics as T
from .registry import query, table


def vectors(spark, sf):
    """vec_id, embedding, topic (the label; 0 stands for outliers as -1) and a second clustering by coarse position."""
    e = table(spark, sf, "embeddings")
    other = (F.when(F.col("embedding")[0] > 0, 1).otherwise(0) + F.when(F.col("embedding")[1] > 0, 2).otherwise(0)).cast("long")
    return e.select("vec_id", "embedding", F.col("label").cast("long").alias("topic"), other.alias("other"))


_V = "v AS (SELECT vec_id, embedding, CAST(label AS BIGINT) AS topic, CAST((CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END) + (CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END) AS BIGINT) AS other FROM embeddings)"
_CEN = _V + """, x AS (SELECT topic, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM v), c0 AS (SELECT topic, d, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY ALL), c AS (SELECT topic, list(m ORDER BY d) AS centroid FROM c0 GROUP BY topic)"""
_SIM = _CEN + """, sim AS (SELECT v.vec_id, v.topic AS own, c.topic, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.centroid), 9) AS s FROM v CROSS JOIN c)"""


@query(f"WITH {_CEN} SELECT topic, CAST(d - 1 AS BIGINT) AS dim, round(m, 8) AS mean FROM c0")
def topic_centroids(spark, sf):
    return T.centroids(vectors(spark, sf), "topic", "embedding").select("topic", F.col("dim").cast("long").alias("dim"), F.round("mean", 8).alias("mean"))


def similarities(spark, sf):
    v = vectors(spark, sf)
    if v.select("topic").distinct().limit(10_001).count() > 10_000:
        raise ValueError("centroids are broadcast: at most 10,000 clusters")
    c = T.centroid_arrays(v, "topic", "embedding")
    return v.select("vec_id", "other", F.col("topic").alias("own"), "embedding").crossJoin(F.broadcast(c)).select("vec_id", "other", "own", "topic", F.round(cosine(F.col("embedding"), F.col("centroid")), 9).alias("s"))


@query(f"WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic) AS k FROM sim) SELECT vec_id, max(own) AS own, max(topic) FILTER (k = 1) AS nearest, round(max(s), 7) AS similarity, round(max(s) FILTER (own = topic), 7) AS typicality FROM r GROUP BY vec_id")
def nearest_centroid(spark, sf):
    s = similarities(spark, sf)
    g = s.groupBy("vec_id").agg(F.max("own").alias("own"), F.max(F.struct("s", (-F.col("topic")).alias("m"))).alias("b"), F.max(F.when(F.col("own") == F.col("topic"), F.col("s"))).alias("t"))
    return g.select("vec_id", "own", (-F.col("b.m")).alias("nearest"), F.round("b.s", 7).alias("similarity"), F.round("t", 7).alias("typicality"))


@query(f"WITH {_SIM}, r AS (SELECT vec_id, own AS topic, s, row_number() OVER (PARTITION BY own ORDER BY s DESC, vec_id) AS k FROM sim WHERE own = topic) SELECT topic, vec_id, round(s, 7) AS typicality, k AS rank FROM r WHERE k <= 12")
def typical_members(spark, sf):
    s = similarities(spark, sf).filter("own = topic")
    r = s.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("s"), "vec_id"))).filter("rank <= 12")
    return r.select("topic", "vec_id", F.round("s", 7).alias("typicality"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SIM}, o AS (SELECT vec_id, max(s) FILTER (own = topic) AS t, max(s) FILTER (own <> topic) AS b, max(own) AS own FROM sim GROUP BY vec_id) SELECT vec_id, own, round(t - b, 7) AS margin FROM o WHERE t - b < 0.05")
def near_misses(spark, sf):
    """Members that another cluster's centroid is nearly as close to, or closer."""
    o = similarities(spark, sf).groupBy("vec_id").agg(F.max(F.when(F.col("own") == F.col("topic"), F.col("s"))).alias("t"), F.max(F.when(F.col("own") != F.col("topic"), F.col("s"))).alias("b"), F.max("own").alias("own"))
    return o.filter("t - b < 0.05").select("vec_id", "own", F.round(F.col("t") - F.col("b"), 7).alias("margin"))


@query(f"WITH {_SIM}, m AS (SELECT v.vec_id, own AS topic, other, s FROM sim JOIN v ON sim.vec_id = v.vec_id WHERE own = sim.topic), a AS (SELECT *, row_number() OVER (PARTITION BY topic, other ORDER BY s DESC, vec_id) AS j FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY least(j, 2), s DESC, vec_id) AS k FROM a) SELECT topic, vec_id, other, k AS rank FROM r WHERE k <= 5")
def diverse_topk(spark, sf):
    """Five members of each cluster: the best of each sub-group first, then the best of the rest."""
    m = similarities(spark, sf).filter("own = topic").withColumn("j", F.row_number().over(W.partitionBy("topic", "other").orderBy(F.desc("s"), "vec_id")))
    r = m.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy(F.least("j", F.lit(2)), F.desc("s"), "vec_id"))).filter("rank <= 5")
    return r.select("topic", "vec_id", "other", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_V}, n AS (SELECT topic AS a, other AS b, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT sum(n) AS t FROM n), sc AS (SELECT sum(n * (n - 1) / 2) AS c FROM n), sa AS (SELECT sum(x * (x - 1) / 2) AS a FROM (SELECT sum(n) AS x FROM n GROUP BY a)), sb AS (SELECT sum(x * (x - 1) / 2) AS b FROM (SELECT sum(n) AS x FROM n GROUP BY b)), ha AS (SELECT -sum(x / t * ln(x / t)) AS h FROM (SELECT sum(n) AS x FROM n GROUP BY a), t), hb AS (SELECT -sum(x / t * ln(x / t)) AS h FROM (SELECT sum(n) AS x FROM n GROUP BY b), t), hc AS (SELECT -sum(n / t * ln(n / t)) AS h FROM n, t) SELECT CAST(t AS BIGINT) AS n, round((c - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 8) AS ari, round((ha.h + hb.h - hc.h) / ((ha.h + hb.h) / 2), 8) AS nmi FROM t, sc, sa, sb, ha, hb, hc")
def contingency_agreement(spark, sf):
    """Adjusted Rand index and normalised mutual information of two clusterings."""
    a = T.agreement(T.contingency(vectors(spark, sf), "topic", "other"))
    return a.select("n", F.round("ari", 8).alias("ari"), F.round("nmi", 8).alias("nmi"))


_CROSS = _V + ", n AS (SELECT topic AS a, other AS b, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM n)"


def best_overlap(spark, sf):
    a, b = W.partitionBy("a"), W.partitionBy("b")
    n = T.contingency(vectors(spark, sf), "topic", "other")
    return n.withColumn("na", F.sum("n").over(a)).withColumn("nb", F.sum("n").over(b)).withColumn("k", F.row_number().over(a.orderBy(F.desc("n"), "b")))


@query(f"WITH {_CROSS}, s AS (SELECT a, count(*) FILTER (n >= greatest(3, 0.05 * na)) AS spread FROM r GROUP BY a) SELECT r.a AS topic, b AS best, n AS overlap, round(n / (na + nb - n), 6) AS jaccard, round(n / na, 6) AS recall, round(n / nb, 6) AS precision, spread, CASE WHEN n / (na + nb - n) >= 0.5 THEN 'kept' WHEN n / na >= 0.7 AND n / nb < 0.5 THEN 'merged' WHEN n / na < 0.7 AND spread >= 2 THEN 'split' ELSE 'changed' END AS verdict FROM r JOIN s ON r.a = s.a WHERE k = 1")
def crosswalk_verdict(spark, sf):
    """What became of each cluster in a second clustering."""
    r = best_overlap(spark, sf)
    s = r.groupBy("a").agg(F.count_if(F.col("n") >= F.greatest(F.lit(3.0), 0.05 * F.col("na"))).alias("spread"))
    n, na, nb = F.col("n"), F.col("na"), F.col("nb")
    j, rec, pre = n / (na + nb - n), n / na, n / nb
    verdict = F.when(j >= 0.5, "kept").when((rec >= 0.7) & (pre < 0.5), "merged").when((rec < 0.7) & (F.col("spread") >= 2), "split").otherwise("changed")
    return r.filter("k = 1").join(s, "a").select(F.col("a").alias("topic"), F.col("b").alias("best"), n.alias("overlap"), F.round(j, 6).alias("jaccard"), F.round(rec, 6).alias("recall"), F.round(pre, 6).alias("precision"), "spread", verdict.alias("verdict"))


@query(f"WITH {_CROSS}, m AS (SELECT a, max(b) FILTER (k = 1) AS best, max(n) FILTER (k = 1) / max(na) AS first, coalesce(max(n) FILTER (k = 2), 0) / max(na) AS second, max(n) FILTER (k = 1) / max(nb) FILTER (k = 1) AS target FROM r GROUP BY a) SELECT a AS topic, best, round(first, 6) AS recall, CASE WHEN first >= 0.7 AND target >= 0.7 THEN 'stable' WHEN second >= 0.2 THEN 'split' WHEN first >= 0.5 THEN 'merged' ELSE 'dissolved' END AS status FROM m")
def seed_match_status(spark, sf):
    r = best_overlap(spark, sf)
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    m = r.groupBy("a").agg(at(1, "b").alias("best"), (at(1, "n") / F.max("na")).alias("first"), (F.coalesce(at(2, "n"), F.lit(0)) / F.max("na")).alias("second"), (at(1, "n") / at(1, "nb")).alias("target"))
    status = F.when((F.col("first") >= 0.7) & (F.col("target") >= 0.7), "stable").when(F.col("second") >= 0.2, "split").when(F.col("first") >= 0.5, "merged").otherwise("dissolved")
    return m.select(F.col("a").alias("topic"), "best", F.round("first", 6).alias("recall"), status.alias("status"))


@query(f"WITH {_V}, u AS (SELECT 'label' AS scheme, topic AS t, vec_id % 20 AS work FROM v UNION ALL SELECT 'coarse', other, vec_id % 20 FROM v), c AS (SELECT scheme, t, work, count(*) AS n FROM u GROUP BY ALL), g AS (SELECT scheme, t, sum(n) AS size, max(n) / sum(n) AS top, count(*) FILTER (n >= 3) AS broad FROM c GROUP BY ALL) SELECT scheme, count(*) AS n_clusters, CAST(sum(size) FILTER (t = 0) AS BIGINT) AS n_outliers, count(*) FILTER (top >= 0.5) AS single_work, round(avg(broad), 4) AS mean_breadth, CAST(max(size) AS BIGINT) AS largest, round(avg(CASE WHEN top >= 0.8 THEN 1.0 ELSE 0.0 END), 4) AS concentrated FROM g GROUP BY scheme")
def scheme_table(spark, sf):
    """Two clusterings side by side: sizes, outliers, clusters of one work, breadth."""
    v = vectors(spark, sf).withColumn("work", F.col("vec_id") % 20)
    u = v.select(F.explode(F.array(F.struct(F.lit("label").alias("scheme"), F.col("topic").alias("t"), "work"), F.struct(F.lit("coarse").alias("scheme"), F.col("other").alias("t"), "work"))).alias("x")).select("x.*")
    g = u.groupBy("scheme", "t", "work").agg(F.count("*").alias("n")).groupBy("scheme", "t").agg(F.sum("n").alias("size"), (F.max("n") / F.sum("n")).alias("top"), F.count_if(F.col("n") >= 3).alias("broad"))
    return g.groupBy("scheme").agg(F.count("*").alias("n_clusters"), F.sum(F.when(F.col("t") == 0, F.col("size"))).alias("n_outliers"), F.count_if(F.col("top") >= 0.5).alias("single_work"), F.round(F.avg("broad"), 4).alias("mean_breadth"), F.max("size").alias("largest"), F.round(F.avg(F.when(F.col("top") >= 0.8, 1.0).otherwise(0.0)), 4).alias("concentrated"))


@query(f"WITH {_SIM}, m AS (SELECT vec_id, own AS topic, s, vec_id % 20 AS work FROM sim WHERE own = topic) SELECT topic, work, arg_max(vec_id, {{'s': s, 'm': -vec_id}}) AS best, count(*) AS n FROM m GROUP BY ALL")
def best_chunk_per_work(spark, sf):
    """The most typical member of each cluster in each work."""
    m = similarities(spark, sf).filter("own = topic").withColumn("work", F.col("vec_id") % 20)
    return m.groupBy("topic", "work").agg((-F.max(F.struct("s", (-F.col("vec_id")).alias("m")))["m"]).alias("best"), F.count("*").alias("n"))


@query(f"WITH {_V}, w AS (SELECT vec_id % 20 AS work, vec_id % 60 AS edition, vec_id FROM v), n AS (SELECT work, edition, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY CASE WHEN edition % 7 = 0 THEN 0 ELSE 1 END, n DESC, edition) AS k FROM n) SELECT work, edition, n, k = 1 AS representative FROM r")
def representative_editions(spark, sf):
    """The edition that stands for its work: a chosen one, else the one with most chunks."""
    n = vectors(spark, sf).groupBy((F.col("vec_id") % 20).alias("work"), (F.col("vec_id") % 60).alias("edition")).agg(F.count("*").alias("n"))
    k = F.row_number().over(W.partitionBy("work").orderBy(F.when(F.col("edition") % 7 == 0, 0).otherwise(1), F.desc("n"), "edition"))
    return n.withColumn("representative", k == 1)


@query()
def kmeans_cosine(spark, sf):
    """Spherical k-means fitted on all vectors."""
    return T.cosine_kmeans(vectors(spark, sf), "embedding", 10, columns=["vec_id"])


@query()
def mmr_members(spark, sf):
    """Five members of each cluster, relevant and unlike each other, of its thirty most typical."""
    s = similarities(spark, sf).filter("own = topic")
    top = s.withColumn("k", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("s"), "vec_id"))).filter("k <= 30").select("topic", "vec_id")
    return T.diverse_members(top.join(vectors(spark, sf).select("vec_id", "embedding"), "vec_id"), "topic", "vec_id", "embedding", 5)


@query()
def topic_map(spark, sf):
    """Topics as points of a plane, by the cosine distances of their centroids (a reviewed dimension, so small)."""
    c = T.centroids(vectors(spark, sf), "topic", "embedding").groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("c")).orderBy("topic").toPandas()
    x = np.array(c["c"].tolist(), float).reshape(len(c), -1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    at = T.plane(np.sqrt(np.maximum(2 - 2 * x @ x.T, 0)))
    return spark.createDataFrame([(int(t), float(a), float(b)) for t, (a, b) in zip(c["topic"], at)], "topic long, x double, y double")
