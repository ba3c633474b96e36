"""Shares and comparisons over the sales hierarchy: line items are chunks (words: quantity, topic: return flag),
orders are editions, customers works, regions groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.stats import chi2_tail_udf, jsd_term, normal_tail_udf
from ..operators import shares as S
from .registry import SQL, query, table


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """genre, work, edition, topic, words of each chunk."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("topic"), F.col("l_quantity").cast("long").alias("words"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("work"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("work"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("genre"))
    return li.join(o, "l_orderkey").join(c, "work").join(n, "n_nationkey").join(r, "n_regionkey").select("genre", "work", F.col("l_orderkey").alias("edition"), "topic", "words")


def work_shares(spark: SparkSession, sf: str) -> DataFrame:
    e = S.full_shares(chunks(spark, sf), ["genre", "work", "edition"], "topic", "words")
    return S.mean_over(e, ["edition"], ["genre", "work"], "topic")


_CHUNKS = """chunks AS (SELECT r_name AS genre, c_custkey AS work, l_orderkey AS edition, l_returnflag AS topic, CAST(l_quantity AS BIGINT) AS words
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_WORKS = _CHUNKS + """,
es AS (SELECT genre, work, edition, topic, CAST((200000 * sum(words) + sum(sum(words)) OVER (PARTITION BY edition)) // (2 * sum(sum(words)) OVER (PARTITION BY edition)) AS DOUBLE) / 100000.0::DOUBLE AS share FROM chunks GROUP BY genre, work, edition, topic),
ne AS (SELECT work, count(DISTINCT edition) AS n FROM es GROUP BY work),
ws AS (SELECT genre, es.work, topic, CAST((2 * sum(CAST(round(share * 100000) AS BIGINT)) + max(n)) // (2 * max(n)) AS DOUBLE) / 100000.0::DOUBLE AS share FROM es JOIN ne ON es.work = ne.work GROUP BY genre, es.work, topic),
ts AS (SELECT DISTINCT topic FROM ws),
wk AS (SELECT DISTINCT genre, work FROM ws),
wd AS (SELECT wk.genre, wk.work, ts.topic, coalesce(ws.share, 0) AS share FROM wk CROSS JOIN ts LEFT JOIN ws ON wk.work = ws.work AND ts.topic = ws.topic)"""


def units():
    """Shares summed as whole hundred-thousandths, so that the sum does not depend on its order."""
    return F.sum(F.round(F.col("share") * 100_000).cast("long")).alias("units")


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return S.grid(work_shares(spark, sf), ["genre", "work"], "topic").select("genre", "work", "topic", "share")


@query(f"""WITH {_WORKS}
SELECT genre, topic, CAST((2 * sum(CAST(round(share * 100000) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 100000.0::DOUBLE AS mean_share, round(median(share), 6) AS median_share, count(*) FILTER (share > 0) AS n_with, count(*) AS n_works FROM wd GROUP BY genre, topic""")
def genre_topic_share(spark, sf):
    g = dense(spark, sf).groupBy("genre", "topic").agg(units(), F.round(F.median("share"), 6).alias("median_share"), F.count_if(F.col("share") > 0).alias("n_with"), F.count("*").alias("n_works"))
    return g.withColumn("mean_share", S.rounded_ratio("units", "n_works", 5, 5)).drop("units")


@query(f"""WITH {_CHUNKS}, t AS (SELECT edition, sum(words) AS w FROM chunks GROUP BY edition)
SELECT chunks.edition, round(coalesce(sum(words) FILTER (topic = 'A'), 0) / max(w), 5) AS t_A, round(coalesce(sum(words) FILTER (topic = 'N'), 0) / max(w), 5) AS t_N, round(coalesce(sum(words) FILTER (topic = 'R'), 0) / max(w), 5) AS t_R, CAST(max(w) AS BIGINT) AS words
FROM chunks JOIN t ON chunks.edition = t.edition GROUP BY chunks.edition""")
def edition_topic_share_wide(spark, sf):
    wide = chunks(spark, sf).groupBy("edition").pivot("topic", ["A", "N", "R"]).agg(F.sum("words"))
    total = sum((F.coalesce(F.col(t), F.lit(0)) for t in "ANR"), F.lit(0).cast("long"))
    return wide.select("edition", *(F.round(F.coalesce(F.col(t), F.lit(0)) / total, 5).alias(f"t_{t}") for t in "ANR"), total.alias("words"))


@query(f"""WITH {_WORKS}, k AS (SELECT genre, work, topic, share / sum(share) OVER (PARTITION BY work) AS c, sum(share) OVER (PARTITION BY work) AS s FROM wd WHERE topic <> 'N')
SELECT genre, topic, round(avg(c), 6) AS mean_share, count(*) AS n_works FROM k WHERE s > 0 GROUP BY genre, topic""")
def conditional_composition(spark, sf):
    """Composition over the kept topics only, of works that have any."""
    kept = dense(spark, sf).filter("topic <> 'N'").withColumn("s", F.sum("share").over(W.partitionBy("work"))).filter("s > 0")
    return kept.groupBy("genre", "topic").agg(F.round(F.avg(F.col("share") / F.col("s")), 6).alias("mean_share"), F.count("*").alias("n_works"))


@query(f"""WITH {_CHUNKS}, cats AS (SELECT unnest(['A', 'N', 'R', 'X']) AS topic),
s AS (SELECT topic, count(*) AS n_chunks, sum(words) AS words, count(DISTINCT work) AS n_works FROM chunks GROUP BY topic UNION ALL SELECT 'ALL', count(*), sum(words), count(DISTINCT work) FROM chunks)
SELECT coalesce(cats.topic, s.topic) AS category, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(coalesce(n_works, 0) AS BIGINT) AS n_works FROM cats FULL JOIN s ON cats.topic = s.topic""")
def category_coverage_total(spark, sf):
    """Chunks, words and works of each category, empty ones too, and of all together."""
    c = chunks(spark, sf)
    by = c.rollup("topic").agg(F.count("*").alias("n_chunks"), F.sum("words").alias("words"), F.countDistinct("work").alias("n_works")).withColumn("category", F.coalesce("topic", F.lit("ALL"))).drop("topic")
    listed = spark.createDataFrame([("A",), ("N",), ("R",), ("X",), ("ALL",)], "category string")
    return listed.join(by, "category", "left").na.fill(0)


@query(f"""WITH {_CHUNKS}, n AS (SELECT genre, work, sum(words) AS w FROM chunks GROUP BY genre, work), r AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY w DESC, work) AS k, sum(w) OVER (PARTITION BY genre) AS t FROM n)
SELECT genre, CAST(max(work) FILTER (k = 1) AS BIGINT) AS top_work, round(max(w) FILTER (k = 1) / max(t), 6) AS top_share, round(sum(w) FILTER (k <= 3) / max(t), 6) AS top3_share, count(*) AS n_works FROM r GROUP BY genre""")
def dominant_member(spark, sf):
    """The work with most words of each group, its share and that of the first three."""
    n = chunks(spark, sf).groupBy("genre", "work").agg(F.sum("words").alias("w"))
    top = n.withColumn("k", F.row_number().over(W.partitionBy("genre").orderBy(F.desc("w"), "work"))).filter("k <= 3").groupBy("genre").agg(F.max(F.when(F.col("k") == 1, F.col("work"))).alias("top_work"), F.max("w").alias("m"), F.sum("w").alias("m3"))
    total = n.groupBy("genre").agg(F.sum("w").alias("t"), F.count("*").alias("n_works"))
    return top.join(total, "genre").select("genre", "top_work", F.round(F.col("m") / F.col("t"), 6).alias("top_share"), F.round(F.col("m3") / F.col("t"), 6).alias("top3_share"), "n_works")


_BRANDS = "b AS (SELECT l_returnflag AS g, p_brand AS topic, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def brands(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("long").alias("q"))
    return li.join(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("topic")), "p_partkey").groupBy("g", "topic").agg(F.sum("q").alias("w"))


@query(f"""WITH {_BRANDS}, s AS (SELECT g, topic, round(w / sum(w) OVER (PARTITION BY g), 5) AS share FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY share DESC, topic) AS k FROM s)
SELECT g, CASE WHEN k <= 5 THEN topic ELSE 'other' END AS label, round(sum(share), 5) AS share, CAST(min(k) AS BIGINT) AS position FROM r GROUP BY 1, 2""")
def top_n_topics_with_remainder(spark, sf):
    s = brands(spark, sf).withColumn("share", F.round(F.col("w") / F.sum("w").over(W.partitionBy("g")), 5))
    return S.top_with_rest(s, ["g"], "topic", "share", 5)


@query(f"""WITH {_WORKS}, m AS (SELECT genre, topic, CAST((2 * sum(CAST(round(share * 100000) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 100000.0::DOUBLE AS mean FROM wd GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY mean DESC, genre) AS k, count(*) OVER (PARTITION BY topic) AS n FROM m)
SELECT topic, max(genre) FILTER (k = 1) AS highest, max(genre) FILTER (k = 2) AS second, max(genre) FILTER (k = n) AS lowest, round(max(mean) FILTER (k = 1) / max(mean) FILTER (k = 2), 4) AS ratio FROM r GROUP BY topic""")
def rank_first_second_last(spark, sf):
    m = dense(spark, sf).groupBy("genre", "topic").agg(units(), F.count("*").alias("n_works")).withColumn("mean", S.rounded_ratio("units", "n_works", 5, 5))
    every = W.partitionBy("topic")
    r = m.withColumn("k", F.row_number().over(every.orderBy(F.desc("mean"), "genre"))).withColumn("n", F.count("*").over(every))
    at = lambda cond, c: F.max(F.when(cond, F.col(c)))
    k, n = F.col("k"), F.col("n")
    return r.groupBy("topic").agg(at(k == 1, "genre").alias("highest"), at(k == 2, "genre").alias("second"), at(k == n, "genre").alias("lowest"), F.round(at(k == 1, "mean") / at(k == 2, "mean"), 4).alias("ratio"))


@query("""SELECT c_custkey, c_mktsegment, round((rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1) / count(*) OVER (PARTITION BY c_mktsegment) * 100, 6) AS pct FROM customer""")
def percent_below_rank(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return S.percent_below(c, "c_acctbal", ["c_mktsegment"], "pct").select("c_custkey", "c_mktsegment", F.round("pct", 6).alias("pct"))


_P = "p AS (SELECT p_brand, p_partkey, 1 / (1 + abs(p_retailprice - 1000)) AS p FROM part)"


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM p)
SELECT p_brand, p_partkey, round(p, 9) AS p, round(least(1.0, min(p * n / k) OVER (PARTITION BY p_brand ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def bh_adjust(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", (1 / (1 + F.abs(F.col("p_retailprice") - 1000))).alias("p"))
    return S.adjust(p, "p", ["p_brand"]).select("p_brand", "p_partkey", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


_RANKS = "x AS (SELECT *, rank() OVER (PARTITION BY topic ORDER BY share) + (count(*) OVER (PARTITION BY topic, share) - 1) / 2 AS rk, count(*) OVER (PARTITION BY topic, share) AS t, count(*) OVER (PARTITION BY topic) AS n FROM wd)"


@query(f"""WITH {_WORKS}, {_RANKS}, g AS (SELECT topic, genre, sum(rk) AS r, count(*) AS m, max(n) AS n FROM x GROUP BY 1, 2), h AS (SELECT topic, 12 / (max(n) * (max(n) + 1)) * sum(r * r / m) - 3 * (max(n) + 1) AS raw, count(*) AS groups, max(n) AS n FROM g GROUP BY topic),
c AS (SELECT topic, 1 - sum(t * t - 1) / (power(max(n), 3) - max(n)) AS c FROM x GROUP BY topic)
SELECT h.topic, n, groups, round(CASE WHEN c > 0 THEN raw / c END, 6) AS h FROM h JOIN c ON h.topic = c.topic""")
def kruskal_wallis_h(spark, sf):
    return S.kruskal(dense(spark, sf), "share", "genre", ["topic"]).withColumn("h", F.round("h", 6))


@query(f"""WITH {_WORKS}, {_RANKS}, u AS (SELECT topic, sum(rk) FILTER (genre = 'ASIA') AS ra, count(*) FILTER (genre = 'ASIA') AS n1, count(*) FILTER (genre <> 'ASIA') AS n2, sum(t * t - 1) AS t FROM x GROUP BY topic)
SELECT topic, n1, n2, round(ra - n1 * (n1 + 1) / 2, 4) AS u, round((ra - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM u""")
def mann_whitney_u(spark, sf):
    return S.mann_whitney(dense(spark, sf), "share", F.col("genre") == "ASIA", ["topic"]).withColumns({"u": F.round("u", 4), "z": F.round("z", 6)})


@query()
def rank_test_p_values(spark, sf):
    """Kruskal-Wallis and U test p values with their adjusted q values; the tails come from a small Python function."""
    h = S.kruskal(dense(spark, sf), "share", "genre", ["topic"]).withColumn("p_h", chi2_tail_udf("h", F.col("groups") - 1))
    u = S.mann_whitney(dense(spark, sf), "share", F.col("genre") == "ASIA", ["topic"]).withColumn("p_u", normal_tail_udf("z"))
    return S.adjust(h.join(u.select("topic", "u", "p_u"), "topic"), "p_h").select("topic", "h", "p_h", "q", "u", "p_u")


def _jsd(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    return f"round(sum((CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2), 9)"


_PROFILE = "pr AS (SELECT genre, topic, avg(share) AS m FROM wd GROUP BY 1, 2), pf AS (SELECT genre, topic, m / sum(m) OVER (PARTITION BY genre) AS p FROM pr)"


@query(f"""WITH {_WORKS}, g AS (SELECT genre, topic, sum(share) AS s, count(*) AS n FROM wd GROUP BY 1, 2), o AS (SELECT genre, topic, s / n AS a, (sum(s) OVER (PARTITION BY topic) - s) / (sum(n) OVER (PARTITION BY topic) - n) AS b FROM g),
z AS (SELECT genre, a / sum(a) OVER (PARTITION BY genre) AS p, b / sum(b) OVER (PARTITION BY genre) AS q FROM o)
SELECT genre, {_jsd("p", "q")} AS jsd FROM z GROUP BY genre""")
def jsd_group_vs_rest(spark, sf):
    """Divergence of each group's mean profile from that of all other works."""
    g = dense(spark, sf).groupBy("genre", "topic").agg(F.sum("share").alias("s"), F.count("*").alias("n"))
    t, e = W.partitionBy("topic"), W.partitionBy("genre")
    o = g.withColumn("a", F.col("s") / F.col("n")).withColumn("b", (F.sum("s").over(t) - F.col("s")) / (F.sum("n").over(t) - F.col("n")))
    z = o.withColumn("p", F.col("a") / F.sum("a").over(e)).withColumn("q", F.col("b") / F.sum("b").over(e))
    return z.groupBy("genre").agg(F.round(F.sum(jsd_term(F.col("p"), F.col("q"))), 9).alias("jsd"))


@query(f"""WITH {_WORKS}, {_PROFILE} SELECT a.genre AS genre_a, b.genre AS genre_b, {_jsd("a.p", "b.p")} AS jsd
FROM pf a JOIN pf b ON a.topic = b.topic AND a.genre < b.genre GROUP BY 1, 2""")
def jsd_pairs(spark, sf):
    """Divergence of every two groups: one row a pair of groups, joined on topics."""
    pr = dense(spark, sf).groupBy("genre", "topic").agg(F.avg("share").alias("m"))
    pf = pr.select("genre", "topic", (F.col("m") / F.sum("m").over(W.partitionBy("genre"))).alias("p"))
    b = pf.select(F.col("genre").alias("genre_b"), "topic", F.col("p").alias("q"))
    return pf.withColumnRenamed("genre", "genre_a").join(b, "topic").filter("genre_a < genre_b").groupBy("genre_a", "genre_b").agg(F.round(F.sum(jsd_term(F.col("p"), F.col("q"))), 9).alias("jsd"))


@query(f"""WITH {_WORKS}, w0 AS (SELECT *, sum(share) OVER (PARTITION BY work) AS s FROM wd), wn AS (SELECT genre, work, topic, share / s AS share FROM w0 WHERE s > 0),
g AS (SELECT genre, topic, sum(share) AS s, count(*) AS n FROM wn GROUP BY 1, 2),
l AS (SELECT w.work, w.genre AS own, g.genre, w.topic, w.share AS p, CASE WHEN w.genre = g.genre THEN CASE WHEN n > 1 THEN (g.s - w.share) / (n - 1) END ELSE g.s / n END AS q FROM wn w JOIN g ON w.topic = g.topic),
d AS (SELECT work, own, genre, {_jsd("p", "q")} AS d FROM l GROUP BY 1, 2, 3 HAVING count(q) = count(*)),
k AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY d, genre) AS r FROM d)
SELECT work, own, max(genre) FILTER (r = 1) AS nearest, round(min(d), 7) AS distance, round(max(d) FILTER (genre = own), 7) AS own_distance FROM k GROUP BY work, own""")
def leave_one_out_nearest(spark, sf):
    """The group whose mean profile is nearest to each work, its own group's without the work."""
    w = dense(spark, sf).withColumn("s", F.sum("share").over(W.partitionBy("work"))).filter("s > 0").select("genre", "work", "topic", (F.col("share") / F.col("s")).alias("p"))
    g = w.groupBy("genre", "topic").agg(F.sum("p").alias("s"), F.count("*").alias("n")).withColumnRenamed("genre", "other")
    l = w.join(g, "topic")  # groups x topics rows; measured before they are broadcast
    q = F.when(F.col("genre") == F.col("other"), F.when(F.col("n") > 1, (F.col("s") - F.col("p")) / (F.col("n") - 1))).otherwise(F.col("s") / F.col("n"))
    d = l.withColumn("q", q).groupBy("work", F.col("genre").alias("own"), "other").agg(F.round(F.sum(jsd_term(F.col("p"), F.col("q"))), 9).alias("d"), F.count("q").alias("nq"), F.count("*").alias("n")).filter("nq = n")
    best = d.groupBy("work", "own").agg(F.min(F.struct("d", "other")).alias("m"), F.max(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("o"))
    return best.select("work", "own", F.col("m.other").alias("nearest"), F.round("m.d", 7).alias("distance"), F.round("o", 7).alias("own_distance"))


@query(f"""WITH {_CHUNKS}, n AS (SELECT genre, topic, work, sum(words) AS w FROM chunks GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY genre, topic ORDER BY w DESC, work) AS k FROM n),
t AS (SELECT genre, topic, sum(w) AS a, sum(w) FILTER (k > 1) AS b FROM r GROUP BY 1, 2)
SELECT genre, topic, round(a / sum(a) OVER (PARTITION BY genre), 6) AS share_all, round(coalesce(b, 0) / sum(b) OVER (PARTITION BY genre), 6) AS share_without, (a / sum(a) OVER (PARTITION BY genre) >= 0.33) = (coalesce(b, 0) / sum(b) OVER (PARTITION BY genre) >= 0.33) AS robust FROM t""")
def dominant_drop_sensitivity(spark, sf):
    """Shares of topics with and without the work that gives most to each."""
    n = chunks(spark, sf).groupBy("genre", "topic", "work").agg(F.sum("words").alias("w"))
    t = n.groupBy("genre", "topic").agg(F.sum("w").alias("a"), (F.sum("w") - F.max("w")).alias("b"))
    e = W.partitionBy("genre")
    sa, sb = F.col("a") / F.sum("a").over(e), F.col("b") / F.sum("b").over(e)
    return t.select("genre", "topic", F.round(sa, 6).alias("share_all"), F.round(sb, 6).alias("share_without"), ((sa >= 0.33) == (sb >= 0.33)).alias("robust"))


_INV = "i AS (SELECT r_name AS genre, p_type AS topic, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"


def inventory(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("long").alias("q"))
    li = li.join(table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("topic")), "p_partkey")
    e = chunks(spark, sf).select(F.col("edition").alias("l_orderkey"), "genre").distinct()
    return li.join(e, "l_orderkey").groupBy("genre", "topic").agg(F.sum("q").alias("w"))


@query(f"""WITH {_INV}, s AS (SELECT *, w / sum(w) OVER (PARTITION BY genre) AS share FROM i), f AS (SELECT * FROM s WHERE share >= 0.01), c AS (SELECT topic, count(*) AS n, min(genre) AS single, round(sum(share), 6) AS total FROM f GROUP BY topic)
SELECT topic, n AS n_groups, CASE WHEN n = (SELECT count(DISTINCT genre) FROM i) THEN 'shared' WHEN n = 1 THEN 'only ' || single ELSE 'partial' END AS kind, total FROM c""")
def shared_exclusive_inventory(spark, sf):
    """Which topics reach a floor of one percent in all groups, in one alone, or in some."""
    s = inventory(spark, sf).withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy("genre")))
    groups = s.agg(F.countDistinct("genre").alias("g"))
    c = s.filter("share >= 0.01").groupBy("topic").agg(F.count("*").alias("n_groups"), F.min("genre").alias("one"), F.round(F.sum("share"), 6).alias("total"))
    return c.crossJoin(F.broadcast(groups)).select("topic", "n_groups", F.when(F.col("n_groups") == F.col("g"), "shared").when(F.col("n_groups") == 1, F.concat(F.lit("only "), "one")).otherwise("partial").alias("kind"), "total")


@query(f"""WITH {_WORKS}, m AS (SELECT topic, avg(share) FILTER (genre = 'EUROPE') AS a, avg(share) FILTER (genre <> 'EUROPE') AS b, count(*) FILTER (genre = 'EUROPE' AND share > 0) AS with_a, count(*) FILTER (genre <> 'EUROPE' AND share > 0) AS with_b FROM wd GROUP BY topic),
k AS (SELECT topic, work, share / sum(share) OVER (PARTITION BY topic) AS part, row_number() OVER (PARTITION BY topic ORDER BY share DESC, work) AS r FROM wd WHERE genre = 'EUROPE')
SELECT m.topic, round(a, 9) AS mean_a, round(b, 9) AS mean_b, round(100 * (a - b), 7) AS diff_pp, round(a / b, 4) AS ratio, with_a, with_b, work AS top_work, round(part, 6) AS top_part, part >= 0.5 AS one_work FROM m JOIN k ON m.topic = k.topic AND r = 1""")
def group_contrast(spark, sf):
    """One group against all others, topic by topic, with the work that gives most to it."""
    d = dense(spark, sf)
    own = F.col("genre") == "EUROPE"
    m = d.groupBy("topic").agg(F.avg(F.when(own, F.col("share"))).alias("a"), F.avg(F.when(~own, F.col("share"))).alias("b"), F.count_if(own & (F.col("share") > 0)).alias("with_a"), F.count_if(~own & (F.col("share") > 0)).alias("with_b"), F.sum(F.when(own, F.col("share"))).alias("s"), F.min(F.when(own, F.struct((-F.col("share")).alias("m"), "work"))).alias("top"))
    part = -F.col("top.m") / F.col("s")
    return m.select("topic", F.round("a", 9).alias("mean_a"), F.round("b", 9).alias("mean_b"), F.round(100 * (F.col("a") - F.col("b")), 7).alias("diff_pp"), F.round(F.col("a") / F.col("b"), 4).alias("ratio"), "with_a", "with_b", F.col("top.work").alias("top_work"), F.round(part, 6).alias("top_part"), (part >= 0.5).alias("one_work"))


@query(f"""WITH {_WORKS}, a AS (SELECT topic, avg(share) AS mean, median(share) AS med, count(*) FILTER (share > 0) / count(*) AS prevalence FROM wd GROUP BY topic), k AS (SELECT topic, share / sum(share) OVER (PARTITION BY topic) AS part, row_number() OVER (PARTITION BY topic ORDER BY share DESC, work) AS r FROM wd)
SELECT a.topic, round(mean, 9) AS mean_share, round(med, 6) AS median_share, round(prevalence, 6) AS prevalence, part >= 0.5 AS single_work FROM a JOIN k ON a.topic = k.topic AND r = 1""")
def topic_table(spark, sf):
    """Mean, median and prevalence of topics over works, and whether one work carries a topic."""
    a = dense(spark, sf).groupBy("topic").agg(F.round(F.avg("share"), 9).alias("mean_share"), F.round(F.median("share"), 6).alias("median_share"), F.round(F.count_if(F.col("share") > 0) / F.count("*"), 6).alias("prevalence"), (F.max("share") / F.sum("share") >= 0.5).alias("single_work"))
    return a


@query()
def bootstrap_jsd(spark, sf):
    """Divergence of each group from the rest with a bootstrap interval, a permutation p and same-size draws."""
    d = dense(spark, sf).groupBy("genre", "work").pivot("topic", ["A", "N", "R"]).agg(F.first("share"))
    tagged = d.crossJoin(F.broadcast(d.select(F.col("genre").alias("target")).distinct()))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("work")
        x, own = p[["A", "N", "R"]].to_numpy(float), (p["genre"] == p["target"]).to_numpy()
        rng = np.random.default_rng([20, len(p), int(own.sum())])

        def profile(v):
            m = v.mean(0)
            return m / m.sum() if m.sum() > 0 else np.full(len(m), 1 / len(m))

        def jsd(a, b):
            a, b = profile(a), profile(b)
            m = (a + b) / 2
            kl = lambda v: np.sum(np.where(v > 0, v * np.log2(np.where(v > 0, v, 1) / m), 0))
            return (kl(a) + kl(b)) / 2

        a, b = x[own], x[~own]
        seen = jsd(a, b)
        boot = [jsd(a[rng.integers(len(a), size=len(a))], b[rng.integers(len(b), size=len(b))]) for _ in range(1000)]
        null = []
        for _ in range(1000):
            o = rng.permutation(own)
            null.append(jsd(x[o], x[~o]))
        draws = [jsd(b[rng.choice(len(b), min(len(a), len(b)), replace=False)], b) for _ in range(300)]
        return pd.DataFrame({"genre": [p["target"].iloc[0]], "jsd": [seen], "low": [np.quantile(boot, 0.025)], "high": [np.quantile(boot, 0.975)], "p": [(np.sum(np.array(null) >= seen) + 1) / 1001], "percentile": [100 * np.mean(np.array(draws) <= seen)]})

    return S.resampled(tagged, "target", run, "genre string, jsd double, low double, high double, p double, percentile double")


@query(f"""WITH {_WORKS}, s AS (SELECT topic, avg(share) FILTER (genre = 'ASIA') AS a, avg(share) FILTER (genre = 'AMERICA') AS b FROM wd GROUP BY topic), r AS (SELECT *, row_number() OVER (ORDER BY (a + b) / 2 DESC, topic) AS k FROM s)
SELECT topic, CAST(k AS BIGINT) AS position, round(a, 9) AS mean_a, round(b, 9) AS mean_b, round(sum((a + b) / 2) OVER (), 8) AS top_sum FROM r WHERE k <= 10""")
def two_side_overview(spark, sf):
    """The ten topics that lead by the mean of two groups' means."""
    s = dense(spark, sf).groupBy("topic").agg(F.avg(F.when(F.col("genre") == "ASIA", F.col("share"))).alias("a"), F.avg(F.when(F.col("genre") == "AMERICA", F.col("share"))).alias("b")).withColumn("m", (F.col("a") + F.col("b")) / 2)
    top = s.orderBy(F.desc("m"), "topic").limit(10)  # the report's ten rows
    return top.select("topic", F.row_number().over(W.orderBy(F.desc("m"), "topic")).cast("long").alias("position"), F.round("a", 9).alias("mean_a"), F.round("b", 9).alias("mean_b"), F.round(F.sum("m").over(W.partitionBy()), 8).alias("top_sum"))


@query(f"""WITH t AS ({SQL['topic_table']}), k AS ({SQL['kruskal_wallis_h']}), u AS ({SQL['mann_whitney_u']}), p AS (SELECT topic, h, exp(-h / 2) * (1 + h / 2) AS p FROM k WHERE groups = 5), r AS (SELECT *, row_number() OVER (ORDER BY p, topic) AS j, count(*) OVER () AS n FROM p)
SELECT t.topic, mean_share, median_share, prevalence, single_work, r.h, round(p, 6) AS p, round(least(1.0, min(p * n / j) OVER (ORDER BY j DESC ROWS UNBOUNDED PRECEDING)), 6) AS q, u, z FROM t JOIN r ON t.topic = r.topic JOIN u ON t.topic = u.topic""")
def topic_report(spark, sf):
    """One table of topics: means, medians, prevalence, the test over groups with p and q, and one group's U test."""
    h = S.kruskal(dense(spark, sf), "share", "genre", ["topic"]).withColumn("h", F.round("h", 6)).withColumn("p", chi2_tail_udf("h", F.col("groups") - 1))
    q = S.adjust(h.select("topic", "h", "p"), "p").select("topic", "h", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))
    return topic_table(spark, sf).join(q, "topic").join(mann_whitney_u(spark, sf).select("topic", "u", "z"), "topic")


@query(f"""WITH n AS ({SQL['leave_one_out_nearest']}), r AS (SELECT *, rank() OVER (PARTITION BY own ORDER BY own_distance) AS k, count(own_distance) OVER (PARTITION BY own) AS m FROM n)
SELECT work, own, nearest, round(own_distance - distance, 7) AS lean, CASE WHEN own_distance IS NOT NULL THEN round((k - 1) / m * 100, 5) END AS percentile, CASE WHEN nearest = own THEN 'own' WHEN own_distance - distance < 0.005 THEN 'near own' ELSE 'other' END AS reading FROM r""")
def work_lean(spark, sf):
    """How far each work leans from its group to the nearest one, and where its distance lies among its group's works."""
    n = leave_one_out_nearest(spark, sf)
    lean = F.col("own_distance") - F.col("distance")
    reading = F.when(F.col("nearest") == F.col("own"), "own").when(lean < 0.005, "near own").otherwise("other")
    return S.percent_below(n, "own_distance", ["own"], "pct").select("work", "own", "nearest", F.round(lean, 7).alias("lean"), F.round("pct", 5).alias("percentile"), reading.alias("reading"))
