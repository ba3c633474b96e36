"""Joins, windows, ranks, sets and order statistics over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.text import token_set
from .registry import query, table


@query("""SELECT t.conv_id, t.turn, q.turn AS asked, left(q.text, 40) AS question FROM (SELECT * FROM conversations WHERE role = 'assistant') t ASOF LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') q ON t.conv_id = q.conv_id AND t.turn > q.turn""")
def as_of_previous(spark, sf):
    """The nearest earlier user turn of each answer, within twenty turns."""
    c = table(spark, sf, "conversations")
    back = W.partitionBy("conv_id").orderBy("turn").rangeBetween(-20, -1)
    asked = F.last(F.when(F.col("role") == "user", F.struct("turn", F.left("text", F.lit(40)).alias("q"))), ignorenulls=True).over(back)
    return c.withColumn("a", asked).filter("role = 'assistant'").select("conv_id", "turn", F.col("a.turn").alias("asked"), F.col("a.q").alias("question"))


@query("""SELECT conv_id, turn, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS boundary, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, conv_id || '_' || lpad(CAST(turn AS VARCHAR), 5, '0') AS node_id FROM conversations""")
def boundary_flag(spark, sf):
    """Where the parent changes from one node to the next, with running numbers and padded ids."""
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(False)).alias("boundary"), F.row_number().over(w).cast("long").alias("seq"), F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.lpad(F.col("turn").cast("string"), 5, "0")).alias("node_id"))


@query("""SELECT conv_id, turn, lag(regexp_extract(text, '[^ ]+$')) OVER w AS previous_word, lead(regexp_extract(text, '^[^ ]+')) OVER w AS next_word, lag(turn) OVER w AS previous_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def previous_context(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag(F.regexp_extract("text", "[^ ]+$", 0)).over(w).alias("previous_word"), F.lead(F.regexp_extract("text", "^[^ ]+", 0)).over(w).alias("next_word"), F.lag("turn").over(w).alias("previous_turn"), F.lead("turn").over(w).alias("next_turn"))


@query("""SELECT a.conv_id, a.turn, b.turn AS context_turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) = 1 WHERE a.role = 'user'""")
def context_rows(spark, sf):
    """The rows right before and after each cut: an equi-join on the neighbour's position."""
    c = table(spark, sf, "conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("context_turn"))
    return a.join(c.select("conv_id", F.col("turn").alias("context_turn"), "role"), ["conv_id", "context_turn"]).select("conv_id", "turn", "context_turn", "role")


@query("""WITH r AS (SELECT c_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey) SELECT c_custkey, o_orderkey, coalesce(o_orderpriority, '') AS priority, o_orderpriority IS NOT DISTINCT FROM '1-URGENT' AS matched FROM r WHERE k = 1""")
def fallback_row_join(spark, sf):
    """The matching row of each key, else its first row, else an empty one."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1).alias("m"), "o_orderkey", "o_orderpriority").alias("o")).groupBy("c_custkey").agg(F.min("o").alias("o"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", "o.o_orderkey", F.coalesce("o.o_orderpriority", F.lit("")).alias("priority"), F.coalesce(F.col("o.m") == 0, F.lit(False)).alias("matched"))


@query("""WITH a AS (SELECT c_custkey, CASE WHEN o_orderkey IS NOT NULL THEN 'exact' WHEN n_nationkey IS NOT NULL THEN 'base' ELSE 'none' END AS how, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS k FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey) SELECT how, count(*) AS n FROM a WHERE k = 1 GROUP BY how""")
def cascading_match(spark, sf):
    """How each key finds its partner: itself, by a coarser key, or not at all."""
    exact = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("e")).distinct()
    base = table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("b"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(exact, "c_custkey", "left").join(base, "c_nationkey", "left")
    return c.groupBy(F.when(F.col("e"), "exact").when(F.col("b"), "base").otherwise("none").alias("how")).agg(F.count("*").alias("n"))


@query("""SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other, list_filter(['flag', 'status', 'quantity'], lambda f: (f = 'flag' AND a.l_returnflag <> b.l_returnflag) OR (f = 'status' AND a.l_linestatus <> b.l_linestatus) OR (f = 'quantity' AND a.l_quantity <> b.l_quantity)) AS differing FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber""")
def differing_fields(spark, sf):
    """Which fields of two alternative rows of one key differ."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    b = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_linenumber").alias("other"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_quantity").alias("q"))
    j = li.join(b, ["l_orderkey", "l_linenumber"])
    diff = F.filter(F.array(F.when(F.col("l_returnflag") != F.col("f"), "flag"), F.when(F.col("l_linestatus") != F.col("s"), "status"), F.when(F.col("l_quantity") != F.col("q"), "quantity")), lambda x: x.isNotNull())
    return j.select("l_orderkey", "l_linenumber", "other", diff.alias("differing"))


@query("""WITH t AS (SELECT DISTINCT p_type || ' ' || p_brand AS large, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_brand), '[a-z0-9]+')) AS s FROM part), u AS (SELECT DISTINCT p_type AS small, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS s FROM part) SELECT small, large FROM u JOIN t ON len(list_filter(u.s, lambda x: NOT list_contains(t.s, x))) = 0""")
def token_subset_join(spark, sf):
    """Names whose tokens all occur in another name: distinct names meet on their first token, then whole sets decide."""
    p = table(spark, sf, "part")
    t = p.select(F.concat_ws(" ", "p_type", "p_brand").alias("large")).distinct().withColumn("t", token_set(F.col("large")))
    u = p.select(F.col("p_type").alias("small")).distinct().withColumn("u", token_set(F.col("small")))
    met = u.withColumn("k", F.get("u", F.lit(0))).join(t.withColumn("k", F.explode("t")), "k")
    return met.filter(F.size(F.array_except("u", "t")) == 0).select("small", "large")


@query("""WITH s AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, max(p_retailprice) FILTER (i = n // 10) AS p10, max(p_retailprice) FILTER (i = n // 2) AS p50, max(p_retailprice) FILTER (i = 9 * n // 10) AS p90 FROM s GROUP BY p_brand""")
def order_statistics(spark, sf):
    """Values at fixed places of the sorted group, without interpolation."""
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list("p_retailprice")).alias("x"))
    n = F.size("x")
    at = lambda i: F.get("x", i.cast("int"))
    return g.select("p_brand", at(F.floor(n / 10)).alias("p10"), at(F.floor(n / 2)).alias("p50"), at(F.floor(9 * n / 10)).alias("p90"))


@query("""SELECT o_orderpriority, CAST(min(year(o_orderdate)) AS BIGINT) AS low, CAST(max(year(o_orderdate)) AS BIGINT) AS high, quantile_cont(year(o_orderdate), 0.25) AS q1, quantile_cont(year(o_orderdate), 0.5) AS med, quantile_cont(year(o_orderdate), 0.75) AS q3 FROM orders GROUP BY 1""")
def year_statistics(spark, sf):
    y = F.year("o_orderdate")
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.min(y).cast("long").alias("low"), F.max(y).cast("long").alias("high"), F.percentile(y, [0.25, 0.5, 0.75]).alias("q"))
    return g.select("o_orderpriority", "low", "high", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"))


@query("""SELECT o_custkey, string_agg(o_orderstatus || '=' || n, ';' ORDER BY o_orderstatus) AS histogram FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def histogram_string(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return c.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "o_orderstatus", F.col("n").cast("string")))), ";").alias("histogram"))


@query("""SELECT c_mktsegment, count(*) FILTER (r_name = 'AFRICA') AS n_africa, count(*) FILTER (r_name = 'ASIA') AS n_asia, count(*) FILTER (r_name = 'EUROPE') AS n_europe, count(*) AS n_all FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def contingency_pivot(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    c = table(spark, sf, "customer").join(n, "c_nationkey").groupBy("c_mktsegment")
    wide = c.agg(*(F.count_if(F.col("r_name") == r).alias(f"n_{r.lower()}") for r in ("AFRICA", "ASIA", "EUROPE")), F.count("*").alias("n_all"))
    return wide


@query("""SELECT coalesce(l_returnflag, 'ALL') AS flag, coalesce(CAST(year(l_shipdate) AS VARCHAR), 'ALL') AS yr, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS words FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, year(l_shipdate)), (year(l_shipdate)), (l_returnflag), ())""")
def mixed_granularity(spark, sf):
    """Groups and all of them together in one pass."""
    li = table(spark, sf, "lineitem").select("l_returnflag", F.year("l_shipdate").cast("string").alias("y"), F.col("l_quantity").cast("long").alias("q"))
    return li.cube("l_returnflag", "y").agg(F.count("*").alias("n"), F.sum("q").alias("words")).select(F.coalesce("l_returnflag", F.lit("ALL")).alias("flag"), F.coalesce("y", F.lit("ALL")).alias("yr"), "n", "words")


@query("""WITH k AS (SELECT o_orderkey, o_custkey || '.' || (o_orderkey % 13) || '.x' || (o_orderkey % 3) AS id, o_custkey, o_orderkey % 13 AS a, o_orderkey % 3 AS b FROM orders) SELECT o_orderkey, id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey) AS BIGINT) AS place FROM k""")
def natural_sort(spark, sf):
    """Dotted ids of each customer in natural order: numbers by value, words by letters."""
    k = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat_ws(".", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 13).cast("string"), F.concat(F.lit("x"), (F.col("o_orderkey") % 3).cast("string"))).alias("id"))
    key = F.transform(F.split("id", r"\."), lambda x: F.struct(x.rlike("^[0-9]+$").alias("num"), F.coalesce(x.try_cast("int"), F.lit(0)).alias("n"), x.alias("s")))
    return k.select("o_orderkey", "id", F.row_number().over(W.partitionBy("o_custkey").orderBy(key, "o_orderkey")).cast("long").alias("place"))


@query("""WITH p AS (SELECT doc_id, list_transform(string_split('1/' || (doc_id % 12) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/' || (doc_id % 30) END, '/'), lambda x: CAST(x AS INTEGER)) AS path FROM documents) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id % 5 ORDER BY path, doc_id) AS BIGINT) AS place, len(path) AS depth FROM p""")
def document_order(spark, sf):
    """Nodes in document order: paths compared number by number, parents first."""
    i = F.col("doc_id")
    path = F.concat(F.lit("1/"), (i % 12).cast("string"), F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), (i % 30).cast("string"))))
    d = table(spark, sf, "documents").select("doc_id", F.transform(F.split(path, "/"), lambda x: x.cast("int")).alias("path"))
    return d.select("doc_id", F.row_number().over(W.partitionBy(F.col("doc_id") % 5).orderBy("path", "doc_id")).cast("long").alias("place"), F.size("path").cast("long").alias("depth"))


@query("""WITH s AS (SELECT doc_id, source, n_chars > 3000 AS flagged, row_number() OVER (PARTITION BY source, n_chars > 3000 ORDER BY md5(doc_id || ':7')) AS k FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY flagged ORDER BY k, source) AS j FROM s) SELECT doc_id, source, flagged FROM r WHERE (flagged AND j <= 5) OR (NOT flagged AND j <= 15)""")
def stratified_sample(spark, sf):
    """Twenty documents, a quarter of them flagged, round robin over sources in seeded order."""
    d = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") > 3000).alias("flagged"), F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7")).cast("binary")).alias("o"))
    s = d.withColumn("k", F.row_number().over(W.partitionBy("source", "flagged").orderBy("o"))).filter("k <= 20")
    r = s.withColumn("j", F.row_number().over(W.partitionBy("flagged").orderBy("k", "source")))
    return r.filter("(flagged AND j <= 5) OR (NOT flagged AND j <= 15)").select("doc_id", "source", "flagged")


@query("""SELECT label FROM (SELECT label, md5(label || ':42') AS o FROM embeddings GROUP BY label HAVING count(*) >= 20) ORDER BY o LIMIT 5""")
def seeded_sample(spark, sf):
    """Five clusters of enough members, in seeded order."""
    g = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n")).filter("n >= 20")
    return g.orderBy(F.md5(F.concat(F.col("label").cast("string"), F.lit(":42")).cast("binary"))).limit(5).select("label")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE k = 1""")
def first_seen(spark, sf):
    """The first row of each key by time: an aggregation, no sort of groups."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id", "value")).alias("f"))
    return e.select("user_id", "event_type", "f.event_id", "f.value")


@query("""SELECT DISTINCT c_custkey AS k, 'main' AS origin FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT DISTINCT o_custkey, 'added' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def conditional_union(spark, sf):
    """A table with the rows of another that it lacks."""
    main = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"))
    more = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct().join(main, "k", "left_anti")
    return main.withColumn("origin", F.lit("main")).unionByName(more.withColumn("origin", F.lit("added")))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT p_partkey AS k FROM part) SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_only_a, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS n_only_b, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_either, (SELECT count(*) FROM (SELECT k FROM c EXCEPT SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_neither""")
def set_reconciliation(spark, sf):
    """Intersection, differences both ways, union and what neither has."""
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_partkey").alias("k"))
    side = lambda f: li.filter(F.col("l_returnflag") == f).select("k").distinct()
    a, b, c = side("R"), side("A"), table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    count = lambda d, name: d.agg(F.count("*").alias(name))
    parts = [count(a.intersect(b), "n_both"), count(a.subtract(b), "n_only_a"), count(b.subtract(a), "n_only_b"), count(a.union(b).distinct(), "n_either"), count(c.join(a, "k", "left_anti").join(b, "k", "left_anti"), "n_neither")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out


@query("""SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40)""")
def semi_and_anti(spark, sf):
    o, li = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return o.join(li.filter("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(li.filter("l_quantity > 40"), "o_orderkey", "left_anti")


@query("""SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")).filter("n > 1")


@query("""SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE c_nationkey WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 9 END, c_acctbal DESC, c_custkey) AS BIGINT) AS place, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_mktsegment), 9) AS part FROM customer QUALIFY place <= 20""")
def custom_order_topk(spark, sf):
    """Rows in a custom order of categories, with their part of the group's total."""
    e = W.partitionBy("c_mktsegment")
    order = F.array_position(F.array(F.lit(3), F.lit(1), F.lit(2)), F.col("c_nationkey").cast("int"))
    c = table(spark, sf, "customer").withColumn("part", F.round(F.col("c_acctbal") / F.sum("c_acctbal").over(e), 9))
    r = c.withColumn("place", F.row_number().over(e.orderBy(F.when(order > 0, order).otherwise(9), F.desc("c_acctbal"), "c_custkey")).cast("long"))
    return r.filter("place <= 20").select("c_mktsegment", "c_custkey", "place", "part")
