"""The rules engine over a node table: documents' lines, with decisions from labels and prefix rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from .registry import query, table

#: Prefix rules over page paths: (path, decision, only).  Two of equal depth conflict on purpose.
RULES = [("site", "exclude", None), ("site/en", "include", None), ("site/en/1", "exclude", "long"), ("site/en/1", "include", None), ("site/de", "pending", None), ("site/fr", "include", None), ("site/fr", "exclude", None), ("site/e", "exclude", None)]
_RULES = "rules(path, decision, cond) AS (VALUES " + ", ".join(f"('{p}', '{d}', {'NULL' if o is None else repr(o)})" for p, d, o in RULES) + ")"
_NODES = "nodes AS (SELECT doc_id, 'site/' || lang || '/' || (doc_id % 3) AS path, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS kind FROM documents)"


def nodes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws("/", F.lit("site"), "lang", (F.col("doc_id") % 3).cast("string")).alias("path"), F.when(F.col("n_chars") > 1500, "long").otherwise("short").alias("kind"))


@query(f"""WITH {_RULES}, {_NODES}, h AS (SELECT doc_id, decision, len(string_split(rules.path, '/')) AS depth, cond IS NOT NULL AS f FROM nodes JOIN rules ON (nodes.path = rules.path OR starts_with(nodes.path, rules.path || '/')) AND (cond IS NULL OR cond = kind) AND decision <> 'pending'),
b AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY depth DESC, f DESC) AS k FROM h)
SELECT nodes.doc_id, nodes.path, min(decision) AS decision, min(decision) <> max(decision) AS conflict, max(depth) AS depth FROM nodes LEFT JOIN b ON nodes.doc_id = b.doc_id AND k = 1 GROUP BY 1, 2""")
def prefix_match_join(spark, sf):
    rules = spark.createDataFrame(RULES, "path string, decision string, only string")
    return R.longest_prefix(nodes(spark, sf), "doc_id", "path", rules, "kind").select("doc_id", "path", "decision", "conflict", "depth")


_FATES = """n AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT *, CASE WHEN source = 'src3' THEN 'deferred' WHEN quality = 0 THEN 'excluded' WHEN toxic = 1 THEN 'excluded' WHEN n_chars < 200 THEN 'pending' WHEN lang <> 'en' THEN 'supplementary' ELSE 'kept' END AS fate,
CASE WHEN source = 'src3' THEN 'unit status' WHEN quality = 0 THEN 'node decision' WHEN toxic = 1 THEN 'node decision' WHEN n_chars < 200 THEN 'undecided' WHEN lang <> 'en' THEN 'language' ELSE 'rule' END AS reason FROM n)"""


def fates(spark, sf):
    """Exactly one fate for each document, with what decided it; earlier clauses win."""
    n = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    steps = [(F.col("source") == "src3", "deferred", "unit status"), (F.col("quality") == 0, "excluded", "node decision"), (F.col("toxic") == 1, "excluded", "node decision"), (F.col("n_chars") < 200, "pending", "undecided"), (F.col("lang") != "en", "supplementary", "language")]
    fate, reason = F.when(steps[0][0], steps[0][1]), F.when(steps[0][0], steps[0][2])
    for cond, f, r in steps[1:]:
        fate, reason = fate.when(cond, f), reason.when(cond, r)
    return n.withColumn("fate", fate.otherwise("kept")).withColumn("reason", reason.otherwise("rule"))


@query(f"WITH {_FATES} SELECT doc_id, fate, reason FROM f")
def precedence_resolver(spark, sf):
    return fates(spark, sf).select("doc_id", "fate", "reason")


@query(f"WITH {_FATES} SELECT source, count(*) AS candidates, count(*) FILTER (fate = 'kept') AS kept, count(*) FILTER (fate = 'excluded') AS excluded, count(*) FILTER (fate = 'pending') AS pending, count(*) FILTER (fate = 'deferred') AS deferred, count(*) FILTER (fate = 'supplementary') AS supplementary, true AS balanced FROM f GROUP BY source")
def fate_accounting(spark, sf):
    """The parts of each source's candidates, which must sum to all of them."""
    kinds = ("kept", "excluded", "pending", "deferred", "supplementary")
    g = fates(spark, sf).groupBy("source").agg(F.count("*").alias("candidates"), *(F.count_if(F.col("fate") == k).alias(k) for k in kinds))
    return g.withColumn("balanced", F.col("candidates") == sum((F.col(k) for k in kinds), F.lit(0)))


@query(f"WITH {_FATES} SELECT fate AS blocker, source, count(*) AS n FROM f WHERE fate = 'pending' GROUP BY ALL")
def freeze_gate_dry_run(spark, sf):
    """What would keep the build from being frozen."""
    blockers = fates(spark, sf).filter("fate = 'pending'").groupBy(F.col("fate").alias("blocker"), "source").agg(F.count("*").alias("n"))
    return R.freeze_gate(blockers, dry_run=True)


@query(f"WITH {_FATES}, r AS (SELECT *, row_number() OVER (PARTITION BY source, reason ORDER BY doc_id) AS k FROM f WHERE fate IN ('pending', 'excluded')) SELECT source, reason, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) FILTER (k <= 3) AS samples FROM r GROUP BY 1, 2")
def pending_worksheet(spark, sf):
    """Open groups with three samples each: the least ids, kept while aggregating."""
    from pyspark.sql import Window as W

    f = fates(spark, sf).filter("fate IN ('pending', 'excluded')").select("source", "reason", "doc_id")
    n = f.groupBy("source", "reason").agg(F.count("*").alias("n"))
    k = f.withColumn("k", F.row_number().over(W.partitionBy("source", "reason").orderBy("doc_id"))).filter("k <= 3")
    s = k.groupBy("source", "reason").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("samples"))
    return n.join(s, ["source", "reason"])


@query("""SELECT d.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'xx' END, CASE WHEN d.doc_id % 10 = 0 THEN 'la' END, nullif(lang, 'en'), CASE WHEN source = 'src5' THEN 'unit' END, 'en') AS language, CASE WHEN toxic = 1 THEN 'node decision' WHEN d.doc_id % 10 = 0 THEN 'override' WHEN lang <> 'en' THEN 'attribute' WHEN source = 'src5' THEN 'unit' ELSE 'assumed' END AS origin FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def language_resolver(spark, sf):
    """Language by precedence, with its source."""
    n = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    c = R.cascade([(F.when(F.col("toxic") == 1, F.lit("xx")), "node decision"), (F.when(F.col("doc_id") % 10 == 0, F.lit("la")), "override"), (F.nullif("lang", F.lit("en")), "attribute"), (F.when(F.col("source") == "src5", F.lit("unit")), "unit")], (F.lit("en"), "assumed"))
    return n.withColumn("c", c).select("doc_id", F.col("c.value").alias("language"), F.col("c.source").alias("origin"))


@query("""SELECT o_orderkey, CASE WHEN NOT coalesce(o_orderstatus IN ('F', 'O'), false) THEN 'status' WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'price' WHEN NOT coalesce(year(o_orderdate) < 2000, false) THEN 'date' ELSE 'included' END AS reason FROM orders""")
def inclusion_reasons(spark, sf):
    """The first clause that keeps a row out."""
    r = R.first_reason([(F.col("o_orderstatus").isin("F", "O"), "status"), (F.col("o_totalprice") > 1000, "price"), (F.year("o_orderdate") < 2000, "date")], "included")
    return table(spark, sf, "orders").select("o_orderkey", r.alias("reason"))


@query("""SELECT p.path, count(DISTINCT d.source) AS n_works, CASE WHEN count(DISTINCT d.source) = 1 THEN min(d.source) END AS attributed, CASE WHEN count(DISTINCT d.source) = 1 THEN 'unique' ELSE 'pending' END AS status, count(*) AS n_lines FROM (SELECT DISTINCT lang || '/' || (doc_id % 90) AS path FROM documents) p JOIN (SELECT lang || '/' || (doc_id % 90) || '/' || doc_id AS node, source FROM documents) d ON starts_with(d.node, p.path || '/') GROUP BY p.path""")
def frame_attribution(spark, sf):
    """Works under each container path: attributed where there is one."""
    d = table(spark, sf, "documents").select("source", F.concat_ws("/", "lang", (F.col("doc_id") % 90).cast("string"), F.col("doc_id").cast("string")).alias("node"))
    paths = d.select(F.regexp_replace("node", "/[^/]*$", "").alias("path")).distinct()
    spread = d.select("source", F.explode(R.prefixes(F.col("node"))).alias("p")).select("source", F.col("p.prefix").alias("path"))
    g = spread.join(paths, "path").groupBy("path").agg(F.countDistinct("source").alias("n_works"), F.min("source").alias("m"), F.count("*").alias("n_lines"))
    one = F.col("n_works") == 1
    return g.select("path", "n_works", F.when(one, F.col("m")).alias("attributed"), F.when(one, "unique").otherwise("pending").alias("status"), "n_lines")


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang IN ('en', 'de')), n AS (SELECT doc_id, sha256(CASE WHEN n_chars > 3000 THEN text || '!' ELSE text END) AS h FROM documents WHERE lang IN ('en', 'fr')) SELECT o.doc_id, CASE WHEN n.h IS NULL OR n.h = o.h THEN 'kept' ELSE 'stale' END AS status FROM o LEFT JOIN n ON o.doc_id = n.doc_id UNION ALL SELECT doc_id, 'added' FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)""")
def decision_merge(spark, sf):
    """New decisions appended, old ones never overwritten, stale text hashes marked."""
    d = table(spark, sf, "documents")
    old = d.filter("lang IN ('en', 'de')").select("doc_id", F.sha2("text", 256).alias("h"))
    new = d.filter("lang IN ('en', 'fr')").select("doc_id", F.sha2(F.when(F.col("n_chars") > 3000, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return R.merge_decisions(old, new, ["doc_id"], "h").select("doc_id", "status")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS side FROM documents a FULL JOIN (SELECT doc_id + 100 AS doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def key_set_reconcile(spark, sf):
    """Keys that only one of two tables has."""
    a, b = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select((F.col("doc_id") + 100).alias("doc_id"))
    return a.join(b, "doc_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "doc_id", "left_anti").withColumn("side", F.lit("extra")))


@query("""WITH e AS (SELECT o_custkey AS work, o_orderkey AS edition, CASE WHEN o_orderpriority = '1-URGENT' THEN 'primary' ELSE 'other' END AS relation, o_orderstatus AS src FROM orders) SELECT work, CASE WHEN n = 0 THEN 'no primary' ELSE 'several primaries' END AS violation, n FROM (SELECT work, count(*) FILTER (relation = 'primary') AS n FROM e GROUP BY work) WHERE n <> 1""")
def integrity_violations(spark, sf):
    """Works without exactly one primary edition."""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("work")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n")).filter("n <> 1")
    return n.select("work", F.when(F.col("n") == 0, "no primary").otherwise("several primaries").alias("violation"), "n")


@query("""WITH v AS (SELECT conv_id, turn, text, role, unnest(['all', 'spoken', 'answers']) AS view FROM conversations) SELECT view, conv_id, CAST(row_number() OVER (PARTITION BY view, conv_id ORDER BY turn) AS BIGINT) AS out_index, turn FROM v WHERE view = 'all' OR (view = 'spoken' AND role <> 'system') OR (view = 'answers' AND role = 'assistant')""")
def view_materialisation(spark, sf):
    """Nested views of one plan, each with its own running index."""
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations")
    views = F.filter(F.array(F.lit("all"), F.when(F.col("role") != "system", F.lit("spoken")), F.when(F.col("role") == "assistant", F.lit("answers"))), lambda x: x.isNotNull())
    v = c.select("conv_id", "turn", F.explode(views).alias("view"))
    return v.select("view", "conv_id", F.row_number().over(W.partitionBy("view", "conv_id").orderBy("turn")).cast("long").alias("out_index"), "turn")


@query("""WITH p AS (SELECT p_partkey, p_name, p_size FROM part) SELECT p_partkey, CASE WHEN o.k IS NOT NULL THEN 'override' WHEN x.k IS NOT NULL THEN 'exact' WHEN p_size % 10 = 0 THEN 'ordinal' ELSE 'unmatched: ' || CASE WHEN p_size > 25 THEN 'late' ELSE 'other' END END AS how FROM p LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity = 50) o ON p_partkey = o.k LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 3) x ON p_partkey = x.k""")
def identity_cascade(spark, sf):
    """How each unit finds its record, and why it has none."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    o = li.filter("l_quantity = 50").select("p_partkey", F.lit(True).alias("o")).distinct()
    x = li.filter("l_quantity < 3").select("p_partkey", F.lit(True).alias("x")).distinct()
    p = table(spark, sf, "part").select("p_partkey", "p_size").join(o, "p_partkey", "left").join(x, "p_partkey", "left")
    why = F.concat(F.lit("unmatched: "), F.when(F.col("p_size") > 25, "late").otherwise("other"))
    return p.select("p_partkey", F.when(F.col("o"), "override").when(F.col("x"), "exact").when(F.col("p_size") % 10 == 0, "ordinal").otherwise(why).alias("how"))


@query("""SELECT 'order without customer' AS violation, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customer without order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'line given twice', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'status not allowed', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'line end in a text', count(*) FROM documents WHERE contains(text, chr(10))
UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'two primaries', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) > 1)""")
def integrity_report(spark, sf):
    """All checks of a build in one table: keys that lead nowhere, keys given twice, values that are not allowed, texts that break the line contract."""
    t = lambda name: table(spark, sf, name)
    o = t("orders")
    checks = [
        ("order without customer", o.join(t("customer"), o.o_custkey == F.col("c_custkey"), "left_anti")),
        ("customer without order", t("customer").join(o, F.col("c_custkey") == o.o_custkey, "left_anti")),
        ("line given twice", t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")),
        ("status not allowed", o.filter(~F.col("o_orderstatus").isin("F", "O"))),
        ("line end in a text", t("documents").filter(F.col("text").contains("\n"))),
        ("label without document", t("labels").join(t("documents").select("doc_id"), "doc_id", "left_anti")),
        ("two primaries", o.filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 1")),
    ]
    parts = [df.agg(F.lit(name).alias("violation"), F.count("*").alias("n")) for name, df in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
