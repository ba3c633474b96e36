"""Decisions over nodes, units, frames and reviews: the layered rules of a corpus build.

Documents play the nodes, their sources the units; what the build's tables would say
is derived from ids and labels, the same way in Spark and SQL.
"""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import identity, rules as R
from .registry import query, table

_DIVS = ("scene", "prologue", "poem", "dedication", "notes", "speech", "poems", "errata", "chapter")
#: Prefix rules over container paths: (path, decision, kind of node or null).
AUDITS = [
    ("t/en", "include", None), ("t/en/3", "exclude", None), ("t/en/3/notes", "include", None), ("t/de", "supplementary", None), ("t/de", "include", "long"), ("t/fr", "include", None), ("t/fr", "exclude", None),
    ("t/es/1", "deferred", None), ("t/es/2", "pending", None), ("t/e", "exclude", None),
]
_sql = lambda x: "NULL" if x is None else f"'{x}'"
_pick = lambda xs, by: f"list_element([{', '.join(map(_sql, xs))}], CAST({by} % {len(xs)} + 1 AS INTEGER))"
_in = lambda xs: ", ".join(map(_sql, xs))

_NODES = f"""audits(prefix, decision, cond) AS (VALUES {', '.join(f'({_sql(a)}, {_sql(b)}, CAST({_sql(c)} AS VARCHAR))' for a, b, c in AUDITS)}),
nodes AS (SELECT d.doc_id AS key, source AS unit, [lang, CAST(d.doc_id % 5 AS VARCHAR), {_pick(_DIVS, 'd.doc_id')}] AS divs, d.doc_id % 4 = 0 AS spoken, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS kind, quality, toxic, sha256(coalesce(text, '')) AS h FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT *, 't/' || array_to_string(divs, '/') AS path, {_pick(('deferred', 'excluded', 'supplementary', 'proposed'), "CAST(substr(unit, 4) AS INTEGER)")} AS us, CASE WHEN quality = 0 THEN 'exclude' WHEN toxic = 1 THEN 'supplementary' WHEN key % 13 = 0 THEN 'include' WHEN key % 17 = 0 THEN 'deferred' WHEN key % 19 = 0 THEN 'pending' END AS decided, key % 11 = 0 AS stale FROM nodes),
hit AS (SELECT key, decision, len(string_split(prefix, '/')) * 2 + CASE WHEN cond IS NULL THEN 0 ELSE 1 END AS k FROM n JOIN audits ON (path = prefix OR starts_with(path, prefix || '/')) AND decision <> 'pending' AND (cond IS NULL OR cond = kind)),
top AS (SELECT key, min(decision) AS a, min(decision) <> max(decision) AS conflict FROM (SELECT *, max(k) OVER (PARTITION BY key) AS m FROM hit) WHERE k = m GROUP BY key),
j AS (SELECT n.*, CASE WHEN NOT conflict THEN a END AS audit, conflict, CASE WHEN spoken THEN 'keep' WHEN divs[3] IN ({_in(R.PERFORMED)}) THEN 'audit' WHEN list_has_any(divs, [{_in(R.APART)}]) THEN 'drop' WHEN list_has_any(divs, [{_in(R.UNSETTLED)}]) THEN 'settle' ELSE 'audit' END AS rule, CASE WHEN CAST(substr(unit, 4) AS INTEGER) % 5 = 4 THEN us END AS ust FROM n LEFT JOIN top ON n.key = top.key),
f AS (SELECT key, unit, divs, CASE WHEN ust IS NOT NULL THEN CASE WHEN ust = 'proposed' THEN 'pending' ELSE ust END WHEN decided IS NOT NULL AND stale THEN 'error' WHEN decided IS NOT NULL THEN CASE decided WHEN 'include' THEN 'kept' WHEN 'exclude' THEN 'excluded' ELSE decided END
 WHEN rule = 'keep' THEN 'kept' WHEN rule = 'drop' THEN 'excluded' WHEN audit IS NULL THEN 'pending' WHEN audit = 'include' THEN 'kept' WHEN audit = 'exclude' THEN 'excluded' ELSE audit END AS fate,
 CASE WHEN ust IS NOT NULL THEN 'unit ' || ust WHEN decided IS NOT NULL AND stale THEN 'decision for another text' WHEN decided IS NOT NULL THEN 'node decision' WHEN rule = 'keep' THEN 'spoken' WHEN rule = 'drop' THEN 'line rule' WHEN rule = 'settle' AND audit IS NULL THEN 'no node decision' WHEN conflict AND audit IS NULL THEN 'conflicting audits' WHEN audit IS NULL THEN 'no audit' ELSE 'audit' END AS reason, CASE WHEN key % 26 = 0 AND decided IS NOT NULL THEN 'song' END AS as_role FROM j)"""


def build_tables(spark, sf):
    """nodes, units, decisions and audits of the build."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    key = F.col("doc_id")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    divs = F.array("lang", (key % 5).cast("string"), pick(_DIVS, key))
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    nodes = d.select(key.alias("key"), F.col("source").alias("unit"), F.concat(F.lit("t/"), F.array_join(divs, "/")).alias("path"), F.when(F.col("n_chars") > 1500, "long").otherwise("short").alias("kind"), divs.alias("divs"), (key % 4 == 0).alias("spoken"), h.alias("text_hash"))
    number = F.substring("unit", 4, 9).cast("int")
    status = F.when(number % 5 == 4, pick(("deferred", "excluded", "supplementary", "proposed"), number))
    units = nodes.select("unit").distinct().withColumn("status", status)
    decided = F.when(F.col("quality") == 0, "exclude").when(F.col("toxic") == 1, "supplementary").when(key % 13 == 0, "include").when(key % 17 == 0, "deferred").when(key % 19 == 0, "pending")
    decisions = d.select(key.alias("key"), decided.alias("decided"), F.when(key % 11 == 0, F.lit("old")).otherwise(h).alias("hash"), F.when(key % 26 == 0, "song").alias("as_role")).filter("decided IS NOT NULL")
    audits = spark.createDataFrame(AUDITS, "path string, decision string, only string")
    return nodes, units, decisions, audits


@query(f"WITH {_NODES} SELECT key, unit, fate, reason, CASE WHEN fate = 'kept' THEN coalesce(as_role, CASE WHEN divs[3] IN ({_in(R.ROLES)}) THEN divs[3] ELSE 'body' END) END AS role FROM f")
def node_fates(spark, sf):
    """The whole resolver: unit, hash-checked node decision, place, container audit; one fate for each node."""
    return R.node_fates(*build_tables(spark, sf))


@query(f"WITH {_NODES} SELECT reason, fate, count(*) AS n, count(DISTINCT unit) AS n_units FROM f GROUP BY ALL")
def node_fate_report(spark, sf):
    """How many nodes each clause decided."""
    return R.node_fates(*build_tables(spark, sf)).groupBy("reason", "fate").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("n_units"))


@query(f"WITH {_NODES}, b AS (SELECT 'pending' AS kind, unit, count(*) AS n FROM f WHERE fate = 'pending' GROUP BY unit UNION ALL SELECT 'stale decision', unit, count(*) FROM f WHERE fate = 'error' GROUP BY unit UNION ALL SELECT 'no kept node', unit, count(*) FROM f GROUP BY unit HAVING count(*) FILTER (fate = 'kept') = 0) SELECT * FROM b")
def build_blockers(spark, sf):
    """Everything that keeps a build from being frozen, kind by kind."""
    f = R.node_fates(*build_tables(spark, sf))
    u = f.groupBy("unit").agg(F.count_if(F.col("fate") == "pending").alias("p"), F.count_if(F.col("fate") == "error").alias("e"), F.count_if(F.col("fate") == "kept").alias("k"), F.count("*").alias("n"))
    kinds = F.array(F.struct(F.lit("pending").alias("kind"), F.col("p").alias("n"), (F.col("p") > 0).alias("on")), F.struct(F.lit("stale decision").alias("kind"), F.col("e").alias("n"), (F.col("e") > 0).alias("on")), F.struct(F.lit("no kept node").alias("kind"), F.col("n"), (F.col("k") == 0).alias("on")))
    return R.freeze_gate(u.select("unit", F.explode(kinds).alias("b")).filter("b.on").select("b.kind", "unit", "b.n"), dry_run=True)


@query(f"""WITH d AS (SELECT doc_id, [lang, {_pick(_DIVS, 'doc_id')}] AS divs FROM documents) SELECT doc_id, CASE WHEN divs[2] IN ({_in(R.ROLES)}) THEN divs[2] ELSE 'body' END AS role, divs[2] IN ({_in(R.PERFORMED)}) AS performed, list_has_any(divs, [{_in(R.APART)}]) AS apart FROM d""")
def role_projection(spark, sf):
    """The role that the innermost division gives, and membership of paths in sets of divisions."""
    divs = F.array("lang", F.element_at(F.array(*map(F.lit, _DIVS)), (F.col("doc_id") % len(_DIVS) + 1).cast("int")))
    d = table(spark, sf, "documents").select("doc_id", divs.alias("divs"))
    return d.select("doc_id", R.role(F.col("divs")).alias("role"), F.get("divs", F.lit(1)).isin(*R.PERFORMED).alias("performed"), F.arrays_overlap("divs", F.array(*map(F.lit, R.APART))).alias("apart"))


_FRAMES = """g AS (SELECT o_orderkey % 40 AS tcp, o_custkey % 7 AS node, o_orderstatus AS section, o_orderpriority AS div, min(o_orderkey) AS k, min(o_orderkey) % 9 <> 0 AS candidate, CASE WHEN min(o_orderkey) % 5 <> 0 THEN min(o_custkey) % 60 END AS attributed FROM orders GROUP BY ALL),
d AS (SELECT *, CASE WHEN k % 6 = 1 THEN 'include' WHEN k % 6 = 2 THEN 'exclude' WHEN k % 12 = 3 THEN 'deferred' END AS decided, CASE WHEN k % 6 = 1 AND k % 4 = 1 THEN CASE WHEN k % 8 = 1 THEN tcp ELSE k % 70 END END AS target, CASE WHEN div < '3' THEN 'include' WHEN div < '4' THEN 'exclude' END AS dflt FROM g),
e AS (SELECT *, coalesce(decided, dflt, 'pending') AS d FROM d),
x AS (SELECT *, target IS NOT NULL AND d = 'include' AS aimed, CASE WHEN target < 50 THEN target % 40 END AS target_of, CASE WHEN attributed < 50 THEN attributed % 40 END AS work_of FROM e),
y AS (SELECT *, CASE WHEN aimed AND target_of IS NULL THEN 'target is not built' WHEN aimed AND target_of <> tcp THEN 'target is from another source' END AS wrong FROM x)"""


@query(f"""WITH {_FRAMES}, z AS (SELECT *, CASE WHEN NOT candidate THEN 'excluded' WHEN d = 'deferred' THEN 'deferred' WHEN d = 'exclude' THEN 'excluded' WHEN wrong IS NOT NULL THEN 'pending' WHEN aimed THEN 'kept' WHEN attributed IS NULL THEN 'pending' WHEN d = 'include' AND work_of IS NULL THEN 'excluded' WHEN d = 'include' THEN 'kept' ELSE 'pending' END AS fate FROM y)
SELECT tcp, node, section, div, fate, CASE WHEN fate = 'kept' THEN CASE WHEN aimed THEN target ELSE attributed END END AS work, CASE WHEN candidate THEN wrong END AS error FROM z""")
def frame_fates(spark, sf):
    """Front and back matter by its four keys: decided group, default of its kind, explicit target, attribution."""
    o = table(spark, sf, "orders")
    keys = [(F.col("o_orderkey") % 40).alias("tcp"), (F.col("o_custkey") % 7).alias("node"), F.col("o_orderstatus").alias("section"), F.col("o_orderpriority").alias("div")]
    k = F.col("k")
    g = o.groupBy(*keys).agg(F.min("o_orderkey").alias("k"), F.min("o_custkey").alias("c")).withColumn("candidate", k % 9 != 0).withColumn("attributed", F.when(k % 5 != 0, F.col("c") % 60))
    decided = F.when(k % 6 == 1, "include").when(k % 6 == 2, "exclude").when(k % 12 == 3, "deferred")
    target = F.when((k % 6 == 1) & (k % 4 == 1), F.when(k % 8 == 1, F.col("tcp")).otherwise(k % 70))
    decisions = g.select("tcp", "node", "section", "div", decided.alias("decided"), target.alias("target")).filter("decided IS NOT NULL")
    kinds = o.select(F.col("o_orderpriority").alias("div")).distinct().withColumn("default", F.when(F.col("div") < "3", "include").when(F.col("div") < "4", "exclude"))
    built = spark.range(50).select(F.col("id").alias("work"), (F.col("id") % 40).alias("of"))
    return R.frame_fates(g.drop("k", "c"), decisions, kinds, built)


@query("""SELECT p_partkey AS topic, p_brand AS value FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#23') OR p_brand IS NULL""")
def enum_violations(spark, sf):
    """Rows whose value is none of those allowed (``allowed`` raises on the first)."""
    known = spark.createDataFrame([(f"Brand#{a}{b}",) for a in (1, 2) for b in (1, 2, 3)], "value string")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("topic"), F.col("p_brand").alias("value")).join(F.broadcast(known), "value", "left_anti").select("topic", "value")


_REVIEW = """ai AS (SELECT p_partkey AS topic, CASE p_partkey % 4 WHEN 0 THEN 'included' WHEN 1 THEN 'contextual_only' WHEN 2 THEN 'pending' ELSE '' END AS ai_use, CASE WHEN p_partkey % 6 = 0 THEN 'checked_ai' ELSE '' END AS ai_status, p_size AS size FROM part),
ed AS (SELECT p_partkey AS topic, CASE p_partkey % 5 WHEN 0 THEN 'included' WHEN 1 THEN 'contextual_only' WHEN 2 THEN 'pending' ELSE '' END AS now, CASE WHEN p_partkey % 7 = 0 THEN 'a label' ELSE '' END AS label, CASE WHEN p_partkey % 10 = 0 THEN 'a note' ELSE '' END AS notes, CASE WHEN p_partkey % 8 = 0 THEN 'own state' WHEN p_partkey % 3 = 0 THEN 'draft_ai' ELSE '' END AS status FROM part)"""


@query(f"""WITH {_REVIEW}, j AS (SELECT *, label <> '' OR notes <> '' OR (now <> '' AND now <> ai_use) AS touched FROM ed JOIN ai USING (topic)) SELECT topic, now AS use, CASE WHEN status NOT IN ('', 'draft_ai', 'checked_ai', 'user_confirmed', 'user_pending', 'user_labelled') THEN status WHEN now IN ('included', 'contextual_only') AND touched THEN 'user_confirmed' WHEN now = 'pending' AND touched THEN 'user_pending' WHEN label <> '' AND now = ai_use THEN 'user_labelled' ELSE coalesce(nullif(ai_status, ''), nullif(status, ''), 'draft_ai') END AS review_status, touched FROM j""")
def review_status(spark, sf):
    """What a reviewed sheet says against the drafts: only what differs from the draft counts as touched."""
    k = F.col("p_partkey")
    use = lambda n, last: F.when(k % n == 0, "included").when(k % n == 1, "contextual_only").when(k % n == 2, "pending").otherwise(last)
    p = table(spark, sf, "part")
    ai = p.select(k.alias("topic"), use(4, "").alias("ai_use"), F.when(k % 6 == 0, "checked_ai").otherwise("").alias("ai_status"), F.col("p_size").alias("size"))
    sheet = p.select(k.alias("topic"), use(5, "").alias("use"), F.when(k % 7 == 0, "a label").otherwise("").alias("label"), F.when(k % 10 == 0, "a note").otherwise("").alias("notes"), F.when(k % 8 == 0, "own state").when(k % 3 == 0, "draft_ai").otherwise("").alias("status"), F.col("p_size").alias("size"))
    return R.reviewed(sheet, ai).select("topic", "use", "review_status", "touched")


@query(f"""WITH {_REVIEW}, sheet AS (SELECT topic, CASE WHEN topic % 50 = 3 THEN 'maybe' ELSE now END AS use FROM ed WHERE topic % 31 <> 0 UNION ALL SELECT topic, now FROM ed WHERE topic % 37 = 5 AND topic % 31 <> 0 UNION ALL SELECT -topic, now FROM ed WHERE topic % 41 = 0)
SELECT 'twice' AS fault, topic FROM sheet GROUP BY topic HAVING count(*) > 1 UNION ALL SELECT 'missing', topic FROM ai WHERE topic NOT IN (SELECT topic FROM sheet) UNION ALL SELECT 'unknown', topic FROM sheet WHERE topic NOT IN (SELECT topic FROM ai) UNION ALL SELECT DISTINCT 'value', topic FROM sheet WHERE use NOT IN ('', 'included', 'contextual_only', 'pending', 'excluded')""")
def review_guards(spark, sf):
    """Why a reviewed sheet would be refused: topics given twice, missing or unknown, and values that are not allowed."""
    k = F.col("p_partkey")
    use = F.when(k % 5 == 0, "included").when(k % 5 == 1, "contextual_only").when(k % 5 == 2, "pending").otherwise("")
    every = table(spark, sf, "part").select(k.alias("topic"), use.alias("use"))
    t = F.col("topic")
    held = every.filter(t % 31 != 0)
    sheet = held.withColumn("use", F.when(t % 50 == 3, "maybe").otherwise(F.col("use"))).union(held.filter(t % 37 == 5)).union(every.filter(t % 41 == 0).withColumn("topic", -t))
    return R.review_faults(sheet, every)


@query("""WITH e AS (SELECT o_orderkey AS edition, o_custkey % 30 AS work, CASE WHEN o_custkey % 30 % 4 = 1 THEN o_orderpriority ELSE CASE WHEN o_custkey % 30 % 4 = 0 THEN '1-URGENT' WHEN o_custkey % 30 % 4 = 2 THEN '5-LOW' ELSE '9-NONE' END END AS genre, CASE WHEN o_custkey % 30 % 3 = 0 THEN '2-HIGH' WHEN o_custkey % 30 % 3 = 1 THEN '' ELSE 'minor' END AS annals FROM orders),
w AS (SELECT work, list_sort(list(DISTINCT genre)) AS g, list_sort(list(DISTINCT annals) FILTER (annals <> '')) AS a FROM e GROUP BY work),
m AS (SELECT work, CASE WHEN len(g) = 1 THEN g[1] ELSE 'CONFLICT: ' || array_to_string(g, ' | ') END AS raw, CASE WHEN len(a) = 1 THEN CASE a[1] WHEN 'minor' THEN '3-MEDIUM' ELSE a[1] END END AS second FROM w)
SELECT work, raw, CASE WHEN raw IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN raw WHEN second IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN second ELSE 'other/multi' END AS genre, CASE WHEN raw IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'first list' WHEN second IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'second list' ELSE 'none' END AS origin FROM m""")
def genre_rule(spark, sf):
    """A work's genre: the main list if its editions agree, else the second list, else other; conflicts stay visible."""
    w = F.col("o_custkey") % 30
    fixed = F.when(w % 4 == 0, "1-URGENT").when(w % 4 == 2, "5-LOW").otherwise("9-NONE")
    e = table(spark, sf, "orders").select(w.alias("work"), F.when(w % 4 == 1, F.col("o_orderpriority")).otherwise(fixed).alias("genre"), F.when(w % 3 == 0, "2-HIGH").when(w % 3 == 1, "").otherwise("minor").alias("second"))
    return R.genres(e, "work", ["1-URGENT", "2-HIGH", "3-MEDIUM"], {"minor": "3-MEDIUM"})


_SPLITS = """u AS (SELECT conv_id AS unit, count(*) AS n FROM conversations GROUP BY conv_id),
s AS (SELECT unit, n, k, CASE WHEN k = 0 THEN 0 ELSE (n * k) // 3 + CASE WHEN unit % 5 = 1 AND k = 1 THEN 1 WHEN unit % 7 = 2 AND k = 2 THEN -1 ELSE 0 END END AS first, (n * (k + 1)) // 3 AS stop FROM u, (VALUES (0), (1), (2)) v(k))"""


@query(f"""WITH {_SPLITS}, c AS (SELECT s.unit, s.n, t.i, count(*) FILTER (t.i >= s.first AND t.i < s.stop) AS covered FROM s JOIN (SELECT unit, unnest(range(0, n)) AS i FROM u) t ON s.unit = t.unit GROUP BY ALL)
SELECT unit, n AS n_children, count(*) FILTER (covered = 0) AS n_missing, count(*) FILTER (covered > 1) AS n_twice, count(*) FILTER (covered <> 1) = 0 AS whole FROM c GROUP BY ALL""")
def split_coverage(spark, sf):
    """Explicit splits of units into ranges of children: each child must lie in exactly one."""
    u = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("unit")).agg(F.count("*").alias("n"))
    third = lambda k: F.floor(F.col("n") * k / 3)
    shift = lambda k: F.when((F.col("unit") % 5 == 1) & F.lit(k == 1), 1).when((F.col("unit") % 7 == 2) & F.lit(k == 2), -1).otherwise(0)
    ranges = F.array(*(F.struct((F.lit(0).cast("long") if k == 0 else third(k) + shift(k)).alias("first"), third(k + 1).alias("stop")) for k in range(3)))
    return R.split_coverage(u.withColumn("ranges", ranges), "unit", "n", "ranges")


@query("""SELECT source, sort_key, rank FROM (SELECT source, CASE WHEN source = 'src4' THEN NULL ELSE source END AS sort_key, CAST(row_number() OVER (ORDER BY CASE WHEN source = 'src4' THEN 1 ELSE 0 END, CAST(substr(source, 4) AS INTEGER), source) AS BIGINT) AS rank FROM (SELECT DISTINCT source FROM documents))""")
def sentinel_last(spark, sf):
    """A sort in which values that stand for nothing come last (a few sources)."""
    s = table(spark, sf, "documents").select("source").distinct().withColumn("sort_key", F.nullif("source", F.lit("src4")))
    order = W.orderBy(F.col("sort_key").isNull().cast("int"), F.substring("source", 4, 9).cast("int"), "source")
    return s.withColumn("rank", F.row_number().over(order).cast("long"))


@query("""SELECT user_id, event_id, event_type, event_type = lag(event_type) OVER w AS same_as_previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY same_as_previous""")
def adjacent_duplicates(spark, sf):
    """Events that repeat the kind of the user's event just before them."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("same_as_previous", F.col("event_type") == F.lag("event_type").over(w))
    return e.filter("same_as_previous").select("user_id", "event_id", "event_type", "same_as_previous")


@query("""WITH v AS (SELECT label AS a, vec_id % 12 AS b FROM embeddings), n AS (SELECT a, b, count(*) AS n FROM v GROUP BY ALL) SELECT a AS topic, b AS other, n AS n_both, round(n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n), 6) AS jaccard FROM n""")
def topic_jaccard(spark, sf):
    """Jaccard overlap of the topics of two clusterings."""
    n = table(spark, sf, "embeddings").groupBy(F.col("label").alias("topic"), (F.col("vec_id") % 12).alias("other")).agg(F.count("*").alias("n_both"))
    size = lambda c: F.sum("n_both").over(W.partitionBy(c))
    return n.withColumn("jaccard", F.round(F.col("n_both") / (size("topic") + size("other") - F.col("n_both")), 6))


@query("""WITH n AS (SELECT label AS topic, vec_id % 60 AS work, count(*) AS n FROM embeddings GROUP BY ALL HAVING count(*) >= 3) SELECT topic, count(*) AS n_works, CAST(sum(n) AS BIGINT) AS n_chunks FROM n GROUP BY topic""")
def broad_topics(spark, sf):
    """Works with at least three chunks in a topic."""
    n = table(spark, sf, "embeddings").groupBy(F.col("label").alias("topic"), (F.col("vec_id") % 60).alias("work")).agg(F.count("*").alias("n")).filter("n >= 3")
    return n.groupBy("topic").agg(F.count("*").alias("n_works"), F.sum("n").alias("n_chunks"))


@query("""WITH v AS (SELECT label AS leaf, vec_id % 12 AS truth FROM embeddings), n AS (SELECT leaf, truth, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT leaf, max(n) / sum(n) AS purity, sum(n) AS size FROM n GROUP BY leaf), t AS (SELECT unnest([0.1, 0.12, 0.15, 0.2, 0.3]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (purity >= threshold) AS n_pure, round(CAST(sum(CASE WHEN purity >= threshold THEN size ELSE 0 END) / sum(size) AS DOUBLE), 6) AS share FROM p, t GROUP BY threshold""")
def purity_thresholds(spark, sf):
    """How many clusters, and what part of the rows, are pure at several thresholds."""
    n = table(spark, sf, "embeddings").groupBy(F.col("label").alias("leaf"), (F.col("vec_id") % 12).alias("truth")).agg(F.count("*").alias("n"))
    p = n.groupBy("leaf").agg((F.max("n") / F.sum("n")).alias("purity"), F.sum("n").alias("size"))
    t = p.withColumn("threshold", F.explode(F.array(*map(F.lit, (0.1, 0.12, 0.15, 0.2, 0.3)))))
    pure = F.col("purity") >= F.col("threshold")
    return t.groupBy("threshold").agg(F.count_if(pure).alias("n_pure"), F.round(F.sum(F.when(pure, F.col("size")).otherwise(0)) / F.sum("size"), 6).alias("share"))


@query("""WITH w AS (SELECT lang AS topic, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT topic, word, count(*) AS n FROM w GROUP BY ALL), d AS (SELECT word FROM c GROUP BY word HAVING count(*) >= 2),
s AS (SELECT c.topic, c.word, n / sum(n) OVER (PARTITION BY topic) * ln(1 + (SELECT sum(n) / count(DISTINCT topic) FROM c JOIN d USING (word)) / sum(n) OVER (PARTITION BY c.word)) AS score, n FROM c JOIN d ON c.word = d.word),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, word) AS k FROM s) SELECT topic, word, n, round(score, 7) AS score, CAST(k AS BIGINT) AS rank FROM r WHERE k <= 10""")
def keywords_of_two_topics(spark, sf):
    """Class keywords of words that occur in two topics at least."""
    w = table(spark, sf, "documents").select(F.col("lang").alias("topic"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    c = w.groupBy("topic", "word").agg(F.count("*").alias("n"))
    d = c.groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("total")).filter("df >= 2")
    both = c.join(d, "word")
    size = both.groupBy("topic").agg(F.sum("n").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))  # one row
    s = both.join(size, "topic").crossJoin(F.broadcast(mean)).withColumn("score", F.col("n") / F.col("size") * F.ln(1 + F.col("mean") / F.col("total")))
    k = F.row_number().over(W.partitionBy("topic").orderBy(F.desc(F.round("score", 9)), "word"))
    return s.withColumn("k", k).filter("k <= 10").select("topic", "word", "n", F.round("score", 7).alias("score"), F.col("k").cast("long").alias("rank"))


@query("""WITH v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS w FROM benchmark UNION ALL SELECT unnest(['the', 'of', 'and']) UNION ALL SELECT unnest(regexp_extract_all(lower(n_name), '[a-z]{4,}')) FROM nation)), d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), k AS (SELECT doc_id, count(*) AS n FROM d WHERE w NOT IN (SELECT w FROM v) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_left FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id""")
def stop_vocabulary_union(spark, sf):
    """Words left after the union of a fixed list and two vocabularies is taken out."""
    words = lambda t, c, p: table(spark, sf, t).select(F.explode(F.regexp_extract_all(F.lower(c), F.lit(p), F.lit(0))).alias("w"))
    fixed = spark.createDataFrame([("the",), ("of",), ("and",)], "w string")
    stop = words("benchmark", "text", "[a-z]{9,}").union(words("nation", "n_name", "[a-z]{4,}")).union(fixed).distinct()
    each = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("ws"))
    # distinct words of a text meet the vocabulary; the text itself is not moved by word
    hits = each.select("doc_id", F.explode("ws").alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n")).join(stop, "w").groupBy("doc_id").agg(F.sum("n").alias("gone"))
    return each.select("doc_id", F.size("ws").cast("long").alias("all")).join(hits, "doc_id", "left").select("doc_id", (F.col("all") - F.coalesce("gone", F.lit(0))).alias("n_left"))


_UNITS = """b AS (SELECT p_partkey AS k, p_partkey // 8 AS s, p_partkey % 8 AS i, CAST(p_size AS BIGINT) AS z FROM part),
r AS (SELECT k, s, i, CASE WHEN s % 6 = 1 THEN s * 8 WHEN i = 7 THEN k - 1 ELSE k END AS work, CASE WHEN k % 3 = 0 THEN i + 1 END AS num FROM b WHERE s % 6 <> 0 AND NOT (s % 6 = 3 AND i = 5)),
o AS (SELECT b.k, r.k AS rec, CASE WHEN r.k IS NULL THEN 'pending' ELSE 'confirmed' END AS identity FROM b LEFT JOIN r ON b.k = r.k WHERE b.k % 13 = 5),
a AS (SELECT s, work, min(k) AS k, list_sort(list(k)) AS ks FROM r GROUP BY s, work), p AS (SELECT r.*, list_filter(a.ks, lambda x: x <> r.k) AS aliases FROM r JOIN a ON r.k = a.k WHERE r.k NOT IN (SELECT rec FROM o WHERE rec IS NOT NULL)),
np AS (SELECT s, count(*) AS n FROM p GROUP BY s), x AS (SELECT b.*, k % 9 = 4 AS apart, k % 11 <> 3 AS has, CASE WHEN k % 2 = 0 THEN i + 1 END AS num, b.k IN (SELECT o.k FROM o) AS forced, b.s IN (SELECT r.s FROM r) AS known, coalesce(np.n, 0) AS n FROM b LEFT JOIN np ON b.s = np.s WHERE b.s % 6 <> 1 OR i < 1 + (b.s % 4) * 2),
y AS (SELECT *, known AND NOT forced AND NOT apart AND has AS open FROM x), t AS (SELECT *, n > 1 AND open AND z % 5 <> 1 AND k IN (SELECT k FROM p) AS titled, sum(CAST(open AS INTEGER)) OVER (PARTITION BY s) AS n_open FROM y),
lu AS (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY k) AS j, count(*) OVER (PARTITION BY s) AS c FROM t WHERE open AND n > 1 AND NOT titled), lp AS (SELECT s, k AS rec, num AS pnum, row_number() OVER (PARTITION BY s ORDER BY k) AS j, count(*) OVER (PARTITION BY s) AS c FROM p WHERE k NOT IN (SELECT k FROM t WHERE titled)),
f AS (SELECT lu.k, lp.rec, lp.pnum FROM lu JOIN lp ON lu.s = lp.s AND lu.j = lp.j AND lu.c = lp.c WHERE lu.c <= 3),
m AS (SELECT t.*, f.rec AS by_order, CASE WHEN forced THEN 'manual' WHEN NOT known THEN 'no record' WHEN apart THEN CASE WHEN k % 2 = 0 THEN 'frames in a division apart' ELSE 'division apart' END WHEN NOT has THEN 'no text' WHEN n = 1 THEN CASE WHEN n_open = 1 THEN 'one to one' ELSE 'one work' END
 WHEN titled THEN CASE WHEN z % 5 <> 0 THEN 'title' WHEN k % 6 = 0 THEN 'title and ordinal' ELSE 'weak title' END WHEN f.rec IS NOT NULL THEN CASE WHEN t.num = f.pnum THEN 'order and ordinal' ELSE 'order' END ELSE 'unmatched' END AS method FROM (SELECT t.* FROM t) t LEFT JOIN f USING (k)),
g AS (SELECT m.*, CASE WHEN forced THEN o.rec WHEN method LIKE 'one%' THEN (SELECT min(p.k) FROM p WHERE p.s = m.s) WHEN titled THEN m.k ELSE by_order END AS rec, CASE WHEN forced THEN o.identity WHEN method IN ('one to one', 'title', 'title and ordinal', 'order and ordinal', 'division apart') OR (method = 'one work' AND num IS NOT NULL) THEN 'confirmed' ELSE 'pending' END AS identity FROM m LEFT JOIN o ON m.k = o.k)"""


def identity_tables(spark, sf):
    """units, records and overrides: eight titles a source, made of hashes, so that only a unit's own title is like it."""
    k, s, i = F.col("k"), F.col("s"), F.col("i")
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 8).alias("s"), (F.col("p_partkey") % 8).alias("i"), F.col("p_size").alias("z"))
    word = lambda salt: F.translate(F.substring(F.md5(F.concat(k.cast("string"), F.lit(salt))), 1, 12), "0123456789", "ghjklmnopq")
    none = F.array().cast("array<long>")
    number = F.array((i + 1).cast("long"))
    records = b.filter("s % 6 <> 0").select(k.alias("record_id"), s.alias("source"), F.when(s % 6 == 1, s * 8).when(i == 7, k - 1).otherwise(k).alias("work_id"), k.alias("ord"), ((s % 6 == 3) & (i == 5)).alias("collection"), F.array(word("a"), word("b")).alias("tokens"), F.when(k % 3 == 0, number).otherwise(none).alias("numbers"))
    tokens = F.when(F.col("z") % 5 == 1, F.array().cast("array<string>")).when(F.col("z") % 5 == 0, F.array(word("a"), word("c"))).otherwise(F.array(word("a"), word("b")))
    u = b.filter("s % 6 <> 1 OR i < 1 + (s % 4) * 2")
    units = u.select(k.alias("unit_id"), s.alias("source"), k.alias("ord"), F.when(k % 9 == 4, "poem").otherwise("play").alias("div_type"), F.when(k % 11 == 3, 0).otherwise(5).alias("chars"), (k % 2 == 0).alias("frames"), tokens.alias("tokens"), F.when(k % 2 == 0, number).otherwise(none).alias("numbers"))
    has = (s % 6 != 0) & ~((s % 6 == 3) & (i == 5))
    overrides = b.filter("k % 13 = 5").select(k.alias("unit_id"), F.when(has, k).alias("record_id"), F.when(has, "confirmed").otherwise("pending").alias("identity"), F.lit("proposed").alias("inclusion"))
    return units, records, overrides


@query(f"""WITH {_UNITS} SELECT k AS unit_id, rec AS record_id, method, identity, CASE WHEN forced THEN 'proposed' WHEN method = 'division apart' THEN 'excluded' WHEN method IN ('one to one', 'title', 'title and ordinal', 'order and ordinal') THEN 'proposed' ELSE 'pending' END AS inclusion,
 array_to_string(CASE WHEN forced OR rec IS NULL THEN [] ELSE coalesce((SELECT any_value(p.aliases) FROM p WHERE p.k = g.rec), []) END, ';') AS aliases FROM g""")
def unit_identities(spark, sf):
    """The whole cascade from units to records: overrides, divisions apart, one work to a source, titles, ordinals, order."""
    found = identity.identify(*identity_tables(spark, sf), ("poem",))
    return found.withColumn("aliases", F.array_join(F.col("aliases").cast("array<string>"), ";"))
