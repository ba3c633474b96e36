"""Documents put together from decided lines, their reports, and authors against others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similar import ratio_udf
from ..functions.stats import jsd_term
from ..operators import spans
from ..sources.writers import documents as join_lines
from .registry import query, table


def lines(spark, sf):
    """source (owner), lang (group), doc_id, line_no, line of documents that are not English."""
    d = table(spark, sf, "documents").filter("lang <> 'en'")
    return d.select("source", "lang", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


@query("""WITH l AS (SELECT source, lang, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE lang <> 'en')
SELECT source || '.' || lang AS document, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY doc_id, k)) AS sha FROM l GROUP BY 1""")
def supplementary_documents(spark, sf):
    """Separate documents by owner and group, from the lines that the main text leaves out."""
    l = lines(spark, sf).select(F.concat_ws(".", "source", "lang").alias("document"), F.struct("doc_id", "line_no").alias("place"), "line")
    n = l.groupBy("document").agg(F.count("*").alias("n_lines"))
    return join_lines(l, "document", "place", "line").join(n, "document").select("document", "n_lines", F.sha2("text", 256).alias("sha"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, length(line) AS n, contains(line, '|') OR regexp_matches(line, '[#$%&*]') AS dropped FROM l)
SELECT doc_id, CAST(coalesce(sum(n) FILTER (NOT dropped), 0) AS BIGINT) AS kept_chars, CAST(coalesce(sum(n) FILTER (dropped), 0) AS BIGINT) AS dropped_chars, count(*) FILTER (dropped) AS dropped_lines FROM k GROUP BY doc_id""")
def unit_text_report(spark, sf):
    """Characters kept and dropped of each unit under a line rule."""
    l = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    k = l.select("doc_id", F.length("line").cast("long").alias("n"), (F.col("line").contains("|") | F.col("line").rlike("[#$%&*]")).alias("dropped"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return k.groupBy("doc_id").agg(part(~F.col("dropped")).alias("kept_chars"), part(F.col("dropped")).alias("dropped_chars"), F.count_if("dropped").alias("dropped_lines"))


@query("""WITH c AS (SELECT CAST(label AS BIGINT) AS topic, vec_id % 4 AS variant, vec_id % 20 AS work, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT topic, sum(n) AS size, max(n) / sum(n) AS top FROM (SELECT topic, work, sum(n) AS n FROM c GROUP BY ALL) GROUP BY topic), v AS (SELECT topic, sum(n) FILTER (variant = 0) / sum(n) AS share FROM c GROUP BY topic)
SELECT t.topic, CAST(size AS BIGINT) AS size, round(top, 6) AS top_work, round(coalesce(share, 0), 6) AS variant_share, CASE WHEN top >= 0.9 THEN 'one work' WHEN top >= 0.8 THEN 'concentrated' WHEN coalesce(share, 0) <= 0.05 OR share >= 0.95 THEN 'pure' ELSE 'mixed' END AS kind FROM t JOIN v ON t.topic = v.topic""")
def cluster_purity(spark, sf):
    """Clusters of one work or of one variant."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("topic"), (F.col("vec_id") % 20).alias("work"), (F.col("vec_id") % 4 == 0).alias("v"))
    t = e.groupBy("topic", "work").agg(F.count("*").alias("n"), F.count_if("v").alias("v")).groupBy("topic").agg(F.sum("n").alias("size"), (F.max("n") / F.sum("n")).alias("top"), (F.sum("v") / F.sum("n")).alias("share"))
    kind = F.when(F.col("top") >= 0.9, "one work").when(F.col("top") >= 0.8, "concentrated").when((F.col("share") <= 0.05) | (F.col("share") >= 0.95), "pure").otherwise("mixed")
    return t.select("topic", "size", F.round("top", 6).alias("top_work"), F.round("share", 6).alias("variant_share"), kind.alias("kind"))


@query("""SELECT p_partkey, TRY_CAST(regexp_extract(p_type || ' x' || p_size, 'x([0-9]+)$', 1) AS INTEGER) AS whole, TRY_CAST(p_brand AS DOUBLE) AS bad, coalesce(nullif(CASE WHEN p_size > 25 THEN '' ELSE p_brand END, ''), 'none') AS label FROM part""")
def tolerant_casts(spark, sf):
    """Casts that give null where a text is no number, and fallbacks for empty texts."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.regexp_extract(F.concat("p_type", F.lit(" x"), F.col("p_size").cast("string")), "x([0-9]+)$", 1).try_cast("int").alias("whole"), F.col("p_brand").try_cast("double").alias("bad"), F.coalesce(F.nullif(F.when(F.col("p_size") > 25, "").otherwise(F.col("p_brand")), F.lit("")), F.lit("none")).alias("label"))


@query("""WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS surface FROM conversations), p AS (SELECT surface, replace(surface, 'th', 'y') AS reg FROM w WHERE surface <> '') SELECT surface, reg, count(*) AS n FROM p WHERE surface <> reg GROUP BY ALL""")
def regularised_pairs(spark, sf):
    """Counts of surface forms with their regularised forms."""
    w = table(spark, sf, "conversations").select(F.explode(F.split(F.lower("text"), " ")).alias("surface")).filter("surface <> ''")
    p = w.select("surface", F.replace("surface", F.lit("th"), F.lit("y")).alias("reg")).filter("surface <> reg")
    return p.groupBy("surface", "reg").agg(F.count("*").alias("n"))


#: Lines and tokens made of them; every seventh line has no twin.
_VIEW = r"""l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
w AS (SELECT conv_id, CAST(turn * 1000 + i - 1 AS BIGINT) AS line_no, line, list_transform(list_filter(string_split(line, ' '), lambda x: x <> ''), lambda x: {'at': regexp_extract(x, '[^\pL\pN]+$'), 'word': regexp_replace(x, '[^\pL\pN]+$', ''), 'name': regexp_matches(x, '^\p{Lu}')}) AS ws FROM l),
g AS (SELECT conv_id, line_no, line, list_transform(ws, lambda x: {'at': x['at'], 'word': x['word'], 'reg': CASE WHEN length(x['word']) > 4 THEN replace(x['word'], 'th', 'y') END, 'name': x['name']}) AS ws FROM w),
d AS (SELECT conv_id, line_no, line, line_no % 7 <> 3 AND regexp_matches(line, '[\pL\pN]') AS has, list_transform(ws, lambda x: {'said': x['at'], 'word': x['word'], 'reg': x['reg'], 'how': CASE WHEN coalesce(x['reg'], '') = '' THEN 'none' WHEN NOT regexp_matches(x['reg'], '\pL') OR regexp_matches(x['reg'], '\p{Ll}\p{Lu}') OR lower(x['reg']) = CASE WHEN x['name'] THEN 'np1' ELSE 'vvb' END THEN 'garbage' WHEN x['name'] AND NOT regexp_matches(x['reg'], '^\p{Lu}') THEN 'lower_name' ELSE 'applied' END}) AS ws FROM g),
v AS (SELECT CAST(conv_id AS VARCHAR) AS key, line_no, line, has, CASE WHEN has THEN 'exact' ELSE 'unaligned_fallback' END AS status, CASE WHEN has THEN array_to_string(list_transform(ws, lambda x: CASE WHEN x['how'] = 'applied' THEN x['reg'] ELSE x['word'] END || x['said']), ' ') ELSE trim(regexp_replace(line, '\s+', ' ', 'g')) END AS text,
 CASE WHEN has THEN len(list_filter(ws, lambda x: x['how'] = 'applied')) ELSE 0 END AS applied, CASE WHEN has THEN len(list_filter(ws, lambda x: x['how'] = 'garbage')) ELSE 0 END AS garbage, CASE WHEN has THEN len(list_filter(ws, lambda x: x['how'] = 'lower_name')) ELSE 0 END AS lower_name FROM d)"""


def _transcriptions(spark, sf):
    """lines (key, line_no, line) and blocks (key, block_no, tokens) of all lines but some."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = c.select("key", (F.col("turn") * 1000 + F.col("i")).alias("line_no"), "line")
    word = lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+$", "")
    reg = lambda w: F.when(F.length(w) > 4, F.replace(w, F.lit("th"), F.lit("y")))
    pair = lambda w: F.array(
        F.struct(word(w).alias("surface"), reg(word(w)).alias("reg"), F.when(w.rlike(r"^\p{Lu}"), "np1").otherwise("vvb").alias("pos"), F.lit("none").alias("glue"), F.lit(False).alias("punct")),
        F.struct(F.regexp_extract(w, r"[^\p{L}\p{N}]+$", 0).alias("surface"), F.lit(None).cast("string").alias("reg"), F.lit("pc").alias("pos"), F.lit("none").alias("glue"), F.lit(True).alias("punct")),
    )
    tokens = F.flatten(F.transform(F.filter(F.split("line", " +"), lambda w: w != ""), pair))
    return lines, lines.filter("line_no % 7 <> 3").select("key", F.col("line_no").alias("block_no"), tokens.alias("tokens"))


@query(f"WITH {_VIEW} SELECT key, line_no, status, CAST(NULL AS VARCHAR) AS reason, text, applied, garbage, lower_name FROM v")
def regularised_view(spark, sf):
    """Each line in the spelling of its span of tokens in a second transcription; lines without one fall back to mechanical spelling."""
    lines, blocks = _transcriptions(spark, sf)
    return spans.view(lines, blocks)


@query(f"""WITH {_VIEW} SELECT key, count(*) AS n_lines, count(*) FILTER (has) AS exact, 0::BIGINT AS fuzzy, 0::BIGINT AS gapfill, 0::BIGINT AS merged, 0::BIGINT AS span_fallback, count(*) FILTER (NOT has) AS unaligned_fallback, CAST(sum(applied) AS BIGINT) AS applied, round(100 * count(*) FILTER (has) / count(*), 2) AS line_pct,
 round(100 * coalesce(sum(length(line)) FILTER (has), 0) / greatest(sum(length(line)), 1), 2) AS char_pct FROM v GROUP BY key""")
def regularised_coverage(spark, sf):
    """Lines and characters of each document that took a span, and how the others fell back."""
    lines, blocks = _transcriptions(spark, sf)
    return spans.coverage(spans.view(lines, blocks), lines)


@query()
def similar_names(spark, sf):
    """Similarity ratios of part names to those of the next part."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(nxt, "p_partkey").select("p_partkey", ratio_udf("p_name", "other").alias("similarity"))


_AUTHORS = """x AS (SELECT c_nationkey AS author, o_custkey AS work, l_returnflag AS topic, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def author_words(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("topic"), F.col("l_quantity").cast("long").alias("w"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("work"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("work"), F.col("c_nationkey").alias("author"))
    return li.join(o, "l_orderkey").join(c, "work").groupBy("author", "work", "topic").agg(F.sum("w").alias("w"))


@query(f"""WITH {_AUTHORS}, a AS (SELECT author, topic, sum(w) AS w FROM x GROUP BY ALL), n AS (SELECT author, count(DISTINCT work) AS n_works FROM x GROUP BY author), t AS (SELECT *, sum(w) OVER (PARTITION BY topic) - w AS rest FROM a), z AS (SELECT author, w / sum(w) OVER (PARTITION BY author) AS p, rest / sum(rest) OVER (PARTITION BY author) AS q FROM t)
SELECT z.author, max(n_works) AS n_works, round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 9) AS jsd FROM z JOIN n ON z.author = n.author WHERE n_works >= 5 GROUP BY z.author""")
def author_contrast(spark, sf):
    """Authors with enough works against all others' words."""
    from pyspark.sql import Window as W

    x = author_words(spark, sf)
    n = x.groupBy("author").agg(F.countDistinct("work").alias("n_works")).filter("n_works >= 5")
    a = x.groupBy("author", "topic").agg(F.sum("w").alias("w")).withColumn("rest", F.sum("w").over(W.partitionBy("topic")) - F.col("w"))
    e = W.partitionBy("author")
    z = a.withColumn("p", F.col("w") / F.sum("w").over(e)).withColumn("q", F.col("rest") / F.sum("rest").over(e))
    j = z.groupBy("author").agg(F.round(F.sum(jsd_term(F.col("p"), F.col("q"))), 9).alias("jsd"))
    return n.join(j, "author")
