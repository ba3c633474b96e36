"""Imprecise dates, decades, windows and company fields, over orders, events and synthesised texts."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import dates as D
from .registry import query, table

#: Date texts that are dealt over suppliers (invented, in the formats that the parser knows).
DATES = ["1599 [1598-1601]", "c. 1604", "not in source", "1600 [revised 1610-1612]", "1590s", "1611?", "licensed 1623", "[1601 or 1603]", ""]
COMPANIES = ["Chapel", "Chapel?", "Admiral's (at the Rose)", "Chapel; Paul's", "unknown", "not in source", "", "closet", "King's or Queen's"]
_PICK = lambda name, xs: f"list_element([{', '.join(repr(x) if chr(39) not in x else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in xs)}], CAST(s_suppkey % {len(xs)} + 1 AS INTEGER)) AS {name}"


def picked(spark, sf, name, xs):
    s = table(spark, sf, "supplier").select("s_suppkey")
    return s.select("s_suppkey", F.element_at(F.array(*map(F.lit, xs)), (F.col("s_suppkey") % len(xs) + 1).cast("int")).alias(name))


@query(rf"""WITH s AS (SELECT s_suppkey, {_PICK('raw', DATES)} FROM supplier), y AS (SELECT *, CAST(nullif(regexp_extract(raw, '^\D*?(\d{{4}})', 1), '') AS INTEGER) AS yr, CASE WHEN NOT contains(lower(raw), 'revised') THEN regexp_extract(raw, '\[\D*(\d{{4}}\D+\d{{4}})\D*\]', 1) END AS lim FROM s)
SELECT s_suppkey, raw, yr AS "year", least(coalesce(CAST(nullif(regexp_extract(lim, '^(\d{{4}})', 1), '') AS INTEGER), yr), yr) AS low, greatest(coalesce(CAST(nullif(regexp_extract(lim, '(\d{{4}})$', 1), '') AS INTEGER), yr), yr) AS high, regexp_matches(lower(raw), '\bc(a|irca)?\.') AS circa, contains(raw, '?') AS queried FROM y""")
def date_parse(spark, sf):
    p = picked(spark, sf, "raw", DATES).withColumn("d", D.parse_date(F.col("raw")))
    return p.select("s_suppkey", "raw", "d.year", "d.low", "d.high", F.array_contains("d.flags", "circa").alias("circa"), F.array_contains("d.flags", "queried").alias("queried"))


@query(rf"""WITH s AS (SELECT s_suppkey, {_PICK('raw', COMPANIES)} FROM supplier) SELECT s_suppkey, CASE WHEN trim(raw) = '' THEN 'missing' WHEN regexp_matches(lower(raw), 'not in') THEN 'not in source' WHEN regexp_matches(lower(raw), 'unacted|closet') THEN 'unacted' WHEN regexp_matches(lower(raw), '^unknown') THEN 'unknown' WHEN regexp_matches(lower(raw), ';|\band\b|\bor\b') THEN 'multiple' WHEN contains(raw, '?') OR regexp_matches(raw, '\(.*\)') THEN 'uncertain' ELSE 'clear' END AS status, trim(regexp_replace(regexp_replace(raw, '\(.*?\)', '', 'g'), '\?', '', 'g')) AS base FROM s""")
def company_status_parse(spark, sf):
    p = picked(spark, sf, "raw", COMPANIES).withColumn("c", D.company_status(F.col("raw")))
    return p.select("s_suppkey", "c.status", "c.base")


@query(rf"""WITH s AS (SELECT s_suppkey, {_PICK('raw', COMPANIES)} FROM supplier), p AS (SELECT s_suppkey % 5 AS grp, CASE WHEN trim(raw) = '' THEN 'missing' WHEN regexp_matches(lower(raw), 'not in') THEN 'not in source' WHEN regexp_matches(lower(raw), 'unacted|closet') THEN 'unacted' WHEN regexp_matches(lower(raw), '^unknown') THEN 'unknown' WHEN regexp_matches(lower(raw), ';|\band\b|\bor\b') THEN 'multiple' WHEN contains(raw, '?') OR regexp_matches(raw, '\(.*\)') THEN 'uncertain' ELSE 'clear' END AS status FROM s)
SELECT grp, count(*) AS n, count(*) FILTER (status = 'clear') AS n_clear, count(*) FILTER (status IN ('uncertain', 'multiple')) AS n_open, round(count(*) FILTER (status NOT IN ('missing', 'not in source', 'unknown')) / count(*), 6) AS coverage FROM p GROUP BY grp""")
def company_coverage(spark, sf):
    p = picked(spark, sf, "raw", COMPANIES).select((F.col("s_suppkey") % 5).alias("grp"), D.company_status(F.col("raw"))["status"].alias("status"))
    return p.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "clear").alias("n_clear"), F.count_if(F.col("status").isin("uncertain", "multiple")).alias("n_open"), F.round(F.count_if(~F.col("status").isin("missing", "not in source", "unknown")) / F.count("*"), 6).alias("coverage"))


_DATED = """d AS (SELECT o_orderkey, o_custkey, o_orderpriority AS genre, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(year(o_orderdate) AS INTEGER) - CAST(o_orderkey % 4 AS INTEGER) AS low, CAST(year(o_orderdate) AS INTEGER) + CAST(o_orderkey % 3 AS INTEGER) AS high, CAST(o_totalprice * 100 AS BIGINT) AS v FROM orders)"""


def dated(spark, sf):
    y = F.year("o_orderdate")
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("genre"), y.alias("y"), (y - (k % 4).cast("int")).alias("low"), (y + (k % 3).cast("int")).alias("high"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))


@query(f"""WITH {_DATED} SELECT genre, CAST(y // 10 * 10 AS INTEGER) AS decade, (y // 10 * 10) || 's' AS label, count(*) AS n, CASE WHEN count(*) < 5 THEN 'insufficient' WHEN count(*) < 10 THEN 'sparse' ELSE 'shown' END AS display FROM d GROUP BY 1, 2, 3""")
def decade_counts(spark, sf):
    n = F.count("*")
    g = dated(spark, sf).groupBy("genre", D.decade(F.col("y")).alias("decade"), D.decade_label(F.col("y")).alias("label")).agg(n.alias("n"))
    return g.withColumn("display", F.when(F.col("n") < 5, "insufficient").when(F.col("n") < 10, "sparse").otherwise("shown"))


@query(f"""WITH {_DATED}, v AS (SELECT 'adopted' AS variant, genre, y AS yr FROM d UNION ALL SELECT 'lower', genre, low FROM d UNION ALL SELECT 'upper', genre, high FROM d) SELECT variant, genre, CAST(yr // 10 * 10 AS INTEGER) AS decade, count(*) AS n FROM v GROUP BY ALL""")
def decade_sensitivity(spark, sf):
    """Decade counts by the adopted year and by either limit: rows are spread over variants, then counted once."""
    v = dated(spark, sf).select("genre", F.explode(F.array(F.struct(F.lit("adopted").alias("variant"), F.col("y").alias("yr")), F.struct(F.lit("lower").alias("variant"), F.col("low").alias("yr")), F.struct(F.lit("upper").alias("variant"), F.col("high").alias("yr")))).alias("x"))
    return v.groupBy("x.variant", "genre", D.decade(F.col("x.yr")).alias("decade")).agg(F.count("*").alias("n"))


@query(f"""WITH {_DATED}, m AS (SELECT *, unnest([CASE WHEN y BETWEEN 1996 AND 1998 THEN 'main' END, CASE WHEN low BETWEEN 1996 AND 1998 THEN 'lower' END, CASE WHEN high BETWEEN 1996 AND 1998 THEN 'upper' END, CASE WHEN low >= 1996 AND high <= 1998 THEN 'strict' END]) AS variant FROM d), f AS (SELECT genre, round(avg(v), 4) AS mean_full FROM d GROUP BY genre)
SELECT variant, m.genre, count(*) AS n, round(avg(v), 4) AS mean_in, round(avg(v) - max(mean_full), 4) AS diff, CAST(sign(avg(v) - max(mean_full)) AS INTEGER) AS direction FROM m JOIN f ON m.genre = f.genre WHERE variant IS NOT NULL GROUP BY ALL""")
def window_variants(spark, sf):
    """A window of years under four readings of its members, against all years."""
    d = dated(spark, sf)
    inside = lambda c: F.col(c).between(1996, 1998)
    v = F.array_compact(F.array(F.when(inside("y"), "main"), F.when(inside("low"), "lower"), F.when(inside("high"), "upper"), F.when((F.col("low") >= 1996) & (F.col("high") <= 1998), "strict")))
    full = d.groupBy("genre").agg(F.round(F.avg("v"), 4).alias("f"))
    g = d.select("genre", "v", F.explode(v).alias("variant")).groupBy("variant", "genre").agg(F.count("*").alias("n"), F.avg("v").alias("a")).join(full, "genre")
    return g.select("variant", "genre", "n", F.round("a", 4).alias("mean_in"), F.round(F.col("a") - F.col("f"), 4).alias("diff"), F.signum(F.col("a") - F.col("f")).cast("int").alias("direction"))


@query(f"""WITH {_DATED}, r AS (SELECT y <= 1997 AS early, genre, row_number() OVER (PARTITION BY y <= 1997 ORDER BY sum(v) DESC, genre) AS k FROM d GROUP BY 1, 2), s AS (SELECT genre, max(k) FILTER (early) AS a, max(k) FILTER (NOT early) AS b FROM r GROUP BY genre)
SELECT genre, a AS rank_early, b AS rank_late, CASE WHEN a <= 3 AND b <= 3 THEN 'stays' WHEN a <= 3 THEN 'leaves' WHEN b <= 3 THEN 'enters' ELSE 'outside' END AS move FROM s""")
def rank_entry_exit(spark, sf):
    """Which groups enter or leave the first three from one period to the next."""
    t = dated(spark, sf).groupBy((F.col("y") <= 1997).alias("early"), "genre").agg(F.sum("v").alias("v"))
    r = t.withColumn("k", F.row_number().over(W.partitionBy("early").orderBy(F.desc("v"), "genre")).cast("long"))
    s = r.groupBy("genre").agg(F.max(F.when(F.col("early"), F.col("k"))).alias("rank_early"), F.max(F.when(~F.col("early"), F.col("k"))).alias("rank_late"))
    a, b = F.col("rank_early") <= 3, F.col("rank_late") <= 3
    return s.withColumn("move", F.when(a & b, "stays").when(a, "leaves").when(b, "enters").otherwise("outside"))


@query(f"""WITH {_DATED}, h AS (SELECT o_custkey, max(low) AS low, min(high) AS high, min(low) AS hull_low, max(high) AS hull_high FROM d GROUP BY 1) SELECT o_custkey, hull_low, hull_high, CASE WHEN low > high THEN 'sources disagree' WHEN low >= 1996 AND high <= 1999 THEN 'core' WHEN high >= 1996 AND low <= 1999 THEN 'boundary' ELSE 'outside' END AS placement FROM h""")
def interval_placement(spark, sf):
    """Intersections and hulls of several sources' intervals, placed to a window."""
    h = dated(spark, sf).groupBy("o_custkey").agg(F.max("low").alias("low"), F.min("high").alias("high"), F.min("low").alias("hull_low"), F.max("high").alias("hull_high"))
    return h.select("o_custkey", "hull_low", "hull_high", F.when(F.col("low") > F.col("high"), "sources disagree").otherwise(D.place(F.col("low"), F.col("high"), 1996, 1999)).alias("placement"))


@query("""WITH s AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN CAST(year(l_shipdate) AS INTEGER) END AS a, CASE WHEN l_returnflag <> 'N' THEN CAST(year(o_orderdate) AS INTEGER) END AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, coalesce(a, b) AS adopted, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' ELSE 'none' END AS source_used, CASE WHEN abs(a - b) = 0 THEN 'ok' WHEN abs(a - b) <= 1 THEN 'minor' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'CHECK' END AS agreement FROM s""")
def source_preference(spark, sf):
    """One source before another, and how they agree."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("oy"))
    li = table(spark, sf, "lineitem").join(o, "l_orderkey")
    s = li.select("l_orderkey", F.when(F.col("l_linestatus") == "O", F.year("l_shipdate")).alias("a"), F.when(F.col("l_returnflag") != "N", F.col("oy")).alias("b"))
    return s.select("l_orderkey", F.coalesce("a", "b").alias("adopted"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("none").alias("source_used"), D.date_check(F.col("a"), F.col("b")).alias("agreement"))


@query("""WITH k AS (SELECT p_partkey, lower(['Professional', 'Closet', 'University; Closet', 'Translation', 'Civic'][CAST(p_partkey % 5 + 1 AS INTEGER)]) AS t FROM part) SELECT p_partkey, CASE WHEN regexp_matches(t, 'professional|university|court|civic') AND NOT regexp_matches(t, 'closet|translation') THEN 'first performance' WHEN regexp_matches(t, 'closet|translation') AND NOT regexp_matches(t, 'professional|university|court|civic') THEN 'composition' ELSE 'kind unclear' END AS kind FROM k""")
def date_kinds(spark, sf):
    kinds = F.array(*map(F.lit, ["Professional", "Closet", "University; Closet", "Translation", "Civic"]))
    return table(spark, sf, "part").select("p_partkey", D.date_kind(F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("kind"))


@query(f"""WITH {_DATED}, c AS (SELECT genre, CAST(y // 10 * 10 AS INTEGER) AS decade, o_custkey AS work, sum(v) AS v FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY genre, decade ORDER BY v DESC, work) AS k, sum(v) OVER (PARTITION BY genre, decade) AS t, count(*) OVER (PARTITION BY genre, decade) AS n FROM c) SELECT genre, decade, work, round(v / t, 8) AS part, n AS n_works, k AS rank FROM r WHERE k <= 3""")
def cell_drilldown(spark, sf):
    """The works behind each cell of group and decade."""
    c = dated(spark, sf).groupBy("genre", D.decade(F.col("y")).alias("decade"), F.col("o_custkey").alias("work")).agg(F.sum("v").alias("v"))
    e = W.partitionBy("genre", "decade")
    r = c.withColumn("t", F.sum("v").over(e)).withColumn("n_works", F.count("*").over(e)).withColumn("rank", F.row_number().over(e.orderBy(F.desc("v"), "work")).cast("long"))
    return r.filter("rank <= 3").select("genre", "decade", "work", F.round(F.col("v") / F.col("t"), 8).alias("part"), "n_works", "rank")
