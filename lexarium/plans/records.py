"""Records of works in the formats that catalogues give them: imprecise dates and company fields.

The texts are invented and dealt over suppliers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from .registry import query, table

DATES = (
    "1599 [1598-1601]", "c. 1604", "not in source", "1600 [revised 1610-1612]", "1611?", "[1601 - 1603 or c. 1605-1606 (?)]", "", "N/A", "none", "no date at all", "1590 [1588-1592; c.1589 (?) - 1591; written 1600-1601]",
    "1612 [licensed 3 May 1613; payment]", "1620 [early summer 1619-1621]", "1580s [1580s]", "1605 [incorrect 1601-1602]", "c. 1590? [1588 or 1589]", "in 1633-1634 at court", "  1598 (?)  [1597-1599?]", "1570 [1568(?)-1572][1566-1567]", "adapted 1607",
)
COMPANIES = (
    "Chapel", "Chapel (?)", "Admiral’s (by 1594)", "Chapel; Paul's", "Unknown (Court)", "not in source", "", "n/a", "None", "Unacted (?)", "Unacted", "King's or Queen's", "Strange's (and Admiral's [?])", "Pembroke's, then Worcester's (on tour)",
    "Queen's [?]", "Revels (in London)(by 1610) and Paul's", "  Oxford's   (?) ", "Andover's",
)


def _dealt(spark, sf, name, texts):
    s = table(spark, sf, "supplier").select("s_suppkey")
    return s.select("s_suppkey", F.element_at(F.array(*map(F.lit, texts)), (F.col("s_suppkey") % len(texts) + 1).cast("int")).alias(name))


def _sql_dealt(texts):
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in texts)
    return f"SELECT s_suppkey, list_element([{quoted}], CAST(s_suppkey % {len(texts)} + 1 AS INTEGER)) AS raw FROM supplier"


_STRAIGHT = "trim(translate(raw, '’‘', ''''''))"
_RANGES = f"""s AS ({_sql_dealt(DATES)}), t AS (SELECT s_suppkey, raw, {_STRAIGHT} AS x FROM s), b AS (SELECT *, regexp_extract_all(x, '\\[([^\\]]*)\\]', 1) AS bs FROM t),
g AS (SELECT *, list_transform(bs, lambda b: list_transform(string_split(b, ';'), lambda q: {{'lo': regexp_extract_all(q, '{D.RANGE}', 2), 'hi': regexp_extract_all(q, '{D.RANGE}', 5), 'c': list_concat(regexp_extract_all(q, '{D.RANGE}', 1), regexp_extract_all(q, '{D.RANGE}', 4)), 'u': list_concat(regexp_extract_all(q, '{D.RANGE}', 3), regexp_extract_all(q, '{D.RANGE}', 6)), 'rev': regexp_matches(q, '(?i){D.REVISION}'), 'alt': regexp_matches(q, '\\bor\\b')}})) AS gs FROM b),
o AS (SELECT *, list_min(list_transform(flatten(flatten(list_transform(gs, lambda z: list_transform(list_filter(z, lambda q: NOT q.rev), lambda q: q.lo)))), lambda v: CAST(v AS INTEGER))) AS lo, list_max(list_transform(flatten(flatten(list_transform(gs, lambda z: list_transform(list_filter(z, lambda q: NOT q.rev), lambda q: q.hi)))), lambda v: CAST(v AS INTEGER))) AS hi FROM g)"""


@query(f"""WITH {_RANGES}, y AS (SELECT *, x = '' OR lower(x) IN ('n/a', 'nan', 'none') OR x = 'not in source' AS none, CAST(nullif(regexp_extract(x, '\\d{{4}}'), '') AS INTEGER) AS yr FROM o),
fl AS (SELECT *, list_concat([CASE WHEN regexp_matches(x, '^c\\.\\s*\\d{{4}}') THEN 'circa' END, CASE WHEN contains(string_split(x, '[')[1], '?') THEN 'queried' END], flatten(list_transform(list_zip(bs, gs), lambda p: list_concat([CASE WHEN contains(p[1], 'incorrect') THEN 'marked-incorrect' END],
 flatten(list_transform(p[2], lambda q: [CASE WHEN len(q.lo) > 0 AND q.rev THEN 'secondary-dates-ignored' END, CASE WHEN len(q.lo) > 0 AND NOT q.rev AND len(list_filter(q.c, lambda v: v <> '')) > 0 THEN 'circa-limit' END, CASE WHEN len(q.lo) > 0 AND NOT q.rev AND len(list_filter(q.u, lambda v: v <> '')) > 0 THEN 'queried-limit' END, CASE WHEN len(q.lo) > 0 AND NOT q.rev AND (len(q.lo) > 1 OR q.alt) THEN 'alternative-limits' END])),
 [CASE WHEN regexp_matches(p[1], '{D.MONTHS}') THEN 'month' END, CASE WHEN regexp_matches(p[1], '(?i){D.SEASONS}') THEN 'season' END, CASE WHEN contains(p[1], 'licensed') THEN 'licensed' END, CASE WHEN regexp_matches(p[1], 'revis|adapt') THEN 'revised' END, CASE WHEN contains(p[1], 'payment') THEN 'payment' END, CASE WHEN regexp_matches(p[1], '\\d{{4}}s') THEN 'decade' END, CASE WHEN contains(p[1], '?') AND NOT regexp_matches(p[1], '\\d{{4}}\\s*\\(\\?\\)') THEN 'queried-bracket' END])))) AS flags FROM y),
e AS (SELECT s_suppkey, unnest(flags) AS f, generate_subscripts(flags, 1) AS i FROM fl), j AS (SELECT s_suppkey, string_agg(f, ' ' ORDER BY i) AS flags FROM (SELECT s_suppkey, f, min(i) AS i FROM e WHERE f IS NOT NULL GROUP BY ALL) GROUP BY s_suppkey)
SELECT fl.s_suppkey, raw, CASE WHEN NOT none THEN yr END AS "year", CASE WHEN NOT none AND yr IS NOT NULL THEN lo END AS low, CASE WHEN NOT none AND yr IS NOT NULL THEN hi END AS high, CASE WHEN NOT none AND yr IS NOT NULL THEN coalesce(j.flags, '') ELSE '' END AS flags, CASE WHEN x = '' THEN 'blank' WHEN none THEN x WHEN yr IS NULL THEN 'no year: ' || x END AS missing FROM fl LEFT JOIN j ON fl.s_suppkey = j.s_suppkey""")
def date_fields(spark, sf):
    """Year, limits over all ranges that tell of no revision, and flags, of imprecise dates."""
    return _dealt(spark, sf, "raw", DATES).withColumn("d", D.full_date(F.col("raw"))).select("s_suppkey", "raw", "d.*")


@query(f"""WITH {_RANGES}, y AS (SELECT *, CAST(nullif(regexp_extract(x, '^(c\\.\\s*)?(\\d{{4}})', 2), '') AS INTEGER) AS yr, CAST(nullif(regexp_extract(x, '(\\d{{4}})\\s*-\\s*(\\d{{4}})', 1), '') AS INTEGER) AS a, CAST(nullif(regexp_extract(x, '(\\d{{4}})\\s*-\\s*(\\d{{4}})', 2), '') AS INTEGER) AS z, x = '' OR x = 'not in source' AS none FROM o)
SELECT s_suppkey, raw, CASE WHEN NOT none THEN yr END AS "year", CASE WHEN none THEN NULL WHEN yr IS NULL THEN a WHEN lo IS NOT NULL THEN least(lo, yr) END AS low, CASE WHEN none THEN NULL WHEN yr IS NULL THEN z WHEN hi IS NOT NULL THEN greatest(hi, yr) END AS high, CASE WHEN NOT none THEN yr IS NULL AND a IS NOT NULL END AS range_only, CASE WHEN NOT none THEN yr IS NULL AND a IS NULL END AS event_only FROM y""")
def leading_dates(spark, sf):
    """The second reading of dates: the leading year only, limits that take it in, texts that are only a range or an event."""
    return _dealt(spark, sf, "raw", DATES).withColumn("d", D.leading_date(F.col("raw"))).select("s_suppkey", "raw", "d.*")


_COMPANY = f"""s AS ({_sql_dealt(COMPANIES)}), t AS (SELECT s_suppkey, raw, regexp_replace({_STRAIGHT}, '\\s*\\(and ([^)]*?)\\s*\\[\\?\\]\\)', '; \\1 (?)', 'g') AS x FROM s),
b AS (SELECT *, trim(regexp_replace(replace(regexp_replace(regexp_replace(x, '\\s*\\((\\?|by \\d{{4}}|on tour|in London)\\)', '', 'g'), '\\s*\\[\\?\\]', '', 'g'), ')(', ') ('), '\\s+', ' ', 'g')) AS base FROM t),
k AS (SELECT *, list_filter(list_transform(string_split_regex(base, ';|\\band\\b|\\bor\\b|,\\s*then\\b'), lambda p: trim(p)), lambda p: p <> '') AS ps, list_filter([CASE WHEN contains(base, ';') THEN ';' END, CASE WHEN regexp_matches(base, '\\band\\b') THEN 'and' END, CASE WHEN regexp_matches(base, '\\bor\\b') THEN 'or' END, CASE WHEN regexp_matches(base, ',\\s*then\\b') THEN 'then' END], lambda v: v IS NOT NULL) AS kinds FROM b),
c AS (SELECT s_suppkey, raw, CASE WHEN x = '' THEN 'missing (blank)' WHEN lower(x) = 'n/a' THEN 'missing (n/a)' WHEN x = 'None' THEN 'missing (None)' WHEN x = 'not in source' THEN x WHEN starts_with(x, 'Unknown') THEN 'unknown' WHEN starts_with(x, 'Unacted') THEN 'unacted' WHEN len(ps) > 1 OR len(kinds) > 0 THEN 'multiple (' || array_to_string(kinds, '/') || ')' WHEN contains(x, '(?)') OR contains(x, '[?]') THEN 'uncertain' ELSE 'clear' END AS status, x, base, ps FROM k)"""


@query(f"""WITH {_COMPANY} SELECT s_suppkey, raw, status, CASE WHEN status IN ('missing (blank)', 'missing (n/a)', 'missing (None)', 'not in source') THEN '' WHEN status = 'unknown' THEN 'Unknown' WHEN status = 'unacted' THEN 'Unacted' ELSE base END AS base,
CASE WHEN status IN ('missing (blank)', 'missing (n/a)', 'missing (None)', 'not in source') THEN '' WHEN status = 'unknown' THEN trim(substr(x, 8)) WHEN status = 'unacted' THEN CASE WHEN contains(x, '(?)') THEN '(?)' ELSE '' END ELSE array_to_string(regexp_extract_all(x, '{D.QUALIFIER}'), ' ') END AS qualifiers,
CASE WHEN status IN ('missing (blank)', 'missing (n/a)', 'missing (None)', 'not in source', 'unknown', 'unacted') THEN 0 ELSE len(ps) END AS n_parts FROM c""")
def company_records(spark, sf):
    """Status, name, qualifiers and parts of company fields."""
    c = _dealt(spark, sf, "raw", COMPANIES).withColumn("c", D.company_fields(F.col("raw")))
    return c.select("s_suppkey", "raw", "c.status", "c.base", "c.qualifiers", F.size("c.parts").cast("long").alias("n_parts"))


@query(f"""WITH {_COMPANY}, two AS (SELECT a.s_suppkey % 9 AS grp, a.base AS x, b.base AS y, a.status AS sx, b.status AS sy FROM c a JOIN c b ON b.s_suppkey = a.s_suppkey + 18 OR (b.s_suppkey = a.s_suppkey AND a.s_suppkey % 4 = 0)),
v AS (SELECT grp, CASE WHEN sx <> 'clear' OR sy <> 'clear' THEN 'not comparable' WHEN list_sort(list_distinct(list_filter(regexp_extract_all(replace(lower(x), '''s', 's'), '[a-z0-9]+'), lambda w: w NOT IN ('of', 'the')))) = list_sort(list_distinct(list_filter(regexp_extract_all(replace(lower(y), '''s', 's'), '[a-z0-9]+'), lambda w: w NOT IN ('of', 'the')))) THEN 'agree' ELSE 'differ' END AS verdict FROM two)
SELECT grp, verdict, count(*) AS n FROM v GROUP BY ALL""")
def company_agreement(spark, sf):
    """Two sources' companies compared by the words of their names, where both are clear."""
    c = _dealt(spark, sf, "raw", COMPANIES).withColumn("c", D.company_fields(F.col("raw"))).select("s_suppkey", "c.status", "c.base")
    second = c.select(F.explode(F.array_compact(F.array(F.col("s_suppkey") - 18, F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey"))))).alias("s_suppkey"), F.col("status").alias("sy"), F.col("base").alias("y"))
    words = lambda x: F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.replace(F.lower(x), F.lit("'s"), F.lit("s")), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin("of", "the"))))
    verdict = F.when((F.col("status") != "clear") | (F.col("sy") != "clear"), "not comparable").when(words("base") == words("y"), "agree").otherwise("differ")
    return c.join(second, "s_suppkey").groupBy((F.col("s_suppkey") % 9).alias("grp"), verdict.alias("verdict")).agg(F.count("*").alias("n"))
