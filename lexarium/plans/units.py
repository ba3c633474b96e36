"""Marked-up editions made from conversations, and the units and lines that are read from them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import escape_html
from ..operators import editions as E
from .registry import query, table

#: Four layouts by conversation: one work; two works and a loose line; a group of texts; a collection with a work within a work.
_SQL = r"""t AS (SELECT conv_id, turn, role, role <> 'system' AS in_sp, trim(regexp_replace(CASE WHEN turn % 4 = 1 THEN regexp_replace(coalesce(text, ''), '^(\S*)\s+', '\1') ELSE coalesce(text, '') END, '\s+', ' ', 'g')) AS text FROM conversations),
u AS (SELECT conv_id, turn, role, in_sp, text, CAST(conv_id AS VARCHAR) || CASE conv_id % 4 WHEN 0 THEN '' WHEN 3 THEN CASE turn % 2 WHEN 1 THEN '.1' ELSE '.2.0' END ELSE CASE turn % 2 WHEN 1 THEN '.1' ELSE '.2' END END AS unit_id,
 CASE conv_id % 4 WHEN 0 THEN 'play' WHEN 1 THEN CASE turn % 2 WHEN 1 THEN 'play' ELSE 'comedy' END WHEN 2 THEN 'act' ELSE CASE turn % 2 WHEN 1 THEN 'poem' ELSE 'masque' END END AS div_path FROM t),
x AS (SELECT * FROM u UNION ALL SELECT DISTINCT conv_id, 1000000, '', false, 'Loose words & <marks>', CAST(conv_id AS VARCHAR) || '.0', '' FROM t WHERE conv_id % 4 = 1 UNION ALL SELECT DISTINCT conv_id, 1000000, '', false, 'A song within', CAST(conv_id AS VARCHAR) || '.2.1', 'masque>masque' FROM t WHERE conv_id % 4 = 3)"""


def files(spark, sf):
    """key, xml, collection: one edition a conversation; every fifth is cut off before its last tags."""
    words = F.coalesce("text", F.lit(""))
    words = escape_html(words)
    words = F.when(F.col("turn") % 4 == 1, F.regexp_replace(words, r"^(\S*)\s", '$1<g ref="char:EOLhyphen"/>\n')).otherwise(words)
    spoken = F.concat(F.lit("<sp><speaker>"), "role", F.lit("</speaker><l>"), words, F.lit("<note>n</note></l></sp>"))
    piece = F.when(F.col("role") == "system", F.concat(F.lit("<stage>Enter.</stage><p>"), words, F.lit("</p>"))).otherwise(spoken)
    t = table(spark, sf, "conversations").select("conv_id", F.struct("turn", piece.alias("x")).alias("p"))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    some = lambda keep: F.array_join(F.transform(F.filter("p", keep), lambda p: p["x"]), "\n")
    odd, even = some(lambda p: p["turn"] % 2 == 1), some(lambda p: p["turn"] % 2 == 0)
    k = F.col("conv_id")
    front = F.concat(F.lit('<front><div type="title"><head>Title</head><p>Front of '), k.cast("string"), F.lit("</p></div></front>"))
    layout = k % 4
    body = (
        F.when(layout == 0, F.concat(front, F.lit('<body><div type="play"><head>The  play</head>'), some(lambda p: p["turn"] >= 0), F.lit("</div></body>")))
        .when(layout == 1, F.concat(F.lit('<body><div type="play"><head>First &amp; last</head>'), odd, F.lit('</div><div type="comedy">'), even, F.lit("</div><p>Loose words &amp; &lt;marks&gt;</p></body>")))
        .when(layout == 2, F.concat(front, F.lit('<group><text><body><div type="act">'), odd, F.lit('</div></body></text><text><body><div type="act">'), even, F.lit("</div></body></text></group>")))
        .otherwise(F.concat(F.lit('<body><div type="poem">'), odd, F.lit('</div><div type="masque"><head>A masque</head>'), even, F.lit('<div type="masque"><l>A song within</l></div></div></body>')))
    )
    end = F.when(k % 5 == 0, "").otherwise("</text></TEI>")
    return c.select(k.alias("key"), F.concat(F.lit('<?xml version="1.0"?><TEI xmlns="http://example.org/ns"><text>'), body, end).alias("xml"), (layout == 3).alias("collection"))


@query(f"WITH {_SQL} SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY turn) AS seq, in_sp, div_path, text FROM x WHERE text <> ''")
def edition_lines(spark, sf):
    """Lines of the units of marked-up editions: words of speakers, notes and stage directions left out, cut words joined."""
    return E.unit_lines(E.units(files(spark, sf))).select("unit_id", "seq", "in_sp", "div_path", "text")


@query(f"""WITH {_SQL}, every AS (SELECT DISTINCT unit_id, conv_id FROM x UNION SELECT CAST(conv_id AS VARCHAR) || '.' || k, conv_id FROM t, (VALUES (1), (2)) v(k) WHERE conv_id % 4 IN (1, 2) OR (conv_id % 4 = 3 AND k = 1)),
s AS (SELECT unit_id, count(*) FILTER (text <> '') AS n_lines, count(*) FILTER (in_sp) AS n_speeches, coalesce(sum(length(text)) FILTER (in_sp), 0) AS spoken, coalesce(sum(length(text)) FILTER (NOT in_sp), 0) AS other, count(*) FILTER (role = 'system') AS stage FROM x GROUP BY unit_id)
SELECT e.unit_id, CASE WHEN conv_id % 4 = 0 OR conv_id % 4 = 2 THEN NULL WHEN e.unit_id LIKE '%.2._' THEN CAST(conv_id AS VARCHAR) || '.2' ELSE CAST(conv_id AS VARCHAR) END AS parent_unit,
 CASE WHEN e.unit_id LIKE '%.0' THEN 'residual' WHEN conv_id % 4 = 0 THEN 'single' WHEN conv_id % 4 = 2 THEN 'group_text' WHEN conv_id % 4 = 1 OR e.unit_id LIKE '%.2.1' THEN 'work_div' ELSE 'body_div' END AS kind,
 CASE WHEN e.unit_id LIKE '%.0' THEN 'residual' WHEN conv_id % 4 IN (0, 2) THEN '' WHEN conv_id % 4 = 1 THEN CASE WHEN e.unit_id LIKE '%.1' THEN 'play' ELSE 'comedy' END WHEN e.unit_id LIKE '%.2.1' THEN 'masque' ELSE 'poem' END AS div_type,
 CASE WHEN conv_id % 4 = 0 THEN 'The play' WHEN conv_id % 4 = 1 AND e.unit_id LIKE '%.1' THEN 'First & last' WHEN e.unit_id LIKE '%.2.0' THEN 'A masque' ELSE '' END AS head,
 coalesce(n_lines, 0) AS n_lines, coalesce(n_speeches, 0) AS n_speeches, CAST(coalesce(spoken, 0) AS BIGINT) AS spoken_chars, CAST(coalesce(other, 0) AS BIGINT) AS other_chars, coalesce(stage, 0) AS dropped_stage, coalesce(n_speeches, 0) AS dropped_note, conv_id % 4 = 0 AS has_front, conv_id % 5 <> 0 AS well_formed
FROM every e LEFT JOIN s ON e.unit_id = s.unit_id WHERE NOT (e.unit_id LIKE '%.0' AND coalesce(n_lines, 0) = 0)""")
def edition_units(spark, sf):
    """Units of marked-up editions, with what was kept and left out of each."""
    return E.units(files(spark, sf)).select("unit_id", "parent_unit", "kind", "div_type", "head", "n_lines", "n_speeches", "spoken_chars", "other_chars", "dropped_stage", "dropped_note", "has_front", "well_formed")


@query(f"WITH {_SQL} SELECT unit_id || CASE WHEN turn = 0 AND in_sp THEN '.1' ELSE '.0' END AS unit_id, conv_id AS key, text FROM x WHERE conv_id % 8 = 0 AND text <> ''")
def edition_splits(spark, sf):
    """Units divided by decided ranges of children: the heading and the first element apart, the rest for itself."""
    f = files(spark, sf).filter("key % 8 = 0")
    k = F.col("key").cast("string")
    rules = f.select("key", k.alias("unit_id"), F.lit("1").alias("part"), F.lit("/TEI[1]/text[1]/body[1]/div[1]").alias("container"), F.lit(1).alias("first"), F.lit(2).alias("last"), F.lit("poem").alias("div_type"), F.lit(True).alias("residual"))
    return E.unit_lines(E.units(f, rules)).select("unit_id", F.col("key").cast("long").alias("key"), "text")


@query("SELECT DISTINCT conv_id AS key, 'front' AS section, 1::BIGINT AS seq, 'title' AS div_path, 'Front of ' || conv_id AS text FROM conversations WHERE conv_id % 2 = 0")
def edition_front_matter(spark, sf):
    """Lines before and after the bodies of marked-up editions."""
    return E.front_and_back(files(spark, sf)).select(F.col("key").cast("long").alias("key"), "section", "seq", "div_path", "text")
