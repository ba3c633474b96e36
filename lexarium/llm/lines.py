"""Line dedup by winnowing over line hashes, in DataFrame functions only.

The lines of a document that hold a word are hashed.  In every window of
``window`` such lines the least hash (leftmost on ties) is the window's
fingerprint, so runs of ``window`` lines that occur twice are sure to share a
fingerprint at the same place.  Only these selected places are written, one row
each, with the windows that they stand for: those around them, up to ``window`` - 1 lines
both ways.  Places whose fingerprint occurs once are dropped.  Those that meet
are extended both ways at once: places whose surroundings are alike match as a
whole, and the first place of each kind is compared with the other kinds window by window.
The first match by (doc_id, key of the row, position) stays, each later one is
deleted; matches that overlap unite, so a repeated run of any length from
``window`` lines up goes as a whole.  With ``words``, shorter runs go as well if they hold that many words:
each of their windows is then its own fingerprint.

Groups are counted and joined back, never paired or gathered; a key that many
rows share is not moved (``shared.join_counted``).

Lines are compared by hashes: windows count as equal if their least lines have
one XXH64 and all their lines one XXH64 of another seed.  Different windows around
the same line pass with chance 2^-64 a pair, others with 2^-128.

Cases: null or blank texts have no lines; texts of fewer lines are kept; blank
lines stay unless they lie inside a deleted run; very long texts are taken whole (a
row holds a text's line hashes); of equal runs the first in order stays, so ties can't arise; in repeated rows that agree in
doc_id and text the copies count as one row and are all cut alike;
a null doc_id sorts first; an empty table gives an empty one; further columns
are kept as they are, but for those named like an added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import WORD, join_counted, row_key, stash, unstash


def _lines(docs: DataFrame, counted: bool) -> DataFrame:
    """doc_id, rk, hs and gs (two hashes of each line with a word) and ix (their places among all lines); ws (their numbers of words) if ``counted``."""
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    words = lambda x: F.regexp_count(x, F.lit(WORD)) if counted else x.rlike(r"[^\x20\x09-\x0D]")
    numbered = F.transform(split, lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), i.alias("i"), words(x).alias("w")))
    held = F.filter(numbered, lambda x: x["w"] > 0 if counted else x["w"])
    rows = docs.select("doc_id", "rk", held.alias("a"))
    return rows.select("doc_id", "rk", F.col("a.h").alias("hs"), F.col("a.g").alias("gs"), F.col("a.i").alias("ix"), *([F.col("a.w").alias("ws")] if counted else []))


def _window(i: Column, lines: int) -> Column:
    """The window of ``lines`` lines from the line ``i``: hash, first place and the place after the last among all lines."""
    return F.struct(F.xxhash64(F.slice("gs", i + 1, F.lit(lines))).alias("wh"), F.get("ix", i).alias("start"), (F.get("ix", i + lines - 1) + 1).alias("end"))


def _selected(window: int) -> tuple[Column, Column]:
    """The place of each window's least line, and (over those, as ``mins``) the selected places: fp, th (hash of the surroundings) and the windows that each stands for."""
    starts = F.sequence(F.lit(0), F.size("hs") - window)

    def minimum(i):
        part = F.slice("hs", i + 1, F.lit(window))
        return i + F.array_position(part, F.array_min(part)).cast("int") - 1

    def place(p):
        mine = F.filter(F.sequence(F.greatest(p - (window - 1), F.lit(0)), F.least(p, F.size("hs") - window)), lambda i: F.get("mins", i) == p)
        first = F.get(mine, F.lit(0))
        th = F.xxhash64(p - first, F.slice("gs", first + 1, F.size(mine) + (window - 1)))
        return F.struct(F.get("hs", p).alias("fp"), th.alias("th"), F.transform(mine, lambda i: _window(i, window)).alias("ws"))

    return F.transform(starts, minimum), F.transform(F.array_distinct("mins"), place)


def _wordy(window: int, words: int) -> Column:
    """Windows of fewer than ``window`` lines that hold ``words`` words or more, as selected places."""

    def some(lines):
        def one(i):
            w = _window(i, lines)
            return F.struct(F.xxhash64(F.lit(lines), F.slice("hs", i + 1, F.lit(lines))).alias("fp"), w["wh"].alias("th"), F.array(w).alias("ws"))

        enough = lambda i: F.aggregate(F.slice("ws", i + 1, F.lit(lines)), F.lit(0), lambda a, x: a + x) >= words
        # zero to size - lines; none where the text has fewer lines
        starts = F.slice(F.sequence(F.lit(0), F.size("hs")), 1, F.greatest(F.size("hs") - lines + 1, F.lit(0)))
        return F.transform(F.filter(starts, enough), one)

    return F.concat(*map(some, range(1, window)))


def places(docs: DataFrame, window: int, words: int | None = None) -> DataFrame:
    """One row for each selected place of the texts: doc_id, rk, fp, th, ws (its windows)."""
    short = words is not None and window > 1
    held = _lines(docs, short)
    mins, chosen = _selected(window)
    long = F.size("hs") >= window
    held = held.withColumn("mins", F.when(long, mins).otherwise(F.array().cast("array<int>")))
    every = F.concat(chosen, _wordy(window, words)) if short else chosen
    return held.select("doc_id", "rk", F.explode(every).alias("p")).select("doc_id", "rk", "p.*")


def later_runs(docs: DataFrame, window: int = 3, words: int | None = None) -> DataFrame:
    """Windows of lines that repeat an earlier one: doc_id, rk, start, end (starts and ends of a row rise together).

    ``docs`` has doc_id, rk and text; repeated rows are counted once.  Windows have
    ``window`` lines, or fewer that hold ``words`` words or more.
    """
    rows = stash(places(docs, window, words), "line-places")
    # places that share their fingerprint with another one
    counts = stash(rows.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1"), "line-counts")
    met = stash(join_counted(rows, counts, ["fp"], "n").drop("n"), "line-met")
    unstash(rows, counts)
    at = F.struct("doc_id", "rk", F.col("ws")[0]["start"].alias("start"))
    kinds = stash(met.groupBy("fp", "th").agg(F.count("*").alias("n"), F.min(at).alias("p")), "line-kinds")
    settled = join_counted(met, kinds, ["fp", "th"], "n").withColumn("first", at.eqNullSafe(F.col("p"))).drop("p")
    # like an earlier place in all its windows
    whole = settled.filter("NOT first").select("doc_id", "rk", F.col("ws")[0]["start"].alias("start"), F.element_at("ws", -1)["end"].alias("end"))
    single = stash(settled.filter("first").select("fp", "doc_id", "rk", F.explode("ws").alias("w")).select("fp", "w.wh", "doc_id", "rk", "w.start", "w.end"), "line-windows")
    start = F.struct("doc_id", "rk", "start")
    equal = stash(single.groupBy("fp", "wh").agg(F.count("*").alias("n"), F.min(start).alias("p")).filter("n > 1"), "line-equal")
    part = join_counted(single, equal, ["fp", "wh"], "n").filter(~start.eqNullSafe(F.col("p"))).select("doc_id", "rk", "start", "end")
    later = whole.union(part)
    if words is not None:
        # a short window inside a longer one ends where that does
        later = later.withColumn("end", F.max("end").over(W.partitionBy("doc_id", "rk").orderBy("start"))).distinct()
    out = stash(later, "line-runs")
    unstash(met, kinds, single, equal)
    return out


def dedup_lines(docs: DataFrame, window: int = 3, words: int | None = None) -> DataFrame:
    """``docs`` with later repeated runs of lines cut from text: ``window`` lines or more, or ``words`` words or more.

    Adds n_lines (lines with a word), n_removed (those deleted) and kept_text.
    """
    keyed = docs.withColumn("_lx_key", row_key("doc_id", "text"))
    runs = later_runs(keyed.select("doc_id", F.col("_lx_key").alias("rk"), "text"), window, words)
    spans = runs.groupBy(F.col("doc_id").alias("_lx_d"), F.col("rk").alias("_lx_r")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_lx_s"))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_lx_d")) & (F.col("_lx_key") == F.col("_lx_r")), "left")
    lines = F.split(F.col("text"), "\n", -1)
    # what lies between deleted runs; starts and ends rise together
    gaps = "transform(sequence(0, size(_lx_s)), j -> struct(IF(j = 0, 0, _lx_s[j - 1].end) AS a, IF(j = size(_lx_s), size(_lx_l), _lx_s[j].start) AS b))"
    worded = lambda c: F.size(F.filter(c, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return (
        joined.withColumn("_lx_l", lines)
        .withColumn("_lx_k", F.expr(f"IF(_lx_s IS NULL, _lx_l, flatten(transform(filter({gaps}, g -> g.b > g.a), g -> slice(_lx_l, g.a + 1, g.b - g.a))))"))
        .withColumn("n_lines", F.coalesce(worded("_lx_l"), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.when(F.col("_lx_s").isNull(), F.lit(0)).otherwise(F.col("n_lines") - worded("_lx_k")).cast("long"))
        .withColumn("kept_text", F.when(F.col("_lx_s").isNull(), F.col("text")).otherwise(F.array_join("_lx_k", "\n")))
        .drop("_lx_d", "_lx_r", "_lx_s", "_lx_l", "_lx_k", "_lx_key")
    )


def digest(docs: DataFrame, window: int = 3) -> DataFrame:
    slim = docs.select("doc_id", "text")
    return dedup_lines(slim, window).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _sql(window: int) -> str:
    """DuckDB SQL for ``digest`` over documents with distinct doc_ids."""
    lead = ", ".join(f"lead(l, {k}) OVER d AS l{k}" for k in range(1, window))
    keys = ", ".join(["l", *(f"l{k}" for k in range(1, window))])
    return f"""
WITH ls AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
held AS (SELECT doc_id, l, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ls WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
win AS (SELECT doc_id, i, {lead}, l, lead(i, {window - 1}) OVER d AS e FROM held WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, i, e FROM (SELECT doc_id, i, e, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id, i) AS r FROM win WHERE e IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT ls.doc_id, ls.i FROM ls JOIN later ON ls.doc_id = later.doc_id AND ls.i BETWEEN later.i AND later.e)
SELECT ls.doc_id, count(*) FILTER (WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS n_lines,
  count(*) FILTER (WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') AND gone.i IS NOT NULL) AS n_removed,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY ls.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
FROM ls LEFT JOIN gone ON ls.doc_id = gone.doc_id AND ls.i = gone.i GROUP BY ls.doc_id
"""


SQL = _sql(3)
