"""Layered decisions: prefix rules, languages, exactly one fate for each node."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def prefixes(path: Column, sep: str = "/") -> Column:
    """All prefixes of a path, itself included, as (prefix, depth) structs."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), sep).alias("prefix"), n.alias("depth")))


def longest_prefix(nodes: DataFrame, key: str, path: str, rules: DataFrame, filters: str = "only") -> DataFrame:
    """The decision of the most specific rule that covers each node.

    ``rules`` has path, decision and ``only`` (a value that the node's column
    ``filters`` must have, or null).  Longer paths win, then rules with a filter;
    rules that are alike in both must agree, else ``conflict`` is true.  A node is
    joined on its prefixes, so there is no theta join.
    """
    listed = rules.filter("decision IS NOT NULL AND decision NOT IN ('', 'pending')").select(F.col("path").alias("prefix"), "decision", F.col("only").alias("_only"))
    spread = nodes.select(key, filters, F.explode(prefixes(F.col(path))).alias("p")).select(key, filters, "p.prefix", "p.depth")
    hits = spread.join(listed, "prefix").filter(F.col("_only").isNull() | (F.col("_only") == F.col(filters)))
    rank = F.struct("depth", F.col("_only").isNotNull().alias("f"))
    best = hits.groupBy(key).agg(F.max(rank).alias("m"))
    at = hits.withColumn("m", rank).join(best, [key, "m"]).groupBy(key).agg(F.min("decision").alias("decision"), (F.min("decision") != F.max("decision")).alias("conflict"), F.max("depth").cast("long").alias("depth"))
    return nodes.join(at, key, "left")


def first_reason(clauses: Sequence[tuple[Column, str]], ok: str) -> Column:
    """The reason of the first clause that fails; a null counts as failing."""
    c = None
    for cond, reason in clauses:
        fails = ~F.coalesce(cond, F.lit(False))
        c = F.when(fails, reason) if c is None else c.when(fails, reason)
    return c.otherwise(ok)


def cascade(choices: Sequence[tuple[Column, str]], default: tuple[Column, str]) -> Column:
    """(value, source) of the first choice that is not null."""
    value = F.coalesce(*(v for v, _ in choices), default[0])
    source = None
    for v, name in choices:
        source = F.when(v.isNotNull(), name) if source is None else source.when(v.isNotNull(), name)
    return F.struct(value.alias("value"), source.otherwise(default[1]).alias("source"))


def merge_decisions(old: DataFrame, new: DataFrame, keys: Sequence[str], text_hash: str) -> DataFrame:
    """Decisions with new ones appended: existing keys are never overwritten, and stale hashes are marked."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    seen = old.join(new.select(*keys, F.col(text_hash).alias("_new")), list(keys), "left")
    return seen.withColumn("status", F.when(F.col("_new").isNull() | (F.col("_new") == F.col(text_hash)), "kept").otherwise("stale")).drop("_new").unionByName(fresh.withColumn("status", F.lit("added")))


#: Kinds of divisions (fixed values of the corpus): performed text, other text, text that a decision must settle, roles.
PERFORMED = ("prologue", "epilogue", "chorus", "song", "induction", "act", "scene", "speech", "dumb_show", "act_and_scene")
APART = (
    "argument", "dramatis_personae", "dedication", "to_the_reader", "title_page", "colophon", "list_of_actors", "table_of_contents", "encomium", "epistle", "errata", "commendatory_verses", "illustration",
    "description", "descriptions", "inscription", "stationer_to_the_reader", "imprimatur", "license", "advertisement",
)
UNSETTLED = ("poem", "poems")
ROLES = ("prologue", "epilogue", "chorus", "song", "induction", "speech", "dumb_show", "poem")


def role(divs: Column, body: str = "body") -> Column:
    """The innermost division if it is a role, else the body."""
    last = F.get(divs, F.size(divs) - 1)
    return F.when(last.isin(*ROLES), last).otherwise(F.lit(body))


def line_rule(divs: Column, spoken: Column, spoken_only: bool = False) -> Column:
    """What a node's place says: keep, audit, drop or settle; the first that applies."""
    has = lambda kinds: F.arrays_overlap(divs, F.array(*map(F.lit, kinds)))
    last = F.get(divs, F.size(divs) - 1)
    rest = F.when(F.coalesce(last.isin(*PERFORMED), F.lit(False)), "audit").when(has(APART), "drop").when(has(UNSETTLED), "settle").otherwise("audit")
    return F.when(spoken, "keep").when(F.lit(spoken_only), "drop").otherwise(rest)


def node_fates(nodes: DataFrame, units: DataFrame, decisions: DataFrame, audits: DataFrame, spoken_only: bool = False) -> DataFrame:
    """Exactly one fate, with what decided it, a role and an error if any, for each node.

    ``nodes``: key, unit, path, kind, divs, spoken, text_hash.  ``units``: unit, status (null: included).
    ``decisions``: key, decided (include, exclude, supplementary, deferred or pending), hash, as_role.  ``audits``: prefix
    rules as in ``longest_prefix`` (decision may be include, exclude, supplementary or deferred).
    The unit's status comes first, then the node's decision (only for the text that it was made for),
    then the place; places that must be audited take the most specific audit, and
    one that has none or conflicting ones is pending.
    """
    audited = longest_prefix(nodes.select("key", "path", "kind"), "key", "path", audits, "kind").select("key", F.col("decision").alias("audit"), "conflict")
    n = nodes.join(units.withColumnRenamed("status", "unit_status"), "unit", "left").join(decisions, "key", "left").join(audited, "key", "left")
    rule = line_rule(F.col("divs"), F.col("spoken"), spoken_only)
    audit = F.when(~F.coalesce("conflict", F.lit(False)), F.col("audit"))
    stale = F.col("decided").isNotNull() & (F.col("hash") != F.col("text_hash"))
    named = {"include": "kept", "exclude": "excluded", "supplementary": "supplementary", "deferred": "deferred"}
    fate_of = lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in named.items() for x in kv)), c), F.lit("pending"))
    steps = [
        (F.col("unit_status").isNotNull(), F.when(F.col("unit_status").isin("excluded", "deferred", "supplementary"), F.col("unit_status")).otherwise(F.lit("pending")), F.concat(F.lit("unit "), F.col("unit_status"))),
        (stale, F.lit("error"), F.lit("decision for another text")),
        (F.col("decided").isNotNull(), fate_of(F.col("decided")), F.lit("node decision")),
        (rule == "keep", F.lit("kept"), F.lit("spoken")),
        (rule == "drop", F.lit("excluded"), F.lit("line rule")),
        ((rule == "settle") & audit.isNull(), F.lit("pending"), F.lit("no node decision")),
        (audit.isNull(), F.lit("pending"), F.when(F.col("conflict"), "conflicting audits").otherwise("no audit")),
    ]
    fate = reason = F
    for cond, f, r in steps:
        fate, reason = fate.when(cond, f), reason.when(cond, r)
    fate = fate.otherwise(fate_of(audit))
    own = F.coalesce(F.col("as_role"), role(F.col("divs")))
    return n.select("key", "unit", fate.alias("fate"), reason.otherwise(F.lit("audit")).alias("reason"), F.when(fate == "kept", own).alias("role"))


def frame_fates(groups: DataFrame, decisions: DataFrame, kinds: DataFrame, built: DataFrame) -> DataFrame:
    """Fates of groups of front and back matter: tcp, node, section, div (their four keys), fate, work, error.

    ``groups`` has the keys, candidate and attributed; ``decisions`` the keys, decided and target;
    ``kinds`` div and default; ``built`` work and of (the source that it was built from).  A target
    given by a decision goes before the attribution, and must be built from the same source.
    """
    keys = ["tcp", "node", "section", "div"]
    g = groups.join(decisions, keys, "left").join(kinds, "div", "left").withColumn("d", F.coalesce("decided", "default", F.lit("pending")))
    g = g.join(built.select(F.col("work").alias("target"), F.col("of").alias("target_of")), "target", "left").join(built.select(F.col("work").alias("attributed"), F.col("of").alias("work_of")), "attributed", "left")
    aimed = F.col("target").isNotNull() & (F.col("d") == "include")
    wrong = F.when(aimed & F.col("target_of").isNull(), "target is not built").when(aimed & (F.col("target_of") != F.col("tcp")), "target is from another source")
    fate = (
        F.when(~F.col("candidate"), "excluded").when(F.col("d") == "deferred", "deferred").when(F.col("d") == "exclude", "excluded").when(wrong.isNotNull(), "pending").when(aimed, "kept")
        .when(F.col("attributed").isNull(), "pending").when((F.col("d") == "include") & F.col("work_of").isNull(), "excluded").when(F.col("d") == "include", "kept").otherwise("pending")
    )
    work = F.when(aimed, F.col("target")).otherwise(F.col("attributed"))
    return g.select(*keys, fate.alias("fate"), F.when(fate == "kept", work).alias("work"), F.when(F.col("candidate"), wrong).alias("error"))


class GateError(RuntimeError):
    """Raised when blockers keep a build from being frozen."""


def freeze_gate(blockers: DataFrame, dry_run: bool = False) -> DataFrame:
    """The blockers, for a dry run; otherwise an error if there is any."""
    if not dry_run:
        found = blockers.limit(20).collect()
        if found:
            raise GateError("; ".join(str(tuple(r)) for r in found))
    return blockers


def allowed(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """``df``, with an error on the first row whose value is none of ``values``."""
    c = F.col(column)
    ok = F.coalesce(c.isin(*values), F.lit(False))
    return df.withColumn(column, F.when(ok, c).otherwise(F.raise_error(F.concat(F.lit(f"{column} has the value "), F.coalesce(c.cast("string"), F.lit("null"))))))


#: Review states that a run derives itself; any other was typed by the reviewer and stays (fixed values).
DERIVED = ("", "draft_ai", "checked_ai", "user_confirmed", "user_pending", "user_labelled")
USES = ("", "included", "contextual_only", "pending", "excluded")


def reviewed(sheet: DataFrame, drafts: DataFrame) -> DataFrame:
    """The sheet (topic, use, label, notes, status) with touched and review_status against the drafts (topic, ai_use, ai_status)."""
    j = sheet.join(drafts.select("topic", "ai_use", "ai_status"), "topic", "left").fillna("", ["ai_use", "ai_status"])
    touched = (F.col("label") != "") | (F.col("notes") != "") | ((F.col("use") != "") & (F.col("use") != F.col("ai_use")))
    state = (
        F.when(~F.col("status").isin(*DERIVED), F.col("status"))
        .when(F.col("use").isin("included", "contextual_only") & touched, "user_confirmed")
        .when((F.col("use") == "pending") & touched, "user_pending")
        .when((F.col("label") != "") & (F.col("use") == F.col("ai_use")), "user_labelled")
        .otherwise(F.coalesce(F.nullif("ai_status", F.lit("")), F.nullif("status", F.lit("")), F.lit("draft_ai")))
    )
    return j.withColumn("touched", touched).withColumn("review_status", state)


def review_faults(sheet: DataFrame, run: DataFrame) -> DataFrame:
    """(fault, topic): topics of the sheet that occur twice, are missing or unknown to the run, or have a use that is not allowed."""
    known, given = run.select("topic").distinct(), sheet.groupBy("topic").agg(F.count("*").alias("n"), F.max(~F.col("use").isin(*USES)).alias("odd"))
    both = known.withColumn("k", F.lit(True)).join(given, "topic", "full")
    faults = F.array_compact(F.array(F.when(F.col("n") > 1, "twice"), F.when(F.col("n").isNull(), "missing"), F.when(F.col("k").isNull(), "unknown"), F.when(F.col("odd"), "value")))
    return both.select(F.explode(faults).alias("fault"), "topic")


def genres(editions: DataFrame, work: str, main: Sequence[str], renamed: dict[str, str]) -> DataFrame:
    """Genre of each work from its editions' ``genre`` and ``second``: the one they agree on if it is a main one, else the second list's, else other/multi."""
    w = editions.groupBy(work).agg(F.array_sort(F.collect_set("genre")).alias("g"), F.collect_set(F.nullif("second", F.lit(""))).alias("a"))
    raw = F.when(F.size("g") == 1, F.get("g", F.lit(0))).otherwise(F.concat(F.lit("CONFLICT: "), F.array_join("g", " | ")))
    names = F.create_map(*(F.lit(x) for kv in renamed.items() for x in kv))
    one = F.when(F.size("a") == 1, F.get("a", F.lit(0)))
    second = F.coalesce(F.try_element_at(names, one), one)
    first_ok, second_ok = F.col("raw").isin(*main), F.coalesce(F.col("b").isin(*main), F.lit(False))
    t = w.select(work, raw.alias("raw"), second.alias("b"))
    return t.select(work, "raw", F.when(first_ok, F.col("raw")).when(second_ok, F.col("b")).otherwise("other/multi").alias("genre"), F.when(first_ok, "first list").when(second_ok, "second list").otherwise("none").alias("origin"))


def split_coverage(units: DataFrame, key: str, count: str, ranges: str) -> DataFrame:
    """Whether explicit ranges [first, stop) of children cover each unit's children once: n_missing, n_twice, whole."""
    each = units.select(key, count, ranges, F.explode_outer(F.when(F.col(count) > 0, F.sequence(F.lit(0).cast("long"), F.col(count) - 1))).alias("i"))
    inside = F.size(F.filter(ranges, lambda r: (r["first"] <= F.col("i")) & (F.col("i") < r["stop"])))
    c = each.withColumn("c", inside).groupBy(key, F.col(count).alias("n_children")).agg(F.count_if(F.col("c") == 0).alias("n_missing"), F.count_if(F.col("c") > 1).alias("n_twice"))
    return c.withColumn("whole", (F.col("n_missing") == 0) & (F.col("n_twice") == 0))
