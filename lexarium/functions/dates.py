"""Imprecise dates, decades and intervals as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What a date may be marked with, and how it shows (fixed values).
FLAGS = {"circa": r"\bc(a|irca)?\.", "queried": r"\?", "licensed": "licensed", "revised": "revised", "decade": r"\d{4}s", "between": "between|-", "before": "before", "after": "after"}


def _year(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).cast("int")


def parse_date(raw: Column) -> Column:
    """(year, low, high, flags) of texts such as "c. 1604", "1599 [1598-1601]", "1600 [revised 1610-1612]".

    Limits come from the first bracketed range that is no revision, and always
    include the year; a text without a year gives nulls.
    """
    year = F.coalesce(_year(raw, r"^\D*?(\d{4})"), F.lit(None).cast("int"))
    limits = F.when(~F.lower(raw).contains("revised"), F.regexp_extract(raw, r"\[\D*(\d{4}\D+\d{4})\D*\]", 1))
    low = F.coalesce(_year(limits, r"^(\d{4})"), year)
    high = F.coalesce(_year(limits, r"(\d{4})$"), year)
    flags = F.filter(F.array(*(F.when(F.lower(raw).rlike(p), F.lit(n)) for n, p in FLAGS.items() if n != "between")), lambda x: x.isNotNull())
    return F.struct(year.alias("year"), F.least(low, year).alias("low"), F.greatest(high, year).alias("high"), flags.alias("flags"))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decade_label(year: Column) -> Column:
    return F.concat(decade(year).cast("string"), F.lit("s"))


def date_kind(play_type: Column) -> Column:
    """What a date stands for, by the kinds of text that it is given for."""
    kinds = F.split(F.lower(play_type), r"\s*;\s*")
    acted = F.exists(kinds, lambda k: k.rlike("professional|university|court|civic"))
    closet = F.exists(kinds, lambda k: k.rlike("closet|translation"))
    return F.when(acted & ~closet, "first performance").when(closet & ~acted, "composition").otherwise("kind unclear")


def date_check(a: Column, b: Column) -> Column:
    """ok for equal years, minor for one apart, CHECK beyond; null if either is missing."""
    d = F.abs(a - b)
    return F.when(d == 0, "ok").when(d <= 1, "minor").when(d.isNotNull(), "CHECK")


def place(low: Column, high: Column, first: int, last: int) -> Column:
    """Where an interval lies to a window: core, boundary, outside or no date."""
    return F.when(low.isNull() | high.isNull(), "no date").when((low >= first) & (high <= last), "core").when((high >= first) & (low <= last), "boundary").otherwise("outside")


def company_status(raw: Column) -> Column:
    """(status, base, qualifiers) of a company field."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    low = F.lower(text)
    marks = F.filter(F.array(F.when(low.contains("?"), F.lit("queried")), F.when(low.rlike(r"\(.*\)"), F.lit("bracketed"))), lambda x: x.isNotNull())
    base = F.trim(F.regexp_replace(F.regexp_replace(text, r"\(.*?\)", ""), r"\?", ""))
    status = (
        F.when(text == "", "missing")
        .when(low.rlike("not in"), "not in source")
        .when(low.rlike("unacted|closet"), "unacted")
        .when(low.rlike("^unknown"), "unknown")
        .when(low.rlike(r";|\band\b|\bor\b"), "multiple")
        .when(F.size(marks) > 0, "uncertain")
        .otherwise("clear")
    )
    return F.struct(status.alias("status"), base.alias("base"), marks.alias("qualifiers"))


#: Words of bracketed dates (fixed values).
REVISION = r"revis|adapt|re-licensed|interpolat|prologue|Act \d|poss\. written|written"
MONTHS = r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b"
SEASONS = r"\b(spring|summer|autumn|winter|Christmas|Lent|Shrovetide|New Year|early|late)\b"
RANGE = r"(c\.)?\s*(\d{4})\s*(\(\?\))?\s*-\s*(c\.)?\s*(\d{4})\s*(\(\?\))?"
#: Texts that stand for a missing value (fixed values).
MISSING = ("n/a", "nan", "none")


def _straight(raw: Column) -> Column:
    return F.trim(F.translate(F.coalesce(raw, F.lit("")), "’‘", "''"))


def _brackets(text: Column) -> Column:
    """What stands in brackets, each with its segments: ranges (first, last, circa, queried), whether it tells of a revision, whether it has alternatives."""

    def segment(x: Column) -> Column:
        parts = [F.regexp_extract_all(x, F.lit(RANGE), F.lit(g)) for g in range(1, 7)]
        said = lambda a, b: F.exists(F.concat(a, b), lambda v: v != "")
        years = lambda c: F.transform(c, lambda v: v.cast("int"))
        return F.struct(
            years(parts[1]).alias("first"), years(parts[4]).alias("last"), said(parts[0], parts[3]).alias("circa"), said(parts[2], parts[5]).alias("queried"),
            x.rlike("(?i)" + REVISION).alias("revision"), ((F.size(parts[1]) > 1) | x.rlike(r"\bor\b")).alias("either"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda b: F.struct(b.alias("b"), F.transform(F.split(b, ";"), segment).alias("s")))


def _own(brackets: Column, end: str) -> Column:
    """The years at one end of all ranges that tell of no revision."""
    return F.flatten(F.transform(brackets, lambda b: F.flatten(F.transform(F.filter(b["s"], lambda s: ~s["revision"]), lambda s: s[end]))))


def full_date(raw: Column, absent: str = "not in source") -> Column:
    """(year, low, high, flags, missing): the first year anywhere, the hull of all ranges in brackets that tell of no revision, and what the text says about them.

    Flags come in the order of the text: its head, then bracket by bracket; ``missing`` says why there is no year.
    """
    text = _straight(raw)
    none = (text == "") | F.lower(text).isin(*MISSING) | (text == absent)
    year = F.nullif(F.regexp_extract(text, r"\d{4}", 0), F.lit("")).cast("int")
    brackets = _brackets(text)
    when = lambda c, name: F.when(c, F.lit(name))

    def of_segment(s: Column) -> Column:
        some = F.size(s["first"]) > 0
        own = some & ~s["revision"]
        return F.array(when(some & s["revision"], "secondary-dates-ignored"), when(own & s["circa"], "circa-limit"), when(own & s["queried"], "queried-limit"), when(own & s["either"], "alternative-limits"))

    def of_bracket(x: Column) -> Column:
        b = x["b"]
        rest = [(b.rlike(MONTHS), "month"), (b.rlike("(?i)" + SEASONS), "season"), (b.contains("licensed"), "licensed"), (b.rlike("revis|adapt"), "revised"), (b.contains("payment"), "payment"), (b.rlike(r"\d{4}s"), "decade"), (b.contains("?") & ~b.rlike(r"\d{4}\s*\(\?\)"), "queried-bracket")]
        return F.concat(F.array(when(b.contains("incorrect"), "marked-incorrect")), F.flatten(F.transform(x["s"], of_segment)), F.array(*(when(c, n) for c, n in rest)))

    head = F.get(F.split(text, r"\["), F.lit(0))
    flags = F.concat(F.array(when(text.rlike(r"^c\.\s*\d{4}"), "circa"), when(head.contains("?"), "queried")), F.flatten(F.transform(brackets, of_bracket)))
    dated = ~none & year.isNotNull()
    missing = F.when(text == "", "blank").when(none, text).when(year.isNull(), F.concat(F.lit("no year: "), text))
    return F.struct(
        F.when(dated, year).alias("year"), F.when(dated, F.array_min(_own(brackets, "first"))).alias("low"), F.when(dated, F.array_max(_own(brackets, "last"))).alias("high"),
        F.when(dated, F.array_join(F.array_distinct(F.array_compact(flags)), " ")).otherwise("").alias("flags"), missing.alias("missing"),
    )


def leading_date(raw: Column, absent: str = "not in source") -> Column:
    """(year, low, high, range_only, event_only) of a text that should begin with its year; limits always take the year in.

    A text that begins otherwise has only a range (its first one) or only an event.  Null for no text.
    """
    text = _straight(raw)
    year = F.nullif(F.regexp_extract(text, r"^(c\.\s*)?(\d{4})", 2), F.lit("")).cast("int")
    end = lambda g: F.nullif(F.regexp_extract(text, r"(\d{4})\s*-\s*(\d{4})", g), F.lit("")).cast("int")
    brackets = _brackets(text)
    low, high = F.array_min(_own(brackets, "first")), F.array_max(_own(brackets, "last"))
    none = (text == "") | (text == absent)
    found = F.struct(
        year.alias("year"), F.when(year.isNull(), end(1)).when(low.isNotNull(), F.least(low, year)).alias("low"), F.when(year.isNull(), end(2)).when(high.isNotNull(), F.greatest(high, year)).alias("high"),
        (year.isNull() & end(1).isNotNull()).alias("range_only"), (year.isNull() & end(1).isNull()).alias("event_only"),
    )
    return F.when(~none, found)


#: Marks that qualify a company's name (fixed values), and what parts names.
QUALIFIER = r"\((\?|by \d{4}|on tour|in London)\)|\[\?\]"
PARTING = {";": ";", "and": r"\band\b", "or": r"\bor\b", "then": r",\s*then\b"}


def company_fields(raw: Column, absent: str = "not in source") -> Column:
    """(status, base, qualifiers, parts) of a company field.

    ``Name (and Other [?])`` is read as two names.  A status of several names says how they are joined.
    """
    text = F.regexp_replace(_straight(raw), r"\s*\(and ([^)]*?)\s*\[\?\]\)", "; $1 (?)")
    base = F.regexp_replace(text, r"\s*\((\?|by \d{4}|on tour|in London)\)", "")
    base = F.trim(F.regexp_replace(F.replace(F.regexp_replace(base, r"\s*\[\?\]", ""), F.lit(")("), F.lit(") (")), r"\s+", " "))
    parts = F.filter(F.transform(F.split(base, ";|" + "|".join(p for n, p in PARTING.items() if n != ";")), lambda x: F.trim(x)), lambda x: x != "")
    kinds = F.array_compact(F.array(*(F.when(base.rlike(p), F.lit(n)) for n, p in PARTING.items())))
    named = [(text == "", "missing (blank)"), (F.lower(text) == "n/a", "missing (n/a)"), (text == "None", "missing (None)"), (text == absent, absent)]
    whole = [(text.startswith("Unknown"), "unknown", "Unknown", F.trim(F.substr(text, F.lit(8)))), (text.startswith("Unacted"), "unacted", "Unacted", F.when(text.contains("(?)"), "(?)").otherwise(""))]
    status, name, marks = F, F, F
    for cond, label in named:
        status, name, marks = status.when(cond, label), name.when(cond, ""), marks.when(cond, "")
    for cond, label, b, q in whole:
        status, name, marks = status.when(cond, label), name.when(cond, b), marks.when(cond, q)
    plain = ~(text.startswith("Unknown") | text.startswith("Unacted") | (text == "") | (F.lower(text) == "n/a") | (text == "None") | (text == absent))
    status = status.when((F.size(parts) > 1) | (F.size(kinds) > 0), F.concat(F.lit("multiple ("), F.array_join(kinds, "/"), F.lit(")"))).when(text.contains("(?)") | text.contains("[?]"), "uncertain").otherwise("clear")
    marks = marks.otherwise(F.array_join(F.regexp_extract_all(text, F.lit(QUALIFIER), F.lit(0)), " "))
    return F.struct(status.alias("status"), name.otherwise(base).alias("base"), marks.alias("qualifiers"), F.when(plain, parts).otherwise(F.array().cast("array<string>")).alias("parts"))
