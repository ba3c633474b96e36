"""Text functions as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: The four word patterns of the corpus (fixed values): white-space words, lower-case ASCII words, words with
#: inner apostrophes, and ASCII words of two letters or more.
WORD_PATTERNS = {"space": r"\S+", "lower": r"\b[a-z]+\b", "apostrophe": r"[A-Za-z][A-Za-z'’]*", "two": r"\b[a-zA-Z]{2,}\b"}


def collapse(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column, kind: str = "space") -> Column:
    """Words of a text by one of WORD_PATTERNS; the pattern ``lower`` reads lower-cased text."""
    return F.regexp_extract_all(F.lower(c) if kind == "lower" else c, F.lit(WORD_PATTERNS[kind]), F.lit(0))


def without(tokens: Column, stop: Sequence[str]) -> Column:
    """Tokens that are no stop words; repeats stay."""
    return F.filter(tokens, lambda w: ~w.isin(*stop))


def canonical(c: Column) -> Column:
    """Comparison key: letters and digits, lower case, long s and double v folded."""
    return F.replace(F.replace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")), F.lit("ſ"), F.lit("s")), F.lit("vv"), F.lit("w"))


def modern_spelling(c: Column) -> Column:
    """Long s to s; a word-initial double v to w."""
    c = F.replace(c, F.lit("ſ"), F.lit("s"))
    c = F.regexp_replace(c, r"\bVV", "W")
    c = F.regexp_replace(c, r"\bvv", "w")
    return F.regexp_replace(c, r"\bVv", "W")


#: Ordinal and cardinal words, the old spellings among them (fixed values), and roman numerals.
ORDINALS = {
    "first": 1, "firste": 1, "second": 2, "seconde": 2, "third": 3, "thirde": 3, "thyrd": 3, "fourth": 4, "fourthe": 4, "fovrth": 4, "fifth": 5, "fift": 5, "fifte": 5, "sixth": 6, "sixt": 6, "sixte": 6,
    "seventh": 7, "seuenth": 7, "eighth": 8, "eight": 8, "eyghth": 8, "ninth": 9, "ninthe": 9, "tenth": 10, "tenthe": 10, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "nine": 9, "ten": 10,
}
ROMANS = {"iiii": 4} | {tens + ones: 10 * k + n for k, tens in enumerate(("", "x")) for n, ones in enumerate(("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")) if tens + ones} | {"xx": 20}


def title_key(c: Column, stop: Sequence[str]) -> Column:
    """Tokens of a title with spelling variants folded: letters mapped, doubled letters squeezed; short words, stop words and names of numbers gone."""
    c = F.lower(c)
    for a, b in (("ſ", "s"), ("vv", "w"), ("æ", "ae"), ("œ", "oe")):
        c = F.replace(c, F.lit(a), F.lit(b))
    tokens = F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))
    fold = lambda w: F.regexp_replace(F.regexp_replace(F.translate(w, "vjy", "uii"), "ie$", "i"), r"(.)\1+", "$1")
    return F.filter(F.transform(F.filter(tokens, lambda w: ~w.isin(*stop, *ORDINALS, *(r for r in ROMANS if len(r) > 1), "v", "x")), fold), lambda w: F.length(w) > 2)


def number_signature(c: Column, ordinals: dict[str, int] | None = None) -> Column:
    """Numbers named in a title: digits, roman numerals up to xx, and ordinals (``ORDINALS`` unless others are given)."""
    table = F.create_map(*(F.lit(x) for kv in ((ORDINALS if ordinals is None else ordinals) | ROMANS).items() for x in kv))
    tokens = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    return F.filter(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w.try_cast("int"))), lambda n: n.isNotNull())


def ij_uv(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(c), "^j", "i"), "v", "u")


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "_")


def split_authors(c: Column) -> Column:
    """Names apart at semicolons, or where a lower-case letter meets the next "Surname, "."""
    return F.filter(F.transform(F.split(c, r";\s*|(?<=[a-z])(?=[A-Z][a-z]+, )"), lambda x: F.trim(x)), lambda x: x != "")


def facets(c: Column, null_words: Sequence[str] = ("", "none", "unknown", "n/a")) -> Column:
    """Values of a delimited facet, without null words."""
    return F.filter(F.transform(F.split(c, r"\s*[;|]\s*"), lambda x: F.trim(x)), lambda x: ~F.lower(x).isin(*null_words))


def apostrophes(c: Column) -> Column:
    return F.translate(c, "’‘ʼ`", "''''")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(apostrophes(c)), F.lit("[a-z0-9']+"), F.lit(0)))


def sentence_ends(c: Column) -> Column:
    """Number of sentence ends: a closing mark, perhaps a quote or bracket, then white space."""
    return F.regexp_count(c, F.lit(r"""[.!?;]["')\]]?\s"""))


def strip_genitive(c: Column) -> Column:
    return F.regexp_replace(c, "['’]s$", "")


def snippet(c: Column, n: int) -> Column:
    """The first ``n`` characters, back to the last whole word where more follows."""
    return F.when(F.length(c) <= n, c).otherwise(F.regexp_replace(F.substring(c, 1, n), r"\s\S*\z", ""))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def highlight(c: Column, keywords: Sequence[str]) -> Column:
    """Escaped text with the keywords marked, whatever their case."""
    return F.regexp_replace(escape_html(c), "(?i)\\b(" + "|".join(map(re.escape, keywords)) + ")\\b", "<mark>$1</mark>")


def ordinal(c: Column) -> Column:
    last, teen = F.pmod(c, F.lit(10)), F.pmod(c, F.lit(100)).between(11, 13)
    return F.concat(c.cast("string"), F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def odd_regularisation(reg: Column, pos: Column) -> Column:
    """A regularised form that can't be right: no letter, an inner capital, or the part of speech itself."""
    return ~reg.rlike(r"\p{L}") | reg.rlike(r"\p{Ll}\p{Lu}") | (F.lower(reg) == F.lower(pos))


def emit_tokens(tokens: Column) -> Column:
    """Text of an array of (surface, glue) structs; glue is none, left, right or both."""
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("tight"))
    step = lambda acc, t: F.struct(F.concat(acc["text"], F.when(acc["tight"] | t["glue"].isin("left", "both"), "").otherwise(" "), t["surface"]).alias("text"), t["glue"].isin("right", "both").alias("tight"))
    return F.aggregate(tokens, start, step, lambda acc: acc["text"])
