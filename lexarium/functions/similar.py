"""String similarity that native functions don't have: Ratcliff-Obershelp ratios as Arrow-batched functions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F, types as T


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Similarity ratio; 0 as soon as a cheap upper bound falls below ``least``."""
    m = SequenceMatcher(None, a, b, autojunk=False)
    if m.real_quick_ratio() < least or m.quick_ratio() < least:
        return 0.0
    return m.ratio()


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)])


def is_subsequence(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


def similar_words(a: str, b: str) -> bool:
    """Same word in two spellings: a long enough subsequence, or a ratio of 0.75."""
    short, long = sorted((a, b), key=len)
    if len(short) >= 4 and len(short) >= 0.5 * len(long) and is_subsequence(short, long):
        return True
    return ratio(a, b, 0.75) >= 0.75


#: How closing words name a part when the heading doesn't (fixed value).
PART = re.compile(r"(first|second|third|1|2|3)\s+part")


def part_number(closing: str) -> list[int]:
    """The part that a unit's closing words name, for units whose headings have no number."""
    found = PART.search(closing.lower().replace("ſ", "s"))
    words = {"first": 1, "second": 2, "third": 3}
    return [words.get(found[1]) or int(found[1])] if found else []


def title_score(head: list[str], title: list[str], head_numbers: list[int], title_numbers: list[int], alike: float = 0.82, closing: str = "") -> float:
    """Fuzzy recall, precision and order of a heading's tokens against a title's, less where the title's numbers differ or are missing.

    Tokens count once, and each answers for one of the other side at most.
    """
    a, b = list(dict.fromkeys(head)), list(dict.fromkeys(title))
    if not a or not b:
        return 0.0
    left, hits = list(a), 0
    for w in b:
        found = next((x for x in left if x == w or ratio(x, w, alike) >= alike), None)
        if found is not None:
            left.remove(found)
            hits += 1
    s = 0.5 * hits / len(b) + 0.25 * hits / len(a) + 0.25 * ratio(" ".join(a), " ".join(b))
    numbers = head_numbers or part_number(closing)
    if title_numbers and not numbers:
        s *= 0.85
    elif not set(title_numbers) <= set(numbers):
        s *= 0.3
    return min(s, 1.0)
