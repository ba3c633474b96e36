"""Near-dedup by Jaccard similarity against brute force, alone and as a stage."""

import itertools
import random

import pytest

import corpus_pipeline
from lexarium.llm import near, simhash

from .test_operators import ODD, SCHEMA, brute_components


def brute_shingles(text):
    w = (text or "").lower().encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_kept(rows):
    """The smallest doc_id of each component of (doc_id, text), distinct doc_ids."""
    sets = [(d, brute_shingles(t)) for d, t in rows]
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if len(x & y) >= 0.8 * len(x | y)]
    return sorted(set(brute_components([d for d, _ in rows], edges).values()))


def copies(rng, n, words=120, changed=8):
    """An original and n copies, each with a run of other words; runs of 8 leave a similarity of 0.81 to the original."""
    first = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(first)]
    for _ in range(n):
        w = list(first)
        many = rng.randint(1, changed)
        at = rng.randrange(words - many)
        w[at : at + many] = [f"x{rng.randrange(5000)}" for _ in range(many)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("leaders", [1, 32])
def test_near_copies(spark, monkeypatch, leaders):
    monkeypatch.setattr(near, "_LEADERS", leaders)
    rng = random.Random(leaders)
    texts = [t for _ in range(6) for t in copies(rng, 4, changed=14)] + copies(rng, 60)
    texts += [None, "", " \n", "One two", "one  two", "one two three", "a b c d e", "A b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    kept = near.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(rows) - 60


def test_stage_drops_copies_beyond_three_bits(spark, tmp_path):
    texts = copies(random.Random(3), 5)
    assert any((simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(t.encode())).bit_count() > 3 for t in texts)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate([*texts, "something else"])]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in out.collect()) == brute_kept([r[:2] for r in rows]) == [0, 6]


def test_near_copies_of_odd_rows(spark):
    assert near.one_per_group(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near.one_per_group(spark.createDataFrame(ODD, SCHEMA))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 4, 5, 6, 8, 9]


def test_rows_are_told_apart_by_text(spark):
    first, second, third = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, first), (1, second), (1, second), (2, second), (None, first), (None, third), (None, third), (None, third + " x")]
    got = near.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[:2]) for r in got) == [(0, "c0"), (1, "a0"), (1, "b0")]
