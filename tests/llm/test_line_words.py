"""Line dedup that also cuts repeats of one or two long lines, against brute force."""

import random

import pytest

import corpus_pipeline
from lexarium.llm import lines

from .test_operators import SCHEMA


def brute_wordy(rows, window, words):
    """rows: (doc_id, text), distinct doc_ids."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        ls = (text or "").split("\n")
        ix = [i for i, x in enumerate(ls) if x.encode().split()]
        gone = set()
        for n in range(1, window + 1):
            for k in range(len(ix) - n + 1):
                key = tuple(ls[i] for i in ix[k : k + n])
                if n < window and sum(len(x.encode().split()) for x in key) < words:
                    continue
                if key in seen:
                    gone.update(range(ix[k], ix[k + n - 1] + 1))
                seen.add(key)
        out[d] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 4])
def test_short_runs_of_many_words(spark, window):
    rng = random.Random(window)
    pool = ["a", "b", "", " \t", "p q", "c d e", "f g h i", "j  k l m n o", "r s t u v w x"]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for d in range(60)]
    got = {r.doc_id: r.kept_text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), window, words=6).collect()}
    assert got == brute_wordy(rows, window, 6)


def test_stage_cuts_long_lines(spark, tmp_path):
    long, half = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(30))
    texts = [f"one\n{long}", f"{long}\ntwo", long, f"{half}\n\n{half} x", f"start\n{half}\n\n{half} x\nend", "license\nline", "license\nline"]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert out == brute_wordy([r[:2] for r in rows], 3, 50)
    assert [out[i] for i in range(7)] == [texts[0], "two", "", texts[3], "start\nend", "license\nline", "license\nline"]
