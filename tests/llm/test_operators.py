"""Each operator against a brute-force version on small inputs, and on awkward rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexarium.llm import langid, lines, mixing, packing, quality, separators, shared, simhash, substring, tokens, topk, toxicity
from lexarium.llm.shared import components, sample_by_hash

DATA = "/root/testdata"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", "en", None, 5),
    (4, "one", "en", "a", 3),
    (5, "one two three naïve – ñ", None, "b", 9),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG, "en", "b", len(LONG)),
    (7, LONG, "en", "b", len(LONG)),
    (None, "no id here", "fr", "c", 10),
    (8, "x\ny\nz\nx\ny\nz", "en", "c", 11),
    (9, "1234 5678 !!!", "en", "c", 13),
]


@pytest.fixture(scope="module")
def odd(spark):
    # names that clash with columns that operators make themselves
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in ("rk", "fp", "size", "target", "spans", "kept", "rep", "start", "copy", "words", "score", "toxic", "quality", "bytes", "ordinal", "shard", "a", "b")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 0, 0),)):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# 1 language ID


def small_crf(k=3):
    rng = np.random.default_rng(1)
    m = langid.Crf([f"l{i}" for i in range(k)], bits=10)
    m.weights = rng.normal(size=(1024, k)).astype(np.float32)
    m.lexicon_weights = rng.normal(size=(k + 1, k)).astype(np.float32)
    m.transitions = rng.normal(size=(k, k)).astype(np.float32)
    return m


def test_forward_backward_equals_enumeration():
    m = small_crf()
    words = ["ab", "cde", "f", "ab"]
    vocab = sorted(set(words))
    e = m.emissions(vocab)
    seq = np.array([vocab.index(w) for w in words])
    got, each = m.posteriors([seq], e, each=True)
    want = np.zeros((4, 3))
    a = np.exp(m.transitions.astype(float))
    for path in itertools.product(range(3), repeat=4):
        p = a[:, path[0]].sum()  # any language may come before the first word
        for t, y in enumerate(path):
            p *= math.exp(e[seq[t], y]) * (a[path[t - 1], y] if t else 1)
        for t, y in enumerate(path):
            want[t, y] += p
    want /= want.sum(1, keepdims=True)
    assert np.allclose(each[0], want, atol=1e-4)
    assert np.allclose(got[0], want.sum(0), atol=1e-3)


def test_segments_do_not_change_posteriors(monkeypatch):
    m = small_crf()
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(40)]
    e = m.emissions(vocab)
    seqs = [rng.integers(40, size=n) for n in (0, 1, 7, 63, 300)]
    whole = m.posteriors(seqs, e)
    monkeypatch.setattr(langid, "SEGMENT", 8)
    assert np.allclose(whole, m.posteriors(seqs, e), atol=1e-3 * 300)
    assert np.allclose(whole.sum(1), [len(s) for s in seqs], atol=0.01)


def test_code_switched_text_is_followed():
    docs = [("aa", ["abba", "baba", "aab", "bab"] * 30), ("xx", ["xyyx", "yxyx", "xxy", "yxy"] * 30)] * 4
    m = langid.train(docs, steps=25)
    (mass, each), n = langid.label_texts(m, ["abba baba aab bab aab xyyx yxyx xxy yxy xxy"], each=True)
    assert [m.langs[i] for i in each[0].argmax(1)] == ["aa"] * 5 + ["xx"] * 5
    assert n[0] == 10


def test_language_accuracy_and_odd_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].lang_pred == by[2].lang_pred == by[9].lang_pred == "und" and by[1].score == 0
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.words_of("½ ² ③") == [] and langid.words_of("½ a") == ["½", "a"]
    learned = langid.training_sample(odd.union(odd))
    assert learned == langid.training_sample(odd) and [words for _, words in learned].count(langid.words_of(LONG)) <= 2


# 2 toxicity


def test_label_model_finds_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    one = (rng.random(4000) < np.where(y, 0.8, 0.01)).astype(float)
    votes = np.column_stack([one, one, (rng.random(4000) < np.where(y, 0.6, 0.02)).astype(float)])
    m = toxicity.LabelModel().fit(votes, y.astype(int))
    assert sorted(map(list, m.groups)) == [[0, 1], [2]]
    assert abs(m.fire[2, 1] - 0.6) < 0.08 and m.fire[0, 0] < 0.05
    p = m.posterior(votes)
    assert p[y].mean() > 0.8 and p[~y].mean() < 0.1


def test_toxicity_held_out_and_odd_rows(spark, odd, empty):
    docs, marks = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.detect(docs, marks).join(marks, "doc_id").toPandas()
    held = got[got.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit >= 0.9 * (held.toxic == 1).sum()
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 0.02 * (held.toxic == 0).sum()
    assert (got.predicted == (got.score >= 0.3)).all()
    for marked in (labels(spark, []), labels(spark, [(2, 1, 1), (4, 1, 0), (6, None, None), (None, 1, 1)])):
        rows = toxicity.detect(odd, marked).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.detect(empty, labels(spark, [])).count() == 0


# 3 separator scan


@pytest.mark.parametrize("block_ids", [7, 1 << 20])
def test_token_counts(spark, odd, empty, block_ids):
    enc = tokens.Tokens(tokens.source_of())
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, *_ in ODD if i != 6 and i != 7] + [(20, "a b c " * 50, None, None, None)], SCHEMA).repartition(3)
    want = sorted((r.doc_id if r.doc_id is not None else -1, len(enc.slow(r.text or ""))) for r in docs.collect())
    got = separators.token_counts(docs, block_ids=block_ids).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == want
    assert separators.token_counts(empty, block_ids=block_ids).count() == 0


def test_scan_of_foreign_files(spark, tmp_path):
    np.array([5, 9, 9, 1, 2, 3, 9, 4], "<u2").tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    got = sorted(tuple(r) for r in separators.scan(spark, f"file://{tmp_path}", end_id=9, block_ids=2).collect())
    assert got == [("a.bin", 0, 0, 1, True), ("a.bin", 1, 2, 0, True), ("a.bin", 2, 3, 3, True), ("a.bin", 3, 7, 1, False)]


def test_a_task_searches_several_blocks(spark, tmp_path):
    want = []
    for name, n in (("a.bin", 31), ("b.bin", 2), ("c.bin", 47)):  # 41 blocks of two ids
        ids = np.arange(n) % 5
        ids.astype("<u2").tofile(tmp_path / name)
        ends = [-1, *np.flatnonzero(ids == 4).tolist()]
        want += [(name, k, a + 1, b - a - 1, True) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
        want += [(name, len(ends) - 1, ends[-1] + 1, n - ends[-1] - 1, False)]
    before = shared.written()
    got = sorted(tuple(r) for r in separators.scan(spark, f"file://{tmp_path}", end_id=4, block_ids=2).collect())
    assert got == want
    (blocks,) = shared.written_since(before)
    files = spark.read.parquet(blocks).inputFiles()
    assert len(files) == -(-41 // separators.TASK_BLOCKS)  # each written file starts processes in the executor


def test_fast_and_slow_tokens_agree(spark):
    enc = tokens.Tokens(tokens.source_of())
    texts = [r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text").collect()]
    for t in [*texts, "a  b\n\n c\t", "<|endoftext|> x", "  é", "日本語 🙂", "1 22 333", " " * 300 + "x"]:
        assert enc.ids(t).tolist() == enc.slow(t)


# 4 quality rules


def brute_stats(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_rule_statistics(spark, odd):
    texts = [t for _, t, *_ in ODD] + ["a b c a b c a", "a b c\n\na b c\n # $x |", "é é é é", "a\u0085b c\x1cd"]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        assert quality.rule_stats((t or "").encode()) == brute_stats(t)


def test_samples_are_bounded(spark):
    rows = spark.range(4000).selectExpr("id", "7 AS key")  # one key: all or none are drawn
    assert sample_by_hash(rows, F.col("key"), 4000, 3999).count() in (0, 4000)
    assert all(sample_by_hash(rows.withColumn("key", F.lit(k)), F.col("key"), 4000, 1000).count() in (0, 2000) for k in range(12))
    got = sample_by_hash(rows, F.col("id"), 4000, 500)
    assert 400 < got.count() < 600 and got.collect() == got.collect()


def test_isolation_paths():
    rng = np.random.default_rng(3)
    stats = np.column_stack([rng.integers(100, 400, 2000), np.zeros(2000), np.zeros(2000), np.zeros(2000), np.zeros(2000)])
    stats[:, 1] = stats[:, 0] * 5
    stats[:40, 2] = stats[:40, 0] * 2
    scores = quality.fit_forests(stats).scores(stats)
    assert scores[:40, 3].min() > scores[40:, 3].max()


def test_quality_verdicts(spark, odd, empty):
    docs, marks = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.verdicts(docs, marks).join(marks, "doc_id").toPandas()
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all()
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.995
    assert judged[judged.quality == 0].kept.mean() < 0.05
    for marked in (labels(spark, []), labels(spark, [(6, 1, 0), (7, 0, 0), (None, 0, 0), (4, None, 0)])):
        rows = quality.verdicts(odd, marked).collect()
        assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.base_failed)
        assert quality.keep_clean(odd, marked).columns == odd.columns
    assert quality.verdicts(empty, labels(spark, [])).count() == 0
    kept = {r.doc_id for r in quality.verdicts(docs, marks).filter("kept").collect()}
    assert {r.doc_id for r in quality.keep_clean(docs, marks).collect()} == kept


# 5 line dedup


def brute_lines(rows, window):
    """rows: (doc_id, text), distinct doc_ids."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        ls = (text or "").split("\n")
        ix = [i for i, x in enumerate(ls) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for k in range(len(ix) - window + 1):
            key = tuple(ls[i] for i in ix[k : k + window])
            if key in seen:
                gone.update(range(ix[k], ix[k + window - 1] + 1))
            seen.add(key)
        out[d] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


@pytest.mark.parametrize("window", [1, 2, 3])
def test_line_dedup(spark, window):
    rng = random.Random(window)
    rows = [(d, "\n".join(rng.choice(["a", "b", "c", "", " ", "long line"]) for _ in range(rng.randint(0, 12)))) for d in range(60)]
    got = {r.doc_id: r.kept_text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()}
    assert got == brute_lines(rows, window)


def test_line_dedup_odd_rows(spark, odd, empty):
    out = lines.dedup_lines(odd)
    assert set(odd.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].kept_text is None and by[1].n_lines == 0
    assert by[8].kept_text == "x\ny\nz" and by[8].n_removed == 3
    assert by[8].rk == "extra"
    assert lines.digest(empty).count() == 0


# 6 substring dedup


def brute_repeats(rows, length):
    count = Counter(tuple(w[i : i + length]) for w in rows for i in range(len(w) - length + 1))
    out = []
    for w in rows:
        gone = {i + k for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for k in range(length)}
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup(spark, seed):
    rng = random.Random(seed)
    parts = [[rng.choice("abcd") for _ in range(rng.randint(3, 14))] for _ in range(12)]
    texts = []
    for d in range(50):
        w = sum((rng.choice(parts) if rng.random() < 0.6 else [rng.choice("abcdefgh") for _ in range(5)] for _ in range(rng.randint(0, 6))), [])
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=7, gram=3).collect()}
    want = brute_repeats([t.encode().split() for t in texts], 7)
    assert [bytes(got[d].kept) for d in range(50)] == want
    assert all(got[d].n_removed == len(t.split()) - len(want[d].split()) for d, t in enumerate(texts))


def test_substring_dedup_odd_rows(spark, odd, empty):
    rows = substring.digest(substring.remove_repeats(odd)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[6].n_removed == by[7].n_removed == 30_000 and by[1].n_words == 0
    assert by[1].kept_sha256 == by[6].kept_sha256 == substring.sha256_of([])
    assert substring.remove_repeats(empty).count() == 0
    slim = odd.select("doc_id", F.lit(1).cast("long").alias("rk"), F.col("text").cast("binary").alias("text"))
    once, often = (substring.repeats(x.filter("doc_id IN (6, 7)")) for x in (slim, slim.union(slim).union(slim)))
    assert sorted(map(str, once.selectExpr("doc_id", "array_sort(spans) AS s").collect())) == sorted(map(str, often.selectExpr("doc_id", "array_sort(spans) AS s").collect()))


# 7 SimHash


def brute_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark):
    for t in [t for _, t, *_ in ODD if t != LONG] + ["A B c d", "Ä b c", "x y", "a b c d e f g h i j"]:
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)


@pytest.mark.parametrize("seed", range(3))
def test_links_are_whole(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(25)}
    fps = sorted(fps)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(rows, "fp long, rep long")).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, x) for x in range(201, 240)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows(rows):
    """Brute-force component of each (doc_id, text)."""
    f = [(d, brute_fingerprint(t)) for d, t in rows]
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(f, 2) if (x ^ y).bit_count() <= 3]
    return brute_components([d for d, _ in f], edges)


def test_near_groups_of_documents(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert got == near_rows(rows)
    got = simhash.near_groups(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[6] == by[7] == 6
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for d, c in by.items() if d is not None})
    assert simhash.near_groups(empty).count() == 0 and simhash.one_per_group(empty).count() == 0


def test_rows_without_id_bridge(spark, monkeypatch):
    fps = {1: 0b0, None: 0b111, 2: 0b111111, 9: 2**63 + 2**40 * 0b1111, 10: 2**20 * 0b1111111}
    rows = [(d, x - (1 << 64) if x >> 63 else x) for d, x in fps.items()] + [(None, 2**50 * 0b11111), (None, 2**50 * 0b11111 + 1)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs)
    got = [(r.doc_id, r.component_id) for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()]
    assert Counter(got) == Counter({(1, 1): 1, (None, 1): 1, (2, 1): 1, (9, 9): 1, (10, 10): 1, (None, None): 2})


# 8 packing


def test_best_two_fit_replaces_the_smallest():
    bins = packing.best_two_fit(np.array([60, 30, 20, 19]), 100)  # 60 + 30 leaves 10; 20 and 19 fill 39 of the 40 that 30 leaves
    assert bins[0] == bins[2] == bins[3] != bins[1]
    rng = np.random.default_rng(0)
    for _ in range(30):
        x = rng.integers(1, 101, rng.integers(1, 200))
        b = packing.best_two_fit(x, 100)
        assert np.bincount(b, x).max() <= 100
        assert b.max() + 1 <= 1.25 * -(-x.sum() // 100) + 1


def check_packing(rows, texts, capacity, enc):
    """rows: pieces; texts: a multiset of (doc_id, text)."""
    want = Counter()
    for d, t in texts:
        ids = np.append(enc.ids(t or ""), 0).astype("<u4")
        n = len(ids)
        k = -(-n // capacity)
        cuts = [0] + [n - capacity * (k - 1 - j) for j in range(k)]
        want.update((d, j, cuts[j], cuts[j + 1] - cuts[j], zlib.crc32(ids[cuts[j] : cuts[j + 1]].tobytes())) for j in range(k))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_packing(spark, odd, empty):
    enc = tokens.Tokens(tokens.source_of())
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    bins, total = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048, enc)
    assert bins <= 1.01 * -(-total // 2048) + 1
    check_packing(packing.pack_documents(odd, 64).collect(), [(d, t) for d, t, *_ in ODD], 64, enc)
    assert packing.pack_documents(empty).count() == 0


def test_repeated_rows_spread_over_shards(spark):
    same = spark.range(2000, numPartitions=4).selectExpr("CAST(NULL AS LONG) AS doc_id", "'one two three' AS text")
    rows = packing.pack(packing.pieces(same), shard_rows=250).collect()
    assert check_packing(rows, [(None, "one two three")] * 2000, 2048, tokens.Tokens(tokens.source_of()))[1] == sum(r.length for r in rows)
    assert max(Counter(r.sequence_id >> 32 for r in rows).values()) < 500


# 9 top k


def brute_topk(vectors, k, is_query):
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors}
    out = set()
    for i in q:
        if is_query(i):
            s = sorted(((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i))[:k]
            out |= {(i, n + 1, j, -v) for n, (v, j) in enumerate(s)}
    return out


def test_topk(spark):
    rng = np.random.default_rng(1)
    vs = [(i, rng.normal(size=8).round(1).tolist()) for i in range(700)]
    vs += [(700 + i, vs[3][1]) for i in range(40)] + [(800, [0.0] * 8), (850, vs[0][1])]
    bad = [(900, None), (950, [float("nan")] * 8), (951, [None] * 8), (952, [float("inf")] * 8), (None, [1.0] * 8), (953, [])]
    df = topk.quantised(spark.createDataFrame(vs + bad, "vec_id long, embedding array<float>").repartition(3))
    for block in (4, 16384):
        got = {tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5, block).collect()}
        assert got == brute_topk(vs, 5, lambda i: i % 50 == 0)
    few = df.filter("vec_id < 3")
    assert topk.top_k(few, few, 5).count() == 6
    none = df.filter("false")
    assert topk.top_k(none, none, 5).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(2).normal(size=(500, 6))
    t = topk.CoverTree(x, leaf=16)
    assert sorted(topk.rows_below(t, t.root).tolist()) == list(range(500))
    for n in range(len(t.centre)):
        assert np.linalg.norm(x[topk.rows_below(t, n)] - t.centre[n], axis=1).max() <= t.radius[n] + 1e-9


def test_large_integers_stay_exact():
    a = np.array([[2**31 + 1, 3]], np.int64)
    assert topk.integer_products(a, a)[0, 0] == (2**31 + 1) ** 2 + 9


# 10 mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, fixed, left = share * sum(sizes.values()), {}, set(names)
    while left:
        level = budget / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > most * sizes[s]}
        if not over:
            return fixed | {s: level * w[s] for s in left}
        for s in over:
            fixed[s] = most * sizes[s]
            budget -= most * sizes[s]
        left -= over
    return fixed


def test_mix(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rng = random.Random(1)
    small = spark.createDataFrame([(i, "w " * rng.randint(0, 30), None, rng.choice(["a", "b", "é", "Z", None, "a"]), None) for i in range(300)], SCHEMA)
    for d in (docs, small, odd):
        rows = mixing.per_document(d).collect()
        src = d.select("doc_id", "source", "text").collect()
        size = lambda t: len((t or "").encode().split())
        assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, size(r.text)) for r in src)
        total = {}
        for r in src:
            total[r.source] = total.get(r.source, 0) + size(r.text)
        want = brute_targets(total)
        of = {r.doc_id: r.source for r in src}
        taken = Counter()
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size
            assert r.source_size == total[of[r.doc_id]]
            assert r.target == pytest.approx(want[of[r.doc_id]])
            taken[of[r.doc_id]] += r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.per_document(d).collect()))
    assert mixing.per_document(empty).count() == 0


def test_mixed_rows_hold_the_words(spark, odd):
    rows = mixing.mixed_rows(odd).select("doc_id", "text", "size").collect()
    plan = mixing.per_document(odd).collect()
    assert sum(len(r.text.encode().split()) for r in rows) == sum(r.taken for r in plan)
    whole = {t for _, t, *_ in ODD if t}
    assert all(any(t.startswith(r.text) for t in whole) for r in rows)
    assert {r.size for r in rows} == {"extra"}
    line = mixing.queue(odd.withColumn("size", mixing.words_in())).select("finish", "words").collect()
    assert [r.finish for r in line] == sorted(r.finish for r in line)
