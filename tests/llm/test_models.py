"""Models that are trained here against enumeration and brute force; samples under hot keys; ids beyond old limits."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.llm import langid, mixing, packing, quality, separators, shared, simhash, tokens, topk, toxicity

from .test_operators import ODD, SCHEMA, brute_components, brute_lines, brute_targets


# 1 language ID


def test_every_language_is_learned(spark):
    rng = random.Random(1)
    langs = [f"l{i:02}" for i in range(70)]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for x in langs}
    rows = [(i, " ".join(rng.choices(words[langs[i % 70]], k=30)), langs[i % 70], "s", 0) for i in range(1400)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).join(spark.createDataFrame(rows, SCHEMA).select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang_pred for r in got} == set(langs)
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.95


@pytest.mark.parametrize("hot", [1, 21])
def test_language_sample_of_one_id(spark, hot):
    same = spark.range(20_000).selectExpr(f"CAST({hot} AS LONG) AS doc_id", "concat('alpha beta ', id) AS text", "'aa' AS lang")
    rest = spark.range(200, 400).selectExpr("id AS doc_id", "concat('xi psi ', id) AS text", "'xx' AS lang")
    learned = langid.training_sample(same.union(rest).union(same.limit(5000)), per_lang=100)
    count = {x: sum(lang == x for lang, _ in learned) for x in ("aa", "xx")}
    assert 50 <= count["aa"] <= 200 and 50 <= count["xx"] <= 200
    long = spark.createDataFrame([(2, "ab " * 50_000, "aa")], "doc_id long, text string, lang string")
    assert sum(len(w) for _, ws in langid.training_sample(long) for w in ws) <= 20_000


# 2 toxicity


def test_label_model_equals_enumeration():
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.3
    a = rng.random(3000) < np.where(y, 0.7, 0.05)
    votes = np.column_stack([a, a ^ (rng.random(3000) < 0.1), rng.random(3000) < np.where(y, 0.5, 0.02), rng.random(3000) < np.where(y, 0.1, 0.6)]).astype(float)
    m = toxicity.LabelModel().fit(votes, y.astype(int))
    every = np.array(list(itertools.product([0.0, 1.0], repeat=4)))
    chance = np.zeros((16, 2))
    for r, v in enumerate(every):
        for c in range(2):
            p = m.prior if c else 1 - m.prior
            for j in range(4):
                q = m.given[j, c, int(v[m.parent[j]]) if m.parent[j] >= 0 else 0]
                p *= q if v[j] else 1 - q
            chance[r, c] = p
    assert chance.sum() == pytest.approx(1)
    assert np.allclose(m.posterior(every), chance[:, 1] / chance.sum(1))
    # accuracies and correlations are those of the draw
    assert np.allclose(m.fire[:, 1], [0.7, 0.66, 0.5, 0.1], atol=0.06) and np.allclose(m.fire[:, 0], [0.05, 0.14, 0.02, 0.6], atol=0.06)
    assert m.correlation[0, 1] > 0.6 and abs(m.correlation[2, 3]) < 0.15
    assert [g.tolist() for g in m.groups] == [[0, 1], [2], [3]] and m.agreement > 0.85


def test_label_model_turns_to_the_labels():
    rng = np.random.default_rng(5)
    y = rng.random(2000) < 0.4
    votes = (rng.random((2000, 6)) < np.where(y, 0.1, 0.7)[:, None]).astype(float)  # all speak for the clean class
    p = toxicity.LabelModel().fit(votes, y.astype(int)).posterior(votes)
    assert p[y].mean() > 0.9 and p[~y].mean() < 0.1


def test_toxicity_sample_of_one_id(spark):
    docs = spark.range(20_000).selectExpr("CAST(21 AS LONG) AS doc_id", "concat('vile words ', id) AS text").union(spark.range(100, 300).selectExpr("id", "concat('kind words ', id)"))
    marks = spark.range(100, 300).selectExpr("id AS doc_id", "0 AS toxic").union(spark.createDataFrame([(21, 1)], "doc_id long, toxic int"))
    rows, _ = toxicity.training_sample(docs, marks, per_class=400)
    assert sum(y for _, y in rows) == 400 and 100 < len(rows) - 400 <= 200


# 4 quality rules


def test_paths_equal_a_walk():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3)).round(1)
    tree = quality.grow(x[:64], rng, [0, 1, 2], 8)

    def walk(row, node=0, depth=0):
        f = tree.feature[node]
        if f < 0:
            return node, depth
        return walk(row, tree.left[node] + int(row[f] >= tree.value[node]), depth + 1)

    got = tree.paths(x)
    inside = {}
    for row, value in zip(x, got):
        node, depth = walk(row)
        assert value == tree.value[node] >= depth
    for row in x[:64]:  # a leaf's value is its depth and what its own points would add
        inside.setdefault(walk(row), []).append(row)
    for (node, depth), rows in inside.items():
        assert tree.value[node] == pytest.approx(depth + float(quality._average_path(len(rows))))


def test_thresholds_equal_a_search(spark):
    rng = np.random.default_rng(7)
    n = 900
    stats = np.column_stack([rng.integers(60, 400, n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)]).astype(int)
    stats[:, 1] = stats[:, 0] * 5
    bad = np.arange(n) < 90
    stats[bad, 2] = stats[bad, 0]
    stats[85:95, 2] = stats[85:95, 0] // 3
    names = [x.split()[0] for x in quality.STATS.split(", ")]
    labelled = spark.createDataFrame([(*map(int, s), int(not b)) for s, b in zip(stats, bad)], [*names, "quality"])
    forests = quality.calibrate(quality.fit_forests(stats), labelled, 0.95, 0.001)
    thresholds, scores = [np.inf] * len(forests.groups), forests.scores(stats)
    bins = np.minimum((scores * quality.BINS).astype(int), quality.BINS - 1)
    left = np.ones(n, bool)
    while True:
        best = None
        for g in range(len(thresholds)):
            if np.isinf(thresholds[g]):
                for low in range(quality.BINS):
                    hit = left & (bins[:, g] >= low)
                    b, c = (hit & bad).sum(), (hit & ~bad).sum()
                    if b >= max(3, 0.02 * (left & bad).sum()) and b >= 0.95 * (b + c) and c <= 0.001 * max((left & ~bad).sum(), 1):
                        gain = b - c / 0.95
                        if best is None or gain > best[0] or (gain == best[0] and g == best[1]):
                            best = (gain, g, low)
        if best is None:
            break
        _, g, low = best
        down = low
        while down > 0 and not (left & (bins[:, g] == down - 1)).any():
            down -= 1
        thresholds[g] = (low + down) / 2 / quality.BINS
        left &= ~(scores[:, g] >= thresholds[g])
    assert forests.thresholds == thresholds and not np.isinf(thresholds).all()


# 5 line dedup


def test_line_dedup_of_hot_lines(spark):
    from lexarium.llm import lines

    rng = random.Random(8)
    rows = [(d, "\n".join(["top", "second", "third"] * rng.randint(0, 2) + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))])) for d in range(1500)]
    got = {r.doc_id: r.kept_text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows, 3)
    places = lines.places(spark.createDataFrame([(1, 1, "\n".join(f"line {i}" for i in range(4000)))], "doc_id long, rk long, text string"), 3)
    assert 0.4 * 4000 < places.count() < 0.6 * 4000  # 2 / (window + 1) of the lines


# 7 SimHash


@pytest.mark.parametrize("groups", simhash._GROUPS)
def test_every_number_of_groups_finds_the_links(spark, monkeypatch, groups):
    monkeypatch.setattr(simhash, "groups_for", lambda count: groups)
    rng = random.Random(groups)
    centres = [rng.getrandbits(64) for _ in range(8)] + [0, 2**64 - 1]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(15)})
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame(rows, "fp long, rep long")).collect()]
    assert sorted(got) == [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]


def test_any_id_names_a_component(spark, monkeypatch):
    big = 0x6000000000000000
    rows = [(big, 1), (big + 5, 0b11), (2**63 - 1, 2**40 * 0b11111), (-(2**63), 2**50 * 0b11111)]
    rows += [(7, 2**20 * 0b1111111), (3, 2**20 * 0b1111111), (7, 2**30 * 0b1111111), (9, 2**30 * 0b1111111)]  # one id with two texts
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert [got[r] for r in rows] == [big, big, 2**63 - 1, -(2**63), 3, 3, 7, 7]


def test_many_cells_are_not_broadcast(spark):
    plan = lambda n: simhash.links(spark.range(n).selectExpr("xxhash64(id) AS fp", "id AS rep"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(20_000) and "SortMergeJoin" in plan(20_000)
    assert "Broadcast" in plan(1000)


def test_heavy_keys_stay_where_they_are(spark):
    left = spark.range(5000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = shared.join_counted(left, right, ["k"], "n")
    assert got.columns == left.join(right, "k").columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    some = right.filter("k % 2 = 0")
    assert sorted(map(tuple, shared.join_counted(left, some, ["k"], "n", "left_semi").collect())) == sorted(map(tuple, left.join(some, "k", "left_semi").collect()))


# 8 packing, 3 separators


def test_spelled_out_marks(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = tokens.Tokens(tokens.source_of())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "x<|endoftext|>", " é \n\n <|endoftext|>\tz", *(t or "" for _, t, *_ in ODD)]
    for t in texts:
        assert enc.marked_ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts[:5])), "doc_id long, text string")
    got = {r.doc_id: r.length for r in packing.pack_documents(docs).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts[:5])}
    # to a scan the mark in a text is text
    got = {r.doc_id: r.n_tokens for r in separators.token_counts(docs).collect()}
    assert got == {i: len(enc.ids(t)) for i, t in enumerate(texts[:5])} and enc.ids(texts[1]).max() < separators.END_ID


def test_widths_and_ends_of_token_files(spark):
    assert separators.id_type(65535) == "<u2" and separators.id_type(65536) == "<u4"
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert separators.token_counts(docs, end_id=70_000).collect()[0].n_tokens == 3
    with pytest.raises(ValueError):
        separators.token_counts(docs, end_id=64)


def brute_best_two(lengths, capacity):
    """Bins as lists of lengths, by a plain search at each step."""
    left, out = sorted(lengths), []
    while left:
        items, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            left.remove(max(fits))
            items.append(max(fits))
            gap -= max(fits)
        if gap and len(items) > 1 and left:
            room = gap + items[-1]
            pairs = [(a + b, -a, a, b) for a, b in itertools.permutations(left, 2) if a + b <= room]
            if pairs and max(pairs)[0] > items[-1]:
                _, _, a, b = max(pairs)
                left.append(items.pop())
                left.remove(a)
                left.remove(b)
                items += [a, b]
        out.append(sorted(items))
    return out


def test_best_two_fit_equals_a_plain_search():
    rng = np.random.default_rng(9)
    for _ in range(60):
        x = rng.integers(1, 61, rng.integers(1, 40))
        b = packing.best_two_fit(x, 60)
        got = [sorted(x[b == k].tolist()) for k in range(b.max() + 1)]
        assert sorted(got) == sorted(brute_best_two(x.tolist(), 60))


# 9 top k


@pytest.mark.parametrize("block", [3, 16384])
def test_topk_of_repeated_ids_and_lengths(spark, block):
    rng = random.Random(block)
    rows = [(i, [rng.randint(-9, 9) / 4 for _ in range(2 + i % 3)]) for i in range(160)]
    rows += [(50, rows[50][1]), (50, [0.25, 1.0]), (50, [0.5] * 3), (100, [1.0, -1.0, 2.0, 0.5]), (7, rows[7][1])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 25 = 0"), 5, block).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for i, q in {(i, tuple(v)) for i, v in whole if i % 25 == 0}:
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))[:5]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert got == sorted(want)


def test_topk_in_waves(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE", 1)
    monkeypatch.setattr(topk, "SAMPLE", 7)
    rng = np.random.default_rng(10)
    df = topk.quantised(spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(400)], "vec_id long, embedding array<double>"))
    one = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 10 = 0"), 5, 9).collect()))
    monkeypatch.undo()
    assert one == sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 10 = 0"), 5).collect())) and len(one) == 200


# 10 mixing


def test_mix_of_many_sources_and_one_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rng = random.Random(11)
    rows = [(None if i % 3 else (7 if i % 2 else i), "w " * rng.randint(0, 9), None, f"host{i % 150}", None) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    total = {}
    for _, t, _, s, _ in rows:
        total[s] = total.get(s, 0) + len(t.split())
    slim = shared.stash(docs.select("doc_id", "source", mixing.words_in().alias("size")), "t")
    got = mixing.mix(slim).collect()
    taken, want = {}, brute_targets(total)
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.first_taken + r.second_taken
    assert len(got) == 1500 and all(abs(taken[s] - want[s]) <= 1 for s in want)
    # no bucket of the running sums holds all rows without an id
    hot = mixing.mix(slim.filter("source = 'host1'").union(slim.filter("doc_id IS NULL").withColumn("source", F.lit("x"))))
    assert hot.count() == 10 + slim.filter("doc_id IS NULL").count()
    out = mixing.mixed_rows(docs).collect()
    assert sum(len(r.text.split()) for r in out) == sum(taken.values())


# the shared folder


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared.shared_root(Session())


def test_scratch_deletes_what_was_written(spark):
    import os

    with shared.scratch(spark):
        path = shared.stash(spark.range(3), "scratch").stash_path
        assert os.path.isdir(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://")) and brute_components([1], []) == {1: 1}
