"""Resolvers, ranks, scans and sinks on small invented inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.functions import dates, text as X
from lexarium.functions.similar import part_number, title_score
from lexarium.operators import align, rules, shares, topics
from lexarium.plans.texts import dense_windows
from lexarium.sources import readers, writers


def fates(spark, nodes, units=(), decisions=(), audits=(), spoken_only=False):
    """nodes: (key, unit, divs, spoken)."""
    n = spark.createDataFrame([(k, u, "t/" + "/".join(d), "k", d, s, f"h{k}") for k, u, d, s in nodes], "key long, unit string, path string, kind string, divs array<string>, spoken boolean, text_hash string")
    u = spark.createDataFrame(list(units), "unit string, status string")
    d = spark.createDataFrame(list(decisions), "key long, decided string, hash string, as_role string")
    a = spark.createDataFrame(list(audits), "path string, decision string, only string")
    return {r.key: (r.fate, r.reason, r.role) for r in rules.node_fates(n, u, d, a, spoken_only).collect()}


def test_units_come_first(spark):
    got = fates(spark, [(i, u, ["act"], True) for i, u in enumerate("abcde")], [("a", None), ("b", "deferred"), ("c", "supplementary"), ("d", "proposed"), ("e", "excluded")], [(1, "include", "h1", None)])
    assert [got[i][0] for i in range(5)] == ["kept", "deferred", "supplementary", "pending", "excluded"]


def test_decisions_go_before_rules_and_hold_for_their_text(spark):
    nodes = [(i, "a", ["act"], True) for i in range(6)] + [(9, "a", ["prologue"], False)]
    decisions = [(0, "exclude", "h0", None), (1, "include", "h1", "song"), (2, "supplementary", "h2", None), (3, "deferred", "h3", None), (4, "pending", "h4", None), (5, "exclude", "old", None), (9, "include", "h9", "body")]
    got = fates(spark, nodes, [], decisions, [("t/prologue", "exclude", None)])
    assert [got[i][0] for i in range(6)] == ["excluded", "kept", "supplementary", "deferred", "pending", "error"]
    assert got[1][2] == "song" and got[9] == ("kept", "node decision", "body")


@pytest.mark.parametrize("flip", [False, True])
def test_audits(spark, flip):
    nodes = [(1, "a", ["x"], False), (2, "a", ["x", "y"], False), (3, "a", ["z"], False), (4, "a", ["q"], False), (5, "a", ["poem"], False), (6, "a", ["poem", "s"], False), (7, "a", ["errata"], False), (8, "a", ["errata", "song"], False), (9, "a", ["w"], False), (10, "a", ["speech"], True)]
    audits = [("t/x", "include", None), ("t/x/y", "exclude", None), ("t/z", "include", None), ("t/z", "exclude", None), ("t/poem/s", "include", None), ("t/errata/song", "deferred", None), ("t/w", "supplementary", None), ("t/w", "supplementary", None)]
    got = fates(spark, nodes, [], [], audits[::-1] if flip else audits)
    want = {1: "kept", 2: "excluded", 3: "pending", 4: "pending", 5: "pending", 6: "kept", 7: "excluded", 8: "deferred", 9: "supplementary", 10: "kept"}
    assert {k: v[0] for k, v in got.items()} == want
    assert got[3][1] == "conflicting audits" and got[4][1] == "no audit" and got[5][1] == "no node decision" and got[10][2] == "speech"
    only = fates(spark, nodes, [], [], audits, spoken_only=True)
    assert {k for k, v in only.items() if v[0] == "kept"} == {10}


def test_frames(spark):
    keys = "tcp long, node long, section string, div string"
    groups = spark.createDataFrame([(1, 0, "f", d, c, a) for d, c, a in (("a", True, 5), ("b", True, 5), ("c", True, None), ("d", False, 5), ("e", True, 99), ("g", True, 5), ("h", True, 5), ("i", True, None))], keys + ", candidate boolean, attributed long")
    decided = [(1, 0, "f", "b", "exclude", None), (1, 0, "f", "g", "include", 77), (1, 0, "f", "h", "include", 6), (1, 0, "f", "i", "include", 5)]
    decisions = spark.createDataFrame(decided, keys + ", decided string, target long")
    kinds = spark.createDataFrame([(d, "include") for d in "acde"], "div string, default string")
    built = spark.createDataFrame([(5, 1), (6, 2)], "work long, of long")
    got = {r.div: (r.fate, r.work, r.error) for r in rules.frame_fates(groups, decisions, kinds, built).collect()}
    assert got["a"] == ("kept", 5, None) and got["b"][0] == got["d"][0] == got["e"][0] == "excluded" and got["c"][0] == "pending"
    assert got["g"] == ("pending", None, "target is not built") and got["h"] == ("pending", None, "target is from another source") and got["i"] == ("kept", 5, None)


def test_values_that_are_not_allowed(spark):
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert rules.allowed(df, "x", ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="value b"):
        rules.allowed(df, "x", ["a"]).collect()


def test_titles():
    assert title_score(["ab", "ab"], ["ab", "cd"], [], []) == pytest.approx(0.5 * 0.5 + 0.25 + 0.25 * 4 / 7)
    assert title_score(["henri"], ["henri"], [1, 4], [4]) == 1 and title_score(["henri"], ["henri"], [4], []) == 1
    assert title_score(["henri"], ["henri"], [], [4]) == 0.85 and title_score(["henri"], ["henri"], [4], [4, 1]) == 0.3
    assert part_number("The ende of the ſecond part.") == [2] and part_number("1 part") == [1] and part_number("finis") == []
    assert title_score(["henri"], ["henri"], [], [2], closing="end of the second part") == 1
    got = align.assign_titles([(1, ["henri"], []), (2, ["lear"], [])], [(10, ["henri"], []), (11, ["henri"], []), (12, ["lear"], [])])
    assert {(h, t, how) for h, t, _, how in got} == {(1, 10, "tie"), (2, 12, "title")}
    assert align.assign_titles([], [(1, ["a"], [])]) == []
    assert align.parse_names("RoedeerDoe", {"Doe"}, {"Roe", "Roedeer", "Doe"}) == ["Roedeer", "Doe"]


def test_title_words(spark):
    f = lambda e, x: spark.range(1).select(e(F.lit(x)).alias("x")).first().x
    assert f(lambda c: X.title_key(c, ["the"]), "The Seconde part of Œdipus, Cæsar xiv") == ["part", "oedipus", "caesar"]
    assert f(X.number_signature, "The seuenth, xix and xx of 3") == [7, 19, 20, 3]
    assert f(lambda c: X.highlight(c, ["a.b"]), "a.b axb") == "<mark>a.b</mark> axb"


def test_date_texts(spark):
    full = lambda s: tuple(spark.range(1).select(dates.full_date(F.lit(s)).alias("x")).first().x)
    lead = lambda s: (lambda r: r and tuple(r))(spark.range(1).select(dates.leading_date(F.lit(s)).alias("x")).first().x)
    assert full("1599 [1598-1601]") == (1599, 1598, 1601, "", None) and full("") == (None, None, None, "", "blank")
    assert full("c. 1590? [1588-1589; revised 1600-1601; c.1585-1586]") == (1590, 1585, 1589, "circa queried secondary-dates-ignored circa-limit revised", None)
    assert full("undated") == (None, None, None, "", "no year: undated")
    assert lead("1600 [1601-1602]") == (1600, 1600, 1602, False, False) and lead("in 1633-1634") == (None, 1633, 1634, True, False)
    assert lead("licensed") == (None, None, None, False, True) and lead("") is None


def test_value_ranks_equal_sorted_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([0.0, 0.5, rng.random(), -3.0])) for _ in range(500)] + [("c", 1.0), ("c", 1.0), ("c", None)]
    got = {(r.k, r.v): (r.rank_low, r.rank_mean, r.n_tie, r.n) for r in shares.value_ranks(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], 7).collect()}
    for k in "abc":
        vs = sorted(v for x, v in rows if x == k and v is not None)
        for v in set(vs):
            t = vs.count(v)
            assert got[k, v] == (vs.index(v) + 1, vs.index(v) + 1 + (t - 1) / 2, t, len(vs))


def test_plane_keeps_distances():
    at = np.random.default_rng(3).normal(size=(7, 2))
    d = np.linalg.norm(at[:, None] - at[None], axis=2)
    p = topics.plane(d)
    assert np.allclose(np.linalg.norm(p[:, None] - p[None], axis=2), d)
    assert topics.plane(np.zeros((0, 0))).shape == (0, 2) and np.allclose(topics.plane(np.zeros((3, 3))), 0)


def test_dense_windows():
    import re

    text = "x" * 50 + " the the the " + "y" * 400 + " the and der " + "z" * 400
    assert dense_windows(text, re.compile(r"\b(the|and|der)\b"), 100, 2)[0][1] == 3
    assert dense_windows("", re.compile("a"), 100, 2) == []


def test_hot_folder_has_several_writers(spark, tmp_path):
    import glob

    name = "spark.sql.adaptive.coalescePartitions.enabled"  # or the tiny parts are put together again
    spark.conf.set(name, "false")
    writers.write_partitioned(spark.range(5000).selectExpr("id", "IF(id < 4500, 1, id) AS k").filter("k < 4600"), f"file://{tmp_path}/p", ["k"], rows=1000)
    spark.conf.unset(name)
    assert len(glob.glob(f"{tmp_path}/p/k=1/*.parquet")) > 1 and spark.read.parquet(f"file://{tmp_path}/p").count() == 4600


def test_scans(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("10.txt", "9.txt", "x.txt"):
        (tmp_path / "in" / n).write_text(n)
    order = [r.file for r in readers.in_file_order(readers.read_lines(spark, f"file://{tmp_path}/in")).collect()]
    assert order == ["9.txt", "10.txt", "x.txt"]
    (tmp_path / "cut.bin").write_text("aé")
    assert readers.header_probe(spark, f"file://{tmp_path}/cut.bin", {"x": "(a)"}, head=2).first().x == "a"
    (tmp_path / "r.csv").write_text('id|title|title_id|n\nid|"a|b"|id|5\n')
    got = [tuple(r) for r in readers.read_ragged(spark, f"file://{tmp_path}/r.csv", ["id", "title", "title_id", "n"], "title_id", "|").collect()]
    assert got == [("id", "a|b", "id", "5", False)]
    with pytest.raises(FileExistsError):
        writers.freeze(spark, f"file://{tmp_path}", ["in"], f"file://{tmp_path}/in")
