"""The cascade from units to records, on small cases."""

import pytest

from lexarium.operators import identity

U = "unit_id long, source long, ord long, div_type string, chars long, frames boolean, tokens array<string>, numbers array<long>"
R = "record_id long, source long, work_id long, ord long, collection boolean, tokens array<string>, numbers array<long>"
O = "unit_id long, record_id long, identity string, inclusion string"


def unit(i, tokens, source=1, numbers=(), div="play", chars=9, frames=False):
    return (i, source, i, div, chars, frames, tokens, list(numbers))


def record(i, tokens, source=1, work=None, numbers=(), collection=False):
    return (i, source, work or i, i, collection, tokens, list(numbers))


@pytest.fixture
def run(spark):
    def go(units, records, overrides=()):
        f = lambda rows, schema: spark.createDataFrame(list(rows), schema)
        return {r.unit_id: (r.record_id, r.method, r.identity) for r in identity.identify(f(units, U), f(records, R), f(overrides, O), ("poem",)).collect()}

    return go


def test_titles_ties_and_order(run):
    got = run([unit(1, ["hamlet"]), unit(2, ["othello"]), unit(3, ["zzzz"])], [record(11, ["othello"]), record(12, ["hamlet"]), record(13, ["lear"])])
    assert got == {1: (12, "title", "confirmed"), 2: (11, "title", "confirmed"), 3: (13, "order", "pending")}
    got = run([unit(1, ["hamlet"])], [record(11, ["hamlet"]), record(12, ["hamlet"])])
    assert got == {1: (None, "tie", "pending")}


def test_single_work_aliases_and_apart(run):
    records = [record(11, ["x"], work=5), record(12, ["y"], work=5), record(13, ["z"], collection=True)]
    got = run([unit(1, ["q"]), unit(2, [], div="poem"), unit(3, [], div="poem", frames=True), unit(4, [], chars=0), unit(5, [], source=9)], records)
    assert got == {1: (11, "one to one", "confirmed"), 2: (None, "division apart", "confirmed"), 3: (None, "frames in a division apart", "pending"), 4: (None, "no text", "pending"), 5: (None, "no record", "pending")}
    got = run([unit(1, ["q"], numbers=[1]), unit(2, ["r"])], records)
    assert got == {1: (11, "one work", "confirmed"), 2: (11, "one work", "pending")}


def test_overrides_take_their_record(run):
    got = run([unit(1, ["a"]), unit(2, ["b"])], [record(11, ["a"]), record(12, ["b"])], [(1, 12, "confirmed", "proposed")])
    assert got == {1: (12, "manual", "confirmed"), 2: (11, "one to one", "confirmed")}


def test_empty(run):
    assert run([], [record(1, ["a"])]) == {} and run([unit(1, ["a"])], []) == {1: (None, "no record", "pending")}
