"""SimHash near-dedup by a segment-popcount embedding and a grid range join.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of the
segments (0, 1 or 2 each) embed it in a grid where the Manhattan distance never
exceeds the Hamming distance.  The segments are dealt to g groups.  Fingerprints within
three bits are within three steps on the grid, so at most three groups differ
and g - 3 agree in all their counts: a cell of the range join is a choice of g - 3 groups with their
counts, and near fingerprints meet in one at least.  Of the cells in which a pair
meets only the first one (by groups) reports it.  Pairs that meet are filtered by
the Manhattan bound of all coordinates, then by the exact number of bits.  g
grows with the number of fingerprints, so that a random one meets a few others,
whatever their number; every g finds the same pairs.

Only distinct fingerprints are joined; exact copies meet as one fingerprint and
are never expanded into pairs.  Links are reduced to components by star
contraction over written tables (see ``shared.components``); a component is known
by its least fingerprint, its id is the least doc_id of its rows.

Cases: a null or blank text has fingerprint zero and links like any other; one
or two words form a single shingle; very long texts are taken whole; repeated rows share a fingerprint and so a
component; rows of one doc_id with different texts count by their texts, each in its own
component, and do not tie those together; rows without a doc_id link and bridge like any other, and a component
without any doc_id has none as its id; ties between rows can't arise, since ids are least values;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import by_merge, components, join_counted, mix64, stash, text_bytes, unstash

_EVEN = 0x5555555555555555
#: Numbers of groups that the segments can be dealt to.
_GROUPS = (6, 7, 8, 10, 12, 16)


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of a text's word shingles."""
    words = text.lower().split()  # of bytes: A-Z alone change, ASCII blanks alone split
    if not words:
        return 0
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if n > 0 else iter([b" ".join(words)])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, max(n, 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, fp long")


def group_masks(groups: int) -> list[int]:
    """The two-bit count fields of each group; sizes differ by one segment at most."""
    ends = [32 * k // groups for k in range(groups + 1)]
    return [(1 << 2 * e) - (1 << 2 * b) for b, e in zip(ends, ends[1:])]


def groups_for(count: int) -> int:
    """The least number of groups at which a random fingerprint among ``count`` meets about four others at most."""
    alike = 3 / 8  # the chance that two random segments have equal counts
    return next((g for g in _GROUPS if count * comb(g, 3) * alike ** (32 * (g - 3) / g) <= 4), _GROUPS[-1])


def grid(distinct: DataFrame, groups: int) -> DataFrame:
    """(cell, fp, rep) rows of distinct fingerprints (fp, rep); a cell's lowest ten bits number the choice of groups."""
    masks = group_masks(groups)
    choices = np.array([sum(masks[g] for g in c) for c in combinations(range(groups), groups - 3)], np.uint64)

    def run(batches):
        even, one, low = np.uint64(_EVEN), np.uint64(1), np.uint64(1023)
        number = np.arange(len(choices), dtype=np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                b = whole.slice(at, 8192)
                fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = fps.view(np.uint64)
                counts = (x & even) + ((x >> one) & even)  # two bits a segment
                cells = (mix64((counts[:, None] & choices) + number) & ~low) | number
                rows = np.repeat(np.arange(len(fps)), len(choices))
                yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1).view(np.int64)), pa.array(fps[rows]), b.column(1).take(pa.array(rows))], names=["cell", "fp", "rep"])

    return distinct.select("fp", "rep").mapInArrow(run, "cell long, fp long, rep long")


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs (a, b) of representatives whose fingerprints (fp, rep: one row each) differ in at most ``bits`` (3 or fewer) bits."""
    if bits > 3:
        raise ValueError("the grid join finds pairs at 3 or fewer bits")
    total = distinct.count()
    groups = groups_for(total)
    cells = grid(distinct, groups)
    left = cells.selectExpr("cell", "fp AS f", "rep AS a")
    right = cells.selectExpr("cell", "fp AS g", "rep AS b")
    # bit counts of the segments as two-bit fields, by half adders (sums could overflow a long)
    even = lambda c: f"({c} & {_EVEN})"
    odd = lambda c: f"(shiftrightunsigned({c}, 1) & {_EVEN})"
    count = lambda c: f"(({even(c)} ^ {odd(c)}) | shiftleft({even(c)} & {odd(c)}, 1))"
    # |x - y| over two-bit fields: a field of the xor is 0 (equal), 1 or 3 (one step), 2 (two steps)
    xor = f"({count('f')} ^ {count('g')})"
    steps = f"(bit_count({xor} & {_EVEN}) + 2 * bit_count(shiftrightunsigned({xor}, 1) & ~{xor} & {_EVEN}))"
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    equal = " + ".join(f"IF(({xor} & {signed(m)}L) = 0, {1 << k}, 0)" for k, m in enumerate(group_masks(groups)))
    chosen = [sum(1 << k for k in c) for c in combinations(range(groups), groups - 3)]
    pick = lambda xs: f"element_at(array({', '.join(map(str, xs))}), CAST(cell & 1023 AS INT) + 1)"
    upto = [(1 << c.bit_length()) - 1 for c in chosen]
    first = f"(({equal}) & {pick(upto)}) = {pick(chosen)}"
    met = left.join(by_merge(right, total * comb(groups, 3)), "cell").filter(f"f < g AND {steps} <= {bits} AND bit_count(f ^ g) <= {bits} AND {first}")
    return met.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")


def near_groups(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    fps = stash(fingerprints(docs, width), "fp")
    distinct = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    comps = components(links(distinct.select("fp", F.col("fp").alias("rep")), bits))
    kinds = distinct.count()
    named = distinct.join(by_merge(comps, kinds), distinct.fp == comps.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    named = stash(named, "named")
    ids = stash(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("kinds")), "ids")
    roots = stash(join_counted(named, by_merge(ids, kinds), ["root"], "kinds").select("fp", "n", "component_id"), "roots")
    unstash(distinct, named, ids)
    return join_counted(fps, by_merge(roots, kinds), ["fp"], "n").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; one of repeated rows.

    Rows without a doc_id can't be named by a group and are kept.
    """
    names = docs.columns
    keep = near_groups(docs, bits, width).filter("doc_id = component_id").select(F.col("doc_id").alias("_lx_keep")).distinct()
    alone = docs.filter("doc_id IS NULL")
    kept = docs.join(keep, F.col("doc_id") == F.col("_lx_keep"), "inner")
    order = W.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return kept.withColumn("_lx_n", F.row_number().over(order)).filter("_lx_n = 1").select(names).unionByName(alone)
