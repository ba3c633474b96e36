"""Substring dedup by seed and extend over winnowed anchors.

A window is ``length`` consecutive words of one document.  Winnowing picks in
each window the word k-gram with the least hash (leftmost on ties), so equal
windows always have equal anchors at equal places.  Consecutive windows that
share an anchor form its territory: the anchor extended both ways as far as it
stays the seed.  Territories are joined on the anchor's hash:

* two territories of equal contents: all of their windows repeat;
* an anchor with several distinct territories: one representative of each is
  extended window by window, and windows that meet again repeat as well.

Overlapping repeated windows unite to maximal repeats.  Nothing is paired within
a group: groups are counted, and the counts are joined back, so a passage that a
third of all documents share costs rows in proportion to its copies.

Cases: a null or blank text has no words and stays empty; shorter texts have no
window; repeated rows repeat each other's windows; empty tables give empty
tables; further columns are ignored; very long texts are taken whole; ties can't arise, since
all places of a repeated window count.  Rows are told apart by doc_id and a key of
doc_id and text; equal rows get the same (full) verdict, gathered once.

Words are compared by hashes: XXH64 of words, 64-bit polynomials over those for anchors and
for windows or territories.  Different windows pass as equal only if both the anchor's and
the window's agree: 2^-64 a pair around the same anchor, 2^-128 otherwise.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import join_counted, mix64, row_key, stash, text_bytes, tidy, unstash

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_INDEX_BITS = np.uint64(24)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashed:
    """Hashes of any span of a sequence of words."""

    def __init__(self, words: list[bytes]):
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))
        n = 1 << max(12, int(len(words)).bit_length())
        up, self.down = _powers(n)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(self.words * up[: len(words)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of its least 40-bit prefix, leftmost on ties."""
    top = values >> _INDEX_BITS
    if len(values) >= 1 << int(_INDEX_BITS):
        return np.lib.stride_tricks.sliding_window_view(top, width).argmin(1) + np.arange(len(values) - width + 1)
    low = (top << _INDEX_BITS) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return (low & np.uint64((1 << int(_INDEX_BITS)) - 1)).astype(np.int64)


def territories(texts: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """Of all texts: row (index of the text), fp, th, start (word), windows."""
    parts = [t.split() for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    keep = np.flatnonzero(sizes >= length)
    out = {k: np.zeros(0, np.int64) for k in ("row", "fp", "th", "start", "windows")}
    if not len(keep):
        return out
    sizes = sizes[keep]
    h = Hashed([w for k in keep for w in parts[k]])
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = int(first[-1])
    grams = h.spans(np.arange(n - gram + 1), np.arange(n - gram + 1) + gram)
    anchor = leftmost_minima(grams, length - gram + 1)  # for each start of a window
    owner = np.repeat(np.arange(len(keep)), sizes)
    valid = owner[: n - length + 1] == owner[length - 1 :]
    starts = np.flatnonzero(valid)
    a, o = anchor[starts], owner[starts]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])])
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(starts)]]))
    start = starts[at]
    span = h.spans(start, start + count + length - 1)
    th = mix64(span + np.uint64(0xC2B2AE3D27D4EB4F) * (count * 4096 + a[at] - start).astype(np.uint64))
    return {"row": keep[o[at]], "fp": grams[a[at]].view(np.int64), "th": th.view(np.int64), "start": start - first[o[at]], "windows": count}


def _batches(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Slices of a batch with at most ``most`` bytes of text, or one row."""
    size = np.cumsum([len(x) for x in batch.column(column).to_pylist()])
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, rk, fp, th, start, windows of each territory."""

    def run(batches):
        for whole in batches:
            for b in _batches(whole, 2):
                t = territories(b.column(2).to_pylist(), length, gram)
                rows = pa.array(t["row"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(t["fp"]), pa.array(t["th"]), pa.array(t["start"].astype(np.int32)), pa.array(t["windows"].astype(np.int32))],
                    names=["doc_id", "rk", "fp", "th", "start", "windows"],
                )

    return docs.mapInArrow(run, "doc_id long, rk long, fp long, th long, start int, windows int")


def windows_of(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """The single windows of representative territories: fp, wh, copies, doc_id, rk, start."""
    wanted = reps.groupBy(F.col("doc_id").alias("_d"), F.col("rk").alias("_r")).agg(F.collect_list(F.struct("fp", "start", "windows", "copies")).alias("t"))
    joined = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("rk") == F.col("_r"))).select("doc_id", "rk", "text", "t")

    def run(batches):
        for whole in batches:
            for b in _batches(whole, 2):
                for doc, rk, text, t in zip(*(c.to_pylist() for c in b.columns)):
                    h = Hashed(text.split())
                    count = np.array([x["windows"] for x in t])
                    begin = np.array([x["start"] for x in t])
                    start = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
                    wh = h.spans(start, start + length).view(np.int64)
                    n = len(start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array([x["fp"] for x in t], np.int64), count)), pa.array(wh), pa.array(np.repeat(np.array([x["copies"] for x in t], np.int32), count)), pa.array([doc] * n, pa.int64()), pa.array(np.full(n, rk, np.int64)), pa.array(start.astype(np.int32))],
                        names=["fp", "wh", "copies", "doc_id", "rk", "start"],
                    )

    return joined.mapInArrow(run, "fp long, wh long, copies int, doc_id long, rk long, start int")


def repeats(docs: DataFrame, length: int = 35, gram: int = 6) -> DataFrame:
    """Spans [start, end) of words that repeated windows cover: doc_id, rk, spans.

    ``docs`` has doc_id, rk and text (bytes).  Spans of a row may overlap.
    """
    t = stash(anchors(docs, length, gram), "territories")
    groups = t.groupBy("fp", "th").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rk", "start", "windows")).alias("rep"))
    several = groups.groupBy("fp").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).filter("total > 1")
    # one row for each distinct territory of an anchor that occurs more than once
    shared = stash(groups.join(several, "fp").select("fp", "th", "n", "kinds", "rep.*"), "shared")
    # whole territories are settled first, so that their table and shuffles are gone before windows are made
    whole = stash(join_counted(t, shared.filter("n > 1").select("fp", "th", "n"), ["fp", "th"], "n").select("doc_id", "rk", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("end")), "whole")
    unstash(t)
    tidy(docs.sparkSession)
    reps = shared.filter("kinds > 1").select("doc_id", "rk", "fp", "start", "windows", F.least(F.col("n"), F.lit(2)).cast("int").alias("copies"))
    single = stash(windows_of(docs, reps, length), "windows")
    tidy(docs.sparkSession)
    met = stash(single.groupBy("fp", "wh").agg(F.sum("copies").alias("c"), F.count("*").alias("n")).filter("c > 1").select("fp", "wh", "n"), "windows-met")
    part = join_counted(single, met, ["fp", "wh"], "n").filter("copies = 1").select("doc_id", "rk", "start", (F.col("start") + length).alias("end"))
    spans = whole.union(part).groupBy("doc_id", "rk").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    out = stash(spans, "spans")
    unstash(shared, single, whole, met)
    tidy(docs.sparkSession)
    return out


def cut(words: list[bytes], spans) -> list[bytes]:
    """The words that no span covers."""
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["end"] for s in spans], -1)
    free = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(free)]


def remove_repeats(docs: DataFrame, length: int = 35, gram: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by single spaces) of each row."""
    slim = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("rk"), text_bytes().alias("text"))
    found = repeats(slim, length, gram).select(F.col("doc_id").alias("_d"), F.col("rk").alias("_r"), "spans")
    joined = slim.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("rk") == F.col("_r")), "left").select("doc_id", "text", "spans")

    def run(batches):
        for whole in batches:
            for b in _batches(whole, 1):
                n, gone, kept = [], [], []
                for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    words = text.split()
                    left = cut(words, spans)
                    n.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """The kept words as a lower-case SHA-256."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def sha256_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
