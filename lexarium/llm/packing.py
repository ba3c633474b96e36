"""Best-two-fit packing of tokenised documents into sequences.

Documents longer than a sequence are cut into full pieces, the first piece being
the shorter one.  Pieces are dealt by hash to shards of about ``shard_rows``
pieces; each shard packs its pieces on its own (a shard wastes at most one
partly filled sequence more than the whole would).  A bin is filled greedily
with the longest piece that fits; when nothing fits, its smallest piece is
replaced by the two unpacked pieces that fill the expanded gap most tightly, if
they fill more than the piece did.

Tokens never move: only doc_id, piece, start, length and a checksum are dealt.
The number of a row in its task is part of the hash, so that repeated rows
spread over the shards; written pieces keep it when a task runs again.

Cases: a special token that a text spells out becomes its own id, as ``tokenizers`` has
it; a null or blank text is the closing id alone; repeated rows are packed
each on their own; an empty table gives an empty one; further columns are
ignored; a null doc_id is packed like any other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import stash
from .tokens import Tokens, source_of


def best_two_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin (from 0) of each length; lengths are 1 to ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    sizes, begin = np.unique(sorted_lengths, return_index=True)
    stacks = {int(s): list(order[b:e][::-1]) for s, b, e in zip(sizes, begin, [*begin[1:], len(order)])}
    count = np.zeros(capacity + 1, np.int64)
    count[sizes] = [len(stacks[int(s)]) for s in sizes]
    # most[x]: the greatest unpacked length up to x, 0 if none
    most = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0))
    top = most.tolist()  # read as a list, scanned as an array

    def take(s: int) -> int:
        count[s] -= 1
        if count[s] == 0:
            end = s
            below = top[s - 1] if s else 0
            while end <= capacity and top[end] == s:
                end += 1
            most[s:end] = below
            top[s:end] = [below] * (end - s)
        return stacks[s].pop()

    def give(s: int, item: int) -> None:
        stacks[s].append(item)
        count[s] += 1
        if count[s] == 1:
            end, below = s, top[s]
            while end <= capacity and top[end] == below:
                end += 1
            most[s:end] = s
            top[s:end] = [s] * (end - s)

    out = np.zeros(len(lengths), np.int64)
    b = 0
    while top[capacity]:
        gap, bin_items = capacity, []
        while gap and (s := top[gap]):
            bin_items.append((s, take(s)))
            gap -= s
        if gap and len(bin_items) > 1 and top[capacity]:
            small, item = bin_items[-1]  # filled in falling order: the last is the smallest
            room = gap + small
            first = np.flatnonzero(count[: room + 1] > 0)
            if len(first):
                second = most[room - first]
                alone = (second == first) & (count[first] < 2)
                second[alone] = most[np.maximum(first[alone] - 1, 0)]
                both = np.where(second > 0, first + second, 0)
                k = int(both.argmax())
                if both[k] > small:
                    bin_items.pop()
                    one, two = int(first[k]), int(second[k])
                    bin_items += [(one, take(one)), (two, take(two))]
                    give(small, item)
        for _, item in bin_items:
            out[item] = b
        b += 1
    return out


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, nth (the row's number in its task) and, if wanted, ids of each row's whole text and its closing id 0."""
    source = docs.sparkSession.sparkContext.broadcast(source_of(path))  # a vocabulary file: a few MB, whatever the corpus

    def run(batches):
        enc, row = Tokens.of(source.value), 0
        for b in batches:
            doc, piece, start, length, crc, nth, parts = [], [], [], [], [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(enc.marked_ids(text or ""), np.uint32(0)).astype("<u4")
                n = len(ids)
                at = 0
                row += 1
                for k in range(-(-n // capacity)):
                    end = n - capacity * (-(-n // capacity) - 1 - k)
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(ids[at:end].tobytes()))
                    nth.append(row)
                    if with_ids:
                        parts.append(ids[at:end].astype(np.int32))
                    at = end
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
            if with_ids:
                cols.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(parts: DataFrame, capacity: int = 2048, shard_rows: int = 16384) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, nth)."""
    shards = max(1, -(-parts.count() // shard_rows))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(key, p):
        p = p.drop(columns="shard").sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins = best_two_fit(p["length"].to_numpy(np.int64), capacity)
        p["sequence_id"] = bins + (int(key[0]) << 32)
        p["offset"] = p.groupby("sequence_id")["length"].cumsum() - p["length"]
        return p

    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth"), F.lit(shards)).alias("shard")
    return parts.select("doc_id", "piece", "start", "length", "ids_crc32", shard).groupBy("shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    return pack(stash(pieces(docs, capacity, path), "pieces"), capacity)
