"""Exact top-k inner products by dual-tree cover-tree search.

Vectors are quantised to integers, floor(256 x).  Queries (a stated set) are dealt by
hash to blocks of about ``query_block`` rows; tasks index each block in a cover tree
and find a first kth score of its queries among a bounded sample of the rows.
The trees pass through the driver in waves of bounded size and go to
all tasks, and each wave is one scan of the rows.  Every task
indexes its own rows, batch by batch, in cover trees and walks both trees
together: with centres c and covering radii r of a query node and a data node,
no pair below them scores more than

    cq.cd + |cq| rd + |cd| rq + rq rd,

so the pair is dropped when that is below the worst kth score of the query
node's queries.  Pairs of leaves are scored as integers.  Worst scores carry over from batch
to batch and begin with those of the sample.  The k best of each task and query are merged by one window per query.

Equal vectors of a batch share a leaf entry that keeps its k + 1 smallest ids,
which is all that a top k (without the query itself) can use; nothing is lost.

Cases: vectors that are null or hold null or non-finite components take no part;
those of each length are searched by themselves; query rows that are equal in id and
vector are one query, those of one id with different vectors have ranks of their own; a
query's candidates are all rows but those of its id, repeated ids competing as
rows of their own; ties go to the smaller id; fewer than k candidates give
fewer rows; an empty table gives an empty one; further columns are ignored.
Scores are exact while they fit 63 bits.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import stash, unstash

#: Rows of each length that give first bounds, and bytes of query trees sent at a time.
SAMPLE, WAVE = 1024, 64 << 20


class CoverTree:
    """Cover tree over rows of ``x``: nodes with centre, covering radius and children or rows.

    The centres of a node's children are chosen farthest first, the node's own centre
    being the first.  They stop once they cover all rows within half the node's
    radius, or at as many as the rows fill leaves (eight at least).  With
    s the greatest distance then left, the children cover their rows within s and their
    centres are at least s apart.
    """

    def __init__(self, x: np.ndarray, leaf: int = 64):
        self.x = x.astype(np.float64)
        self.leaf = leaf
        self.centre, self.radius, self.children, self.rows = [], [], [], []
        self.root = self._grow(np.arange(len(x)), 0) if len(x) else -1
        self.norm = [float(np.linalg.norm(c)) for c in self.centre]

    def _grow(self, rows: np.ndarray, at: int) -> int:
        # rows[at] is the centre
        todo = [(rows, int(rows[at]), -1)]
        first = len(self.centre)
        while todo:
            rows, centre, parent = todo.pop()
            d = np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(1))
            node = len(self.centre)
            self.centre.append(self.x[centre])
            self.radius.append(float(d.max()) * (1 + 1e-9))
            self.children.append([])
            self.rows.append(None)
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= self.leaf or d.max() == 0:
                self.rows[node] = rows
                continue
            scale = d.max() / 2
            near = d  # distance to the nearest centre so far, the node's own first
            owner = np.full(len(rows), centre)
            fan = max(8, len(rows) // self.leaf)
            kinds = 1
            while near.max() > scale and kinds < fan:
                far = int(near.argmax())
                e = np.sqrt(((self.x[rows] - self.x[rows[far]]) ** 2).sum(1))
                closer = e < near
                owner[closer] = rows[far]
                near = np.minimum(near, e)
                kinds += 1
            for c in np.unique(owner):
                todo.append((rows[owner == c], int(c), node))
        return first


class Best:
    """The k best (score, id) of each query, with the worst kept score."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.ident = np.full((n, k), np.iinfo(np.int64).max)
        self.k = k
        # the kth score of all rows is known to be no less
        self.floor = np.full(n, np.iinfo(np.int64).min) if floor is None else floor

    def worst(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[q, -1], self.floor[q])

    def add(self, q: np.ndarray, score: np.ndarray, ident: np.ndarray, valid: np.ndarray) -> None:
        """Offer each query the scores of candidates: score and valid (queries x candidates), ident (candidates)."""
        score = np.where(valid, score, np.iinfo(np.int64).min)
        hit = (score >= self.worst(q)[:, None]).any(1)
        for row, s in zip(q[hit], score[hit]):
            at = np.flatnonzero((s >= max(self.score[row, -1], self.floor[row])) & (s > np.iinfo(np.int64).min))
            both_s = np.concatenate([self.score[row], s[at]])
            both_i = np.concatenate([self.ident[row], ident[at]])
            order = np.lexsort((both_i, -(both_s + 1)))[: self.k]  # plus one: the least long has no negative
            self.score[row], self.ident[row] = both_s[order], both_i[order]


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as exact integers: over doubles where those are exact, else over 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2.0**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class QueryBlock:
    """Queries, their cover tree and the first bounds of their kth scores."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, x: np.ndarray):
        self.ids, self.keys, self.x, self.tree = ids, keys, x, CoverTree(x, 128)
        self.floor = np.full(len(ids), np.iinfo(np.int64).min)

    def prime(self, k: int, ids: np.ndarray, x: np.ndarray) -> None:
        """Take the kth scores among some rows as first bounds."""
        best = Best(len(self.ids), k)
        search_batch(self, best, ids, x)
        self.floor = best.score[:, -1].copy()


class RowTree:
    """A batch of rows, each distinct vector once, and their cover tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        unique, owner = np.unique(self.x, axis=0, return_inverse=True)
        owner = owner.reshape(-1)
        by = np.argsort(owner, kind="stable")  # ids rise within an owner
        begin = np.searchsorted(owner[by], np.arange(len(unique) + 1))
        rank = np.arange(len(by)) - begin[owner[by]]
        self.by = by[rank <= k]  # the k + 1 smallest ids of each vector
        self.begin = np.searchsorted(owner[self.by], np.arange(len(unique) + 1))
        self.tree = CoverTree(unique, 512)

    def rows(self, node: int) -> np.ndarray:
        return np.concatenate([self.by[self.begin[u] : self.begin[u + 1]] for u in self.tree.rows[node]])


def search_batch(block: QueryBlock, best: Best, ids: np.ndarray, x: np.ndarray) -> None:
    """Offer one batch of rows to the queries of a block."""
    walk(block, best, RowTree(ids, x, best.k))


def walk(block: QueryBlock, best: Best, batch: RowTree) -> None:
    """Walk the trees of a query block and of one batch of rows together."""
    tree, q = batch.tree, block.tree
    if tree.root < 0 or q.root < 0:
        return
    stack = [(q.root, tree.root)]
    while stack:
        a, b = stack.pop()
        cross = float(q.centre[a] @ tree.centre[b])
        bound = cross + q.norm[a] * tree.radius[b] + tree.norm[b] * q.radius[a] + q.radius[a] * tree.radius[b]
        below = rows_below(q, a)
        if bound + 1e-6 * abs(bound) + 1 < float(best.worst(below).min()):
            continue
        if q.rows[a] is not None and tree.rows[b] is not None:
            rows = batch.rows(b)
            score = integer_products(block.x[below], batch.x[rows])
            best.add(below, score, batch.ids[rows], block.ids[below][:, None] != batch.ids[rows][None, :])
        elif tree.rows[b] is not None or (q.rows[a] is None and q.radius[a] > tree.radius[b]):
            stack += [(c, b) for c in q.children[a]]
        else:  # the child nearest in angle is walked first
            order = sorted(tree.children[b], key=lambda c: float(q.centre[a] @ tree.centre[c]))
            stack += [(a, c) for c in order]


def rows_below(tree: CoverTree, node: int) -> np.ndarray:
    cache = tree.__dict__.setdefault("below", {})
    if node not in cache:
        cache[node] = tree.rows[node] if tree.rows[node] is not None else np.concatenate([rows_below(tree, c) for c in tree.children[node]])
    return cache[node]


def quantised(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and v (array of long) of the rows whose vector is whole and finite."""
    v = F.transform(column, lambda x: x.cast("double"))
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = vectors.filter(F.col(ident).isNotNull() & F.col(column).isNotNull()).filter(~F.coalesce(bad, F.lit(True)) & (F.size(column) > 0))
    return whole.select(F.col(ident).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * 256)).alias("v"))


def query_trees(vectors: DataFrame, queries: DataFrame, dim: int, count: int, k: int, query_block: int) -> DataFrame:
    """Pickled blocks of queries of length ``dim``, built and given first bounds in tasks: block, bytes."""
    spark = vectors.sparkSession
    drawn = vectors.filter(F.size("v") == dim).select("vec_id", "v").orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).toPandas()  # at most SAMPLE rows
    sample = spark.sparkContext.broadcast((drawn["vec_id"].to_numpy(np.int64), np.array(drawn["v"].tolist(), np.int64).reshape(len(drawn), dim)))
    blocks = max(1, -(-count // query_block))
    own = queries.filter(F.size("v") == dim).withColumn("qkey", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("vec_id", "qkey"), F.lit(blocks)).cast("int"))

    def build(p):
        p = p.sort_values(["vec_id", "qkey"])
        block = QueryBlock(p["vec_id"].to_numpy(np.int64), p["qkey"].to_numpy(np.int64), np.stack(p["v"].to_numpy()).astype(np.int64))
        block.prime(k, *sample.value)
        return pd.DataFrame({"block": [int(p["block"].iloc[0])], "bytes": [pickle.dumps(block)]})

    return stash(own.select("block", "vec_id", "qkey", "v").groupBy("block").applyInPandas(build, "block int, bytes binary"), "query-trees")


def scan_wave(rows: DataFrame, blocks: list[bytes], k: int) -> DataFrame:
    """The candidates of some query blocks among ``rows``, in one scan: query_id, qkey, vec_id, score."""
    sent = rows.sparkSession.sparkContext.broadcast(blocks)  # at most WAVE bytes or one block

    def run(batches):
        blocks = [pickle.loads(b) for b in sent.value]
        best = [Best(len(b.ids), k, b.floor) for b in blocks]
        for p in batches:
            if len(p):
                ids, x = p["vec_id"].to_numpy(np.int64), np.stack(p["v"].to_numpy()).astype(np.int64)
                tree = RowTree(ids, x, k)
                for b, found in zip(blocks, best):
                    walk(b, found, tree)
        for b, found in zip(blocks, best):
            row, col = np.nonzero(found.ident != np.iinfo(np.int64).max)
            yield pd.DataFrame({"query_id": b.ids[row], "qkey": b.keys[row], "vec_id": found.ident[row, col], "score": found.score[row, col]})

    out = stash(rows.mapInPandas(run, "query_id long, qkey long, vec_id long, score long"), "top-candidates")
    sent.destroy()
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of ``vectors`` for each of ``queries`` (both vec_id, v).

    Vectors of each length are searched by themselves.
    """
    asked = stash(queries.select("vec_id", "v").distinct(), "queries")
    found = []
    # one row for each length of vectors
    for dim, count in sorted((r.dim, r.n) for r in asked.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()):
        trees = query_trees(vectors, asked, dim, count, k, query_block)
        rows = vectors.filter(F.size("v") == dim).select("vec_id", "v")
        wave, size = [], 0
        for r in trees.orderBy("block").toLocalIterator():
            if wave and size + len(r.bytes) > WAVE:
                found.append(scan_wave(rows, wave, k))
                wave, size = [], 0
            wave.append(bytes(r.bytes))
            size += len(r.bytes)
        found.append(scan_wave(rows, wave, k))
        unstash(trees)
    out = None
    for part in found:
        out = part if out is None else out.union(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, qkey long, vec_id long, score long")
    unstash(asked)
    order = W.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the registered query, by brute force.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
