"""Quality rules: an isolation forest on rule statistics.

Rule statistics are taken of every whole text.  Documents that pass the base
rules are judged by isolation forests: path lengths over random splits of a
statistic tell how easily a document is set apart.  One forest splits on all
statistics together and one on each statistic alone; a document is anomalous if
a forest's score exceeds that forest's threshold.  The thresholds come from all
labelled rows, forest by forest: of the documents that no forest rejects yet,
the score is sought from which on the most low-quality ones are caught while at
least ``precision`` of those rejected are of low quality and at most
``max_clean_loss`` of the clean ones are lost.  A forest that has no such score
judges nothing.

Cases: a null or blank text has zero words and fails the base rules; without
labels or without a passing document only the base rules judge; an empty table
gives an empty table; repeated rows are judged alike.  A label that joins to
several rows counts with each.  Very long texts are counted whole; a score that ties with a
threshold rejects; further columns are ignored by ``verdicts`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import sample_by_hash, stash, text_bytes, unstash

#: Fixed by the contract of the statistics.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = ("log words", "chars a word", "symbols a word", "copied lines a word", "repeated words a word")


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) > 1 << 20:  # three ids must fit 63 bits
        _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        key = pair[:-1] * np.int64(len(seen)) + ids[2:]
    else:
        key = (ids[:-2] * len(seen) + ids[1:-1]) * len(seen) + ids[2:]
    order = np.argsort(key, kind="stable")
    run = key[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def rule_stats(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    chars = len(text.translate(None, BLANKS).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def stats_frame(docs: DataFrame) -> DataFrame:
    """doc_id and the five statistics of each row's whole text."""

    def run(batches):
        kinds = pa.int64()
        for b in batches:
            rows = [rule_stats(x) for x in b.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], kinds) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *(x.split()[0] for x in STATS.split(", "))])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, f"doc_id long, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(s: np.ndarray) -> np.ndarray:
    """Rows of FEATURES from rows of statistics."""
    s = s.astype(float)
    n = np.maximum(s[:, 0], 1)
    return np.column_stack([np.log(n), s[:, 1] / n, s[:, 2] / n, s[:, 3] / n, s[:, 4] / n])


def _average_path(n):
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1 and its full path length as value."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray

    def paths(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            live = live[self.feature[at[live]] >= 0]
            node = at[live]
            at[live] = self.left[node] + (x[live, self.feature[node]] >= self.value[node])
        return self.value[at]


def grow(x: np.ndarray, rng: np.random.Generator, columns: list[int], height: int) -> Tree:
    feature, value, left = [-1], [0.0], [0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        spread = [c for c in columns if depth < height and len(rows) > 1 and part[:, c].min() < part[:, c].max()]
        if not spread:
            value[node] = depth + float(_average_path(len(rows)))
            continue
        c = spread[rng.integers(len(spread))]
        cut = rng.uniform(part[:, c].min(), part[:, c].max())
        below = part[:, c] < cut
        if not below.any():
            below = part[:, c] <= cut
            cut = np.nextafter(cut, np.inf)
        feature[node], value[node], left[node] = c, cut, len(feature)
        feature += [-1, -1]
        value += [0.0, 0.0]
        left += [0, 0]
        todo += [(left[node], rows[below], depth + 1), (left[node] + 1, rows[~below], depth + 1)]
    return Tree(np.array(feature), np.array(value), np.array(left))


@dataclass
class Forests:
    """One group of trees for all statistics and one for each; thresholds by group."""

    groups: list[list[Tree]]
    scale: float
    thresholds: list[float]

    def scores(self, s: np.ndarray) -> np.ndarray:
        """Anomaly scores (0 to 1), a column for each group."""
        x = features(s)
        return np.column_stack([2.0 ** (-np.mean([t.paths(x) for t in g], axis=0) / self.scale) for g in self.groups])

    def keeps(self, s: np.ndarray) -> np.ndarray:
        if not self.groups:
            return np.ones(len(s), bool)
        return ~(self.scores(s) >= np.array(self.thresholds)).any(axis=1)


def fit_forests(sample: np.ndarray, trees: int = 40, points: int = 256, seed: int = 11) -> Forests:
    """Grow the forests on rows of statistics; thresholds are still infinite."""
    if len(sample) < 8:
        return Forests([], 1.0, [])
    x, rng = features(sample), np.random.default_rng(seed)
    points = min(points, len(x))
    height = int(np.ceil(np.log2(points))) + 4
    every = list(range(x.shape[1]))
    groups = [[grow(x[rng.choice(len(x), points, replace=False)], rng, columns, height) for _ in range(trees)] for columns in [every, *([c] for c in every)]]
    return Forests(groups, float(_average_path(points)), [np.inf] * len(groups))


BINS = 2000


def calibrate(forests: Forests, labelled: DataFrame, precision: float, max_clean_loss: float) -> Forests:
    """Set thresholds from a histogram of the scores of all labelled rows (statistics, quality)."""
    if not forests.groups:
        return forests
    cols = [x.split()[0] for x in STATS.split(", ")]
    rows = stash(labelled.select(*cols, F.col("quality").cast("int").alias("quality")), "labelled")
    n_groups = len(forests.groups)
    while True:  # one pass for each forest that judges, and one more

        def run(batches):
            for p in batches:
                stats = p.iloc[:, :5].to_numpy()
                score = forests.scores(stats)
                left = ~(score >= np.array(forests.thresholds)).any(axis=1)
                bins = np.minimum((score[left] * BINS).astype(int), BINS - 1)
                yield pd.concat([pd.DataFrame({"g": g, "bin": bins[:, g], "quality": p["quality"].to_numpy()[left]}) for g in range(n_groups)])

        counts = rows.mapInPandas(run, "g int, bin int, quality int").groupBy("g", "bin", "quality").count()
        table = np.zeros((n_groups, BINS, 2))
        for g, b, q, n in counts.collect():  # at most groups x BINS x 2 rows
            table[g, b, int(q == 1)] += n
        above = table[:, ::-1].cumsum(axis=1)[:, ::-1]
        bad, good = above[..., 0], above[..., 1]
        ok = (bad >= max(3, 0.02 * bad[0, 0])) & (bad >= precision * (bad + good)) & (good <= max_clean_loss * np.maximum(good[:, :1], 1)) & np.isinf(forests.thresholds)[:, None]
        if not ok.any():
            unstash(rows)
            return forests
        caught = np.where(ok, bad - good / precision, -np.inf)
        g = int(caught.max(axis=1).argmax())
        low = int(np.flatnonzero(caught[g] == caught[g].max())[-1])
        # halfway into the empty bins below, so that scores just beneath the lowest bad one still count
        down = low
        while down > 0 and table[g, down - 1].sum() == 0:
            down -= 1
        forests.thresholds[g] = (low + down) / 2 / BINS


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = 8192, precision: float = 0.95, max_clean_loss: float = 0.001) -> Forests:
    """Forests grown on about ``sample_rows`` documents (twice as many at most) that pass the base rules, calibrated on all labelled ones."""
    passing = stats.filter(~base_failed())
    cols = [x.split()[0] for x in STATS.split(", ")]
    sample = sample_by_hash(passing, F.xxhash64("doc_id", *cols), passing.count(), sample_rows).select(*cols).toPandas()
    sample = sample.sort_values(cols).to_numpy()
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "quality")
    return calibrate(fit_forests(sample), passing.join(marks, "doc_id"), precision, max_clean_loss)


def judge(stats: DataFrame, forests: Forests) -> DataFrame:
    """The statistics with base_failed and kept."""

    @F.pandas_udf("boolean")
    def verdict(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(forests.keeps(np.column_stack([a, b, c, d, e])))

    cols = [x.split()[0] for x in STATS.split(", ")]
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(*cols))


def verdicts(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, statistics, base_failed and kept of each row of ``docs``."""
    stats = stash(stats_frame(docs), "stats")
    return judge(stats, fit(stats, labels, **params))


def keep_clean(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; rows and their statistics are written together, and nothing is shuffled."""

    @F.pandas_udf(STATS)
    def counted(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule_stats(x) for x in text], columns=[x.split()[0] for x in STATS.split(", ")], dtype="int64")

    names = docs.columns
    rows = stash(docs.select(*names, counted(text_bytes()).alias("_lx_stats")), "counted")
    forests = fit(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_lx_stats.*"), labels, **params)

    @F.pandas_udf("boolean")
    def verdict(s: pd.DataFrame) -> pd.Series:
        return pd.Series(forests.keeps(s.to_numpy(np.int64)))

    base = (F.col("_lx_stats.n_words") < 50) | (100 * F.col("_lx_stats.n_repeat_words") > 50 * F.col("_lx_stats.n_words"))
    return rows.filter(~base & verdict("_lx_stats")).select(names)
