"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicon and pattern rules: a whole word, a word beginning or a word
ending, present or making up at least one word in a hundred, that speaks for either
class in a bounded sample of labelled documents.  A voter either fires on a document or stays silent.  The generative
model has for each voter the chance to fire in either class, and for voters that are
correlated given the class a forest of dependencies: each voter's chance then also depends on
one other voter, its parent, chosen by the greatest information given the class.
Chances, correlations, forest and the classes' shares are estimated from the votes by
expectation-maximisation, in which a label weighs ``strength`` (3) times as much as the posterior of its
document (by the votes alone, texts of languages with few voters drift to the clean class);
labels also say which class is the toxic one, and how well the posteriors agree with them.  A logistic
classifier over hashed word and affix features is trained on the posteriors;
it alone scores texts.

Cases: null, blank or letterless texts get the score of no evidence (the
intercept's); without a toxic or a clean labelled row every score is the least one, 4e-18; repeated
rows score alike and are learned once; very long texts are scored whole; a score of just 0.3 is
predicted toxic; an empty table gives an empty one; further columns are
ignored.  Bounds: ``per_class`` distinct toxic texts and twice as many clean ones, of texts over
``most_chars`` characters a passage from a hashed place; ``max_candidates``
patterns looked at, ``max_voters`` voters for the toxic class and ``max_clean`` for the other, ``max_features`` features, these without patterns that fire on nearly the
same sampled documents as a stronger one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import stash, unstash

_WORDS = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def marks_of(word: str) -> list[str]:
    """What a word matches: itself, its beginnings and its endings."""
    n = len(word)
    return [f"={word}", *(f"^{word[:k]}" for k in range(3, min(10, n + 1))), *(f"{word[-k:]}$" for k in range(4, min(7, n + 1)))]


def is_dense(count: int, words: int) -> bool:
    """Whether a mark makes up at least one word in a hundred."""
    return 100 * count >= words


def patterns(text: str | None) -> set[str]:
    """The marks that a text's words match, and those that are dense in it (with a plus sign)."""
    words = _WORDS.findall(text.lower()) if text else []
    count: Counter = Counter()
    for w, c in Counter(words).items():
        for m in marks_of(w):
            count[m] += c
    return count.keys() | {m + "+" for m, c in count.items() if is_dense(c, len(words))}


@dataclass
class LabelModel:
    """Chances of voters to fire in the clean and the toxic class, and how they depend on one another given the class.

    The joint chance of a class and all votes is the class's share times, voter by
    voter, the chance of the vote given the class and the vote of the voter's parent.
    """

    fire: np.ndarray = None  # voters x 2: given the class
    correlation: np.ndarray = None  # voters x voters: the greater one in size of both classes'
    parent: np.ndarray = None  # a voter each, -1 for none
    given: np.ndarray = None  # voters x class x parent's vote
    groups: list = None  # arrays of voters that depend on one another
    prior: float = 0.5
    tie: float = 0.2  # least correlation of a dependency
    agreement: float = 0.0  # share of labels that posteriors agree with

    def joint(self, votes: np.ndarray) -> np.ndarray:
        """Logarithms of the joint chances of votes (rows) with either class."""
        up = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(int)
        out = np.log([1 - self.prior, self.prior]) + np.zeros((len(votes), 2))
        for y in range(2):
            q = np.where(up > 0, self.given[:, y, 1], self.given[:, y, 0])
            out[:, y] += np.log(np.where(votes > 0, q, 1 - q)).sum(1)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = self.joint(votes)
        return 1 / (1 + np.exp(-np.clip(z[:, 1] - z[:, 0], -40, 40)))

    def fit(self, votes: np.ndarray, seeds: np.ndarray, rounds: int = 30, strength: float = 3.0) -> "LabelModel":
        """EM over the votes; it starts at ``seeds`` (labels), which weigh ``strength`` against a posterior's 1."""
        p = seeds.astype(float)
        for _ in range(rounds):
            w = np.stack([1 - p, p], 1) + strength * np.stack([seeds == 0, seeds == 1], 1)
            self.prior = float(np.clip(w[:, 1].sum() / w.sum(), 0.01, 0.99))
            both = [(votes * w[:, [y]]).T @ votes for y in range(2)]  # weights with which two voters fire
            self._dependencies(both, w.sum(0))
            self._chances(both, w.sum(0))
            new = self.posterior(votes)
            done = np.abs(new - p).max() < 1e-4
            p = new
            if done:
                break
        if seeds.any() and not seeds.all() and p[seeds == 1].mean() < p[seeds == 0].mean():
            self.prior, self.fire, self.given = 1 - self.prior, self.fire[:, ::-1], self.given[:, ::-1]
            p = 1 - p
        self.agreement = float(((p >= 0.5) == (seeds == 1)).mean())
        return self

    def _dependencies(self, both: list, total: np.ndarray) -> None:
        """Correlations given the class and the forest of the strongest dependencies among them."""
        m = len(both[0])
        share, info = np.zeros((m, m)), np.zeros((m, m))
        for y in range(2):
            n = total[y] + 1e-9
            f = np.clip(np.diag(both[y]) / n, 1e-5, 1 - 1e-5)
            dev = np.sqrt(f * (1 - f))
            c = (both[y] / n - np.outer(f, f)) / np.outer(dev, dev)
            c[np.minimum.outer(f, f) * n < 1] = 0  # fired by less than one document's weight
            share = np.where(np.abs(c) > np.abs(share), c, share)
            info -= n / total.sum() * np.log(np.maximum(1 - np.minimum(np.abs(c), 1) ** 2, 1e-6))
        np.fill_diagonal(share, 1)
        self.correlation = share
        info = np.where(np.abs(share) >= self.tie, info, 0)
        np.fill_diagonal(info, 0)
        # the greatest forest: voters join one by one over the strongest dependency that is left
        self.parent = np.full(m, -1)
        name = np.arange(m)
        outside, best, via = np.ones(m, bool), np.zeros(m), np.full(m, -1)
        for _ in range(m):
            j = int(np.where(outside, best, -1).argmax())
            outside[j] = False
            if best[j] > 0:
                self.parent[j] = via[j]
                name[j] = name[via[j]]
            closer = info[j] > best
            best, via = np.where(closer, info[j], best), np.where(closer, j, via)
        self.groups = [np.flatnonzero(name == k) for k in sorted(set(name), key=lambda k: np.flatnonzero(name == k)[0])]

    def _chances(self, both: list, total: np.ndarray) -> None:
        """Chances to fire by class, and by class and the parent's vote."""
        m = len(both[0])
        self.fire = np.zeros((m, 2))
        self.given = np.zeros((m, 2, 2))
        for y in range(2):
            f = np.diag(both[y])
            self.fire[:, y] = np.clip((f + 0.1) / (total[y] + 1), 1e-5, 1 - 1e-5)
            up = np.where(self.parent >= 0, f[self.parent], 0)
            meet = np.where(self.parent >= 0, both[y][np.arange(m), self.parent], 0)
            # a little of the chance by class alone keeps those of rare votes apart from 0 and 1
            for v, hit, n in ((1, meet, up), (0, f - meet, total[y] - up)):
                self.given[:, y, v] = np.clip((hit + self.fire[:, y]) / (n + 1), 1e-5, 1 - 1e-5)


@dataclass
class Linear:
    weights: dict = field(default_factory=dict)  # pattern: weight
    intercept: float = -40.0

    def marks(self) -> set[str]:
        """The marks that the weighted patterns are about."""
        return {p.rstrip("+") for p in self.weights}

    def score(self, text: str | None, marks: set[str], cache: dict) -> float:
        z = self.intercept
        words = _WORDS.findall(text.lower()) if text else []
        count: dict = {}
        for w, c in Counter(words).items():
            got = cache.get(w)
            if got is None:
                got = cache[w] = tuple(m for m in marks_of(w) if m in marks)
            for m in got:
                count[m] = count.get(m, 0) + c
        if count:
            get = self.weights.get
            z += math.fsum(get(m, 0.0) + (get(m + "+", 0.0) if is_dense(c, len(words)) else 0.0) for m, c in count.items())
        return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))


_SKETCH = 1 << 22


def _counter(mark: str) -> int:
    """The counter of a pattern, the same one in every process."""
    return zlib.crc32(mark.encode("utf-8", "surrogatepass")) % _SKETCH


def candidates(texts: list[str | None], toxic: np.ndarray, most: int, most_clean: int = 0) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Patterns that are frequent enough and skewed to the toxic class, then those skewed to the other, with their log lifts and firings (documents x patterns).

    Patterns are never held for all texts: counters of hashed patterns first
    tell which may be frequent, and only those are kept, as numbers.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    least = max(4, int(0.02 * n1))
    counters = np.zeros(_SKETCH, np.int32)
    for t, y in zip(texts, toxic):
        if y:
            p = patterns(t)
            counters[np.unique(np.fromiter(map(_counter, p), np.int64, len(p)))] += 1
    number: dict[str, int] = {}
    rows = []
    frequent = (counters >= least).tolist()
    for t, y in zip(texts, toxic):
        if y:  # only toxic texts add patterns, so those go first
            rows.append([number.setdefault(m, len(number)) for m in patterns(t) if frequent[_counter(m)]])
        else:
            rows.append(None)
    for r, t in enumerate(texts):
        if rows[r] is None:
            rows[r] = [number[m] for m in number.keys() & patterns(t)]
    count = lambda y: np.bincount([k for r, z in zip(rows, toxic) if z == y for k in r], minlength=len(number))
    pos, neg = count(True), count(False)
    lift = np.log(((pos + 0.5) / n1) / ((neg + 0.5) / n0))
    names = list(number)
    order = sorted(np.flatnonzero((pos >= least) & (lift > 2)).tolist(), key=lambda k: (-lift[k] * np.sqrt(pos[k]), names[k]))[:most]
    order += sorted(np.flatnonzero((neg >= max(4, 0.02 * n0)) & (lift < -1)).tolist(), key=lambda k: (lift[k] * np.sqrt(neg[k]), names[k]))[:most_clean]
    place = np.full(len(names), -1)
    place[order] = np.arange(len(order))
    fires = np.zeros((len(texts), len(order)), bool)
    for r, ks in enumerate(rows):
        at = place[ks] if ks else np.zeros(0, int)
        fires[r, at[at >= 0]] = True
    return [names[k] for k in order], lift[order], fires


def distinct(fires: np.ndarray, most: int, overlap: float = 0.8) -> list[int]:
    """The first columns that do not fire on nearly the same documents as one taken before."""
    f = fires.astype(np.float32)
    both = f.T @ f
    size = np.diag(both)
    taken: list[int] = []
    for j in range(fires.shape[1]):
        if len(taken) == most:
            break
        if (both[j, taken] < overlap * (size[taken] + size[j] - both[j, taken])).all():
            taken.append(j)
    return taken


def train(rows: list[tuple[str | None, int]], odds: float | None = None, max_voters: int = 100, max_features: int = 200, l2: float = 0.2, max_candidates: int = 2000, max_clean: int = 20) -> Linear:
    """Voters, label model and classifier from labelled texts; ``odds`` of the toxic class outside the sample."""
    toxic = np.array([y == 1 for _, y in rows], bool)
    if not toxic.any() or toxic.all():
        return Linear()
    odds = odds or toxic.sum() / (~toxic).sum()
    names, lift, fires = candidates([t for t, _ in rows], toxic, max_candidates, 10 * max_clean)
    speak = distinct(fires[:, lift > 0], max_features)
    calm = [int((lift > 0).sum()) + j for j in distinct(fires[:, lift <= 0], max_clean)]
    features = speak + calm
    voters = [j for j in speak if lift[j] > 3][:max_voters]
    if voters:
        voters += calm
    if not voters:
        return Linear({}, float(np.log(odds)))
    votes = fires[:, voters].astype(float)
    posterior = LabelModel().fit(votes, toxic.astype(int)).posterior(votes)
    # logistic regression on the posteriors by Newton steps
    x = np.column_stack([fires[:, features], np.ones(len(rows))]).astype(float)
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(len(features), l2), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(ridge), x.T @ (posterior - p) - ridge * w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    shift = np.log(odds) - np.log(toxic.sum() / (~toxic).sum())
    return Linear({names[j]: float(v) for j, v in zip(features, w)}, float(w[-1] + shift))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_chars: int = 50_000) -> tuple[list[tuple[str | None, int]], float | None]:
    """At most ``per_class`` toxic and twice as many clean labelled texts, distinct ones, and the odds among all labels."""
    marks = labels.filter(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    # texts are drawn by their hashes, whatever ids they have; only hashes are moved
    known = stash(texts.select("doc_id", "th").join(marks, "doc_id").groupBy("toxic", "th").agg(F.min("doc_id").alias("doc_id")), "known-texts")
    draw = F.xxhash64("th", F.lit(5))
    picked = known.filter("toxic = 1").orderBy(draw, "th").limit(per_class).union(known.filter("toxic = 0").orderBy(draw, "th").limit(2 * per_class))
    part = F.when(F.length("text") > most_chars, F.expr(f"substring(text, CAST(1 + pmod(th, length(text) - {most_chars}) AS INT), {most_chars})")).otherwise(F.col("text"))
    # the chosen rows are bounded by per_class, so they can be sent to the texts
    chosen = texts.join(F.broadcast(picked), ["doc_id", "th"]).select("doc_id", "toxic", part.alias("text"))
    rows = chosen.distinct().collect()
    unstash(known)
    found = [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], r["text"] or ""))]
    return found, counts[1] / counts[0] if counts.get(0) and counts.get(1) else None


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id, held_out, score and predicted of each row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features weights

    def run(batches):
        m, cache = sent.value, {}
        marks = m.marks()
        for b in batches:
            s = []
            for t in b.column(2).to_pylist():
                s.append(m.score(t, marks, cache))
                if len(cache) > 300_000:
                    cache.clear()
            s = np.array(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    return score(docs, train(*training_sample(docs, labels, **params)))
