"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled, so that text that switches languages is
followed word by word.  A word's features are its character n-grams (one to four
characters between word-boundary marks, so those at a mark are its affixes) and
the lexicon that it belongs to, if any; transitions between the languages of
neighbouring words are learned with them.  Labels come from forward-backward
over the whole text; a document's language is the one with the greatest
posterior mass over its words, its score that mass per word.

Training uses a bounded sample of distinct labelled texts, drawn by the hash of the text:
``per_lang`` for each language that any row is labelled with, ``most_texts`` for all of them
together (but eight each), of longer texts a passage of ``most_chars`` characters from a hashed place.
Their words carry the text's label; 48-word sequences that join passages of several texts teach
the field, 4,000 of them or 100 a language, whichever is more.  Languages are
never left out; the model in the driver grows with their number, not with that of rows.

Long texts are cut into segments for speed only: each segment's transfer matrix
passes exact messages across the cuts, so the result is that of one chain.

Cases: texts that are null or have no letter give ``und`` with score 0; so does
every text if no document has a language to learn; ties go to the first
language in order; repeated rows are labelled alike and learned once; an empty table gives an
empty one; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import stash, unstash

_WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
SEGMENT = 512


def words_of(text: str | None) -> list[str]:
    """The words of a text; none if it holds but signs such as ½ that count as word characters without being letters."""
    words = _WORDS.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def ngrams(words: list[str], bits: int, longest: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words as (feature, word) pairs in order of words."""
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    feats, owners = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, longest + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        ok = owner[: len(h)] == owner[n - 1 :]
        x = h[ok] * np.uint64(0x9E3779B97F4A7C15)
        feats.append((x >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(owner[: len(h)][ok])
    feats, owners = np.concatenate(feats), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return feats[order], owners[order]


def _sum_by(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by a sorted owner that has every number below n."""
    return np.add.reduceat(values, np.searchsorted(owner, np.arange(n)), axis=0) if n else values[:0]


@dataclass
class Crf:
    langs: list[str]
    bits: int = 17
    weights: np.ndarray = None  # features x languages
    lexicon: dict = field(default_factory=dict)  # word: row of lexicon_weights
    lexicon_weights: np.ndarray = None  # (languages + 1) x languages; the last row for words of no lexicon
    transitions: np.ndarray = None  # languages x languages

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials of distinct words."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        f, o = ngrams(words, self.bits)
        e = _sum_by(self.weights[f], o, len(words))
        member = np.fromiter((self.lexicon.get(w, len(self.langs)) for w in words), np.int64, len(words))
        return e + self.lexicon_weights[member]

    def posteriors(self, sequences: list[np.ndarray], e: np.ndarray, each: bool = False):
        """Posterior mass of each language per sequence of word numbers; with ``each`` also per word."""
        k = len(self.langs)
        e = np.exp(np.clip(e - e.max(1, keepdims=True), -40, 0)).astype(np.float32)
        a = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        pieces = [(d, at, min(SEGMENT, len(s) - at)) for d, s in enumerate(sequences) for at in range(0, len(s), SEGMENT)]
        order = sorted(range(len(pieces)), key=lambda p: -pieces[p][2])
        mass = np.zeros((len(sequences), k))
        per_word = [np.zeros((len(s), k), np.float32) for s in sequences] if each else None
        ahead = np.full((len(pieces), k), 1 / k, np.float32)
        behind = np.ones((len(pieces), k), np.float32)
        split = [p for p in order if len(sequences[pieces[p][0]]) > SEGMENT]
        matrices: dict = {}
        for lo in range(0, len(split), 512):
            self._messages(split[lo : lo + 512], pieces, sequences, e, a, matrices)
        if split:
            for p in range(1, len(pieces)):
                if pieces[p][0] == pieces[p - 1][0]:
                    m = ahead[p - 1] @ matrices[p - 1]
                    ahead[p] = m / m.sum()
            for p in range(len(pieces) - 2, -1, -1):
                if pieces[p][0] == pieces[p + 1][0]:
                    m = matrices[p + 1] @ behind[p + 1]
                    behind[p] = m / m.max()
        for lo in range(0, len(order), 1024):
            group = order[lo : lo + 1024]
            index, live = self._grid(group, pieces, sequences)
            alphas = np.zeros((*index.shape, k), np.float32)
            cur = ahead[group]
            for t, n in enumerate(live):
                cur = (cur[:n] @ a) * e[index[t, :n]]
                cur /= cur.sum(1, keepdims=True)
                alphas[t, :n] = cur
            cur = behind[group]
            for t in range(len(live) - 1, -1, -1):
                n = live[t]
                p = alphas[t, :n] * cur[:n]
                p /= p.sum(1, keepdims=True)
                alphas[t, :n] = p
                back = (cur[:n] * e[index[t, :n]]) @ a.T
                cur[:n] = back / back.max(1, keepdims=True)
            total = alphas.sum(0)
            for j, p in enumerate(group):
                d, at, n = pieces[p]
                mass[d] += total[j]
                if each:
                    per_word[d][at : at + n] = alphas[:n, j]
        return (mass, per_word) if each else mass

    def _grid(self, group, pieces, sequences):
        """Word numbers as (place, piece), pieces by falling length, and how many are alive at each place."""
        sizes = np.array([pieces[p][2] for p in group])
        index = np.zeros((sizes[0], len(group)), np.int64)
        for j, p in enumerate(group):
            d, at, n = pieces[p]
            index[:n, j] = sequences[d][at : at + n]
        return index, np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")

    def _messages(self, group, pieces, sequences, e, a, out):
        """Transfer matrices of pieces, each scaled to sum 1."""
        index, live = self._grid(group, pieces, sequences)
        r = np.tile(np.eye(len(self.langs), dtype=np.float32), (len(group), 1, 1))
        for t, n in enumerate(live):
            x = (r[:n] @ a) * e[index[t, :n]][:, None, :]
            r[:n] = x / x.sum((1, 2), keepdims=True)
        for j, p in enumerate(group):
            out[p] = r[j]


def training_sequences(docs: list[tuple[str, list[str]]], langs: list[str], rng, length: int = 48, most: int = 4000):
    """Passages of 6 to 24 words, joined to sequences with (words, labels); neighbours often differ in language."""
    number = {x: i for i, x in enumerate(langs)}
    passages: list[tuple[int, list[str]]] = []
    for lang, words in docs:
        at = 0
        while at < len(words):
            n = int(rng.integers(6, 25))
            passages.append((number[lang], words[at : at + n]))
            at += n
    rng.shuffle(passages)
    by = [[p for p in passages if p[0] == k] for k in range(len(langs))]
    by = [b for b in by if b]
    out, spent = [], [0] * len(by)
    while by and len(out) < most:
        words, labels = [], []
        k = int(rng.integers(len(by)))
        while len(words) < length:
            lang, part = by[k][spent[k] % len(by[k])]
            spent[k] += 1
            words += part
            labels += [lang] * len(part)
            if rng.random() < 0.5:
                k = int(rng.integers(len(by)))
        out.append((words[:length], labels[:length]))
        if all(s >= len(b) for s, b in zip(spent, by)):
            break
    return out


def train(docs: list[tuple[str, list[str]]], steps: int = 40, rate: float = 0.5, decay: float = 1e-4, seed: int = 5) -> Crf:
    """Fit a field by AdaGrad on the log likelihood of joined passages."""
    langs = sorted({lang for lang, words in docs if words})
    crf = Crf(langs)
    k = len(langs)
    if not k:
        return crf
    rng = np.random.default_rng(seed)
    counts: dict = {}
    for lang, words in docs:
        for w in words:
            counts.setdefault(w, np.zeros(k, np.int64))[langs.index(lang)] += 1
    crf.lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 5 and c.max() > 0.7 * c.sum()}
    del counts
    crf.weights = np.zeros((1 << crf.bits, k), np.float32)
    crf.lexicon_weights = np.zeros((k + 1, k), np.float32)
    crf.transitions = np.zeros((k, k), np.float32)
    if k == 1:
        return crf
    seqs = training_sequences(docs, langs, rng, most=max(4000, 100 * k))
    vocab: dict = {}
    numbers = [np.array([vocab.setdefault(w, len(vocab)) for w in ws]) for ws, _ in seqs]
    labels = [np.array(ls) for _, ls in seqs]
    words = list(vocab)
    f, o = ngrams(words, crf.bits)
    member = np.array([crf.lexicon.get(w, k) for w in words])
    x, y = np.stack(numbers), np.stack(labels)
    params = [crf.weights, crf.lexicon_weights, crf.transitions]
    square = [np.full_like(p, 1e-2) for p in params]
    for _ in range(steps):
        e = _sum_by(crf.weights[f], o, len(words)) + crf.lexicon_weights[member]
        p_word, p_pair = _marginals(e[x], crf.transitions)
        g = -p_word
        np.put_along_axis(g, y[..., None], np.take_along_axis(g, y[..., None], 2) + 1, 2)
        by_word = np.stack([np.bincount(x.ravel(), g[..., c].ravel(), len(words)) for c in range(k)], 1)
        gw = np.stack([np.bincount(f, by_word[o, c], len(crf.weights)) for c in range(k)], 1)
        gl = np.stack([np.bincount(member, by_word[:, c], k + 1) for c in range(k)], 1)
        gt = np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k) - p_pair
        for p, q, grad in zip(params, square, (gw, gl, gt)):
            grad = grad / len(x) - decay * p
            q += (grad * grad).astype(np.float32)
            p += (rate * grad / np.sqrt(q)).astype(np.float32)
    return crf


def _marginals(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and summed pair marginals of equally long sequences (sequence x place x label)."""
    n, t_max, k = e.shape
    pot = np.exp(e - e.max(2, keepdims=True))
    a = np.exp(trans - trans.max())
    alpha, beta = np.zeros_like(pot), np.ones_like(pot)
    alpha[:, 0] = pot[:, 0] / pot[:, 0].sum(1, keepdims=True)
    for t in range(1, t_max):
        z = (alpha[:, t - 1] @ a) * pot[:, t]
        alpha[:, t] = z / z.sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(t_max - 1, 0, -1):
        right = beta[:, t] * pot[:, t]
        z = right @ a.T
        beta[:, t - 1] = z / z.max(1, keepdims=True)
        # alpha_i a_ij right_j, each sequence's scaled to sum 1
        whole = (alpha[:, t - 1] * (right @ a.T)).sum(1, keepdims=True)
        pairs += a * ((alpha[:, t - 1] / whole).T @ right)
    p = alpha * beta
    return p / p.sum(2, keepdims=True), pairs


def held_out(modulus: int = 5, remainder: int = 0) -> Column:
    """Whether crc32 of doc_id as text leaves ``remainder``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def training_sample(docs: DataFrame, per_lang: int = 400, most_texts: int = 25_600, most_chars: int = 20_000) -> list[tuple[str, list[str]]]:
    """About ``per_lang`` distinct texts (twice as many at most) of each language, fewer if all would be over ``most_texts``."""
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    learn = docs.filter(~held_out() & F.col("lang").isNotNull()).select("lang", "text", th.alias("th"))
    # one row a language
    counts = stash(learn.groupBy("lang").agg(F.approx_count_distinct("th").alias("n")), "langs")
    langs = counts.count()
    if not langs:
        return []
    each = min(per_lang, max(8, most_texts // langs))
    draw = F.pmod(F.xxhash64("th", F.lit(3)), F.lit(1 << 30))
    over = F.length("text") - most_chars
    part = F.when(over > 0, F.expr(f"substring(text, CAST(1 + pmod(th, length(text) - {most_chars}) AS INT), {most_chars})")).otherwise(F.col("text"))
    near = learn.join(counts, "lang").filter(draw < F.lit(float(each << 30)) / F.col("n")).select("lang", "th", draw.alias("draw"), part.alias("text")).distinct()
    picked = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("draw", "th"))).filter(F.col("k") <= 2 * each).select("lang", "th", "text").collect()
    unstash(counts)
    return [(r["lang"], words_of(r["text"])) for r in sorted(picked, key=lambda r: (r["lang"], r["th"], r["text"] or ""))]


def label_texts(crf: Crf, texts: list[str | None], each: bool = False):
    """Posterior mass per text and language, with the number of words of each text."""
    vocab: dict = {}
    put = vocab.setdefault
    seqs = [np.array([put(w, len(vocab)) for w in words_of(t)], np.int64) for t in texts]
    e = crf.emissions(list(vocab))
    return crf.posteriors(seqs, e, each), np.array([len(s) for s in seqs])


def predict(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_letters_words, second_lang and second_share of each row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)  # bounded by the training sample and the feature table

    def run(batches):
        m = sent.value
        k = len(m.langs)
        for whole in batches:
            for b in _slices(whole, 2, 6 << 20):
                texts = b.column(2).to_pylist()
                if k:
                    mass, n = label_texts(m, texts)
                else:
                    mass, n = np.zeros((len(texts), 1)), np.array([len(words_of(t)) for t in texts])
                share = mass / np.maximum(n, 1)[:, None]
                rank = np.argsort(-share, axis=1, kind="stable")
                best = rank[:, 0]
                found = [m.langs[j] if c and k else UNKNOWN for j, c in zip(best, n)]
                second = [m.langs[r[1]] if c and k > 1 else None for r, c in zip(rank, n)]
                rest = [float(s[r[1]]) if c and k > 1 else None for s, r, c in zip(share, rank, n)]
                score = np.clip(share[np.arange(len(share)), best], 0, 1) * (n > 0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(n), pa.array(second, pa.string()), pa.array(rest, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "n_tagged", "second_lang", "second_share"])

    cols = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return cols.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_tagged long, second_lang string, second_share double")


def _slices(batch: pa.RecordBatch, column: int, most: int):
    """Slices of a batch with at most ``most`` characters of text, or one row."""
    size = np.cumsum([len(x or "") for x in batch.column(column).to_pylist()])
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def identify(docs: DataFrame, **params) -> DataFrame:
    return predict(docs, train(training_sample(docs, **params)))
