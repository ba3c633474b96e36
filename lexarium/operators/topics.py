"""Keywords, vectors and comparisons of clusterings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def class_tfidf(counts: DataFrame, topic: str = "topic", word: str = "word", n: str = "n") -> DataFrame:
    """score of words by topic: n / words of the topic, times ln(1 + mean words of topics / n of the word overall)."""
    sizes = counts.groupBy(topic).agg(F.sum(n).alias("_size"))
    overall = counts.groupBy(word).agg(F.sum(n).alias("_all"))
    mean = sizes.agg((F.sum("_size") / F.count("*")).alias("_mean"))
    joined = counts.join(sizes, topic).join(overall, word).crossJoin(F.broadcast(mean))
    return joined.select(topic, word, n, (F.col(n) / F.col("_size") * F.ln(1 + F.col("_mean") / F.col("_all"))).alias("score"))


def top_words(scores: DataFrame, k: int, topic: str = "topic", word: str = "word") -> DataFrame:
    order = W.partitionBy(topic).orderBy(F.desc(F.round("score", 9)), word)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, dim, mean) of each cluster, in long form: sums combine before the shuffle."""
    return vectors.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_arrays(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    c = centroids(vectors, label, vector).groupBy(label).agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("v"))
    return c.select(label, F.transform("v", lambda x: x["mean"]).alias("centroid"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(cells: DataFrame) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two clusterings' contingency cells."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    ent = lambda: -F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t")))
    total = cells.agg(F.sum("n").alias("t"))
    with_t = lambda d: d.crossJoin(F.broadcast(total))
    a, b = (cells.groupBy(k).agg(F.sum("n").alias("n")) for k in "ab")
    sa = with_t(a).agg(pairs("n").alias("pa"), ent().alias("ha"))
    sb = with_t(b).agg(pairs("n").alias("pb"), ent().alias("hb"))
    sc = with_t(cells).agg(pairs("n").alias("pc"), ent().alias("hc"), F.max("t").alias("t"))
    one = sa.crossJoin(sb).crossJoin(sc)  # single rows
    every = F.col("t") * (F.col("t") - 1) / 2
    expected = F.col("pa") * F.col("pb") / every
    top = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("pc") - expected) / (top - expected))
    nmi = F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise((F.col("ha") + F.col("hb") - F.col("hc")) / ((F.col("ha") + F.col("hb")) / 2))
    return one.select(F.col("t").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def mmr(vectors: np.ndarray, centroid: np.ndarray, k: int, trade: float = 0.5) -> list[int]:
    """Indices picked one by one: relevant to the centroid, unlike those picked before."""
    u = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    rel = u @ (centroid / max(np.linalg.norm(centroid), 1e-12))
    chosen: list[int] = [int(rel.argmax())] if len(u) else []
    near = u @ u[chosen[0]] if chosen else None
    while chosen and len(chosen) < min(k, len(u)):
        s = trade * rel - (1 - trade) * near
        s[chosen] = -np.inf
        chosen.append(int(s.argmax()))
        near = np.maximum(near, u @ u[chosen[-1]])
    return chosen


def diverse_members(candidates: DataFrame, label: str, ident: str, vector: str, k: int) -> DataFrame:
    """The k members of each cluster that MMR picks among its candidates (a bounded top list per cluster)."""

    def run(p):
        p = p.sort_values(ident)
        x = np.stack(p[vector].to_numpy()).astype(float)
        picked = mmr(x, x.mean(0), k)
        return pd.DataFrame({label: p[label].iloc[picked].to_numpy(), ident: p[ident].iloc[picked].to_numpy(), "rank": np.arange(1, len(picked) + 1)})

    return candidates.groupBy(label).applyInPandas(run, f"{label} long, {ident} long, rank long")


def cosine_kmeans(vectors: DataFrame, vector: str, k: int, seed: int = 42, columns: Sequence[str] = ()) -> DataFrame:
    """Spherical k-means by Spark ML: the given columns with the assigned topic and its representative status."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(*columns, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(data)
    return model.transform(data).select(*columns, F.col("prediction").cast("long").alias("topic"))


def plane(distances: np.ndarray) -> np.ndarray:
    """Classical scaling: points of the plane whose distances come closest to those given (a small symmetric matrix).

    The greater coordinate of each axis is positive, so the map does not depend on signs of eigenvectors.
    """
    n = len(distances)
    centre = np.eye(n) - 1 / n if n else np.zeros((0, 0))
    values, vectors = np.linalg.eigh(-0.5 * centre @ (np.asarray(distances, float) ** 2) @ centre)
    out = np.zeros((n, 2))
    for axis, k in enumerate(np.argsort(values)[::-1][:2]):
        x = vectors[:, k] * np.sqrt(max(values[k], 0.0))
        out[:, axis] = x * (1 if not n or x[np.abs(x).argmax()] >= 0 else -1)
    return out
