"""Kernel-pooling rankers over token embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.vectors import dot, kernel_means, kernel_widths

FLOOR = 1e-10


def kernel_scores(query_vectors: DataFrame, document_vectors: DataFrame, pairs: DataFrame, weights: list[float]) -> DataFrame:
    """``qid, docid, score``: dot products of all token pairs, Gaussian kernels, log sums, a weighted sum.

    ``query_vectors`` and ``document_vectors`` have ``qid|docid, pos, vector``. The relational form:
    explode, exp, sum over the document, log, sum over the query.
    """
    total = sum((F.get("kernels", F.lit(i)) * w for i, w in enumerate(weights)), F.lit(0.0))
    return kernel_features(query_vectors, document_vectors, pairs, len(weights)).select("qid", "docid", total.alias("score"))


def kernel_features(query_vectors: DataFrame, document_vectors: DataFrame, pairs: DataFrame, kernels: int = 11) -> DataFrame:
    """``qid, docid, kernels``: the log sums that the head of the ranker weighs."""
    means, widths = kernel_means(kernels), kernel_widths(kernels)
    q = query_vectors.select("qid", F.col("pos").alias("qpos"), F.col("vector").alias("qv"))
    d = document_vectors.select("docid", F.col("vector").alias("dv"))
    met = pairs.join(q, "qid").join(d, "docid").select("qid", "docid", "qpos", dot(F.col("qv"), F.col("dv")).alias("s"))
    sums = [F.sum(F.exp(-0.5 * ((F.col("s") - m) / w) ** 2)).alias(f"k{i}") for i, (m, w) in enumerate(zip(means, widths, strict=True))]
    pooled = met.groupBy("qid", "docid", "qpos").agg(*sums)
    logs = F.array(*(F.sum(F.ln(F.greatest(F.col(f"k{i}"), F.lit(FLOOR)))) for i in range(kernels)))
    return pooled.groupBy("qid", "docid").agg(logs.alias("kernels"))


def trained_head(features: DataFrame, relevant: str, regularisation: float = 0.01, rounds: int = 50) -> tuple[list[float], float]:
    """Weights of the kernels and an offset, by logistic regression on all judged pairs (``kernels`` and a 0/1 column).

    Gradients are summed by the tasks; only the weights come to the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = features.select(array_to_vector("kernels").alias("features"), F.col(relevant).cast("double").alias("label"))
    model = LogisticRegression(regParam=regularisation, maxIter=rounds).fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept)


def score_in_batches(pairs: DataFrame, keys: list[str], score, batch: str = "double") -> DataFrame:  # noqa: ANN001
    """``keys, score`` by a pluggable ``score(query vectors, document vectors)`` over Arrow batches.

    ``pairs`` has ``query_vectors`` and ``document_vectors``, arrays of equally long arrays.
    """

    @F.pandas_udf(batch)
    def scored(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in frames:
            yield pd.Series([score(np.stack([np.asarray(v, dtype=float) for v in a]), np.stack([np.asarray(v, dtype=float) for v in b])) for a, b in zip(q, d, strict=True)], dtype="float64")

    return pairs.select(*keys, scored("query_vectors", "document_vectors").alias("score"))


class ContextRanker:
    """A small transformer ranker: contextual and plain vectors in equal parts, cosines, kernels by sum and by mean.

    Weights are drawn from ``seed``; nothing is trained here.
    """

    def __init__(self, width: int, heads: int = 8, layers: int = 2, kernels: int = 11, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.heads = heads
        scale = 1 / np.sqrt(width)
        self.layers = [{n: rng.normal(0, scale, (width, width)) for n in ("q", "k", "v", "o", "up", "down")} for _ in range(layers)]
        self.means, self.widths = np.array(kernel_means(kernels)), np.array(kernel_widths(kernels))
        self.by_sum, self.by_mean, self.both = rng.uniform(-0.014, 0.014, kernels), rng.uniform(-0.014, 0.014, kernels), np.array([0.5, 0.5])

    @staticmethod
    def _normal(x: np.ndarray) -> np.ndarray:
        return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)

    def context(self, x: np.ndarray) -> np.ndarray:
        places = np.arange(len(x))[:, None] / np.power(10000.0, np.arange(0, x.shape[1], 2) / x.shape[1])
        h = x.copy()
        h[:, 0::2] += np.sin(places)
        h[:, 1::2] += np.cos(places)[:, : h[:, 1::2].shape[1]]
        for layer in self.layers:
            parts = [np.split(h @ layer[n], self.heads, axis=1) for n in ("q", "k", "v")]
            mixed = []
            for q, k, v in zip(*parts, strict=True):
                logits = q @ k.T / np.sqrt(q.shape[1])
                share = np.exp(logits - logits.max(1, keepdims=True))
                mixed.append(share / share.sum(1, keepdims=True) @ v)
            h = self._normal(h + np.concatenate(mixed, axis=1) @ layer["o"])
            h = self._normal(h + np.maximum(h @ layer["up"], 0) @ layer["down"])
        return h

    def __call__(self, query: np.ndarray, document: np.ndarray) -> float:
        q, d = (0.5 * x + 0.5 * self.context(x) for x in (query, document))
        cosines = q @ d.T / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None], 1e-12)
        kernels = np.exp(-((cosines[..., None] - self.means) ** 2) / (2 * self.widths**2)).sum(1)
        by_sum = (np.log2(np.maximum(kernels, FLOOR)) * 0.01).sum(0) @ self.by_sum
        by_mean = (kernels / (len(document) + 1) * 0.01).sum(0) @ self.by_mean
        return float(self.both @ np.array([by_sum, by_mean]))
