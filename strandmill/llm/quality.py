"""Quality by nearest-neighbour voting in a latent semantic space.

A text is a TF-IDF vector of hashed byte pairs and of words that repeat the word before them (REPEATS
times one count, as it stands for the whole text's order), projected to DIMENSIONS latent directions (truncated
SVD of the labelled sample) and scaled to length 1. The labelled vectors are broadcast: at most
2 * PER_LABEL rows of DIMENSIONS floats. Every document's cosine with every labelled vector is computed exactly, block by block, and
its NEIGHBOURS nearest vote with their labels, weighted by a power of the cosine.

The labelled sample is bounded (PER_LABEL rows of each label, those with the smallest hash of the id);
its votes are weighted so that both labels keep the shares that they have among all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import ngrams
from .common import fold
from .words import WordHasher, text_blocks

PER_LABEL, DIMENSIONS, NEIGHBOURS, POWER = 2048, 64, 25, 16
GRAM, REPEATS = 2, 6
TERMS = ngrams.BUCKETS + 1


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float


def counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, counts by row and term): byte pairs, then repeated words."""
    hasher = WordHasher(lower=False)
    for row, end, data, offsets in text_blocks(column):
        words, bounds = hasher.block(data, offsets)
        again = np.zeros(len(words) + 1, np.int64)
        again[2:] = words[1:] == words[:-1]
        again[bounds[:-1][bounds[:-1] < len(words)] + 1] = 0
        sums = np.cumsum(again)
        repeats = (sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.float32)[:, None]
        yield row, end, np.hstack([ngrams.counts_of(data, offsets, GRAM, ngrams.as_is()), repeats])


def latent_axes(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """The k leading right singular vectors of x, by randomised subspace iteration, in whole numbers of ngrams.ONE."""
    rng = np.random.default_rng(seed)
    k = min(k, *x.shape)
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(k + 16, *x.shape))))[0]
    for _ in range(4):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    return np.rint(np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T * ngrams.ONE)


def latent(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit rows projected to the axes, scaled to length 1; exact up to rounding row by row."""
    return ngrams.unit((x @ axes) / (ngrams.ONE * ngrams.ONE) * 256.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[list, dict[int, int]]:
    """At most ``per_label`` (counts, label) rows of each label, and how many labelled rows each has in all.

    Conflicting labels of one id are left out; null labels and ids too.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("top")).where("q = top")
    known = known.where(fold(F.col("doc_id"), 3) != 1).select(F.col("doc_id").alias("_id"), "q")
    shares = {r["q"]: r["count"] for r in known.groupBy("q").count().collect()}
    order = F.xxhash64("_id")
    picked = [known.where(F.col("q") == q).orderBy(order, "_id").limit(per_label) for q in (0, 1)]
    # At most 2 * per_label rows of an id and a label: bounded by a parameter, so broadcast.
    sample = F.broadcast(picked[0].union(picked[1]))
    texts = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id")).select("_id", "q", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = ngrams.packed(x for _, _, x in counted(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.string()), b.column("q").cast(pa.int32()), counts], ["id", "q", "counts"])

    texts = texts.select(F.col("_id").cast("string").alias("_id"), F.col("q").cast("int").alias("q"), "text")
    # Rows that repeat an id are bounded here too: one text is kept for each.
    rows = texts.groupBy("_id", "q").agg(F.min("text").alias("text")).mapInArrow(count, "id string, q int, counts binary").collect()
    return sorted(rows, key=lambda r: r["id"]), shares


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fit on the bounded sample. Without labelled rows the model votes 0.5 for everything."""
    rows, shares = labelled_sample(docs, labels, per_label)
    counts, y = ngrams.unpacked((r["counts"] for r in rows), len(rows), TERMS), np.array([r["q"] for r in rows], np.float32)
    idf = ngrams.idf_of(counts)
    idf[-1] *= REPEATS
    x = ngrams.tfidf(counts, idf)
    del counts
    axes = latent_axes(x, DIMENSIONS) if len(x) else np.zeros((TERMS, 1))
    held = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    weights = np.where(y == 1, shares.get(1, 0) / held[1], shares.get(0, 0) / held[0]).astype(np.float32)
    total = sum(shares.values())
    return Model(idf, axes, latent(x, axes), y, weights, shares.get(1, 0) / total if total else 0.5)


def vote(model: Model, z: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The share of label 1 among the nearest labelled vectors of each row, weighted by cosine."""
    if not len(model.vectors):
        return np.full(len(z), model.prior)
    cosine = ngrams.cosines(z, model.vectors)
    k = min(neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER * model.weights[near]
    total = weight.sum(1)
    return np.where(total > 0, (weight * model.labels[near]).sum(1) / np.where(total > 0, total, 1), model.prior)


def score_quality(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5).

    The whole text is scored; nothing else of a row is. A null or empty text has no vector and gets
    label 1's share of the labelled rows. Equal texts get equal scores in any batch, repeated rows a result each. A
    column of ``docs`` that has one of the new names is replaced. An empty table gives an empty result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    schema = StructType([docs.schema[c] for c in carry] + [StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: broadcasts are pickled by reference

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for b in batches:
            scores = np.empty(b.num_rows)
            for row, end, counts in counted(b.column("text")):
                scores[row:end] = vote(m, latent(ngrams.tfidf(counts, m.idf), m.axes))
                scores[row:end][counts.sum(1) == 0] = m.prior
            scores = np.clip(np.round(scores, 6), 0, 1)
            yield pa.RecordBatch.from_arrays([*map(b.column, carry), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*carry, "score", "predicted"])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(score, schema)
