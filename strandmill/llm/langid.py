"""Language by nearest centroid.

A text is a TF-IDF vector of hashed byte trigrams of its letters, scaled to length 1. Each language has
several centroids (spherical k-means over a bounded sample of its texts); a text gets the language of
the centroid with the largest cosine. If that cosine is small the text is far from everything that was
learned: ``rejected`` says so, by a distance that training texts keep to their own centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import ngrams
from .words import text_blocks

#: Texts for each language that centroids are fitted on, at most; centroids of a language; most languages that are learned.
PER_LANGUAGE, CENTROIDS, MOST_LANGUAGES = 600, 6, 256
#: Texts that centroids are fitted on in all, if languages are so many that each gets less than PER_LANGUAGE.
LEARNED = 6000
#: A text is rejected below this quantile of the training texts' own best cosines, taken by half.
REJECT_QUANTILE, REJECT_SHARE = 0.01, 0.5
GRAM = 3
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    owner: np.ndarray
    least: float


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Up to k unit centroids of unit rows; fewer when rows are few."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=k)[:, None]
        centres = ngrams.unit(sums[size[:, 0] > 0] / size[size > 0][:, None] / ngrams.ONE * 16)
        k = len(centres)
    return centres


def _counted(column: pa.Array) -> Iterator[np.ndarray]:
    return (ngrams.counts_of(data, offsets, GRAM, ngrams.letters()) for _, _, data, offsets in text_blocks(column))


def fit(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE, most: int = MOST_LANGUAGES) -> Model:
    """Fit on rows of ``docs(doc_id, text, lang)`` for which ``train`` holds and lang and text are not null.

    At most ``per_language`` (and LEARNED over all languages) different (id, text) pairs of a language are learned from, those with the smallest hashes, so reruns agree and
    rows that repeat count once; and of more than ``most`` languages those of most rows.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64(F.col("doc_id"), "text", F.lit("langid"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(order).alias("pairs")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not sizes:
        return Model(np.ones(ngrams.BUCKETS, np.float32), np.zeros((0, ngrams.BUCKETS)), [], np.zeros(0, int), 0.0)
    per_language = max(1, min(per_language, LEARNED // len(sizes)))
    # Thinned to a few times what is learned from before hashes are ranked, and ranked before texts are read.
    rate = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, (2.0 * per_language + 40) / max(1, r["pairs"])))])
    thinned = rows.where(F.pmod(order, F.lit(1 << 20)) / F.lit(float(1 << 20)) < rate[F.col("lang")])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 20)), "order"))
    picked = thinned.select("lang", order.alias("order")).distinct().withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth")
    # At most per_language rows of at most ``most`` languages: bounded by parameters, so broadcast.
    texts = thinned.withColumn("order", order).join(F.broadcast(picked), ["lang", "order"])
    sample = texts.groupBy("lang", "order").agg(F.min("text").alias("text")).select(F.col("order").cast("string").alias("id"), "lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), ngrams.packed(_counted(b.column("text")))], ["id", "lang", "counts"])

    got = sorted(sample.mapInArrow(count, "id string, lang string, counts binary").collect(), key=lambda r: (r["lang"], r["id"] or "", r["counts"]))
    counts, lang = ngrams.unpacked((r["counts"] for r in got), len(got)), np.array([r["lang"] for r in got])
    idf = ngrams.idf_of(counts)
    x = ngrams.tfidf(counts, idf)
    names = sorted(set(lang.tolist()))
    sets = [spherical_kmeans(x[lang == name], CENTROIDS) for name in names]
    centroids = np.concatenate(sets) if sets else np.zeros((0, ngrams.BUCKETS))
    owner = np.repeat(np.arange(len(names)), [len(s) for s in sets])
    best = ngrams.cosines(x, centroids).max(1) if len(x) and len(centroids) else np.zeros(1)
    return Model(idf, centroids, names, owner, float(np.quantile(best, REJECT_QUANTILE)) * REJECT_SHARE)


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) with lang_pred, score (the best cosine, 0 to 1) and rejected.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Whole texts
    count; equal texts get equal results in any batch, ties go to the language first in code point order. A
    column of ``docs`` that has one of the new names is replaced. An empty table gives an empty result.
    """
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in {f.name for f in new}]
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: broadcasts are pickled by reference

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for b in batches:
            text = b.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, which = np.zeros(b.num_rows), np.zeros(b.num_rows, int)
            for row, end, data, offsets in text_blocks(text):
                counts = ngrams.counts_of(data, offsets, GRAM, ngrams.letters())
                if len(m.centroids):
                    cosine = ngrams.cosines(ngrams.tfidf(counts, m.idf), m.centroids)
                    which[row:end] = m.owner[cosine.argmax(1)]
                    best[row:end] = cosine.max(1)
            known = lettered & (len(m.languages) > 0)
            names = [m.languages[k] if ok else UNKNOWN for k, ok in zip(which, known)]
            score = np.where(known, np.clip(best, 0, 1), 0.0)
            found = [pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < m.least))]
            yield pa.RecordBatch.from_arrays([*map(b.column, carry), *found], [*carry, *(f.name for f in new)])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(predict, StructType([docs.schema[c] for c in carry] + new))
