"""Hard-negative mining with product quantisation and exact rerank.

Components are quantised to floor(scale * x). Every vector is encoded: each pair of dimensions becomes the number of its nearest of
256 centroids, and the norm of what the codes leave over, the residual, is stored beside them. For an anchor a table of products
with all centroids gives a vector's score up to the residual, and by Cauchy-Schwarz the residual adds at most the product of
the anchor's norm and the stored one. So score plus and minus that bound holds the exact integer score, and what is left out is proven not to be wanted:

1. Positives: of the anchor's label, vectors whose upper bound reaches the k-th best lower bound; those are scored exactly.
2. Each positive opens a window of negative scores. Of other labels, vectors whose bounds meet the window, and whose upper bound reaches the
   third best lower bound among those that are certainly inside; those are scored exactly, and the best three inside complete the window.

Anchors are taken in blocks of about ANCHORS; a block goes to all tasks, encoded vectors stay where they lie and stream by. A task keeps
the few best of each anchor or window, and those of all tasks meet by anchor. Codebooks decide what is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

#: Fixed values of the contract: scale; anchors are ids divisible by EVERY; positives of an anchor, negatives of a window; per cent of the positive's score.
SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256.0, 50, 5, 3, 50, 95
#: Dimensions that share a code, centroids of each, rows that codebooks are fitted on at most, rounds of fitting.
GROUP, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 2048, 6
#: Anchors of a block, about; vectors of a chunk.
ANCHORS, CHUNK = 2048, 1024
#: The largest score that a long holds, and the sums up to which doubles are exact.
MOST, EXACT = 2**63 - 1, 2.0**53

ENCODED = "row long, vec_id long, label long, n int, q array<double>, codes binary, residual double"
FOUND = "anchor_row long, slot int, anchor_id long, positive_id long, positive_score long, row long, vec_id long, score long"


def components(vectors: DataFrame) -> DataFrame:
    """vec_id, label and quantised components as doubles of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    q = F.transform(x, lambda v: whole(v * SCALE))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))
    return rows.where(F.forall("q", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def relabelled(vectors: DataFrame, shift: int = 7, labels: int = 10) -> DataFrame:
    """``vectors`` where the label of ids divisible by ``shift`` is the next one."""
    label = F.col("label").cast("long")
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % shift == 0, (label + 1) % labels).otherwise(label).alias("label"))


# Codebooks: for each number of dimensions, an array (centroids, dimensions) for each group of dimensions.


def fit(sample: np.ndarray) -> list[np.ndarray]:
    """Centroids of each group of dimensions by Lloyd's rounds from evenly spaced rows; deterministic."""
    books = []
    for start in range(0, sample.shape[1], GROUP):
        x = sample[:, start : start + GROUP]
        x = x[np.lexsort(x.T[::-1])]
        c = x[np.linspace(0, len(x) - 1, min(CENTROIDS, len(x))).astype(int)].copy()
        for _ in range(ROUNDS):
            near = _nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            for d in range(x.shape[1]):
                total = np.bincount(near, x[:, d], len(c))
                c[n > 0, d] = total[n > 0] / n[n > 0]
        books.append(c)
    return books


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for s in range(0, len(x), 4096):
        out[s : s + 4096] = ((c * c).sum(1) - 2 * (x[s : s + 4096] @ c.T)).argmin(1)
    return out


def encode(x: np.ndarray, books: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, groups) and residual norms. Without codebooks there are no codes and the vector is its own residual."""
    if not books:
        return np.zeros((len(x), 0), np.uint8), np.sqrt((x * x).sum(1))
    codes, left = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x))
    for m, c in enumerate(books):
        part = x[:, m * GROUP : m * GROUP + c.shape[1]]
        codes[:, m] = _nearest(part, c)
        left += ((part - c[codes[:, m]]) ** 2).sum(1)
    return codes, np.sqrt(left)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


def encoded(vectors: DataFrame) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """All rows with their codes and residual norms, written once so that row numbers stay; and the codebooks by number of dimensions,
    fitted on at most SAMPLE rows."""
    rows = components(vectors)
    taken = rows.select("q").orderBy(F.xxhash64("q")).limit(SAMPLE).toArrow().column(0).to_pylist()
    by_length: dict[int, list] = {}
    for q in taken:
        by_length.setdefault(len(q), []).append(q)
    with np.errstate(all="ignore"):
        books = {n: fit(np.array(x, float)) for n, x in by_length.items() if n and np.abs(x).max() < 1e15}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column(3).to_pylist(), np.int64)
            for n in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == n))
                with np.errstate(all="ignore"):
                    codes, residual = encode(matrix(part.column(4), n), books.get(n))
                columns = [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residual, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "codes", "residual"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("q").alias("n"), "q")
    return spool(numbered.mapInArrow(run, ENCODED), "encoded"), books


def exact(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows as longs; beyond 64 bits, the largest or the least that fits."""
    if not len(a):
        return np.zeros(0, np.int64)
    dims = max(1, a.shape[1])
    with np.errstate(all="ignore"):
        safe = dims * np.abs(a).max(1, initial=0.0) * np.abs(x).max(1, initial=0.0) < EXACT
        out = np.where(safe, np.einsum("ij,ij->i", a, x), 0.0).astype(np.int64)
    for k in np.flatnonzero(~safe):
        out[k] = max(-MOST, min(MOST, sum(int(u) * int(v) for u, v in zip(a[k], x[k]))))
    return out


class Best:
    """The ``k`` best (score, then smaller id, then smaller row) of each key."""

    def __init__(self, keys: int, k: int):
        self.k, self.keys = k, keys
        self.held = [np.zeros(0, np.int64) for _ in range(4)]  # key, score, id, row
        self.floor = np.full(keys, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids, rows = (np.concatenate(x) for x in zip(self.held, (key, score, ids, rows)))
        order = np.lexsort((rows, ids, -score, key))
        key = key[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        keep = rank < self.k
        self.held = [key[keep], *(x[order][keep] for x in (score, ids, rows))]
        last = rank == self.k - 1
        self.floor[key[last]] = score[order][last]


class Anchors:
    """A block of anchors of one number of dimensions, with tables of products for one codebook."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, books: list[np.ndarray] | None):
        self.rows, self.ids, self.labels, self.q = rows, ids, labels, q
        with np.errstate(all="ignore"):
            self.norm = np.sqrt((q * q).sum(1))
            self.tables = [(c @ q[:, m * GROUP : m * GROUP + c.shape[1]].T).astype(np.float32) for m, c in enumerate(books or [])]
        self.by_label = {int(v): np.flatnonzero(labels == v) for v in np.unique(labels)}

    def bounds(self, which: np.ndarray | slice, rows: np.ndarray, x: np.ndarray, codes: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the scores of vectors (down) and the anchors ``which`` (across); an anchor is not a candidate of its own. Tables are
        single precision, whose error is far below the hundred-thousandth of both norms that is added."""
        norm = self.norm[which]
        with np.errstate(all="ignore"):
            about = np.zeros((len(x), len(norm)), np.float32)
            for m, t in enumerate(self.tables):
                about += t[:, which][codes[:, m]] if not isinstance(which, slice) else t[codes[:, m]]
            length = np.sqrt((x * x).sum(1))
            reach = np.outer(residual * (1 + 1e-6) + 1e-5 * (length + residual), norm) + 1e-3
            lower, upper = about - reach, about + reach
        lower[np.isnan(lower)], upper[np.isnan(upper)] = -np.inf, np.inf
        _, c, a = np.intersect1d(rows, self.rows[which], return_indices=True)
        lower[c, a], upper[c, a] = -np.inf, -np.inf
        return lower, upper


def _top(lower: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each column; minus infinity if there are fewer."""
    return np.partition(lower, len(lower) - k, axis=0)[len(lower) - k] if len(lower) >= k else np.full(lower.shape[1], -np.inf)


def add_positives(a: Anchors, best: Best, rows, ids, labels, x, codes, residual) -> int:
    """Rank a chunk's vectors among the positives of their label's anchors; the number of exact scores that took."""
    scored = 0
    for label, which in a.by_label.items():
        c = np.flatnonzero(labels == label)
        if not len(c):
            continue
        lower, upper = a.bounds(which, rows[c], x[c], codes[c], residual[c])
        floor = np.maximum(best.floor[which], _top(lower, best.k))
        i, j = np.nonzero((upper >= floor) & (upper > -np.inf))
        i, j = c[i], which[j]
        best.add(j, exact(a.q[j], x[i]), ids[i], rows[i])
        scored += len(i)
    return scored


def add_negatives(a: Anchors, low: np.ndarray, high: np.ndarray, best: Best, rows, ids, labels, x, codes, residual) -> int:
    """Rank a chunk's vectors in the windows ``low`` to ``high`` (anchors, slots; empty ones have low > high) of anchors of other
    labels; the number of exact scores that took."""
    slots, scored = low.shape[1], 0
    lower, upper = a.bounds(slice(None), rows, x, codes, residual)
    barred = (labels[:, None] == a.labels[None, :]) | (upper == -np.inf)
    lower[barred], upper[barred] = -np.inf, -np.inf
    wanted = np.zeros(lower.shape, bool)
    for s in range(slots):
        inside = np.where((lower >= low[:, s]) & (upper <= high[:, s]), lower, -np.inf)
        floor = np.maximum(np.maximum(best.floor.reshape(-1, slots)[:, s], _top(inside, best.k)), low[:, s])
        wanted |= (upper >= floor) & (lower <= high[:, s]) & (low[:, s] <= high[:, s])
    i, j = np.nonzero(wanted)
    for at in range(0, len(i), 1 << 16):
        ci, cj = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        score = exact(a.q[cj], x[ci])
        scored += len(ci)
        for s in range(slots):
            fits = (score >= low[cj, s]) & (score <= high[cj, s])
            best.add(cj[fits] * slots + s, score[fits], ids[ci[fits]], rows[ci[fits]])
    return scored


def windows(scores: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that is ``low`` to ``high`` per cent of each score; low > high if there is none."""
    least, most = (np.empty(scores.shape, object) for _ in range(2))
    for k, s in np.ndenumerate(scores):
        least[k], most[k] = -(-low * int(s) // 100), high * int(s) // 100
    return least.astype(np.int64), most.astype(np.int64)


def _stream(vectors: DataFrame, blocks, books: dict[int, list[np.ndarray]], k: int, windows_of) -> DataFrame:
    """FOUND of one pass of all encoded vectors by a broadcast block of anchors: by number of dimensions, its arrays and, for negatives, the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = blocks.value
        held = {n: Anchors(*arrays, books.get(n)) for n, arrays in block.items()}
        slots = {n: windows_of[n][0].shape[1] if windows_of else 1 for n in held}
        best = {n: Best(len(a.rows) * slots[n], k) for n, a in held.items()}
        for b in batches:
            lengths = np.asarray(b.column(3).to_pylist(), np.int64)
            for n in np.unique(lengths).tolist():
                if n not in held:
                    continue
                part = b.filter(pa.array(lengths == n))
                for at in range(0, part.num_rows, CHUNK):
                    p = part.slice(at, CHUNK)
                    rows, ids, labels, residual = (p.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 6))
                    codes = np.frombuffer(b"".join(p.column(5).to_pylist()), np.uint8).reshape(p.num_rows, -1) if n else np.zeros((p.num_rows, 0), np.uint8)
                    args = rows, ids, labels, matrix(p.column(4), n), codes, residual
                    add_negatives(held[n], *windows_of[n][:2], best[n], *args) if windows_of else add_positives(held[n], best[n], *args)
        for n, found in best.items():
            key, score, ids, rows = found.held
            who, slot = key // slots[n], key % slots[n]
            known = [windows_of[n][w][who, slot] if windows_of else np.zeros(len(key), np.int64) for w in (2, 3)]
            columns = [held[n].rows[who], slot.astype(np.int32), held[n].ids[who], *known, rows, ids, score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in FOUND.split(", ")])

    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return vectors.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows_of(block: dict[int, tuple], found: list, positives: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each number of dimensions: least and greatest score, id and score of the positive of each anchor's slots."""
    out = {}
    at = {int(r): (n, k) for n, (rows, *_) in block.items() for k, r in enumerate(rows)}
    for n, (rows, *_) in block.items():
        out[n] = np.ones((len(rows), positives), np.int64), np.zeros((len(rows), positives), np.int64), np.zeros((len(rows), positives), np.int64), np.zeros((len(rows), positives), np.int64)
    for r in found:
        n, k = at[r["anchor_row"]]
        low, high = windows(np.array([r["score"]]))
        for a, v in zip(out[n], (low[0], high[0], r["vec_id"], r["score"])):
            a[k, r["rank"] - 1] = v
    return out


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of ``vectors(vec_id, embedding, label)``: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``; their positives are the first ``positives`` other rows of the same label by
    score, ties by smaller id; each positive's negatives are the first ``negatives`` rows of other labels whose score is LOW to HIGH per cent of the positive's.
    Rows with a null id, label or vector, or a component that is null or not finite (before or after scaling), take no part. Rows
    that repeat an id or a vector are rows of their own; repeated anchors have their results each. Vectors of different length are not
    compared; those without components score 0 with their like. A positive whose score is negative has no negatives. Scores beyond 64
    bits count as the largest, or least, number that fits. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows, books = encoded(vectors)
    asks = rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "n", "q")
    blocks = max(1, -(-asks.count() // ANCHORS))
    asks = spool(asks.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).repartition("block"), "anchors") if blocks > 1 else asks.withColumn("block", F.lit(0))
    out = []
    for k in range(blocks):
        taken = asks.where(F.col("block") == k).drop("block").toArrow()
        block = {}
        for n in set(taken.column("n").to_pylist()):
            t = taken.filter(pa.array(np.asarray(taken.column("n")) == n)).combine_chunks()
            block[n] = (*(np.asarray(t.column(c)) for c in ("row", "vec_id", "label")), matrix(t.column("q").combine_chunks(), n))
        told = spark.sparkContext.broadcast(block)
        best = _stream(rows, told, books, positives, None).select("anchor_row", "vec_id", "score", "rank").collect()  # at most ``positives`` for each anchor of the block
        found = _stream(rows, told, books, negatives, _windows_of(block, best, positives))
        out.append(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        if blocks > 1:
            out[-1] = spool(out[-1], "negatives")
            told.unpersist()
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def oracle() -> str:
    return f"""
    with v as (select row_number() over (order by vec_id) as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as q
               from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.row as anchor, a.vec_id as anchor_id, b.row, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.row <> b.row and len(a.q) = len(b.q) where a.vec_id % {EVERY} = 0),
    p as (select * from s where same qualify row_number() over (partition by anchor order by score desc, vec_id, row) <= {POSITIVES}),
    w as (select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score, (row_number() over (partition by p.anchor, p.row order by s.score desc, s.vec_id, s.row))::int as rank
          from p join s on s.anchor = p.anchor and not s.same and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from w where rank <= {NEGATIVES}
    """
