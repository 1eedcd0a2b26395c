"""Exact top-k inner products by columnar branch and bound.

Components are quantised to floor(scale * x). Queries are taken in blocks of bounded size; a block goes to all tasks and the
candidates, which stay where they lie, stream by. A task turns each chunk of candidates into vertical layout (a dimension after the
other, those first in which the queries have most mass); inner products grow block of dimensions by block, and after each block a
candidate survives only if its sum so far, plus the most that the remaining dimensions can add (product of the remaining
lengths of both vectors, Cauchy-Schwarz), still reaches the query's k-th best lower bound: that of the chunk, or the k-th best score that the
task has seen, which rises as candidates stream by. Survivors are compacted, so later blocks touch fewer columns. The k best of each task
meet by query: only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool
from .hard_negatives import EXACT, Best, exact, matrix

SCALE, EVERY, K = 256.0, 50, 5
#: Bytes of a block of queries, about: what the driver holds and tasks are told at a time. Candidates of a chunk, and queries whose first sums are made at once.
QUERY_BYTES, CHUNK, TILE = 16 << 20, 4096, 256
BLOCK = 8
FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def _floor(v: Column) -> Column:
    """floor(SCALE * v) as a double; from 2**53 on the product is a whole number as it is."""
    y = v * SCALE
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)


def quantised(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, n, q): a stable row number, the id, the number of components and the quantised components as doubles.

    Vectors that are null or hold null or non-finite components are left out. Written once, so that row
    numbers stay what they are.
    """
    x = F.col("embedding").cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("n"), F.transform(x, _floor).alias("q"))
    return spool(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


class Queries:
    """A block of queries of one number of dimensions, and the k best candidates of each so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, block: int = BLOCK):
        self.rows, self.ids, self.q, self.best, self.block = rows, ids, q, Best(len(rows), k), block
        with np.errstate(all="ignore"):
            self.order = np.argsort(-(q * q).sum(0), kind="stable")
            self.vertical = np.ascontiguousarray(q[:, self.order])
            self.starts = list(range(0, q.shape[1], block)) or [0]
            self.left = self._left(self.vertical.T)
        self.peak = np.abs(q).max(initial=0.0)

    def _left(self, columns: np.ndarray) -> list[np.ndarray]:
        """What lengths the vectors have left after each block of dimensions."""
        return [np.sqrt((columns[s:] ** 2).sum(0)) for s in [*self.starts[1:], len(columns)]]

    def meet(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> int:
        """Rank a chunk of candidates among the best; ties go to the smaller id, then row. Returns the number of sums that reached the last block.

        Sums of doubles are exact while they stay below 2**53. Beyond, bounds allow for rounding and for scores that no long
        holds, and survivors are scored with whole numbers.
        """
        with np.errstate(all="ignore"):
            columns = np.ascontiguousarray(x.T[self.order])
            left = self._left(columns)
            safe = max(1, x.shape[1]) * self.peak * np.abs(x).max(initial=0.0) < EXACT
            rough = None if safe else (x.shape[1] + 8) * 2.0**-52 * np.sqrt((x * x).sum(1))
            own = np.full(len(self.rows), -1)
            _, at, who = np.intersect1d(rows, self.rows, return_indices=True)
            own[who] = at
            found, reached = [], 0
            for t in range(0, len(self.rows), TILE):
                first = self.vertical[t : t + TILE, : self.block] @ columns[: self.block]
                for i in range(t, min(t + TILE, len(self.rows))):
                    alive, scores = self._survivors(i, own[i], first[i - t], columns, left, rough)
                    reached += len(alive)
                    scores = scores.astype(np.int64) if safe else exact(np.broadcast_to(self.q[i], (len(alive), x.shape[1])), x[alive])
                    top = np.lexsort((rows[alive], ids[alive], -scores))[: self.best.k]
                    found.append((np.full(len(top), i), scores[top], ids[alive[top]], rows[alive[top]]))
        if found:
            self.best.add(*(np.concatenate(c) for c in zip(*found)))
        return reached

    def _survivors(self, i: int, own: int, sums: np.ndarray, columns: np.ndarray, left: list[np.ndarray], rough: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the candidates that may be among query i's k best, and their sums. ``rough`` times the query's length bounds what rounding adds."""
        k, alive = self.best.k, np.arange(columns.shape[1])
        error = None if rough is None else rough * np.sqrt((self.q[i] ** 2).sum())
        if own >= 0:
            alive, sums = np.delete(alive, own), np.delete(sums, own)
        for b, s in enumerate(self.starts):
            if b:
                sums = sums + self.vertical[i, s : s + self.block] @ columns[s : s + self.block, alive]
            floor = self.best.floor[i]
            slack = self.left[b][i] * left[b][alive] * (1 + 1e-12) + 1e-6
            upper = sums + slack
            if error is not None:
                slack = slack + error[alive]
                upper = np.maximum(sums + slack, -(2.0**63))
            if len(alive) > k:
                lower = sums - slack
                lower[np.isnan(lower)] = -np.inf
                floor = max(floor, np.partition(lower, len(alive) - k)[len(alive) - k])
            if floor > -np.inf:
                stay = ~(upper < min(floor, 2.0**63 - 4096))
                alive, sums = alive[stay], sums[stay]
        return alive, sums


def _stream(rows: DataFrame, block, k: int) -> DataFrame:
    """The k best of each query of a broadcast block, by number of dimensions its (rows, ids, vectors), in one pass of all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: Queries(*arrays, k) for n, arrays in block.value.items()}
        for b in batches:
            lengths = b.column(2).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                if n not in held:
                    continue
                part = b.filter(pa.array(lengths == n))
                for at in range(0, part.num_rows, CHUNK):
                    p = part.slice(at, CHUNK)
                    held[n].meet(p.column(0).to_numpy(), p.column(1).to_numpy(), matrix(p.column(3), n))
        for q in held.values():
            who, score, ids, found = q.best.held
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q.rows[who], q.ids[who], found, ids, score)], [c.split()[0] for c in FOUND.split(", ")])

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return rows.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """For each row of ``vectors(vec_id, embedding)`` whose id is divisible by ``every``, its k best rows:
    query_id, rank (from 1), vec_id, score.

    Every other row is a candidate, rows that repeat the query's id or vector included; a row is left out of
    its own list only. Ties go to the smaller vec_id. Fewer than k candidates give fewer ranks. Vectors
    of different length are not compared. A vector of no components scores 0 with its like. Rows with a
    null id, null vectors and those with null or non-finite components take no part. A score beyond 64 bits counts as the
    largest number, or the least, that fits. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors)
    asks = rows.where(F.col("vec_id") % every == 0)
    size = asks.agg(F.coalesce(F.sum(F.col("n") * F.lit(8) + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // QUERY_BYTES))
    asks = spool(asks.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).repartition("block"), "queries") if blocks > 1 else asks.withColumn("block", F.lit(0))
    cores = spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) < cores:  # a table of few files: its candidates are dealt once, so that all cores take part
        rows = rows.repartition(cores, "row")
    out = []
    for b in range(blocks):
        taken = asks.where(F.col("block") == b).drop("block").toArrow()
        lengths = np.asarray(taken.column("n"))
        parts = ((n, taken.filter(pa.array(lengths == n)).combine_chunks()) for n in np.unique(lengths).tolist())
        told = spark.sparkContext.broadcast({n: (np.asarray(t.column("row")), np.asarray(t.column("vec_id")), matrix(t.column("q").combine_chunks(), n)) for n, t in parts})
        out.append(_stream(rows, told, k))
        if blocks > 1:
            out[-1] = spool(out[-1], "nearest")
            told.unpersist()
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def oracle(every: int = EVERY, k: int = K) -> str:
    sound = "embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
    return f"""
    with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q, row_number() over (order by vec_id) as row from embeddings where {sound}),
    s as (select a.row, a.vec_id as query_id, b.vec_id, list_inner_product(a.q::double[], b.q::double[])::bigint as score from v a join v b on a.row <> b.row and len(a.q) = len(b.q) where a.vec_id % {every} = 0),
    r as (select *, row_number() over (partition by row order by score desc, vec_id)::int as rank from s)
    select query_id, rank, vec_id, score from r where rank <= {k}
    """
