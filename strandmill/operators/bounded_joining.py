"""Neighbour joining that reads few cells: rows sorted by distance, and a bound on what a row can hold.

In a step with m nodes beside the pair, pair (i, j) has the value m d(i, j) - r(i) - r(j), r being sums of rows. No pair of row i is below m d - r(i) - max r for the least
distance d of the row, so rows whose bound is above the best value found are not read, and a row is read only as far as its distances can still matter
(as in RapidNJ, Simonsen, Mailund and Pedersen, 2008). Rows are never rewritten: a joined node gets a row of its own with its distances to the nodes that are left,
and entries of nodes that are gone are passed over. What the driver holds is a few numbers for each node; distances stay in files.

Distances are whole multiples of 1e-12, so sums are exact and ties go by number: of equal pairs the first in order is joined, and the joined node goes by the smaller number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_folder

#: Distances are kept in units of 1 / UNIT; rows that are searched first in a step.
UNIT, FIRST = 10**12, 64
ROW = "node int, d array<long>, j array<int>"
FOUND = "q long, i int, j int, d long, a int, b int, cells long"


def _search(rows: DataFrame, wanted: list[int], m: int, sums: np.ndarray, number: np.ndarray, alive: np.ndarray, best: int) -> tuple[tuple | None, int]:
    """The least (value, greater number, smaller number, distance, nodes) in the ``wanted`` rows that is not above ``best``; and how many cells were read."""
    told = rows.sparkSession.sparkContext.broadcast((sums, number, alive, int(sums[alive].max())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, no, there, most = told.value
        for b in batches:
            out = []
            for node, d, j in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                d, j = d.values.to_numpy(), j.values.to_numpy()
                own, read, found = int(r[node]), 0, None
                limit, at, step = best, 0, 4
                while at < len(d) and m * int(d[at]) - own - most <= limit:
                    part = slice(at, at + step)
                    read += len(d[part])
                    keep = there[j[part]]
                    dd, jj = d[part][keep], j[part][keep]
                    if len(dd):
                        q = m * dd - own - r[jj]
                        low = int(q.min())
                        if low <= limit:
                            for k in np.flatnonzero(q == low).tolist():
                                x, y = int(no[node]), int(no[jj[k]])
                                key = (low, max(x, y), min(x, y), int(dd[k]), node if x > y else int(jj[k]), int(jj[k]) if x > y else node)
                                found = key if found is None or key < found else found
                            limit = low
                    at, step = at + step, step * 2
                out.append((*(found or (None,) * 6), read))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()])], [c.split()[0] for c in FOUND.split(", ")])

    got = rows.where(F.col("node").isin(wanted)).mapInArrow(run, FOUND).agg(F.min(F.when(F.col("q").isNotNull(), F.struct("q", "i", "j", "d", "a", "b"))), F.sum("cells")).first()
    told.unpersist()
    return (tuple(got[0]) if got[0] else None), int(got[1] or 0)


def _distances(rows: DataFrame, a: int, b: int, alive: np.ndarray) -> tuple[dict[int, int], dict[int, int]]:
    """The distances of a and b to the nodes that are there: from their own rows, and from those of nodes made later."""
    later = [int(k) for k in np.flatnonzero(alive) if k > min(a, b)]
    cells = rows.where(F.col("node").isin([a, b, *later])).select("node", F.explode(F.arrays_zip("d", "j")).alias("c")).select("node", "c.j", "c.d")
    found: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in cells.where(F.col("node").isin(a, b) | F.col("j").isin(a, b)).collect():  # two rows at most
        for k, x in enumerate((a, b)):
            if x in (r["node"], r["j"]):
                other = r["j"] if r["node"] == x else r["node"]
                if alive[other]:
                    found[k][other] = r["d"]
    return found


def join_neighbours(cells: DataFrame, n: int) -> tuple[list[tuple[int, int, float, float]], float, tuple[int, int], int]:
    """Join the n leaves of ``cells(i, j, d)``, all i <> j in both directions: joins (the nodes that are joined, with the greater number first, and their branch lengths), leaves being nodes 0 to
    n - 1 and the k-th join node n + k; the distance of the last two nodes; these two; and the number of cells that searches read."""
    spark, path = cells.sparkSession, work_folder(cells.sparkSession, "rows")
    fixed = cells.select("i", "j", F.round(F.col("d").cast("double") * UNIT).cast("long").alias("d"))
    entry = F.array_sort(F.collect_list(F.struct("d", "j")))
    fixed.groupBy(F.col("i").alias("node")).agg(entry.alias("e")).select("node", F.col("e.d").alias("d"), F.col("e.j").alias("j")).write.parquet(path)
    read = lambda: spark.read.schema(ROW).parquet(path)
    sums, least, number, alive = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64), np.zeros(2 * n, bool)
    number[:n], alive[:n] = np.arange(n), True
    for r in read().select("node", F.aggregate("d", F.lit(0).cast("long"), lambda x, y: x + y).alias("r"), F.col("d")[0].alias("least"), F.array_max("d").alias("most")).collect():
        if n * abs(r["most"]) >= 2**61 or n * abs(r["least"]) >= 2**61:
            raise ValueError("distances are too large for their number")
        sums[r["node"]], least[r["node"]] = r["r"], r["least"]
    joins, searched = [], 0
    while len(joins) < n - 2:
        m, rows = n - len(joins) - 2, read()
        nodes = np.flatnonzero(alive)
        bound = m * least[nodes] - sums[nodes] - sums[nodes].max()
        first = [int(nodes[k]) for k in heapq.nsmallest(FIRST, range(len(nodes)), key=lambda k: (bound[k], k))]
        best, cells_read = _search(rows, first, m, sums, number, alive, 2**62)
        searched += cells_read
        asked = set(first)
        rest = [int(x) for x, b in zip(nodes, bound) if int(x) not in asked and b <= best[0]]
        if rest:
            more, cells_read = _search(rows, rest, m, sums, number, alive, best[0])
            searched += cells_read
            best = min(best, more) if more else best
        _, _, _, d, a, b = best
        of_a, of_b = _distances(rows, a, b, alive)
        length = (d + (int(sums[a]) - int(sums[b])) / m) / 2 / UNIT
        joins.append((a, b, length, d / UNIT - length))
        alive[a] = alive[b] = False
        new = n + len(joins) - 1
        made = sorted(((of_a[k] + of_b[k] - d + 1) // 2, k) for k in map(int, np.flatnonzero(alive)))
        for x, k in made:
            sums[k] += x - of_a[k] - of_b[k]
        sums[new], least[new], number[new], alive[new] = sum(x for x, _ in made), made[0][0], min(number[a], number[b]), True
        spark.createDataFrame([(new, [x for x, _ in made], [k for _, k in made])], ROW).coalesce(1).write.mode("append").parquet(path)
    u, v = sorted(map(int, np.flatnonzero(alive)), key=lambda k: number[k]) if n > 1 else (0, 0)
    left = _distances(read(), u, v, alive)[0][v] / UNIT if n > 1 else 0.0
    return joins, left, (u, v), searched
