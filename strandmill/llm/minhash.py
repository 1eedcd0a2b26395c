"""Near-duplicate components: a multi-index Hamming join over b-bit min-hash signatures, confirmed on full sets.

1. Every text becomes its set of word shingles, a print of the set and a signature of SYMBOLS symbols.
   Documents with equal sets form a class; only one of each class goes on, so thousands of copies cost as
   much as one.
2. Signatures differ in at most DISTANCE symbols for pairs at the threshold (a pair of similarity 0.75 differs in
   more with probability 1.2e-5). They are split into CHUNKS chunks. By the pigeonhole principle such a
   pair has a chunk with at most ERRORS errors, since CHUNKS * (ERRORS + 1) > DISTANCE; every chunk is therefore entered
   into an index once for each way to leave ERRORS symbols out, and every such pair shares a key.
3. A key's classes are not expanded into pairs. Each is first compared with the least one of the key
   (a star), the best of its stars only; confirmed links give components. What then still shares a key across two
   components is compared by signature, in blocks of bounded size, and the classes that are left with a pair
   within DISTANCE are compared on full sets, again in blocks, each pair in the first key that it shares. Classes of the component that
   is a large key's main one only meet the others, block by block. Pairs inside one component need no look, as they can't change it, and a block tells only of links that join
   components. So no step hands on pairs in a number that grows with the square of a group.
4. Links are confirmed on full sets, recomputed from the texts of the candidates alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, of_ids, spool, told_join
from .components import connected_components
from .shingles import SYMBOLS, multipliers, prints, shingle_sets, signatures
from .words import mixed

PERCENT = 75
DISTANCE, CHUNKS, ERRORS = 22, 12, 1
#: Classes of a key that are compared in one block; larger keys are cut into blocks.
BLOCK = 1024
#: Keys whose cuts are told to their rows by broadcast; more are joined by key, as their rows are short and a broadcast takes the driver's memory.
KEYS = 20_000
#: Shingles of a block's full sets, about, and pairs of one pivot that are confirmed together.
SET_BLOCK, PIVOT = 1 << 20, 1000


def chunk_keys(symbols: int = SYMBOLS, chunks: int = CHUNKS, errors: int = ERRORS, distance: int = DISTANCE) -> list[tuple[int, ...]]:
    """The symbols of each index key: every chunk, without each choice of ``errors`` of its symbols."""
    if chunks * (errors + 1) <= distance:
        raise ValueError("so few chunks and errors don't reach every pair within the distance")
    bounds = np.linspace(0, symbols, chunks + 1).round().astype(int)
    return [kept for a, b in zip(bounds[:-1], bounds[1:]) for kept in combinations(range(a, b), max(1, b - a - errors))]


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), p1 and p2 (the set's print), sig (SYMBOLS 16-bit symbols) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers()
        for b in batches:
            for row, end, hashes, offsets in shingle_sets(b.column(1)):
                sig = signatures(hashes, offsets, factors)
                p1, p2 = prints(hashes, offsets)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, end - row), pa.array(np.diff(offsets)), pa.array(p1), pa.array(p2), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "n", "p1", "p2", "sig"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, p1 long, p2 long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SYMBOLS)


def index(classes: DataFrame) -> DataFrame:
    """(key, rep) for every class and key."""
    kept = chunk_keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sig, reps = _matrix(part.column(1)), part.column(0).to_numpy()
                keys = np.empty((len(kept), len(reps)), np.uint64)
                for k, symbols in enumerate(kept):
                    key = np.full(len(reps), k + 1, np.uint64)
                    for s in symbols:
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, s].astype(np.uint64))
                    keys[k] = (key & ~np.uint64(63)) | np.uint64(k)  # which key it is, in its last bits
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(reps, len(kept)))], ["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def stars(keys: DataFrame) -> DataFrame:
    """(key, rep, pivot) for the keys of two or more classes; the pivot is the least of the key. Pivots are partial minima, joined
    back to the keys' rows; those of keys of very many classes go to the rows instead, so such a key is dealt over tasks."""
    pivots = spool(keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("m")).where("m > 1"), "pivots")
    return told_join(keys, pivots, "key", "m").select("key", "rep", "pivot")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose full sets reach ``percent``: 100 * intersection >= percent * union. Pairs of a popular ``a``
    are dealt over slots of PIVOT pairs, each of which gets its text once."""
    pairs = spool(pairs, "pairs")
    ends = spool(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    texts = spool(of_ids(texts, ends), "texts")
    popular = spool(pairs.groupBy("a").count().where(F.col("count") > PIVOT).select("a", F.ceil(F.col("count") / PIVOT).alias("slots")), "popular")
    slots = F.coalesce("slots", F.lit(1).cast("long"))
    dealt = lookup_join(pairs, popular, "a").select("a", "b", F.pmod(F.xxhash64("b"), slots).alias("slot"))
    pivots = texts.join(pairs.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").toDF("a", "text_a")
    pivots = lookup_join(pivots, popular, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("slot"))
    both = dealt.join(texts.toDF("b", "text_b"), "b").join(pivots, ["a", "slot"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [[h[o[r] : o[r + 1]] for _, _, h, o in shingle_sets(part.column(c)) for r in range(len(o) - 1)] for c in (2, 3)]
                keep = []
                for x, y in zip(*sets):
                    common = 0
                    if len(x) and len(y):
                        at_y = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        common = int((y[at_y] == x).sum())
                    keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return spool(both.mapInArrow(run, "a long, b long").distinct(), "confirmed")


def _wrong(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of signatures, the symbols that differ as the bits of a number."""
    bits = np.packbits(a != b, axis=1, bitorder="little")
    return np.pad(bits, ((0, 0), (0, 8 - bits.shape[1]))).view(np.uint64)[:, 0]


def owned_pairs(group: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (p, q) of the pairs of a key's block that are to be settled there: of different components, within the
    bound that their sizes set and within DISTANCE, and with no earlier key in common."""
    c, n, sig, mine, k = group["c"], group["n"], group["sig"], group["mine"], int(group["key"][0] & 63)
    masks = [np.uint64(sum(1 << s for s in kept)) for kept in chunk_keys()[:k]]
    for at in range(0, len(c), 256):
        rows = slice(at, at + 256)
        near = (c[rows, None] < c[None, :]) & (100 * np.minimum(n[rows, None], n[None, :]) >= PERCENT * np.maximum(n[rows, None], n[None, :]))
        if group["i"][0] != group["j"][0]:
            near &= mine[rows, None] != mine[None, :]
        x, y = np.nonzero(near)
        for part in range(0, len(x), 1 << 16):
            p, q = x[part : part + (1 << 16)] + at, y[part : part + (1 << 16)]
            wrong = _wrong(sig[p], sig[q])
            mine_to_settle = np.bitwise_count(wrong) <= DISTANCE
            for m in masks:
                mine_to_settle &= (wrong & m) != 0
            yield p[mine_to_settle], q[mine_to_settle]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The blocks of keys, one after the other, of rows that are sorted by key, i and j."""

    def whole(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        out = {k: t.column(k).to_numpy() for k in t.column_names if k not in ("sig", "set")}
        out["sig"] = _matrix(t.column("sig"))
        if "set" in t.column_names:
            out["set"] = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        return out

    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key, i, j = (b.column(k).to_numpy() for k in range(3))
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1), b.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            now = (key[start], i[start], j[start])
            if held and now != last:
                yield whole(held)
                held = []
            held.append(b.slice(start, end - start))
            last = now
    if held:
        yield whole(held)


def _cuts(rows: DataFrame) -> DataFrame:
    """(key, main, large, small) of the keys of ``rows(key, c, m, total)`` that two or more components share: how classes of the key are cut
    into blocks. Classes of its main component, if the key is more than one block, are never compared with each other, only with the rest."""
    by = rows.groupBy("key", "c").agg(F.sum("m").alias("m"), F.sum("total").alias("total"))
    top = F.max(F.struct("m", "total", "c")).alias("top")
    keys = by.groupBy("key").agg(top, F.sum("m").alias("m"), F.sum("total").alias("total"), F.count("*").alias("components")).where("components > 1")
    blocks = lambda m, total: F.ceil(F.greatest(m / BLOCK, total / SET_BLOCK)).cast("int")
    many = blocks(F.col("m"), F.col("total")) > 1
    return keys.select(
        "key",
        F.when(many, F.col("top")["c"]).alias("main"),
        F.when(many, blocks(F.col("top")["m"], F.col("top")["total"])).otherwise(0).alias("large"),
        F.greatest(F.lit(1), blocks(F.col("m") - F.when(many, F.col("top")["m"]).otherwise(0), F.col("total") - F.when(many, F.col("top")["total"]).otherwise(0))).alias("small"),
    )


def _blocked(rows: DataFrame, keys: DataFrame, more: DataFrame, columns: list[str]) -> DataFrame:
    """``rows(key, rep, …)`` dealt out in blocks of their keys, with what ``more`` has of each class, in order.

    ``keys`` comes from _cuts. Blocks of the rest, numbered from 0, meet each other and themselves; blocks of the main component, numbered down from -1, meet
    those of the rest. So a key of one large component and few other classes is handed on about twice, however large it is.
    """
    rows = lookup_join(rows, spool(keys, "keys"), "key", "inner", most=KEYS)
    inside = F.coalesce(F.col("c") == F.col("main"), F.lit(False))
    at = F.pmod(F.xxhash64("rep"), F.when(inside, F.col("large")).otherwise(F.col("small"))).cast("int")
    rows = rows.withColumn("mine", F.when(inside, -1 - at).otherwise(at))
    rest, main = F.sequence(F.lit(0), F.col("small") - 1), F.when(F.col("large") > 0, F.sequence(-F.col("large"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("other", F.explode(F.when(inside, rest).otherwise(F.concat(rest, main))))
    rows = rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other", "main", "large", "small")
    # A fixed number of partitions, as comparing takes far longer than the bytes of a partition suggest.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(more, "rep").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "c", "rep")
    return dealt.select("key", "i", "j", "mine", "rep", "c", "n", "sig", *columns)


def unsettled(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, rep) of the classes that have a pair to settle in that key: see owned_pairs. ``named(key, rep, c)``."""
    keys = _cuts(named.select("key", "c", F.lit(1).alias("m"), F.lit(0).alias("total")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            open_rows = np.zeros(len(group["rep"]), bool)
            for p, q in owned_pairs(group):
                open_rows[p] = open_rows[q] = True
            if open_rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(group["key"][open_rows]), pa.array(group["rep"][open_rows])], ["key", "rep"])

    return spool(_blocked(named, keys, classes.select("rep", "n", "sig"), []).mapInArrow(run, "key long, rep long").distinct(), "unsettled")


def full_sets(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, set): the sorted 64-bit hashes of the shingles of each of ``reps(doc_id)``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for row, end, hashes, offsets in shingle_sets(b.column(1)):
                sets = [hashes[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array(sets, pa.binary())], ["rep", "set"])

    return spool(of_ids(texts, reps, run, "rep long, set binary"), "sets")


def settled(named: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): confirmed links that join the components of ``named(key, rep, c)`` as all pairs that share a key would.

    Pairs are compared in the blocks of their keys, on full sets, and a block only tells of links that join what it has
    not joined yet; so what comes out grows with the classes, not with their pairs.
    """
    rows = unsettled(named, classes)
    sets = full_sets(spool(rows.select(F.col("rep").alias("doc_id")).distinct(), "ends"), docs)
    rows = spool(rows.join(named.select("rep", "c").distinct(), "rep").select("key", "rep", "c"), "open")
    keys = _cuts(rows.join(classes.select("rep", "n"), "rep").select("key", "c", F.lit(1).alias("m"), F.col("n").alias("total")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            rep, c, sets = group["rep"], group["c"], group["set"]
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while parent.get(x, x) != x:
                    parent[x] = x = parent.get(parent[x], parent[x])
                return x

            values, codes = np.unique(np.concatenate(sets), return_inverse=True)
            codes = np.split(codes, np.cumsum([len(s) for s in sets])[:-1])
            marked, found = np.zeros(len(values), np.int64), []
            for p, q in owned_pairs(group):
                for x, partners in zip(*_runs(p, q)):
                    partners = [y for y in partners if find(c[x]) != find(c[y])]
                    if not partners:
                        continue
                    marked[codes[x]] = 1
                    for y in partners:
                        common = int(marked[codes[y]].sum())
                        if 100 * common >= PERCENT * (len(codes[x]) + len(codes[y]) - common) and find(c[x]) != find(c[y]):
                            parent[find(c[x])] = find(c[y])
                            found.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
                    marked[codes[x]] = 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return spool(_blocked(rows, keys, classes.select("rep", "n", "sig").join(sets, "rep"), ["set"]).mapInArrow(run, "a long, b long").distinct(), "settled")


def _runs(p: np.ndarray, q: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """The rows of p, each once, and their partners in q; p is sorted."""
    heads = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, int)
    return p[heads].tolist(), [x.tolist() for x in np.split(q, heads[1:])] if len(p) else []


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of near duplicates of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Texts are compared by their sets of five-word shingles, A-Z lower-cased; a text of fewer words has its
    word sequence as its one shingle. Null texts and texts without words have n_shingles 0 and link with nothing.
    Documents with equal sets are linked. component_id is the least id that a document reaches; kept
    says that it is its own. A row with a null id is kept and has a null component. Ids should be
    unique; repeated rows have equal results, and classes whose least id is the same count as one. Other
    columns are ignored. An empty table gives an empty result.
    """
    rows = spool(signed(docs), "signed")
    # Equal sets have equal signatures, so any of a class will do.
    classes = spool(rows.where("n > 0 and doc_id is not null").groupBy("p1", "p2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("sig").alias("sig"), F.count("*").alias("copies")), "classes")
    hits = spool(stars(index(classes)), "hits")

    star = hits.where("rep <> pivot").groupBy("rep", "pivot").count()
    best = star.groupBy("rep").agg(F.max(F.struct("count", -F.col("pivot"))).alias("best")).select(F.col("rep").alias("b"), (-F.col("best")["col2"]).alias("a"))
    links = confirmed(best.select("a", "b"), docs)
    component = spool(connected_components(links).toDF("rep", "component"), "component")

    named = spool(hits.select("key", "rep").join(component, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c")), "named")
    links = links.union(settled(named, classes, docs))
    component = spool(connected_components(links).toDF("rep", "component"), "component")

    # Copies of one text, however many, are told their class; rows without words or id have none.
    both = F.struct("p1", "p2").alias("print")
    fate = spool(classes.join(component, "rep", "left").select(both, "copies", F.coalesce("component", "rep").alias("least")), "fate")
    classed = F.coalesce((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    judged = told_join(rows.where(classed).select("doc_id", "n", both), fate, "print", "copies").drop("print")
    judged = judged.unionByName(rows.where(~classed).select("doc_id", "n", F.lit(None).cast("long").alias("least")))
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id"))
    return judged.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not kept: of each component the least id stays. Columns are
    those of ``docs``; rows with a null id stay, and so do rows that repeat an id that stays."""
    gone = spool(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__sm_id")).distinct(), "gone")
    return lookup_join(docs.withColumn("__sm_id", F.col("doc_id").cast("long")), gone, "__sm_id", "left_anti").drop("__sm_id")
