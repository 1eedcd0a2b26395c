"""Parsing of records that no task holds: stretches of bases, each parsed with as much of its neighbours as its cores depend on.

A record comes as pieces with coordinates. It is cut into windows of ``size`` bases; every window gets a halo of bases on either side by
one shuffle on (record, window), and is parsed level by level. At an edge that is not the record's own, runs that the cut may have changed are dropped at
each level, so what is left are consecutive cores of the whole record. A window owns the cores that start in it. If its halo was too short to settle
all of them, as in long repeats, it takes part in another round with a longer one; rounds end when no window is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .lcp import coded, parse_many

#: Bases of a window and of its first halo on either side; how much longer the halo of an open window gets.
SIZE, HALO, GROWTH = 1 << 20, 4096, 4
#: Bases of the windows that a task parses together, about.
TOGETHER = 1 << 20


def pieces_of(sequences: DataFrame, size: int = SIZE) -> DataFrame:
    """``sequences(…, seq)`` as pieces: all columns but seq, at (first base), part (bases) and length (of the record)."""
    keep = [c for c in sequences.columns if c != "seq"]
    long = sequences.where("seq <> ''").withColumn("length", F.length("seq").cast("long"))
    cut = long.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    return cut.select(*keep, "at", F.substring("seq", F.col("at").cast("int") + 1, F.lit(size)).alias("part"), "length")


def windows_of(pieces: DataFrame, size: int, halo: int, only: DataFrame | None = None) -> DataFrame:
    """(keys …, window, begins, bases, length): the bases of every window and ``halo`` more on either side. Pieces may be of any size and need not
    meet windows' edges; with ``only(keys …, window)`` just those windows are made."""
    keys = [c for c in pieces.columns if c not in ("at", "part", "length")]
    last = F.floor((F.col("length") - 1) / size)
    near = lambda base: F.least(F.greatest(F.floor(base / size), F.lit(0)), last)
    ends = F.col("at") + F.length("part")
    dealt = pieces.withColumn("window", F.explode(F.sequence(near(F.col("at") - halo), near(ends - 1 + halo))))
    if only is not None:  # keys may be null
        told = only.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "window")])
        same = F.lit(True)
        for c in (*keys, "window"):
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        dealt = dealt.join(told, same, "left_semi")
    begin = F.greatest(F.col("at"), F.col("window") * size - halo)
    end = F.least(ends, (F.col("window") + 1) * size + halo)
    part = F.expr("substring(part, cast(begin - at + 1 as int), cast(end - begin as int))")
    parts = dealt.withColumn("begin", begin).withColumn("end", end).where("begin < end").select(*keys, "window", "length", F.struct("begin", part.alias("part")).alias("piece"))
    whole = parts.groupBy(*keys, "window").agg(F.first("length").alias("length"), F.array_sort(F.collect_list("piece")).alias("got"))
    return whole.select(*keys, "window", F.col("got")[0]["begin"].alias("begins"), F.array_join(F.transform("got", lambda p: p["part"]), "").alias("bases"), "length")


def parse_windows(bases: list[str], level: int, low: np.ndarray, high: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, end, label) of the cores that start in ``low`` to ``high`` of many stretches, coordinates in each, and which stretches do not settle all of theirs, of which
    there are none. ``left`` and ``right`` tell whether a stretch's ends are the record's own. All stretches are parsed together."""
    texts = [t.encode("latin-1", "replace") for t in bases]
    x = coded(b"\n".join(texts))
    size = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(size + 1) - size - 1
    edges = np.flatnonzero(np.diff(np.concatenate([[True], x == 4, [True]]).astype(np.int8))).reshape(-1, 2)
    a, b = edges[:, 0], edges[:, 1]
    of = np.searchsorted(begins, a, "right") - 1
    cut = (a == begins[of]) & ~left[of], (b == begins[of] + size[of]) & ~right[of]
    good = x != 4
    start, end, label = parse_many(x[good], np.flatnonzero(good), np.repeat(np.arange(len(a)), b - a), level, cut)
    # A segment that its stretch cuts has to reach from what the window owns of it to its end.
    which = np.searchsorted(a, start, "right") - 1
    first, last = np.searchsorted(which, np.arange(len(a)), "left"), np.searchsorted(which, np.arange(len(a)), "right") - 1
    none, own_low, own_high = last < first, (begins + low)[of], (begins + high)[of]
    told = np.concatenate([start, [0]])
    short = (cut[0] & (none | (told[first] > np.maximum(own_low, a)))) | (cut[1] & (none | (told[last] < np.minimum(own_high, b) - 1)))
    is_open = np.zeros(len(texts), bool)
    is_open[of[short & (b > own_low) & (a < own_high)]] = True
    window = of[which]
    mine = (start >= (begins + low)[window]) & (start < (begins + high)[window]) & ~is_open[window]
    window, start, end, label = window[mine], start[mine], end[mine], label[mine]
    return window, start - begins[window], end - begins[window], label, is_open


def parse_open(codes: np.ndarray, level: int, left: bool, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, label) of consecutive cores of the segment that ``codes`` is a stretch of, as many as the stretch settles. ``left`` and ``right`` tell
    whether its ends are the segment's own."""
    return parse_many(codes, np.arange(len(codes)), np.zeros(len(codes), np.int64), level, (np.array([not left]), np.array([not right])))


def parse_window(bases: str, level: int, low: int, high: int, left: bool, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """parse_windows of one stretch; None if it does not settle all cores that start in ``low`` to ``high``."""
    _, start, end, label, is_open = parse_windows([bases], level, *(np.array([v]) for v in (low, high, left, right)))
    return None if is_open[0] else (start, end, label)


def cores_of_pieces(pieces: DataFrame, level: int = 1, size: int = SIZE, halo: int = HALO) -> DataFrame:
    """Cores of records that come as ``pieces(keys …, at, part, length)``: keys, start, end, label, len; the same as ``lcp.cores`` gives for the
    whole records. A task holds a window and its halo, whatever a record's length.

    Each round parses the windows that are still open and is written to the shared folder. Keys may be null; records without
    bases have no cores; an empty table gives an empty result.
    """
    if level < 1 or size < 1 or halo < 1:
        raise ValueError("level, size and halo start at 1")
    keys = [c for c in pieces.columns if c not in ("at", "part", "length")]

    def run(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            window, begin, length = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("window", "begins", "length"))
            bases = b.column(b.schema.get_field_index("bases"))
            held = pc.binary_length(bases).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(held) // TOGETHER)) + 1).tolist(), b.num_rows]
            for p, q in zip(cuts[:-1], cuts[1:]):
                if p == q:
                    continue
                at, texts = begin[p:q], bases.slice(p, q - p).to_pylist()
                low, high = window[p:q] * size - at, np.minimum((window[p:q] + 1) * size, length[p:q]) - at
                k, start, end, label, is_open = parse_windows(texts, level, low, high, at == 0, at + [len(t) for t in texts] == length[p:q])
                todo = np.flatnonzero(is_open)  # a row without a core for each
                core = np.arange(len(k) + len(todo)) >= len(k)
                rows = np.concatenate([k, todo])
                long = [pa.array(np.concatenate([v, np.zeros(len(todo), np.int64)]), pa.int64(), mask=core) for v in (start + at[k], end + at[k], label)]
                lens = pa.array(np.concatenate([end - start, np.zeros(len(todo), np.int64)]).astype(np.int32), mask=core)
                own = [b.column(b.schema.get_field_index(c)).take(pa.array(rows + p)) for c in (*keys, "window")]
                yield pa.RecordBatch.from_arrays([*own, *long, lens], [*keys, "window", "start", "end", "label", "len"])

    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{kinds}, window long, start long, end long, label long, len int"
    out, todo = None, None
    while True:
        windows = windows_of(pieces, size, halo, todo)
        round_ = stored(windows.mapInArrow(lambda it, reach=halo: run(it, reach), schema), "cores")
        found = round_.where("start is not null").drop("window")
        out = found if out is None else out.unionByName(found)
        todo = round_.where("start is null").select(*keys, "window")
        if todo.isEmpty():
            return out
        halo *= GROWTH
