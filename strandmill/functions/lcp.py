"""Locally consistent parsing of sequences into cores (Cole and Vishkin; Sahinalp and Vishkin).

Symbols are ordered A < C < G < T. A core is a run of equal symbols or a single local minimum with its
two neighbours, or a local maximum with neighbours that are not minima themselves; what two consecutive cores
leave between them is a core of its own, one symbol over either edge. No core is forced at the ends, and
fewer than three symbols give none. For the next level each core's label is reduced against its left
neighbour by deterministic coin tossing, and the reduced symbols are parsed in the same way. Other letters
than ACGT end a segment; no core crosses them. Coordinates count bases, whatever the level.

Both forms here give equal cores: arrays in numpy for any level, and window functions for level 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Symbol codes, and the reduced symbol of equal neighbours.
CODES, EQUAL = {"A": 0, "C": 1, "G": 2, "T": 3}, 120
#: Bases that are parsed at a time.
CHUNK = 1 << 18
CORE_FIELDS = "start long, end long, label long, len int"


def labels_of(content: np.ndarray) -> np.ndarray:
    """60 bits of an MD5 over each row of ``content``: a core's first and second token, their number and its last token."""
    told = b"".join(hashlib.md5(b"%d|%d|%d|%d" % (a, b, n, z)).digest() for a, b, n, z in content.tolist())
    return (np.frombuffer(told, ">u8")[::2] >> np.uint64(4)).astype(np.int64)


def distinct_rows(content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row of whole numbers stands once, and which of these each row equals. Rows are sorted by a 64-bit mix of their
    columns; should two unlike rows share a mix, by all columns."""
    mix = np.zeros(len(content), np.uint64)
    for column in content.T:
        mix = (mix ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    _, one, which = np.unique(mix, return_index=True, return_inverse=True)
    if not np.array_equal(content[one[which]], content):
        _, one, which = np.unique(content, axis=0, return_index=True, return_inverse=True)
    return one, which.ravel()


def run_cores(x: np.ndarray, segment: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs of equal symbols, their sizes, and the runs that make a core of their own.

    ``segment`` numbers the sequences that ``x`` holds one after the other; nothing crosses from one to the next.
    """
    if not len(x):
        return (np.zeros(0, np.int64),) * 3
    change = x[1:] != x[:-1]
    if segment is not None:
        change |= segment[1:] != segment[:-1]
    starts = np.concatenate([[0], np.flatnonzero(change) + 1])
    s, size = x[starts].astype(np.int64), np.diff(np.concatenate([starts, [len(x)]]))
    if len(starts) < 3:
        return starts, size, np.zeros(0, np.int64)
    same = np.ones(len(s) - 1, bool) if segment is None else segment[starts[1:]] == segment[starts[:-1]]
    inside, low, high = same[:-1] & same[1:], np.zeros(len(s), bool), np.zeros(len(s), bool)
    low[1:-1] = inside & ((size[1:-1] >= 2) | ((s[:-2] > s[1:-1]) & (s[1:-1] < s[2:])))
    # A neighbour of a maximum is no minimum if it repeats, or if the symbol beyond it is smaller.
    left, right = size >= 2, size >= 2
    left[1:] |= same & (s[:-1] < s[1:])
    right[:-1] |= same & (s[1:] < s[:-1])
    high[1:-1] = inside & (size[1:-1] == 1) & (s[:-2] < s[1:-1]) & (s[1:-1] > s[2:]) & left[:-2] & right[2:]
    return starts, size, np.flatnonzero(low | high)


def with_gaps(first: np.ndarray, last: np.ndarray, segment: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cores and, between consecutive ones of a segment that leave something out, the cores that fill the gap; in order."""
    apart = last[:-1] + 1 < first[1:]
    gap = np.flatnonzero(apart if segment is None else apart & (segment[first[:-1]] == segment[first[1:]]))
    first, last = np.concatenate([first, last[gap]]), np.concatenate([last, first[gap + 1]])
    order = np.argsort(first, kind="stable")
    return first[order], last[order]


def cut(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions (both included) of the cores of one whole sequence of symbols."""
    starts, size, runs = run_cores(x)
    return with_gaps(starts[runs] - 1, starts[runs] + size[runs])


def reduce_labels(labels: np.ndarray) -> np.ndarray:
    """Deterministic coin tossing: the lowest bit in which a label differs from its left neighbour, and that bit's value."""
    a, b = labels[:-1].astype(np.uint64), labels[1:].astype(np.uint64)
    z = a ^ b
    low = z & (~z + np.uint64(1))
    at = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
    return np.where(z == 0, EQUAL, 2 * at + ((b >> np.minimum(at, np.uint64(63))) & np.uint64(1))).astype(np.int64)


def label_cores(tokens: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Labels of cores over ``tokens``; equal content is hashed once."""
    if not len(first):
        return np.zeros(0, np.int64)
    content = np.stack([tokens[first], tokens[first + 1], last - first + 1, tokens[last]], 1)
    one, which = distinct_rows(content)
    return labels_of(content[one])[which]


def settled_runs(runs: np.ndarray, of: np.ndarray, open_left: np.ndarray, open_right: np.ndarray) -> np.ndarray:
    """Those of ``runs`` that a cut before or after their segment can't have changed; ``of`` is every run's segment. A run's kind depends on two runs on either side, of
    which the outermost may be longer than they look."""
    first, last = np.searchsorted(of, of[runs], "left"), np.searchsorted(of, of[runs], "right")
    return runs[~(open_left[of[runs]] & (runs - first < 2)) & ~(open_right[of[runs]] & (last - runs <= 2))]


def parse_many(codes: np.ndarray, place: np.ndarray, segment: np.ndarray, level: int, cut: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, label) of the level's cores of many short segments at once; ``place`` has each symbol's coordinate. ``cut`` tells of each segment by its number whether it went on before
    its first and after its last symbol; of such ones come the consecutive cores that are settled."""
    symbols, labels, start, end = codes, codes.astype(np.int64), place, place + 1
    for k in range(level):
        if k:
            joined = segment[1:] == segment[:-1]  # the first token of a segment has no left neighbour and drops
            symbols = reduce_labels(labels)[joined] if len(labels) else labels
            labels, start, end, segment = (v[1:][joined] for v in (labels, start, end, segment))
        begin, size, runs = run_cores(symbols, segment)
        if cut is not None and len(runs):
            runs = settled_runs(runs, segment[begin], *cut)
        first, last = with_gaps(begin[runs] - 1, begin[runs] + size[runs], segment)
        labels, start, end, segment = label_cores(labels, first, last), start[first], end[last], segment[first]
    return start, end, labels


class Level:
    """One level of parsing over a stream of tokens. It holds on to as many as the next core can depend on: a
    core depends on two runs of equal symbols on either side, and a gap on the cores next to it."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []  # symbols, labels, starts, ends of the tokens that are still needed
        self.at = -1  # where the last core that was told of starts in them

    def feed(self, tokens: list[np.ndarray], final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label, start, end) of the cores that are settled by now; all that are left if ``final``."""
        self.held = [np.concatenate(x) for x in zip(self.held, tokens)] if self.held else tokens
        symbols, labels, starts, ends = self.held
        begin, size, runs = run_cores(symbols)
        runs = runs if final else runs[runs < len(begin) - 2]
        first, last = begin[runs] - 1, begin[runs] + size[runs]
        known = int(np.searchsorted(first, self.at)) if self.at >= 0 else -1
        if len(runs) <= known + 1:
            return (np.zeros(0, np.int64),) * 3
        f, t = with_gaps(first[max(known, 0) :], last[max(known, 0) :])
        if known >= 0:
            f, t = f[1:], t[1:]
        out = label_cores(labels, f, t), starts[f], ends[t]
        keep = int(begin[max(0, runs[-1] - 3)])
        self.held, self.at = [x[keep:] for x in self.held], int(first[-1]) - keep
        return out


def parse_segment(codes: np.ndarray, level: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, label) of the level's cores of one segment, in batches; ends are exclusive."""
    levels, before = [Level() for _ in range(level)], [None] * level
    for at in range(0, len(codes), chunk):
        final, x = at + chunk >= len(codes), codes[at : at + chunk].astype(np.int64)
        place = np.arange(at, at + len(x))
        labels, start, end = levels[0].feed([x, x, place, place + 1], final)
        for k in range(1, level):
            if before[k] is not None:  # the first token of all has no left neighbour and drops
                labels, start, end = (np.concatenate([[b], v]) for b, v in zip(before[k], (labels, start, end)))
            if len(labels):
                before[k] = labels[-1], start[-1], end[-1]
            symbols = reduce_labels(labels) if len(labels) > 1 else np.zeros(0, np.int64)
            labels, start, end = levels[k].feed([symbols, labels[1:], start[1:], end[1:]], final)
        if len(labels):
            yield start, end, labels


def coded(sequence: bytes) -> np.ndarray:
    """Symbol codes of letters, of either case; 4 for what is no symbol."""
    table = np.full(256, 4, np.uint8)
    for letter, code in CODES.items():
        table[ord(letter)] = table[ord(letter.lower())] = code
    return table[np.frombuffer(sequence, np.uint8)]


def parse_chunks(sequence: str, level: int = 1, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cores of one long sequence, segment by segment, in batches. Beyond the sequence itself, memory is bounded by
    ``chunk`` bases and what they depend on."""
    x = coded(sequence.encode("latin-1", "replace"))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], x == 4, [True]]).astype(np.int8)))
    for a, b in edges.reshape(-1, 2):
        for start, end, label in parse_segment(x[a:b], level, chunk) if b - a >= 3 else ():
            yield start + a, end + a, label


def parse_records(sequences: list[str | None], level: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(record number, start, end, label) of the cores of many sequences, in batches: short ones together, long ones in chunks."""
    held, numbers, size = [], [], 0

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = coded(b"\n".join(held))
        begins = np.cumsum([0, *(len(h) + 1 for h in held[:-1])])
        good = x != 4
        place, segment = np.flatnonzero(good), np.cumsum(~good)[good]
        start, end, label = parse_many(x[good], place, segment, level)
        which = np.searchsorted(begins, start, "right") - 1
        return np.array(numbers, np.int64)[which], start - begins[which], end - begins[which], label

    for number, sequence in enumerate(sequences):
        if not sequence:
            continue
        if len(sequence) > CHUNK:
            for start, end, label in parse_chunks(sequence, level):
                yield np.full(len(start), number, np.int64), start, end, label
            continue
        held.append(sequence.encode("latin-1", "replace"))
        numbers.append(number)
        size += len(held[-1])
        if size > CHUNK:
            yield together()
            held, numbers, size = [], [], 0
    if held:
        yield together()


def parse(sequence: str, level: int = 1, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, label) of all cores of a sequence."""
    found = list(parse_chunks(sequence, level, chunk))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def cores(sequences: DataFrame, level: int = 1) -> DataFrame:
    """Cores of ``sequences(…, seq)``: all columns but seq, and start, end, label, len.

    Null and short sequences give no cores. Short records are parsed together, long ones in chunks, in Arrow batches.
    """
    if level < 1:
        raise ValueError("the level starts at 1")
    keep = [c for c in sequences.columns if c != "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for record, start, end, label in parse_records(b.column(b.schema.get_field_index("seq")).to_pylist(), level):
                cols = [b.column(b.schema.get_field_index(c)).take(pa.array(record)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(start), pa.array(end), pa.array(label), pa.array((end - start).astype(np.int32))], [*keep, "start", "end", "label", "len"])

    kept = ", ".join(f"`{c}` {sequences.schema[c].dataType.simpleString()}" for c in keep)
    return sequences.mapInArrow(run, f"{kept}, {CORE_FIELDS}" if kept else CORE_FIELDS)


def cores_by_window(sequences: DataFrame, key: str = "record") -> DataFrame:
    """Level-1 cores of sequences over ACGT alone, by window functions over runs of equal symbols.

    The form for checking and for engines without Python; ``key`` must tell records apart.
    """
    letters = sequences.select(key, F.posexplode(F.split("seq", "")).alias("pos", "letter")).where("letter <> ''")
    by_pos = Window.partitionBy(key).orderBy("pos")
    coded = letters.select(key, "pos", (F.expr("instr('ACGT', letter)") - 1).alias("s"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    runs = coded.withColumn("before", F.lag("s").over(by_pos)).where("before is null or before <> s")
    runs = runs.withColumn("size", F.coalesce(F.lead("pos").over(by_pos), F.col("n")) - F.col("pos"))
    for name, at in (("l1", -1), ("l2", -2), ("r1", 1), ("r2", 2)):
        runs = runs.withColumn(name, F.lead("s", at).over(by_pos) if at > 0 else F.lag("s", -at).over(by_pos))
    runs = runs.withColumn("lsize", F.lag("size").over(by_pos)).withColumn("rsize", F.lead("size").over(by_pos))
    low = "size >= 2 or (l1 > s and s < r1)"
    high = "size = 1 and l1 < s and s > r1 and (lsize >= 2 or l2 < l1) and (rsize >= 2 or r2 < r1)"
    found = runs.where(f"l1 is not null and r1 is not null and (({low}) or ({high}))")
    found = found.selectExpr(key, "pos - 1 as first", "pos + size as last", "l1 as a", "s as b", "size + 2 as m", "r1 as z")
    # Between cores symbols are single and monotone, so the second is the neighbour of the first.
    by_first = Window.partitionBy(key).orderBy("first")
    gaps = found.withColumn("from", F.lag("last").over(by_first)).where("from + 1 < first").select(key, "from", F.col("first").alias("to"))
    at = coded.select(F.col(key).alias("k"), F.col("pos").alias("p"), "s")
    for name, pos in (("a", F.col("from")), ("b", F.col("from") + 1), ("z", F.col("to"))):
        gaps = gaps.join(at.withColumnRenamed("s", name), (F.col(key) == F.col("k")) & (pos == F.col("p"))).drop("k", "p")
    gaps = gaps.select(key, F.col("from").alias("first"), F.col("to").alias("last"), "a", "b", (F.col("to") - F.col("from") + 1).alias("m"), "z")
    label = F.conv(F.substring(F.md5(F.concat_ws("|", "a", "b", "m", "z").cast("binary")), 1, 15), 16, 10).cast("long")
    return found.union(gaps).select(key, F.col("first").cast("long").alias("start"), (F.col("last") + 1).cast("long").alias("end"), label.alias("label"), (F.col("last") + 1 - F.col("first")).cast("int").alias("len"))


def encode_core(label, length):
    """A core in one 64-bit number: the low 32 bits of its label above its length. As a signed number it may be negative."""
    return F.shiftleft(label.bitwiseAND(F.lit(0xFFFFFFFF)), 32) + length.cast("long")


def decode_length(packed):
    return packed.bitwiseAND(F.lit(0xFFFFFFFF))


def decode_label(packed):
    return F.shiftrightunsigned(packed, 32)


def reverse_complement(seq):
    """The other strand, read in its own direction; letters other than ACGT stay."""
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def both_strands(sequences: DataFrame) -> DataFrame:
    """``sequences`` and their reverse complements, told apart by ``strand`` (+ or -), in one pass over the input."""
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.upper("seq").alias("seq")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))
    return sequences.withColumn("_s", F.explode(strands)).drop("seq").select("*", "_s.strand", "_s.seq").drop("_s")
