"""Packing documents into training sequences whose mixture of sources is controlled throughout.

Sources are queues. Windows of WINDOW tokens are filled by deficit round-robin: in each window a source's
credit grows by its quantum (its target share of the window), it serves as many whole tokens as its
credit allows, and what is left over, the deficit, goes on to the next window. Documents are cut freely, so
credits never wait for a document to fit; a window has QUANTUM tokens or more for each source on average, so documents are not cut into slivers. Targets are given proportions (when a queue runs dry its share passes to the
others), or the proportions of an input that is already in training order, stretch by stretch. Credit after
a window is the sum of quanta, less what was served, so what a source has served by any window has
a closed form, and any task can place any document from three numbers: the tokens that its source has in
earlier parts of the input, those before it in its own part, and the sources' totals. Deficits thus carry over
windows and partitions without passing through them one by one.

Windows follow each other in one stream without gaps, which is cut every LENGTH tokens. Only the last
sequence is short.

Texts are read and tokenised once, in the order of the input's files and their blocks (its partitions, if it is not read from files);
token ids are written to the shared folder as two or four bytes each and read back where they lie, so no text or
token is shuffled. Shares of up to MOST_SOURCES sources, those of most tokens, are controlled one by one; the rest are dealt
into FOLDED queues by a hash of their names, each with the shares of its sources together.
"""

from __future__ import annotations

import array
import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, lookup_join, spool
from .mixing import ranked
from .words import MOST_ROWS, text_blocks

#: Tokens of a sequence, of a window at least, and of a source in a window on average; and the id that ends a document.
LENGTH, WINDOW, QUANTUM, END = 2048, 4 * 2048, 1024, 1
#: Sources with a queue of their own, queues of the rest, and stretches of an input in training order.
MOST_SOURCES, FOLDED, STRETCHES = 4096, 512, 64
#: Entries of a task's word cache before it starts anew, and characters of text that are worked on at a time: a task's Python holds some 60 bytes of
#: numbers for each character of a block, and 250 for each word of the cache, beside the two tokenizers.
MOST_CACHED, PIECE = 200_000, 1 << 20
#: A single space between two visible characters: pieces of text on either side are tokenised alike apart or together.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


class WordTokenizer:
    """Ids of a byte-level BPE by way of a cache of words.

    The pre-tokenizer starts a new piece at every single space between visible characters, so a text's ids
    are those of its parts ``" part"`` one after the other. Parts that the cache lacks are encoded by
    tiktoken from the same vocabulary's ranks if given and if the part is Latin text, where both libraries'
    character classes agree, else by tokenizers. The tokenizer's special tokens are what it makes of them by default: a part that
    holds one goes to tokenizers.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.spaced = np.zeros(max(ranks.values()) + 1, bool)  # ids whose bytes begin with a space
            self.spaced[[k for token, k in ranks.items() if token[:1] == b" "]] = True
            self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.parts: dict[str, bytes | None] = {}

    def latin(self, text: str) -> bool:
        """Whether tiktoken may encode it."""
        return self.fast is not None and (text.isascii() or max(text) < "ɐ") and not any(t in text for t in self.special)

    def encode(self, text: str) -> bytes:
        """Ids of one string, as they lie in memory."""
        if self.latin(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array.array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()

    def learn(self, parts: list[str]) -> None:
        """Enter ids of ``" part"`` for parts that the cache lacks. Those that are empty or have white space at an end get None, as spaces
        around them are not single ones between words; Latin ones are encoded in one go, and told apart by the space that each begins with."""
        sound = [p for p in parts if p and p == p.strip()]
        if len(sound) < len(parts):
            self.parts.update(dict.fromkeys(parts))
        together = sound if self.latin(" ".join(sound)) else [p for p in sound if self.latin(p)]
        if len(together) < len(sound):
            fast = set(together)
            self.parts.update((p, self.encode(" " + p)) for p in sound if p not in fast)
        if together:
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(together)), self.dtype)
            at = np.flatnonzero(self.spaced[ids])
            data, width = ids.tobytes(), self.dtype.itemsize
            ends = (np.append(at[1:], len(ids)) * width).tolist()
            self.parts.update((part, data[i:k]) for part, i, k in zip(together, (at * width).tolist(), ends))

    def whole(self, text: str) -> bytes:
        """For texts with other white space: cut only where it is safe."""
        head, *rest = SAFE_CUT.split(text)
        return self.encode(head) + b"".join(self.encode(" " + part) for part in rest)

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text]))[0].tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after the other, and how many each has; null counts as empty. Words are told apart, and ids put in their places, in
        whole columns; Python sees a word only the first time that a block has it."""
        texts = texts.cast(pa.large_string()).fill_null("")
        cut = pc.split_pattern(texts, " ")
        words, ends = cut.flatten(), cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
        encoded = words.dictionary_encode()
        which = encoded.indices.to_numpy().astype(np.int64)
        distinct = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.parts) > MOST_CACHED:
            self.parts.clear()
        self.learn([w for w in distinct if w not in self.parts])
        ids = list(map(self.parts.__getitem__, distinct))
        odd = np.array([x is None for x in ids], bool)
        begins = np.concatenate([[0], ends[:-1]])
        row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        head_at = begins[ends > begins]
        # A first word has no space before it; a text with other white space is one piece.
        whole = np.zeros(len(texts), bool)
        inner = odd[which]
        inner[head_at] = False
        whole[row[inner]] = True
        heads = words.take(pa.array(head_at)).to_numpy(zero_copy_only=False).tolist()
        rows = np.flatnonzero(ends > begins)
        first = []
        for r, head in zip(rows.tolist(), heads):
            if whole[r] or (head and head[-1].isspace()) or (not head and ends[r] - begins[r] > 1):
                whole[r] = True
                first.append(self.whole(texts[r].as_py()))
            else:
                first.append(self.encode(head) if head else b"")
        width = self.dtype.itemsize
        which[head_at] = len(ids) + np.arange(len(first))
        all_ids = [x or b"" for x in ids] + first
        sizes = np.fromiter(map(len, all_ids), np.int64, len(all_ids)) // width
        pool = np.frombuffer(b"".join(all_ids), self.dtype)
        starts = np.cumsum(sizes) - sizes
        counts = sizes[which]
        counts[whole[row] & (which < len(ids))] = 0
        total = int(counts.sum())
        source = np.arange(total) + np.repeat(starts[which] - (np.cumsum(counts) - counts), counts)
        return pool[source], np.bincount(row, counts, len(texts)).astype(np.int64)

    def documents(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, their number by row) of a column's texts, each with END behind it, block by block."""
        for row, end, _, _ in text_blocks(column, PIECE, 4 * MOST_ROWS):
            texts = column.slice(row, end - row)
            if end == row + 1 and len(text := texts[0].as_py() or "") > PIECE:  # one long text: piece by piece
                found, at = [], 0
                while at < len(text):
                    cut = SAFE_CUT.search(text, at + PIECE)
                    stop = cut.start() if cut else len(text)
                    # A piece after the first follows the space that it was cut at.
                    piece, lead = (f"a {text[at:stop]}", len(self.encode("a")) // self.dtype.itemsize) if at else (text[:stop], 0)
                    found.append(self.batch(pa.array([piece]))[0][lead:])
                    at = stop + 1 if cut else stop
                ids = np.concatenate([*found, np.array([END], self.dtype)])
                yield row, end, ids, np.array([len(ids)])
                continue
            ids, counts = self.batch(texts)
            at = np.cumsum(counts)
            yield row, end, np.insert(ids, at, END), counts + 1


class Rounds:
    """What each source has served by each window, in closed form.

    ``shares`` are target proportions; by default the totals', so that all queues run dry together. ``stretches`` are target
    proportions that vary instead: a row for each stretch of the input, with the tokens of each source in it.
    """

    def __init__(self, totals: list[int], shares: list[float] | None = None, window: int = WINDOW, stretches: np.ndarray | None = None):
        self.totals = np.array(totals, np.int64)
        self.window, self.total = window, int(self.totals.sum())
        self.windows = max(1, -(-self.total // window))
        self.known: dict[int, tuple[np.ndarray, int, np.ndarray]] = {}
        self.sums = None
        if stretches is not None:
            self.sums = np.concatenate([np.zeros((1, len(totals)), np.int64), np.cumsum(stretches, 0, dtype=np.int64)])
            self.times, self.tokens = np.arange(len(self.sums), dtype=float), self.sums.sum(1).astype(float)
            return
        self.quanta = np.array(totals if shares is None else shares, float)
        if (self.quanta[self.totals > 0] <= 0).any():
            raise ValueError("every source that has tokens needs a share")
        # Time in rounds at which queues run dry, and the tokens served by then.
        dry = np.divide(self.totals, self.quanta, out=np.zeros(len(totals)), where=self.quanta > 0)
        self.times = np.unique(np.concatenate([[0.0], dry]))
        order = np.argsort(dry)
        done, left = np.cumsum(self.totals[order]), self.quanta.sum() - np.cumsum(self.quanta[order])
        at = np.searchsorted(dry[order], self.times, "right") - 1
        self.tokens = np.where(at >= 0, done[at] + self.times * left[at], 0.0) if len(order) else np.zeros(len(self.times))
        self.tokens[-1:] = self.total

    def served(self, w: int) -> tuple[np.ndarray, int, np.ndarray]:
        """Tokens served by each source before window w, their sum, and each source's place in window w."""
        if w not in self.known:
            if len(self.known) > 64:
                self.known.clear()
            now, then = self._served(w), self._served(w + 1)
            self.known[w] = now, int(now.sum()), np.cumsum(then - now) - (then - now)
        return self.known[w]

    def _served(self, w: int) -> np.ndarray:
        if w >= self.windows:
            return self.totals
        t = np.interp(w * self.window, self.tokens, self.times)
        if self.sums is not None:
            k = min(int(t), len(self.sums) - 2)
            return self.sums[k] + np.floor((t - k) * (self.sums[k + 1] - self.sums[k])).astype(np.int64)
        return np.minimum(self.totals, np.floor(self.quanta * t).astype(np.int64))

    def window_of(self, source: int, token: int) -> int:
        """The window in which a source serves its token number ``token``."""
        if self.sums is not None:
            own = self.sums[:, source]
            k = int(np.searchsorted(own, token, "right")) - 1
            t = k + (token - own[k]) / (own[k + 1] - own[k])
        else:
            t = min((token + 1) / self.quanta[source], self.times[-1])
        w = min(self.windows - 1, max(0, int(np.interp(t, self.times, self.tokens) // self.window)))
        while w > 0 and self.served(w)[0][source] > token:
            w -= 1
        while self.served(w + 1)[0][source] <= token:
            w += 1
        return w

    def pieces(self, source: int, first: int, n: int, length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
        """(start, length, sequence, offset, window) of the pieces of the n tokens from ``first`` of a source's queue."""
        done, w = 0, -1
        while done < n:
            w = self.window_of(source, first) if w < 0 else w
            while self.served(w + 1)[0][source] <= first + done:
                w += 1
            served, begin, place = self.served(w)
            at = begin + int(place[source]) + first + done - int(served[source])
            size = min(n - done, int(self.served(w + 1)[0][source]) - first - done, length - at % length)
            yield done, size, at // length, at % length, w
            done += size


def in_file_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__part``: which file and which block of it a row was read from, numbers of files first, so that parts sort as they were
    written; where ``docs`` isn't read from files, its partitions."""
    try:
        number = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
        part = F.format_string("%012d %s %020d", number, F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
        found = docs.select("*", part.alias("__part"))
        found.schema  # noqa: B018 - analysed here
        return found
    except AnalysisException:
        return docs.select("*", F.format_string("%012d", F.spark_partition_id()).alias("__part"))


def tokenised(docs: DataFrame, tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> tuple[DataFrame, np.dtype]:
    """doc_id, queue, part, before (tokens of the same queue and part that come earlier), n, ids; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer_path, ranks_path, pattern)
        before: dict[tuple[str, str], int] = {}
        for batch in batches:
            for row, end, ids, sizes in words.documents(batch.column(2)):
                earlier = []
                for key, n in zip(zip(batch.column(1).slice(row, end - row).to_pylist(), batch.column(3).slice(row, end - row).to_pylist()), sizes.tolist()):
                    earlier.append(before.get(key, 0))
                    before[key] = earlier[-1] + n
                ends = np.concatenate([[0], np.cumsum(sizes)]) * words.dtype.itemsize
                cells = pa.Array.from_buffers(pa.large_binary(), end - row, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.tobytes())])
                rest = [batch.column(k).slice(row, end - row) for k in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(earlier, pa.int64()), pa.array(sizes, pa.int64()), cells.cast(pa.binary())], ["doc_id", "queue", "part", "before", "n", "ids"])

    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = in_file_order(docs).select("doc_id", queue.alias("queue"), "text", "__part")
    out = parts.mapInArrow(run, f"doc_id {id_type}, queue string, part string, before long, n long, ids binary")
    path = fresh_path(docs.sparkSession, "tokens")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path), WordTokenizer(tokenizer_path).dtype


def _queues(held: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``held(queue, part, held)`` with the queue that is controlled (``lane``), and (lane, total, share) of each; ``given(queue, share)``."""
    totals = spool(held.groupBy("queue").agg(F.sum("held").alias("total")).join(given, "queue", "left"), "totals")
    if totals.count() <= MOST_SOURCES:
        totals = totals.withColumn("lane", F.col("queue"))
    else:
        own = ranked(totals, [F.desc("total"), F.col("queue")], {}).where(F.col("nr") < MOST_SOURCES).select("queue", F.col("queue").alias("lane"))
        folded = F.format_string("~%d", F.pmod(F.xxhash64("queue"), F.lit(FOLDED)))
        totals = spool(lookup_join(totals, spool(own, "own"), "queue").withColumn("lane", F.coalesce("lane", folded)), "lanes")
    lanes = totals.groupBy("lane").agg(F.sum("total").alias("total"), F.sum(F.coalesce("share", F.lit(0.0))).alias("share"))
    return lookup_join(held, spool(totals.select("queue", "lane"), "lane"), "queue", "inner"), lanes


def shares_by_rank(queues: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(queue, share): ``weights`` in turn to the sources by code point, null last."""
    rows = ranked(spool(queues.select("queue").distinct(), "queues"), [F.col("queue") == "", F.col("queue")], {})
    weight: Column = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nr") % len(weights) + 1).cast("int"))
    return rows.select("queue", weight.alias("share"))


def pack(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, shares: dict[str | None, float] | None = None, weights: tuple[float, ...] | None = None,
    follow: bool = False, length: int = LENGTH, window: int | None = None,
) -> DataFrame:
    """Pack ``docs(doc_id, source, text)``: a row for each piece with doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, window and ids (32-bit little-endian).

    A document is its token ids and END; each of them lies in exactly one piece. Sequences are numbered from 0
    and filled from offset 0 without gaps to ``length``; only the last can be shorter. Windows have ``window`` tokens, by default WINDOW, or QUANTUM for
    each source if that is more, so a document of n tokens has about n / QUANTUM pieces, and one more at either end. The target proportions of every window are
    ``shares`` by source, or ``weights`` in turn by the sources' code points, until a queue runs dry and its share passes to the
    others; or with ``follow`` those of the input's own order, of STRETCHES stretches; or those of the whole input.

    Null text counts as empty: one token, END. Null source is a source of its own. Repeated rows are separate
    documents. A long document spans as many sequences as it needs. An empty table gives an empty result; other columns are
    ignored. Order within a source is that of the input's files, in order of their numbers, and of rows in them.
    """
    tokens, dtype = tokenised(docs, tokenizer_path, ranks_path, pattern)
    spark = docs.sparkSession
    held = spool(tokens.groupBy("queue", "part").agg(F.sum("n").alias("held")), "held")
    if weights:
        given = shares_by_rank(held, weights)
    else:
        given = spark.createDataFrame([("" if k is None else f"={k}", float(v)) for k, v in (shares or {}).items()], "queue string, share double")
    held, lanes = _queues(held, given)
    held = spool(held, "held")
    found = sorted(lanes.collect(), key=lambda r: r["lane"])  # at most MOST_SOURCES + FOLDED
    names, sums = [r["lane"] for r in found], [r["total"] for r in found]
    window = window or max(WINDOW, QUANTUM * len(names))
    wanted = [r["share"] for r in found] if shares is not None or weights else None
    stretches = None
    if follow:
        parts = ranked(spool(held.groupBy("part").agg(F.sum("held").alias("held")), "parts"), [F.col("part")], {"before": "held"})
        share = (F.col("before") + F.col("held") / 2) / F.lit(float(max(1, sum(sums))))
        stretch = spool(parts.select("part", F.least((share * STRETCHES).cast("int"), F.lit(STRETCHES - 1)).alias("stretch")), "stretches")
        stretches, number = np.zeros((STRETCHES, len(names)), np.int64), {q: k for k, q in enumerate(names)}
        for r in lookup_join(held, stretch, "part", "inner").groupBy("stretch", "lane").agg(F.sum("held").alias("held")).collect():  # at most STRETCHES for a lane
            stretches[r["stretch"], number[r["lane"]]] = r["held"]
        stretches = stretches[stretches.any(1)]
    Rounds(sums, wanted, window, stretches)  # refuses impossible shares before any task starts
    earlier = Window.partitionBy("lane").orderBy("part", "queue").rowsBetween(Window.unboundedPreceding, -1)
    key = F.concat_ws("|", F.col("part"), F.col("queue")).alias("key")
    starts = spool(held.select(key, "lane", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base")), "starts")
    placed = lookup_join(tokens.select("*", key), starts, "key", "inner").select("doc_id", "lane", (F.col("base") + F.col("before")).alias("first"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, number = Rounds(sums, wanted, window, stretches), {q: k for k, q in enumerate(names)}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                doc, out = [], []
                b = batch.slice(at, 500)
                for row, (lane, first, n, ids) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 5)))):
                    wide = np.frombuffer(ids, dtype).astype("<u4").tobytes()
                    for start, size, sequence, offset, w in rounds.pieces(number[lane], first, n, length):
                        piece = wide[4 * start : 4 * (start + size)]
                        doc.append(row)
                        out.append((start, size, zlib.crc32(piece), n, sequence, offset, w, piece))
                columns = [pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 7 + [pa.binary()])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int32())), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, ids binary")
