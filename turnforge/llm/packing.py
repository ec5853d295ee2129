"""Best-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

1. Tokenise: ids of each document and one end id, cut into pieces of ``capacity``
   ids (the last may be shorter).  Tasks keep the ids of recent words.
2. Range-sort: lengths are whole numbers up to ``capacity``, so pieces and gaps in
   order of size are told by their counts per size.  Spark counts the pieces; the
   counts, at most ``capacity`` rows, are all the driver sees of them.
3. Best fit decreasing over the counts, in a loop on the driver instead of bulk-synchronous
   rounds on Spark: a length at a time from the longest down, a sweep gives all pieces
   of the length their successors, the smallest gaps that hold them; the gaps are updated and the
   sweep is repeated until the pieces are placed or nothing holds them, when new
   sequences are opened.
4. Conflicts are resolved by rank: the k-th piece of a length takes the k-th gap that
   the rounds gave to it.  Spark numbers the pieces of each length and looks each
   number up in the rounds' table of runs.

The runs depend on the counts per size, not on the number of pieces.

Cases: a null or empty text is one piece, the end id; repeated rows are packed
each; null ids stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnforge.llm import words as W
from turnforge.llm.common import chunks, stored

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 500_000
CACHE_BYTES = 48  # longer words are not kept
ENCODED = 4096  # words given to the tokenizer at once
CHUNK = 1 << 20  # bytes of text at once
BLOCK_BITS = 10

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, ordinal long"
STOPS = np.isin(np.arange(256), [ord("."), ord(",")])
ASCII_ALNUM = W.ALNUM & (np.arange(256) < 128)
_CACHE: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds:
    """Ids of texts; remembers those of recent words.

    A text is cut at ASCII white space and before a full stop or comma that
    follows an ASCII letter or digit: the tokenizer cuts there too, and it
    lower-cases, so that one entry serves many forms of a word.  Words are
    told by their 64-bit names, in a sorted table of numpy columns: some 40 bytes a
    word, where Python objects take 200 and more.  Words in use stay: a table of twice
    CACHE_WORDS words is cut to those used last.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.turn = 0
        self.name, self.begin, self.size, self.used = np.empty(0, W.U), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
        self.flat = np.empty(0, "<u4")

    def words(self, name: np.ndarray, start: np.ndarray, end: np.ndarray, low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in one array, and where those of each of the distinct words with these (sorted) names and places begin and how many they are."""
        self.turn += 1
        place = np.searchsorted(self.name, name)
        old = np.zeros(len(name), bool)
        inside = place < len(self.name)
        old[inside] = self.name[place[inside]] == name[inside]
        begin, size = np.zeros(len(name), np.int64), np.zeros(len(name), np.int32)
        begin[old], size[old] = self.begin[place[old]], self.size[place[old]]
        self.used[place[old]] = self.turn

        short = end - start <= CACHE_BYTES
        new, more = np.flatnonzero(~old & short), np.flatnonzero(~old & ~short)
        flat = [self.flat]
        for some in (new, more):
            for lo in range(0, len(some), ENCODED):
                part = some[lo:lo + ENCODED]
                ids = [e.ids for e in self.encode([low[s:e].decode() for s, e in zip(start[part], end[part], strict=True)], add_special_tokens=False)]
                size[part] = [len(x) for x in ids]
                flat.append(np.frombuffer(b"".join(map(little_endian, ids)), "<u4"))
        fresh = np.concatenate([new, more])
        begin[fresh] = len(self.flat) + np.cumsum(size[fresh], dtype=np.int64) - size[fresh]
        every = np.concatenate(flat)
        self.flat = every[:len(self.flat) + int(size[new].sum())]
        if len(more):
            self.flat = self.flat.copy()  # a view would hold the long ones' ids
        for column, values in (("name", name[new]), ("begin", begin[new]), ("size", size[new]), ("used", np.full(len(new), self.turn))):
            setattr(self, column, np.insert(getattr(self, column), place[new], values))
        if len(self.name) > 2 * CACHE_WORDS:
            self.forget()
        return every, begin, size

    def forget(self) -> None:
        """Leave the CACHE_WORDS words used last."""
        stay = np.sort(np.argsort(self.used, kind="stable")[len(self.used) - CACHE_WORDS:])
        self.name, self.used, begin, self.size = self.name[stay], self.used[stay], self.begin[stay], self.size[stay]
        self.begin = np.cumsum(self.size, dtype=np.int64) - self.size
        self.flat = self.flat[np.repeat(begin - self.begin, self.size) + np.arange(self.size.sum())]

    def of(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's begin (one more at the end)."""
        stop = np.flatnonzero(STOPS[buf[1:]] & ASCII_ALNUM[buf[:-1]]) + 1
        start, end, first = W.spans(buf, off, W.NOT_SPACE, stop)
        if not len(start):
            return np.empty(0, "<u4"), np.zeros(len(off), np.int64)
        name, at, word = np.unique(W.names(buf, start, end), return_index=True, return_inverse=True)
        flat, begin, size = self.words(name, start[at], end[at], W.LOWER[buf].tobytes())
        n = size[word]
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return flat[np.repeat(begin[word] - upto[:-1], n) + np.arange(upto[-1])], upto[first]


def word_ids(path: str) -> WordIds:
    if _CACHE.get("path") != path:
        _CACHE.update(path=path, ids=WordIds(path))
    return _CACHE["ids"]


def _cut(path: str, capacity: int, end_id: int):
    end = little_endian([end_id])
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())

    def cut(batches):
        encoder, task = word_ids(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            doc = batch.column(0).to_pylist()
            for lo, hi, buf, off in chunks(batch, limit=CHUNK):
                ids, first = encoder.of(buf, off)
                rows = []
                for k in range(hi - lo):
                    raw = ids[first[k]:first[k + 1]].tobytes() + end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at:at + 4 * capacity]
                        n = len(part) // 4
                        rows.append((doc[lo + k], piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "ordinal"])
    return cut


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``task`` and ``ordinal`` number those of one length."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_cut(path, capacity, end_id), PIECES)


def rounds(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Runs (length, rank, n, sequence_id, offset): pieces of ``length`` from ``rank`` on go to consecutive sequences.

    ``counts[s]`` is the number of pieces of length s, up to the capacity.
    """
    capacity = len(counts) - 1
    gaps: list[deque] = [deque() for _ in range(capacity + 1)]  # by size: runs (first sequence, how many)
    there = np.zeros(capacity + 1, bool)  # sizes with gaps
    runs, opened = [], 0

    def add(size: int, first: int, n: int):
        if size:
            gaps[size].append((first, n))
            there[size] = True

    for s in range(capacity, 0, -1):
        left, rank = int(counts[s]), 0
        while left:
            fit = there[s:]
            at = int(fit.argmax())
            if fit[at]:  # the successor: the smallest gap that holds the size
                g = s + at
                first, n = gaps[g].popleft()
                m = min(n, left)
                if m < n:
                    gaps[g].appendleft((first + m, n - m))
                there[g] = bool(gaps[g])
                runs.append((s, rank, m, first, capacity - g))
                add(g - s, first, m)
                left, rank = left - m, rank + m
            else:  # new sequences, each as full of this size as it gets
                each = min(capacity // s, left)
                n = left // each
                for k in range(each):
                    runs.append((s, rank + k * n, n, opened, k * s))
                add(capacity - each * s, opened, n)
                opened, left, rank = opened + n, left - each * n, rank + each * n
    table = np.array(runs, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "n", "sequence_id", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` must be a written table (its numbering is read twice)."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    seen = by_task.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(capacity + 1, np.int64)
    counts[seen["length"].to_numpy()] = seen["n"].to_numpy()

    table = rounds(counts)
    size = 1 << BLOCK_BITS  # runs are cut at blocks of ranks, so that a frequent length is many groups
    first, last = table["rank"] >> BLOCK_BITS, (table["rank"] + table["n"] - 1) >> BLOCK_BITS
    times = last - first + 1
    row = np.repeat(np.arange(len(times)), times)
    block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    begin = np.maximum(table["rank"][row], block * size)
    runs = spark.createDataFrame(pa.table({"length": table["length"][row], "block": block, "rank": begin, "to": table["sequence_id"][row] + begin - table["rank"][row], "offset": table["offset"][row]}),
                                 "length long, block long, rank long, to long, offset long")

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("ordinal")).withColumn("block", F.shiftright("rank", BLOCK_BITS))
    both = ranked.select("length", "block", "rank", F.struct("doc_id", "piece", "start", "ids_crc32").alias("p")).unionByName(
        runs.select("length", "block", "rank", F.struct("rank", "to", "offset").alias("r")), allowMissingColumns=True)
    order = Window.partitionBy("length", "block").orderBy("rank", F.col("r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumn("at", F.last("r", ignorenulls=True).over(order)).where("p is not null")
            .select("p.doc_id", "p.piece", "p.start", "length", "p.ids_crc32", (F.col("at.to") + F.col("rank") - F.col("at.rank")).alias("sequence_id"), F.col("at.offset").alias("offset")))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(stored(pieces_of(docs, path or tokenizer_path(), capacity, end_id), "pieces"), capacity)
