"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Each text is encoded by a byte-level BPE (A) and a sentencepiece BPE (B); both
give the bytes of a space and the text.  An offset where a token of either ends
is a shared cut.  An interval between two shared cuts is searched for another
one: the end of the A token in its middle is looked up among the ends of the B
tokens by bisect, then the ends beside it, outwards.  A cut that is found parts
the interval, and both halves are searched again; an interval without a cut is
a leaf, a group of tokens.  The intervals of many texts are searched together.

The tokens of an A and a B group are linked, all with all.  How many documents
hold a pair of ids linked is counted a block of text at a time (a few MB);
the blocks' counts meet by pair, and each block gets the totals of its own
pairs back, so neither texts nor pairs of documents are sent by pair.

Tokens are remembered by unit: a text is cut before a single space between
characters that are no white space.  A's pattern begins a word there, and no
piece of B has a space after another character (checked; else a unit is a text).

Cases: a null or empty text, or one whose tokens' bytes differ from space and
text, has no tokens: zeros and empty groups; strings of special tokens are
plain text; repeated rows and repeated ids count as documents each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnforge.llm.common import chunks, stored

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
CACHE_UNITS = 300_000
CACHE_BYTES = 64  # longer units are not kept
PROBES = 8  # ends tried one by one before all of an interval are
LINKS = 1 << 20  # links written out at a time
WHOLE = 1 << 16  # a group of more links is counted by its different ids

FIRST = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary, "
         "counted_pair array<long>, counted array<long>")
KINDS = [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
         ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("counted_pair", pa.list_(pa.int64())), ("counted", pa.list_(pa.int64()))]
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

GRAPH = np.zeros(256, bool)
GRAPH[0x21:0x7F] = True
#: First bytes of characters that may be white space.
MAYBE_SPACE = np.zeros(256, bool)
MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(A_NAME), public_tokenizers.path(B_NAME)


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes a printable Latin-1 byte as itself, the others as characters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Both tokenizers, the bytes of their ids, and the ids of recent units."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.encode_a = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        char = byte_of_char()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(char[c] for c in token) if all(c in char for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_len, self.b_len = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        width = len(str(max(len(self.a_bytes), len(self.b_bytes))))
        digits = [str(k).encode() for k in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.n_digits = np.array([len(d) for d in digits])
        self.digits = np.frombuffer(b"".join(d.ljust(width + 1, b"\0") for d in digits), np.uint8).reshape(-1, width + 1)
        self.pair_kind = "<u4" if len(self.a_bytes) * len(self.b_bytes) <= 1 << 32 else "<u8"
        self.kept: dict[bytes, tuple] = {}
        self.older: dict[bytes, tuple] = {}

    def units(self, distinct: list[bytes]) -> list[tuple[bytes, bytes] | None]:
        """Ids by A and B of units (each begins with a space) as bytes of unsigned 32-bit numbers; None where a unit's bytes are not met."""
        if len(self.kept) + len(distinct) > CACHE_UNITS:
            self.older, self.kept = self.kept, {}
        out = [self.kept.get(u, 0) or self.older.get(u, 0) for u in distinct]
        new = [k for k, x in enumerate(out) if x == 0]
        text = [distinct[k].decode() for k in new]
        a = [e.ids for e in self.encode_a(text, add_special_tokens=False)] if new else []
        b = self.b.encode([t[1:] for t in text], num_threads=1) if new else []
        for k, x, y in zip(new, a, b, strict=True):
            same = b"".join([self.a_bytes[i] for i in x]) == distinct[k] == b"".join([self.b_bytes[i] for i in y])
            out[k] = (np.array(x, "<u4").tobytes(), np.array(y, "<u4").tobytes()) if same else None
        self.kept.update((u, x) for u, x in zip(distinct, out, strict=True) if len(u) <= CACHE_BYTES and x is not None)
        return out

    def unit_starts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where units begin: at each text, and before each single space between characters that are surely no white space."""
        begins = np.zeros(len(buf) + 1, bool)
        if self.cuts and len(buf) > 2:
            wide = np.zeros(len(buf) + 3, bool)
            wide[3:] = MAYBE_SPACE[buf]  # shifted by three
            high = buf >= 0x80
            before = GRAPH[buf[:-2]] | high[:-2] & ~(wide[2:-3] | wide[1:-4])  # neither the second nor the third last byte opens such a character
            after = GRAPH[buf[2:]] | high[2:] & ~MAYBE_SPACE[buf[2:]]
            begins[1:-2] = (buf[1:-1] == 32) & before & after
        begins[off] = True
        return np.flatnonzero(begins[:-1])

    def of(self, buf: np.ndarray, off: np.ndarray):
        """(A ids, B ids, A tokens before each text, B tokens before each text); a text begins with the added space."""
        starts = self.unit_starts(buf, off)
        ends = np.append(starts, len(buf)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        code = column.indices.to_numpy()
        ids = self.units(column.dictionary.to_pylist())
        good = np.array([x is not None for x in ids], bool)
        first = np.searchsorted(starts, off)
        text = np.repeat(np.arange(len(off) - 1), np.diff(first))
        fine = np.diff(off) > 1
        fine[text[~good[code]]] = False
        out = []
        for side in (0, 1):
            parts = [x[side] if x else b"" for x in ids]
            size = np.array([len(p) >> 2 for p in parts], np.int64)
            flat, before = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
            n = np.where(fine[text], size[code], 0)
            upto = np.concatenate([[0], np.cumsum(n)])
            out.append((flat[np.repeat(before[code] - upto[:-1], n) + np.arange(upto[-1])], upto[first]))
        return out[0][0], out[1][0], out[0][1], out[1][1]


_CACHE: dict = {}


def tokens(paths: tuple[str, str]) -> Tokens:
    if _CACHE.get("paths") != paths:
        _CACHE.update(paths=paths, tokens=Tokens(*paths))
    return _CACHE["tokens"]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group ends as token numbers of A and B.

    ``ends_*`` are byte offsets, rising; ``a`` and ``b`` are the tokens before
    each text (one more at the end), which are shared cuts.
    """
    found_a, found_b = [a[1:]], [b[1:]]

    def open_ones(*x):
        keep = (x[1] - x[0] > 1) & (x[3] - x[2] > 1)  # a single token has no end inside
        return [y[keep] for y in x]

    now = open_ones(a[:-1], a[1:], b[:-1], b[1:])
    tries = np.zeros(len(now[0]), np.int64)
    while len(now[0]):
        a0, a1, b0, b1 = now
        half = (tries + 1) >> 1
        at = (a0 + a1 - 2 >> 1) + np.where(tries & 1, half, -half)
        inside = (at >= a0) & (at <= a1 - 2)
        at = np.where(inside, at, a0)
        to = np.searchsorted(ends_b, ends_a[at])  # bisect; the last end of A is one of B, so it is found
        hit = inside & (ends_b[to] == ends_a[at])
        cut_a, cut_b = at[hit] + 1, to[hit] + 1
        halves = [open_ones(a0[hit], cut_a, b0[hit], cut_b), open_ones(cut_a, a1[hit], cut_b, b1[hit])]
        found_a.append(cut_a)
        found_b.append(cut_b)
        tries = tries + 1
        left = ~hit & (tries <= a1 - a0)
        for k in np.flatnonzero(left & (tries >= PROBES)):  # all ends at once: the cut nearest to the middle
            every = np.arange(a0[k], a1[k] - 1)
            to = np.searchsorted(ends_b, ends_a[every])
            cuts = np.flatnonzero(ends_b[to] == ends_a[every])
            if len(cuts):
                best = cuts[np.argmin(np.abs(2 * cuts - len(every)))]
                x, y = every[best:best + 1] + 1, to[best:best + 1] + 1
                found_a.append(x)
                found_b.append(y)
                halves += [open_ones(a0[k:k + 1], x, b0[k:k + 1], y), open_ones(x, a1[k:k + 1], y, b1[k:k + 1])]
        left &= tries < PROBES
        tries = np.concatenate([tries[left], np.zeros(sum(len(h[0]) for h in halves), np.int64)])
        now = [np.concatenate([now[j][left], *[h[j] for h in halves]]) for j in range(4)]
    ends = np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))
    some = np.diff(ends[0], prepend=0) > 0  # texts without tokens end no group
    return ends[0][some], ends[1][some]


def _written(t: Tokens, ids_a, ids_b, group_a, group_b, a, b) -> pa.Array:
    """`a1,a2|b1;a3|b2,b3` of every text."""
    n_a, n_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
    of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    place_a, place_b = np.arange(len(ids_a)) + (group_b - n_b)[of_a], np.arange(len(ids_b)) + group_a[of_b]
    every = np.empty(len(ids_a) + len(ids_b), np.int64)
    every[place_a], every[place_b] = ids_a, ids_b
    mark = np.full(len(every), ord(","), np.uint8)
    mark[place_a[group_a - 1]] = ord("|")
    mark[place_b[group_b - 1]] = ord(";")
    upto = a + b
    mark[upto[1:][np.diff(upto) > 0] - 1] = 0  # nothing after a text's last token
    wide = t.digits[every]
    wide[np.arange(len(every)), t.n_digits[every]] = mark
    size = np.concatenate([[0], np.cumsum(t.n_digits[every] + (mark > 0))])
    return pa.Array.from_buffers(pa.string(), len(a) - 1, [None, pa.py_buffer(size[upto].astype(np.int32)), pa.py_buffer(wide[wide > 0])])


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[new], np.add.reduceat(times, new) if len(new) else times


def _pairs(ids_a, ids_b, group_a, group_b, text, radix, span) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of all links, by text and pair; a pair is A id * radix + B id, below ``span``."""
    n_a, n_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
    since_a, since_b, links = group_a - n_a, group_b - n_b, n_a * n_b
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    small = np.flatnonzero(links <= WHOLE)
    upto = np.cumsum(links[small])
    lo = 0
    while lo < len(small):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LINKS, "right")))
        n = links[small[lo:hi]]
        of = np.repeat(small[lo:hi], n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = n_b[of]
        key = text[of] * span + ids_a[since_a[of] + k // wide].astype(np.int64) * radix + ids_b[since_b[of] + k % wide]
        parts.append(np.unique(key, return_counts=True))
        lo = hi
    for g in np.flatnonzero(links > WHOLE):
        x, times_x = np.unique(ids_a[since_a[g]:group_a[g]], return_counts=True)
        y, times_y = np.unique(ids_b[since_b[g]:group_b[g]], return_counts=True)
        step = max(1, LINKS // len(y))
        for k in range(0, len(x), step):
            pair = x[k:k + step].astype(np.int64)[:, None] * radix + y
            parts.append(((text[g] * span + pair).ravel(), np.outer(times_x[k:k + step], times_y).ravel()))
    key, times = parts[1] if len(parts) == 2 else _summed(*(np.concatenate([p[j] for p in parts]) for j in range(2)))
    return key // span, key % span, times


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(rows, kind) for n, kind in KINDS], [n for n, _ in KINDS])


def _align(paths: tuple[str, str]):
    def align(batches):
        t = tokens(paths)
        radix, span = len(t.b_bytes), len(t.b_bytes) * len(t.a_bytes)
        task, n_block, size, counts = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for lo, hi, buf, off in chunks(batch, limit=CHUNK_BYTES):
                block = task << 32 | n_block
                ids_a, ids_b, a, b = t.of(buf, off)
                group_a, group_b = shared_cuts(np.cumsum(t.a_len[ids_a]), np.cumsum(t.b_len[ids_b]), a, b)
                upto = np.searchsorted(group_a, a, "right")  # groups that end by each text's begin
                text = np.repeat(np.arange(hi - lo), np.diff(upto))
                links = np.concatenate([[0], np.cumsum(np.diff(group_a, prepend=0) * np.diff(group_b, prepend=0))])
                where, pair, times = _pairs(ids_a, ids_b, group_a, group_b, text, radix, span)
                at = np.searchsorted(where, np.arange(hi - lo + 1))
                counts.append(np.unique(pair, return_counts=True))
                packed = lambda x, kind: pa.array([x[i:j].astype(kind).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())  # noqa: E731, B023
                yield _batch({
                    "block": pa.array(np.full(hi - lo, block)), "doc_id": batch.column(0).slice(lo, hi - lo),
                    "n_a": pa.array(np.diff(a)), "n_b": pa.array(np.diff(b)), "n_groups": pa.array(np.diff(upto)), "n_links": pa.array(np.diff(links[upto])),
                    "groups": _written(t, ids_a, ids_b, group_a, group_b, a, b),
                    "pairs": packed(pair, t.pair_kind),
                    "times": packed(times, "<u1" if not len(times) or times.max() < 256 else "<u8"),
                }, hi - lo)
                size += len(buf)
                if size >= BLOCK_BYTES:
                    yield _block(block, counts)
                    n_block, size, counts = n_block + 1, 0, []
        if counts:
            yield _block(task << 32 | n_block, counts)
    return align


def _block(block: int, counts: list) -> pa.RecordBatch:
    pair, n = _summed(*(np.concatenate([c[j] for c in counts]) for j in range(2)))
    return _batch({"block": pa.array([block], pa.int64()), "counted_pair": pa.array([pair], pa.list_(pa.int64())), "counted": pa.array([n], pa.list_(pa.int64()))}, 1)


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """A row for each document with its ``groups`` (ids as `a1,a2|b1;a3|b2,b3`), its linked ``pairs`` and their ``times``; and
    a row for each block (``counted_pair`` not null) with how many of its documents hold each pair."""
    text = F.concat(F.lit(" "), F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_align(paths or default_paths()), FIRST)


def _score(kind: str):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of a block with the sums over the totals of its pairs."""
        pair, total, best = (right.column(c).to_numpy() for c in ("pair", "total", "best"))
        order = np.argsort(pair)
        pair, total, best = pair[order], total[order], best[order]
        sums = []
        for raw, times in zip(left.column("pairs").to_pylist(), left.column("times").to_pylist(), strict=True):
            name = np.frombuffer(raw, kind)
            times = np.frombuffer(times, "<u1" if len(times) == len(name) else "<u8").astype(np.int64)
            at = np.searchsorted(pair, name)
            sums.append((int(times[best[at]].sum()), int((times * total[at]).sum())) if len(name) else (0, 0))
        n_best, count_sum = zip(*sums, strict=True)
        return pa.table([left.column(c) for c in KEPT[:-1]] + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), left.column(KEPT[-1])],
                        names=[*KEPT[:-1], "n_best", "count_sum", KEPT[-1]])
    return score


KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def pair_counts(first: DataFrame, radix: int) -> DataFrame:
    """(of: block, pair, total, best) of every block's pairs: total documents that hold the pair, and whether no pair of its A id has more."""
    of_block = first.where("counted_pair is not null").select("block", F.explode(F.arrays_zip("counted_pair", "counted")).alias("c"))
    of_block = of_block.select("block", F.col("c.counted_pair").alias("pair"), F.col("c.counted").alias("n"))
    total = stored(of_block.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("a", F.floor(F.col("pair") / radix)), "link-counts")
    most = total.groupBy(F.col("a").alias("of")).agg(F.max("total").alias("most"))
    marked = total.join(most, total["a"] == most["of"]).select(F.col("pair").alias("p"), "total", (F.col("total") == F.col("most")).alias("best"))
    return of_block.join(marked, of_block["pair"] == marked["p"]).select(F.col("block").alias("of"), "pair", "total", "best")


def token_alignment(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    paths = paths or default_paths()
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups"), 256)).otherwise(F.lit("")).alias("groups_sha256")
    first = stored(aligned(docs, paths).select("block", *KEPT[:-1], digest, "pairs", "times", "counted_pair", "counted"), "aligned")
    rows = first.where("counted_pair is null").drop("counted_pair", "counted")
    t = tokens(paths)
    counts = pair_counts(first, len(t.b_bytes))
    return rows.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_score(t.pair_kind), OUT)
