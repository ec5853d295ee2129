"""Phrases of two to four words that stand together, mined with weighted acyclic automata.

A ``Counts`` is an acyclic transducer over words: a state is a prefix, its arcs
are sorted by word, and the weight of an arc is how often the phrase that ends
there occurs.  It is kept as arrays, a level of states at a time.

1. Build: a task (shard) counts its phrases a chunk at a time, sorts them and
   builds a transducer from each sorted run, for each prefix range.
2. Union: the transducers of a prefix range, from all shards, are united and
   their weights summed.  A range is a slice of the hashes of a phrase's first
   two words (of a single word: of the word), so a word that begins very many
   phrases is split over many ranges.
3. Compose: a candidate's parts are looked up by walking them through the
   transducer of the range that owns them; a range asks for each part once.

Three passes over the texts: words, pairs of words, then three and four words.
A phrase that occurs LEAST times has parts that do, too, so each pass leaves
out phrases of which a part is rare.  What is not rare is told by a bitmap of
2^BITMAP_BITS bits (its size does not grow with the corpus), which may let a rare
part through but drops none that is not.

Words are told by 64-bit names mixed with their language, so everything is per
language.  Transducers of single words carry the words themselves, which are
joined to the phrases at the end.

Cases: a null or empty text has no words; a null language is `und`; repeated
rows count each; ties go by the phrase; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnforge.llm import words as W
from turnforge.llm.common import chunks, stored

LEAST = 30
TOP = 2000
COVER = 80  # per cent
LONGEST = 4
SCALE = 2_000_000
BITMAP_BITS = 24
HELD = 2_000_000  # phrases that a task counts before it builds transducers of them

SEPARATES = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
WORD = ~(SEPARATES | np.isin(np.arange(256), [32, 9]))

SHARD = "range int, counts binary, words binary, lang string, n long"
UNION = "range int, counts binary, since int, bits binary, names array<long>, words array<string>"
ASKED = "owner int, sender int, w1 long, w2 long, w3 long, f long"
ANSWER = "range int, kind int, w1 long, w2 long, w3 long, value long"
SCORED = "w1 long, w2 long, w3 long, w4 long, a long, l1 long, l2 long, l3 long, r1 long, r2 long, r3 long, cover long"


# --- transducers ---------------------------------------------------------------

def _smallest(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _sum_sorted(paths: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted paths (rows of names, 0 after the last), equal ones summed."""
    order = np.lexsort(paths.T[::-1])
    paths, weight = paths[order], weight[order]
    if not len(paths):
        return paths, weight
    new = np.flatnonzero(np.append(True, (paths[1:] != paths[:-1]).any(axis=1)))
    return paths[new], np.add.reduceat(weight, new)


class Counts:
    """``levels[k]`` = (arcs of each state of level k, words on the arcs, weights); weight 0: no phrase ends there."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def of(cls, paths: np.ndarray, weight: np.ndarray) -> Counts:
        """From sorted, different paths: a state opens wherever a prefix is not the one before."""
        levels, states = [], 1
        parent, changed = np.zeros(len(paths), np.int64), np.zeros(len(paths), bool)
        for k in range(paths.shape[1]):
            label = paths[:, k]
            if not label.any():
                break
            changed[0] = True
            changed[1:] |= label[1:] != label[:-1]
            opens = changed & (label != 0)
            at = np.flatnonzero(opens)
            ends = paths[at, k + 1] == 0 if k + 1 < paths.shape[1] else True  # a phrase sorts before those that go on from it
            levels.append((np.bincount(parent[at], minlength=states), label[at], np.where(ends, weight[at], 0)))
            parent, states = np.cumsum(opens) - 1, len(at)
        return cls(levels)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases with a weight, not sorted, and their weights."""
        prefix, out = np.zeros((1, LONGEST), W.U), []
        for k, (arcs, label, weight) in enumerate(self.levels):
            prefix = np.repeat(prefix, arcs, axis=0)
            prefix[:, k] = label
            out.append((prefix[weight > 0], weight[weight > 0]))
        return np.concatenate([p for p, _ in out]) if out else prefix[:0], np.concatenate([w for _, w in out]) if out else np.empty(0, np.int64)

    def weights(self, asked: np.ndarray) -> np.ndarray:
        """Weights of the asked paths (0 if there is none): each is walked arc by arc, by binary search among a state's arcs."""
        state, out = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        alive = np.ones(len(asked), bool)
        for k, (arcs, label, weight) in enumerate(self.levels[:asked.shape[1]]):
            until = np.cumsum(arcs)
            alive = alive & (asked[:, k] != 0)
            lo, hi = (until - arcs)[state], until[state]
            top = hi.copy()
            while (going := alive & (lo < hi)).any():
                mid = (lo + hi) >> 1
                less = going & (label[np.minimum(mid, len(label) - 1)] < asked[:, k])
                lo, hi = np.where(less, mid + 1, lo), np.where(going & ~less, mid, hi)
            at = np.minimum(lo, len(label) - 1)
            alive &= (lo < top) & (label[at] == asked[:, k])
            ends = alive & ((asked[:, k + 1] == 0) if k + 1 < asked.shape[1] else True)
            out[ends] = weight[at[ends]]
            state = np.where(alive, at, 0)
        return out

    def pack(self) -> bytes:
        parts = [np.array([len(self.levels)], "<u4").tobytes()]
        for level in self.levels:
            for x in (_smallest(level[0]), level[1].astype("<u8"), _smallest(level[2])):
                parts += [np.array([x.itemsize, len(x)], "<u8").tobytes(), x.tobytes()]
        return b"".join(parts)

    @classmethod
    def unpack(cls, raw: bytes) -> Counts:
        at, levels = 4, []
        for _ in range(int(np.frombuffer(raw, "<u4", 1)[0])):
            level = []
            for kind in (np.int64, W.U, np.int64):
                size, n = (int(v) for v in np.frombuffer(raw, "<u8", 2, at))
                level.append(np.frombuffer(raw, f"<u{size}", n, at + 16).astype(kind))
                at += 16 + size * n
            levels.append(tuple(level))
        return cls(levels)


def union(packed: list[bytes]) -> Counts:
    """One transducer of all phrases, weights summed."""
    parts = [Counts.unpack(p).paths() for p in packed]
    return Counts.of(*_sum_sorted(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts])))


# --- names and ranges ------------------------------------------------------------

def _owner(name: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash: ranges are slices of the hashes in order."""
    return ((name >> W.U(32)) * W.U(ranges) >> W.U(32)).astype(np.int64)


def _pair(paths: np.ndarray) -> np.ndarray:
    """Hash by which a phrase is owned: of its first two words, or of its only one."""
    if paths.shape[1] == 1:
        return paths[:, 0]
    return np.where(paths[:, 1] == 0, paths[:, 0], W.mix(paths[:, 0] * W.MULT + paths[:, 1]))


def _bit(name: np.ndarray, bits: int) -> np.ndarray:
    return (name >> W.U(64 - bits)).astype(np.int64)


def _in(bitmap: np.ndarray, name: np.ndarray) -> np.ndarray:
    at = _bit(name, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (at & 7) & 1).astype(bool)


def _words(batch: pa.RecordBatch, lo: int, hi: int, buf: np.ndarray, off: np.ndarray):
    """Names of all words, whether each is followed by the next in its piece, their spans and their texts."""
    starts, ends, first = W.spans(buf, off, WORD)
    text = np.repeat(np.arange(hi - lo), np.diff(first))
    lang = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)[lo:hi].view(W.U)
    name = W.mix(W.names(buf, starts, ends) ^ lang[text])
    name[name == 0] = 1  # 0 ends a path
    joined = np.zeros(len(name), bool)
    cut = np.concatenate([[0], np.cumsum(SEPARATES[buf])])
    joined[:-1] = (text[1:] == text[:-1]) & (cut[starts[1:]] == cut[ends[:-1]])
    return name, joined, starts, ends, text


# --- passes over the texts ---------------------------------------------------------

class Shard:
    """Counts phrases of a task; ``full`` tells when transducers are to be built of them."""

    def __init__(self, width: int, ranges: int, held: int):
        self.width, self.ranges, self.held, self.parts, self.size = width, ranges, held, [], 0

    def add(self, paths: np.ndarray) -> None:
        key = paths[:, 0]
        for k in range(1, self.width):
            key = W.mix(key * W.MULT + paths[:, k])
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        self.parts.append((paths[at], n))
        self.size += len(at)

    def merge(self) -> None:
        if self.parts:
            self.parts = [_sum_sorted(np.concatenate([p for p, _ in self.parts]), np.concatenate([n for _, n in self.parts]))]
            self.size = len(self.parts[0][0])

    def full(self) -> bool:
        """Whether too many different phrases are held."""
        if self.size > self.held:
            self.merge()
        return 2 * self.size > self.held and len(self.parts) == 1

    def built(self) -> list[tuple[int, bytes]]:
        """(range, transducer) of what was counted; counting begins anew."""
        self.merge()
        out = []
        if self.size:
            paths, n = self.parts[0]
            owner = _owner(_pair(paths), self.ranges)
            order = np.argsort(owner, kind="stable")  # paths stay sorted within a range
            cuts = np.flatnonzero(np.diff(owner[order])) + 1
            out = [(int(owner[part[0]]), Counts.of(paths[part], n[part]).pack()) for part in np.split(order, cuts)]
        self.parts, self.size = [], 0
        return out


def _rows(built=(), totals=()) -> pa.RecordBatch:
    n, k = len(built), len(totals)
    return pa.RecordBatch.from_arrays([
        pa.array([b[0] for b in built] + [None] * k, pa.int32()), pa.array([b[1] for b in built] + [None] * k, pa.binary()),
        pa.array([b[2] if len(b) > 2 else None for b in built] + [None] * k, pa.binary()),
        pa.array([None] * n + [t[0] for t in totals], pa.string()), pa.array([None] * n + [t[1] for t in totals], pa.int64()),
    ], ["range", "counts", "words", "lang", "n"])


def _with_words(built: list[tuple[int, bytes]], said: dict[int, bytes]):
    """Each range's transducer of single words with the words, in its order: lengths, then all bytes (`language, tab, word`)."""
    for owner, raw in built:
        words = [said[n] for n in Counts.unpack(raw).levels[0][1].tolist()]
        yield owner, raw, np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words)


def _count_words(ranges: int, held: int):
    def count(batches):
        shard, totals, said = Shard(1, ranges, held), {}, {}
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for lo, hi, buf, off in chunks(batch):
                name, _, starts, ends, text = _words(batch, lo, hi, buf, off)
                for lang, n in zip(langs[lo:hi], np.bincount(text, minlength=hi - lo).tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
                shard.add(name[:, None])
                names, at = np.unique(name, return_index=True)
                low, prefix = W.LOWER[buf].tobytes(), [f"{x}\t".encode() for x in langs[lo:hi]]
                for n, i in zip(names.tolist(), at.tolist(), strict=True):
                    if n not in said:
                        said[n] = prefix[text[i]] + low[starts[i]:ends[i]]
                if shard.full():
                    yield _rows(built=list(_with_words(shard.built(), said)))
                    said = {}
        yield _rows(built=list(_with_words(shard.built(), said)), totals=list(totals.items()))
    return count


def _count_pairs(frequent, ranges: int, held: int):
    def count(batches):
        shard = Shard(2, ranges, held)
        for batch in batches:
            for lo, hi, buf, off in chunks(batch):
                name, joined, *_ = _words(batch, lo, hi, buf, off)
                known = _in(frequent.value, name)
                at = np.flatnonzero(joined[:-1] & known[:-1] & known[1:])
                shard.add(np.stack([name[at], name[at + 1]], axis=1))
                if shard.full():
                    yield _rows(built=shard.built())
        yield _rows(built=shard.built())
    return count


def _count_longer(frequent, frequent_pairs, ranges: int, held: int):
    def count(batches):
        shard = Shard(LONGEST, ranges, held)
        for batch in batches:
            for lo, hi, buf, off in chunks(batch):
                name, joined, *_ = _words(batch, lo, hi, buf, off)
                known = _in(frequent.value, name)
                pair = np.zeros(len(name) + 2, bool)  # with the next word a pair that is not rare
                at = np.flatnonzero(joined[:-1] & known[:-1] & known[1:])
                pair[at] = _in(frequent_pairs.value, _pair(np.stack([name[at], name[at + 1]], axis=1)))
                three = np.flatnonzero(pair[:-2] & pair[1:-1])
                four = three[pair[three + 2]]
                paths = np.zeros((len(three) + len(four), LONGEST), W.U)
                for k in range(LONGEST):
                    paths[len(three):, k] = name[four + k]
                    if k < 3:
                        paths[:len(three), k] = name[three + k]
                shard.add(paths)
                if shard.full():
                    yield _rows(built=shard.built())
        yield _rows(built=shard.built())
    return count


# --- unions --------------------------------------------------------------------------

def _unite(least: int, bits: int):
    def unite(table: pa.Table) -> pa.Table:
        """The phrases of a range that are not rare, and the bits of their hashes from byte ``since`` on."""
        paths, n = union(table.column("counts").to_pylist()).paths()
        paths, n = _sum_sorted(paths[n >= least], n[n >= least])
        bit = np.unique(_bit(_pair(paths), bits))
        since = int(bit[0]) >> 3 if len(bit) else 0
        marks = np.zeros(((int(bit[-1]) >> 3) - since + 1) * 8 if len(bit) else 0, np.uint8)
        marks[bit - 8 * since] = 1
        names, words = _said(table, paths[:, 0]) if table.column("words").null_count < table.num_rows else (None, None)
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "counts": [Counts.of(paths, n).pack()],
                         "since": pa.array([since], pa.int32()), "bits": [np.packbits(marks, bitorder="little").tobytes()],
                         "names": pa.array([names], pa.list_(pa.int64())), "words": pa.array([words], pa.list_(pa.string()))})
    return unite


def _said(table: pa.Table, kept: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The kept names of a range and their words, from the shards that hold them."""
    out = {}
    for counts, words in zip(table.column("counts").to_pylist(), table.column("words").to_pylist(), strict=True):
        name = Counts.unpack(counts).levels[0][1]
        ends = np.cumsum(np.frombuffer(words, "<u4", len(name)).astype(np.int64)) + 4 * len(name)
        at = np.flatnonzero(np.isin(name, kept))
        out.update((int(name[i]), words[int(ends[i - 1]) if i else 4 * len(name):int(ends[i])]) for i in at)
    return kept.view(np.int64), [out[n].decode() for n in kept.tolist()]


def _united(shards: DataFrame, label: str, least: int, bits: int) -> DataFrame:
    rows = shards.where("range is not null").select("range", "counts", "words")
    return stored(rows.groupBy("range").applyInArrow(_unite(least, bits), UNION), label)


def _bitmap(united: DataFrame, bits: int) -> np.ndarray:
    """All ranges' bits: slices of a bitmap of 2^bits bits, a byte of overlap each at most."""
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in united.select("since", "bits").collect():
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["since"]:r["since"] + len(part)] |= part
    return out


# --- look-up of parts ----------------------------------------------------------------

def _parts(paths: np.ndarray):
    """(kind, k, rows, part) of every candidate's parts: first k words (0), the rest (1), inner words (2)."""
    length = (paths != 0).sum(axis=1)
    for k in range(1, LONGEST):
        rows = np.flatnonzero(length > k)
        left, right = np.zeros((len(rows), LONGEST - 1), W.U), np.zeros((len(rows), LONGEST - 1), W.U)
        left[:, :k] = paths[rows, :k]
        right[:, :LONGEST - k] = paths[rows, k:]
        yield 0, k, rows, left
        yield 1, k, rows, right
    rows = np.flatnonzero(length == LONGEST)
    inner = np.zeros((len(rows), LONGEST - 1), W.U)
    inner[:, :LONGEST - 2] = paths[rows, 1:LONGEST - 1]
    yield 2, 0, rows, inner


def _signed(paths: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(paths[:, k]).view(np.int64)) for k in range(paths.shape[1])]


def _unsigned(table: pa.Table, columns) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().view(W.U) for c in columns], axis=1) if table.num_rows else np.empty((0, len(columns)), W.U)


def _ask(ranges: int):
    def ask(batches):
        """What a range asks for: each part once, with the most frequent candidate that holds it."""
        for batch in batches:
            for sender, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                paths, n = Counts.unpack(raw).paths()
                parts = [(part, n[rows]) for _, _, rows, part in _parts(paths)]
                part, f = np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts])
                order = np.lexsort((f, *part.T[::-1]))
                part, f = part[order], f[order]
                last = np.flatnonzero(np.append((part[1:] != part[:-1]).any(axis=1), True)) if len(part) else np.empty(0, np.int64)
                part, f = part[last], f[last]
                owner = _owner(_pair(part), ranges) + np.where(part[:, 1] == 0, ranges, 0) if len(part) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), pa.array(np.full(len(f), sender, np.int32)), *_signed(part), pa.array(f.astype(np.int64))],
                                                 ["owner", "sender", "w1", "w2", "w3", "f"])
    return ask


def _answer(asked: pa.Table, owned: pa.Table) -> pa.Table:
    """Weights of the parts that ranges ask of this one (kind 0), and for its own phrases the most frequent candidate that holds them (1)."""
    part, f = _unsigned(asked, ("w1", "w2", "w3")), asked.column("f").to_numpy()
    found = Counts.unpack(owned.column("counts")[0].as_py()).weights(part) if owned.num_rows else np.zeros(len(part), np.int64)
    sender = asked.column("sender").to_numpy()
    own = np.flatnonzero(part[:, 1] != 0)
    order = own[np.lexsort((f[own], *part[own].T[::-1]))]
    last = order[np.flatnonzero(np.append((part[order][1:] != part[order][:-1]).any(axis=1), True))] if len(order) else order
    to = np.concatenate([sender, asked.column("owner").to_numpy()[last]]).astype(np.int32)
    kind = np.repeat(np.array([0, 1], np.int32), [len(part), len(last)])
    return pa.table([pa.array(to), pa.array(kind), *_signed(np.concatenate([part, part[last]])), pa.array(np.concatenate([found, f[last]]).astype(np.int64))],
                    names=["range", "kind", "w1", "w2", "w3", "value"])


def _assemble(answers: pa.Table, owned: pa.Table) -> pa.Table:
    """A range's candidates with the weights of their parts."""
    paths, n = Counts.unpack(owned.column("counts")[0].as_py()).paths() if owned.num_rows else (np.empty((0, LONGEST), W.U), np.empty(0, np.int64))
    kind, value = answers.column("kind").to_numpy(), answers.column("value").to_numpy()
    words = _unsigned(answers, ("w1", "w2", "w3"))
    of = [Counts.of(*_sum_sorted(words[kind == k], value[kind == k])) for k in (0, 1)]  # the answers as transducers
    columns = {}
    for side, k, rows, part in _parts(paths):
        if side < 2:
            got = np.zeros(len(paths), np.int64)
            got[rows] = of[0].weights(part)
            columns["lr"[side] + str(k)] = pa.array(got, mask=got == 0)
    cover = of[1].weights(paths[:, :LONGEST - 1])
    cover[(paths != 0).sum(axis=1) == LONGEST] = 0  # nothing is longer
    columns["cover"] = pa.array(cover, mask=cover == 0)
    return pa.table([*_signed(paths), pa.array(n.astype(np.int64)), *[columns[c] for c in ("l1", "l2", "l3", "r1", "r2", "r3", "cover")]],
                    names=["w1", "w2", "w3", "w4", "a", "l1", "l2", "l3", "r1", "r2", "r3", "cover"])


# --- the operator ------------------------------------------------------------------------

def candidates(docs: DataFrame, least: int = LEAST, bits: int = BITMAP_BITS, held: int = HELD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates with the weights of their parts, words by name, number of words of each language)."""
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("key"))
    context = spark.sparkContext

    words = stored(texts.mapInArrow(_count_words(ranges, held // 4), SHARD), "phrase-words")
    single = _united(words, "phrase-words-united", least, bits)
    totals = words.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = context.broadcast(_bitmap(single, bits))

    pairs = _united(texts.mapInArrow(_count_pairs(frequent, ranges, held), SHARD), "phrase-pairs-united", least, bits)
    frequent_pairs = context.broadcast(_bitmap(pairs, bits))

    longer = texts.mapInArrow(_count_longer(frequent, frequent_pairs, ranges, held), SHARD).select("range", "counts", "words")
    counts = _united(longer.unionByName(pairs.select("range", "counts", F.lit(None).cast("binary").alias("words"))), "phrases", least, bits)
    symbol = single.select(F.explode(F.arrays_zip("names", "words")).alias("s"))
    symbols = symbol.select(F.col("s.names").alias("name"), F.regexp_extract("s.words", r"(?s)^(.*)\t", 1).alias("lang"), F.substring_index("s.words", "\t", -1).alias("word"))

    asked = counts.select("range", "counts").mapInArrow(_ask(ranges), ASKED)
    owned = counts.select(F.col("range").alias("owner"), "counts").unionByName(single.select((F.col("range") + ranges).alias("owner"), "counts"))
    answers = asked.groupBy("owner").cogroup(owned.groupBy("owner")).applyInArrow(_answer, ANSWER)
    found = answers.groupBy("range").cogroup(counts.select("range", "counts").groupBy("range")).applyInArrow(_assemble, SCORED)
    return found, symbols, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, bits: int = BITMAP_BITS, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    found, symbols, totals = candidates(docs, least, bits, held)
    wide = lambda c: f"cast({c} as decimal(20, 0))"
    cut = lambda k: f"if(l{k} is null, null, struct(({wide('a')} * {SCALE}) div ({wide(f'l{k}')} + r{k}) as score, {k} as k, l{k} as l, r{k} as r))"
    least_cut = F.expr(f"array_min(array({', '.join(cut(k) for k in range(1, LONGEST))}))")
    kept = found.where(f"cover is null or 100 * {wide('cover')} < {cover} * {wide('a')}").withColumn("cut", least_cut)
    kept = stored(kept.select("w1", "w2", "w3", "w4", "a", "cut.score", "cut.l", "cut.r"), "phrases-kept")
    each = kept.select("w1", "w2", "w3", "w4", F.explode(F.expr("filter(transform(array(w1, w2, w3, w4), (w, i) -> struct(i as i, w as name)), x -> x.name != 0)")).alias("x"))
    said = each.select("w1", "w2", "w3", "w4", "x.i", "x.name").join(symbols, "name").groupBy("w1", "w2", "w3", "w4").agg(
        F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("words"))
    phrase = said.select("w1", "w2", "w3", "w4", "lang", F.array_join(F.col("words.word"), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(phrase, ["w1", "w2", "w3", "w4"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
