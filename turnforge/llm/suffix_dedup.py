"""Removal of repeated byte strings across documents by names of growing length at anchors.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a
smaller id.  In place of prefix doubling over all positions, strings are told by names of two
lengths at anchor positions: the name of 16 bytes is that of two names of 8 bytes at offset 8, the
name of 50 bytes joins those of its 16-byte anchor and of the 34 bytes around it.  Spark sorts (name, document) pairs,
positions whose name is unique to a document drop out, and the rest go on to
the next length, until they are unique or past the threshold.

Texts that a smaller document has as a whole go first, as a whole.

Round 1, 16 bytes.  A string is sorted at one of its positions only: where its 35 names
of 16 bytes have their least hash.  This anchor depends on the string alone, so
equal strings have equal anchors, and about one position in 18 is an anchor.
Anchors whose name is in one document only drop out.

Round 2, 50 bytes.  The strings that share an anchor are a run of consecutive
positions; a run is sent as the bytes around its anchor to where the anchor's name is
sorted, and all its 50-byte strings are ranked there.  Equal runs that meet in a map
task are sent once, for their smallest document; the others are matched on the spot.

Last, each document's matched ranges are joined with its text.

Names are 64-bit hashes; a wrong match needs two of the strings under one anchor to
collide.  Positions, ranges and texts move through shuffles, nothing goes to the driver.

Cases: a null or empty text has no bytes; rows with a null id neither lose bytes nor take
any; rows that repeat an id are one document's texts, each with its own result, and
do not match each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnforge.llm import words as W
from turnforge.llm.common import chunks, string_buffer, with_key

LENGTH = 50
ANCHOR = 16
REST = LENGTH - ANCHOR
PLACE_BITS = 28  # of an anchor's order; the hash has the rest
CHUNK = 1 << 20
SEGMENT = 1 << 24  # a longer text is worked on in segments that overlap by LENGTH - 1
M1, M2 = W.U(0x9FB21C651E98DF25), W.U(0xA0761D6478BD642F)

#: ``run``: HEAD bytes, little-endian start (8), row_hash (4) and bytes before the anchor (1), then the bytes around it.
RUNS = "name long, doc_id long, stop long, run binary"
HEAD = 13
RANGES = "doc_id long, row_hash int, start long, stop long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number."""
    return np.ndarray((max(len(buf) - 7, 0),), "<u8", buffer=np.ascontiguousarray(buf), strides=(1,))


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * M1
    z ^= z >> W.U(32)
    z += y
    z *= M2
    z ^= z >> W.U(29)
    return z


def names_around(buf: np.ndarray) -> np.ndarray:
    """Names of the REST bytes from each position on, joined from 8 bytes at offsets 8, 16, 24 and 26."""
    v = _eights(buf)
    n = max(len(buf) - REST + 1, 0)
    z = v[:n]
    for at in (8, 16, 24, REST - 8):
        z = _joined(z, v[at:at + n])
    return z


def anchored_runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, anchor's name) of every run of strings with one anchor."""
    none = np.empty(0, np.int64)
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return none, none, none, none, none.astype(W.U)
    v = _eights(buf)
    name = _joined(v[:len(buf) - ANCHOR + 1], v[ANCHOR - 8:])
    order = (name * M1) & ~W.U((1 << PLACE_BITS) - 1)
    order |= np.arange(len(order), dtype=W.U)
    width, want = 1, LENGTH - ANCHOR + 1
    while 2 * width <= want:
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    order = np.minimum(order[:n], order[want - width:want - width + n])
    anchor = (order & W.U((1 << PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    ok = np.arange(n) + LENGTH <= off[1:][text]
    at = np.flatnonzero(ok)
    anchor, text = anchor[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return text[first], at[first], at[last], anchor[first], name[anchor[first]]


def segments(buf: np.ndarray, off: np.ndarray):
    """(bytes, offsets, place of the first byte in its text): the chunk itself, or segments of one very long text."""
    if len(buf) <= SEGMENT:
        yield buf, off, 0
        return
    for k in range(len(off) - 1):
        for lo in range(int(off[k]), max(int(off[k + 1]) - LENGTH + 1, int(off[k]) + 1), SEGMENT):
            hi = min(lo + SEGMENT + LENGTH - 1, int(off[k + 1]))
            part = np.zeros(len(off), np.int64)
            part[k + 1:] = hi - lo
            yield buf[lo:hi], part, lo - int(off[k])


def _anchor_names(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, _, buf, off in chunks(batch, limit=CHUNK):
            for part, offsets, _ in segments(buf, off):
                text, _, _, _, name = anchored_runs(part, offsets)
                order = np.lexsort((name, text))
                text, name = text[order], name[order]
                new = np.ones(len(name), bool)
                new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(name[new].view(np.int64)), pa.array(ids[lo + text[new]])], ["name", "doc_id"])


def _in_two_documents(batches):
    """From rows sorted by (name, doc_id): each distinct row whose name has another document."""
    held = None  # the last row, if its name has been seen with its document only
    last = None
    for batch in batches:
        name, doc = (batch.column(k).to_numpy() for k in range(2))
        if held is not None:
            name, doc = np.concatenate([[held[0]], name]), np.concatenate([[held[1]], doc])
        if not len(name):
            continue
        distinct = np.ones(len(name), bool)
        distinct[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        if held is None and last is not None:
            distinct[0] = (name[0], doc[0]) != last
        name, doc = name[distinct], doc[distinct]
        if not len(name):
            continue
        same = name[1:] == name[:-1]
        shared = np.zeros(len(name), bool)
        shared[1:] |= same
        shared[:-1] |= same
        if held is None and last is not None and name[0] == last[0]:
            shared[name == last[0]] = True
        last = (name[-1], doc[-1])
        held = None if shared[-1] else last
        yield pa.RecordBatch.from_arrays([pa.array(name[shared]), pa.array(doc[shared])], ["name", "doc_id"])


def _merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the ranges of each key."""
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    if not len(key):
        return key, start, stop
    big = int(stop.max()) + 1
    reach = np.maximum.accumulate(key * big + stop)  # keys ascend
    new = np.ones(len(key), bool)
    new[1:] = key[1:] * big + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], reach[last] - key[first] * big


def _run_rows(batches):
    """Run rows of documents that come in the order of their ids.

    A run that an earlier document of this task has too, byte for byte, is
    matched on the spot: its range goes out as a row with a stop, ranges of one
    document merged.  Other runs go out as the bytes around their anchor.
    """
    schema = pa.schema([("name", pa.int64()), ("doc_id", pa.int64()), ("stop", pa.int64()), ("run", pa.binary())])
    met, met_doc = np.empty(0, W.U), np.empty(0, np.int64)  # runs so far and the first document of each
    for batch in batches:
        ids, hashes = batch.column("doc_id").to_numpy(), batch.column("row_hash").to_numpy()
        listed = batch.column("names")
        for lo, hi, buf, off in chunks(batch, limit=CHUNK):
            part = listed.slice(lo, hi - lo)
            known = part.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(hi - lo), part.value_lengths().fill_null(0).to_numpy())
            known = np.unique(W.mix(known + W.mix(owner.astype(W.U))))
            for piece, offsets, base in segments(buf, off):
                text, first, last, anchor, name = anchored_runs(piece, offsets)
                keep = np.isin(W.mix(name + W.mix(text.astype(W.U))), known)
                text, first, last, anchor, name = (x[keep] for x in (text, first, last, anchor, name))
                if not len(text):
                    continue
                stop = last + LENGTH
                content = W.mix(W.names(piece, first, stop, lower=False) + (anchor - first).astype(W.U))
                doc = ids[lo + text]
                every, every_doc = np.concatenate([met, content]), np.concatenate([met_doc, doc])
                met, place = np.unique(every, return_inverse=True)
                met_doc = np.full(len(met), np.iinfo(np.int64).max)
                np.minimum.at(met_doc, place, every_doc)
                done = doc > met_doc[place[len(every) - len(doc):]]
                start = first - offsets[text] + base
                t, s, e = _merged(text[done], start[done], start[done] + (stop - first)[done])
                raw = piece.tobytes()
                go = np.flatnonzero(~done)
                head = struct.Struct("<qiB").pack
                around = [head(at, h, m - a) + raw[a:m] + raw[m + ANCHOR:b] for at, h, a, m, b in
                          zip(start[go].tolist(), hashes[lo + text[go]].tolist(), first[go].tolist(), anchor[go].tolist(), stop[go].tolist(), strict=True)]
                done_rows = [head(at, h, 0) for at, h in zip(s.tolist(), hashes[lo + t].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([name[go].view(np.int64), W.mix(s.astype(W.U) + W.mix(ids[lo + t].view(np.uint64))).view(np.int64)])),
                    pa.array(np.concatenate([doc[go], ids[lo + t]])), pa.array(np.concatenate([0 * go, e])), pa.array(around + done_rows, pa.binary())], schema=schema)


def _heads(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes, offsets, and start, row_hash and left of each run."""
    buf, off = string_buffer(column)
    head = buf[off[:-1, None] + np.arange(HEAD)]
    start = np.ascontiguousarray(head[:, :8]).view("<i8").ravel()
    row = np.ascontiguousarray(head[:, 8:12]).view("<i4").ravel()
    return buf, off, start, row, head[:, 12].astype(np.int64)


Seen = tuple[np.ndarray, np.ndarray]  # names of strings and the smallest document of each


def _ranked(rows: pa.Table, seen: Seen) -> tuple[pa.RecordBatch, Seen]:
    """Ranges of starts that a smaller document has too, given what came before; and all that has been seen."""
    table = rows.combine_chunks()
    doc = table.column("doc_id").to_numpy()
    buf, off, start, row, left = _heads(table.column("run"))
    count = np.maximum(np.diff(off) - HEAD - REST + 1, 0)
    of = np.repeat(np.arange(len(doc)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    # the bytes around the anchor, the anchor's name and its place in the string
    anchor = W.mix(table.column("name").to_numpy().view(np.uint64))
    name = W.mix(names_around(buf)[off[of] + HEAD + at] + anchor[of] + (left[of] - at).astype(W.U))
    name = np.concatenate([name, seen[0]])
    owner = np.concatenate([doc[of], seen[1]])
    order = np.argsort(name, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = name[order][1:] != name[order][:-1]
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[order], heads) if len(order) else owner
    hit = np.empty(len(order), bool)
    hit[order] = owner[order] > least[np.cumsum(new) - 1]
    hit = hit[:len(of)]
    edge = np.ones(len(of) + 1, bool)
    edge[1:-1] = of[1:] != of[:-1]
    begins = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    ends = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False)))
    found = pa.RecordBatch.from_arrays([pa.array(doc[of[begins]]), pa.array(row[of[begins]]), pa.array(start[of[begins]] + at[begins]), pa.array(start[of[ends]] + at[ends] + LENGTH)], ["doc_id", "row_hash", "start", "stop"])
    return found, (name[order][heads], least)


def _rank_runs(batches):
    """From run rows sorted by name and document: the matched ranges.

    About CHUNK bytes of runs are ranked at once.  Of a name with more runs, 16 bytes
    for each distinct string are held until the name ends.
    """
    fresh: Seen = (np.empty(0, W.U), np.empty(0, np.int64))
    held, size, seen = [], 0, fresh
    for batch in batches:
        open_ = pa.compute.equal(batch.column("stop"), 0)
        if not pa.compute.all(open_).as_py():
            done = batch.filter(pa.compute.invert(open_))
            _, _, start, row, _ = _heads(done.column("run"))
            yield pa.RecordBatch.from_arrays([done.column("doc_id"), pa.array(row), pa.array(start), done.column("stop")], ["doc_id", "row_hash", "start", "stop"])
            batch = batch.filter(open_)
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("run").nbytes
        if size < CHUNK:
            continue
        rows = pa.Table.from_batches(held)
        name = rows.column("name").to_numpy()
        cut = int(np.searchsorted(name, name[-1]))
        if cut:
            yield _ranked(rows.slice(0, cut), seen)[0]
            seen = fresh
        rest = rows.slice(cut)
        held, size = rest.to_batches(), rest.column("run").nbytes
        if size >= CHUNK:
            found, seen = _ranked(rest, seen)
            yield found
            held, size = [], 0  # if another name comes next, its strings differ from those seen
    if held:
        yield _ranked(pa.Table.from_batches(held), seen)[0]


def _cut_texts(batches):
    for batch in batches:
        ids, hashes, listed, copies = (batch.column(c).to_pylist() for c in ("doc_id", "row_hash", "ranges", "copy"))
        text = batch.column("text").cast(pa.binary())
        out = []
        for k in range(batch.num_rows):
            raw = text[k].as_py() or b""
            ranges = sorted((r["start"], r["stop"]) for r in listed[k] or () if r["row_hash"] == hashes[k])
            if copies[k] and len(raw) >= LENGTH:
                ranges = [(0, len(raw))]
            spans: list[list[int]] = []
            for a, b in ranges:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            digest, upto = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[upto:a])
                upto = b
            digest.update(raw[upto:])
            out.append((ids[k], len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def copies_of_smaller(docs: DataFrame) -> DataFrame:
    """(doc_id, copies, several) of documents for which one of them says something.

    ``copies``: the row_hashes of a document's texts that a smaller document has as
    a whole.  ``several``: the id has more than one text.
    """
    keys = ("size", "h1", "h2")
    known = docs.select("doc_id", "row_hash", F.length("text").alias("size"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(LENGTH), "text").alias("h2"))
    first = known.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = known.join(first, list(keys)).where("doc_id > first").select("doc_id", "row_hash", F.lit(None).cast("int").alias("other"))
    said = known.select("doc_id", F.lit(None).cast("int").alias("row_hash"), F.col("row_hash").alias("other")).union(copies)
    said = said.groupBy("doc_id").agg(F.collect_set("row_hash").alias("copies"), (F.min("other") < F.max("other")).alias("several"))
    return said.where("several or size(copies) > 0")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Byte ranges (doc_id, row_hash, start, stop) that strings of smaller documents cover; they may overlap.

    ``docs`` is dealt out by doc_id.
    """
    names = docs.select("doc_id", "text").mapInArrow(_anchor_names, "name long, doc_id long").repartition("name").sortWithinPartitions("name", "doc_id")
    of_doc = names.mapInArrow(_in_two_documents, "name long, doc_id long").groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    runs = docs.join(of_doc, "doc_id").select("doc_id", "row_hash", "text", "names").sortWithinPartitions("doc_id").mapInArrow(_run_rows, RUNS)
    return runs.repartition("name").sortWithinPartitions("name", "doc_id").mapInArrow(_rank_runs, RANGES)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    keyed = with_key(docs)
    copies = copies_of_smaller(keyed.where("doc_id is not null"))
    # one exchange of the texts, by doc_id, serves all three uses of ``named``
    named = keyed.where("doc_id is not null").repartition("doc_id").join(copies, "doc_id", "left")
    copy = F.coalesce(F.array_contains("copies", F.col("row_hash")), F.lit(False))
    row = F.when(F.coalesce("several", F.lit(False)), F.col("row_hash")).otherwise(0)  # 0 where the id says it all
    named = named.select("doc_id", "text", row.alias("row_hash"), copy.alias("copy"))
    ranges = repeated_ranges(named.where("not copy")).groupBy("doc_id").agg(F.collect_list(F.struct("row_hash", "start", "stop")).alias("ranges"))
    nameless = keyed.where("doc_id is null").select("doc_id", "text", "row_hash", F.lit(False).alias("copy"), F.lit(None).cast("array<struct<row_hash:int,start:long,stop:long>>").alias("ranges"))
    return named.join(ranges, "doc_id", "left").unionByName(nameless).mapInArrow(_cut_texts, RESULT)
