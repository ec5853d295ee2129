"""Benchmark decontamination: prefix-filtered set join of item windows against documents.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item of fewer words, but not none, is one window).  A document contains a
window only if it contains each of the window's shingles, so for exact
containment one shingle is a necessary prefix; the rarest one in the corpus
makes the fewest candidates.

1. Count, over all documents, the shingles that occur in some item.  Tasks keep
   only shingles that pass a bitmap of fixed size (``BITMAP_BITS``; the one
   thing that is broadcast), so the shuffle holds counts of item shingles.
2. Order each window's shingles by rarity; a window with a shingle that no
   document has is out; of the others the rarest shingle is the prefix.
3. Join the places of prefix shingles in documents with the windows.  Length and
   positional bounds drop places too near a text's ends; the words
   around the place must equal the window's words exactly.
4. Per document: the union of matched word ranges, and the items they belong to.

Cases: a null or empty text has no words and no hit; an item without words has
no window; repeated items count each by its id, a repeated item row once; an item
with a null item_id hits like any other but is not among the ids; a null doc_id is a document like any other; repeated
documents are judged row by row; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnforge.llm import words as W
from turnforge.llm.common import chunks, stored, with_key

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
BITMAP_BITS = 24

WINDOWS = "item_id long, window string, n long, names array<long>, sizes array<int>"
COUNTS = "name long, n long"
HITS = "doc_id long, row_hash int, n_words long, hits array<struct<name:long,at:int,before:int,words:string>>"


def _cut_items(window: int, shingle: int):
    def cut(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, buf, off in chunks(batch):
                starts, ends, first = W.spans(buf, off, W.ALNUM)
                name = W.names(buf, starts, ends)
                low = W.LOWER[buf].tobytes()
                text = [low[a:b].decode() for a, b in zip(starts, ends, strict=True)]
                out = []
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    n = min(window, b - a)
                    size = min(shingle, n)
                    for p in range(a, b - n + 1) if n else ():
                        got = W.grams(name[p:p + n], np.array([0, n]), size)[0]
                        out.append((ids[lo + i], " ".join(text[p:p + n]), n, got.view(np.int64).tolist(), [size] * len(got)))
                yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "window", "n", "names", "sizes"), r, strict=True)) for r in out], pa.schema([("item_id", pa.int64()), ("window", pa.string()), ("n", pa.int64()), ("names", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]))
    return cut


def _bitmap(names: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the low bits of ``name``; at most 2^(bits - 6) slots come to the driver, whatever the table's size."""
    at = F.col("name").bitwiseAND((1 << bits) - 1)
    slots = names.groupBy(F.shiftright(at, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(name & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(1 << bits >> 6, np.uint64)
    out[slots["slot"].to_numpy()] = slots["set"].to_numpy().view(np.uint64)
    return out


def _passes(bitmap: np.ndarray, name: np.ndarray, bits: int) -> np.ndarray:
    low = name & W.U((1 << bits) - 1)
    return (bitmap[(low >> W.U(6)).astype(np.int64)] >> (low & W.U(63)) & W.U(1)).astype(bool)


def _count_shingles(bitmap, sizes, bits):
    def count(batches):
        for batch in batches:
            for _, _, buf, off in chunks(batch):
                starts, ends, first = W.spans(buf, off, W.ALNUM)
                word = W.names(buf, starts, ends)
                got = [g[_passes(bitmap.value, g, bits)] for g in (W.grams(word, first, s)[0] for s in sizes)]
                name, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.empty(0, W.U), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n.astype(np.int64))], ["name", "n"])
    return count


def _find_prefixes(bitmap, sizes, bits, window):
    item = pa.struct([("name", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.string())])

    def find(batches):
        for batch in batches:
            for lo, hi, buf, off in chunks(batch):
                starts, ends, first = W.spans(buf, off, W.ALNUM)
                word = W.names(buf, starts, ends)
                rows = []
                for s in sizes:
                    name, text, at = W.grams(word, first, s)
                    keep = _passes(bitmap.value, name, bits)
                    rows.append((name[keep], text[keep], at[keep]))
                name, text, at = (np.concatenate([r[k] for r in rows]) if rows else np.empty(0, np.int64) for k in range(3))
                order = np.argsort(text, kind="stable")
                name, text, at = name[order], text[order], at[order]
                low = W.LOWER[buf].tobytes()
                since, until = np.maximum(at - window + 1, first[text]), np.minimum(at + window, first[text + 1])
                around = [b" ".join(low[starts[k]:ends[k]] for k in range(a, b)).decode() for a, b in zip(since, until, strict=True)]
                values = pa.StructArray.from_arrays([pa.array(name.astype(W.U).view(np.int64)), pa.array((at - first[text]).astype(np.int32)), pa.array((at - since).astype(np.int32)), pa.array(around, pa.string())], fields=list(item))
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)), values)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_hash"), pa.array(np.diff(first).astype(np.int64)), hits], ["doc_id", "row_hash", "n_words", "hits"])
    return find


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(documents with n_words, matches): matches has a row for each document row, word range and item."""
    spark = docs.sparkSession
    docs = with_key(docs)
    cut = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_cut_items(window, shingle), WINDOWS)
    cut = stored(cut.distinct(), "item-windows")
    windows = cut.dropDuplicates(["window"]).select("window", "n", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("names") - 1).alias("offset"), "names", "sizes")).alias("s")).select("window", "n", "s.offset", F.col("s.names").alias("name"), F.col("s.sizes").alias("size"))
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # 1 to ``shingle``
    context = spark.sparkContext

    seen = context.broadcast(_bitmap(windows.select("name"), bits))
    counts = docs.select("text").mapInArrow(_count_shingles(seen, sizes, bits), COUNTS).groupBy("name").agg(F.sum("n").alias("n_corpus"))
    rarest = (windows.join(counts, "name", "left").groupBy("window", "n")
              .agg(F.min(F.coalesce("n_corpus", F.lit(0))).alias("least"), F.min_by(F.struct("name", "offset"), F.struct("n_corpus", "name", "offset")).alias("prefix"))
              .where("least > 0").select("window", "n", "prefix.name", "prefix.offset"))
    rarest = stored(rarest, "window-prefixes")

    prefix = context.broadcast(_bitmap(rarest.select("name"), bits))
    found = stored(docs.mapInArrow(_find_prefixes(prefix, sizes, bits, window), HITS), "prefix-hits")
    place = found.select("doc_id", "row_hash", "n_words", F.explode("hits").alias("hit")).select("doc_id", "row_hash", "n_words", "hit.*")
    start = F.col("at") - F.col("offset")
    same = F.array_join(F.slice(F.split("words", " "), (F.col("before") - F.col("offset") + 1).cast("int"), F.col("n").cast("int")), " ") == F.col("window")
    verified = (place.join(rarest, "name").where((start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("before") >= F.col("offset")))
                .where(same).select("doc_id", "row_hash", start.alias("since"), (start + F.col("n")).alias("until"), "window"))
    return found.select("doc_id", "row_hash", "n_words"), verified.join(cut.select("window", "item_id"), "window").select("doc_id", "row_hash", "since", "until", "item_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS, bits: int = BITMAP_BITS) -> DataFrame:
    """One row per document row: doc_id, row_hash, n_words, n_hit, item_ids (sorted as strings)."""
    base, matches = find_matches(docs, items, window, shingle, bits)
    # since/until pairs of one document: at most one per word and window length
    covered = F.expr("aggregate(array_sort(collect_set(struct(since, until))), struct(0L as n, 0L as upto), "
                     "(a, x) -> struct(a.n + greatest(0L, x.until - greatest(x.since, a.upto)) as n, greatest(a.upto, x.until) as upto)).n")
    of_doc = matches.groupBy("doc_id", "row_hash").agg(covered.alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    b, m = base.alias("b"), of_doc.alias("m")
    return (b.join(m, F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.row_hash") == F.col("m.row_hash")), "left")
            .select("b.doc_id", "b.row_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no item window, all columns as they were."""
    _, matches = find_matches(docs, items, window)
    hit = matches.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.hash(F.coalesce(docs["text"], F.lit(""))) == F.col("__hash")), "left_anti")
