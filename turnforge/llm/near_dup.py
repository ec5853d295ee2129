"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set is its distinct ``size``-word shingles.  Documents with the same
set are one class, told by a 128-bit sum over the set; only a class's smallest
document goes on.

Sketch (``SKETCH`` coordinates).  Round i < t throws each element into a bin
hashed by (i, element) with value i + u, u in [0, 1); round t + j throws all of
them into bin j.  A bin keeps its smallest value, and rounds end when all bins
are full.  So every coordinate is filled, whatever the set's size, elements of
one round fill bins without replacement, and the number of equal coordinates of
two sets is concentrated around t times their similarity at least as sharply
as with t independent minima.

Bands of ``ROWS`` coordinates make buckets.  Two sets of similarity 0.8 share none
of 50 bands of 5 with probability (1 - 0.8^5)^50, under 3e-9.

Verification, on full sets, in rounds of pivots (see ``_linked``): each candidate pair
is compared, already connected, or ruled out by what both share with their
pivot, and no bucket of more than ``SMALL`` members is expanded into pairs.

Cases: null or empty texts, or texts without words, have empty sets and are
linked with nothing; rows that repeat a doc_id count as that one document, with
the first of its texts in binary order; null ids form no document of their own
and come back unlinked (component null, kept); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnforge.llm import words as W
from turnforge.llm.common import chunks, stored
from turnforge.llm.graph import components

SIZE = 5
PERCENT = 80
SMALL = 8
MEET = 256  # largest element bucket whose pairs meet at once
NEAR = 60  # percent of similarity at which a pivot's buckets go to the pivot above it
VOICES = 9
CHUNK = 1 << 19  # bytes of text at once
ROWS, BANDS = 5, 50
SKETCH = ROWS * BANDS


def distinct_shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (name, text) sorted by text and name."""
    starts, ends, first = W.spans(buf, off, W.NOT_SPACE)
    name, text = W.shingles(W.names(buf, starts, ends), first, size)
    order = np.lexsort((name, text))
    name, text = name[order], text[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    return name[new], text[new]


def sketches(name: np.ndarray, text: np.ndarray, n: int, t: int = SKETCH) -> np.ndarray:
    """Fast similarity sketches of sets: an (n, t) array of 64-bit values; rows of empty sets are not set.

    A value holds the round in its top 16 bits and hashed bits below.
    """
    out = np.full((n, t), np.iinfo(np.uint64).max, W.U)
    flat = out.reshape(-1)
    i = 0
    while len(name):
        h = W.mix(name ^ W.mix(np.array([i + 1], W.U))[0])
        if i < t:
            at = text * t + ((h >> W.U(32)) * W.U(t) >> W.U(32)).astype(np.int64)
        else:
            at = text * t + (i - t)
        value = (W.U(i) << W.U(48)) | (W.mix(h) >> W.U(16))
        np.minimum.at(flat, at, value)
        i += 1
        full = (out != np.iinfo(np.uint64).max).all(axis=1)
        open_ = ~full[text]
        name, text = name[open_], text[open_]
    return out


def _signatures(size: int):
    def sign(batches):
        for batch in batches:
            for lo, hi, buf, off in chunks(batch, limit=CHUNK):
                n = hi - lo
                name, text = distinct_shingles(buf, off, size)
                count = np.bincount(text, minlength=n)
                sums = []
                for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99):
                    total = np.concatenate([[W.U(0)], np.cumsum(W.mix(name ^ W.U(salt)))])
                    upto = np.cumsum(count)
                    sums.append(total[upto] - total[upto - count])
                sketch = sketches(name, text, n).reshape(n, BANDS, ROWS)
                band = np.tile(np.arange(1, BANDS + 1, dtype=W.U), (n, 1))
                for r in range(ROWS):
                    band = W.mix(band * W.MULT + sketch[:, :, r])
                has = count > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(count.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[has].reshape(-1).view(np.int64)))],
                                                 ["doc_id", "n_shingles", "fp1", "fp2", "bands"])
    return sign


def _sets(size: int):
    def cut(batches):
        for batch in batches:
            for lo, hi, buf, off in chunks(batch, limit=CHUNK):
                name, text = distinct_shingles(buf, off, size)
                offsets = np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(name.view(np.int64)))], ["doc_id", "names"])
    return cut


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b and what else they have) with the full sets of a and b as ``names_a`` and ``names_b``."""
    of_a = sets.select(F.col("doc_id").alias("a"), F.col("names").alias("names_a"))
    of_b = sets.select(F.col("doc_id").alias("b"), F.col("names").alias("names_b"))
    return pairs.join(of_b, "b").join(of_a, "a")


def _with_labels(df: DataFrame, labels: DataFrame | None, node: str, name: str) -> DataFrame:
    """``df`` with the component of the document in column ``node``: its own id if it has no link yet."""
    if labels is None:
        return df.withColumn(name, F.col(node))
    known = labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    return df.join(known, F.col(node) == F.col("__node"), "left").withColumn(name, F.coalesce("__label", node)).drop("__node", "__label")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after new links (a, b)."""
    if labels is None:
        return components(links)
    if not links.limit(1).count():
        return labels
    ends = _with_labels(_with_labels(links.select("a", "b"), labels, "a", "x"), labels, "b", "y")
    merged = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    new = merged.join(labels, merged["node"] == labels["node"], "left_anti").select("node", F.col("node").alias("label"))
    return stored(_with_labels(labels.union(new), merged, "label", "now").select("node", F.col("now").alias("label")), "labels")


def _pivots(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, a, n_a): the document with which the members of each large bucket are compared.

    That is the bucket's most loaded member, or, if this one is near the most
    loaded pivot of all its buckets, that pivot.  A cluster of near copies then is
    mostly one group, and its members are not taken apart again in the groups of
    some of them.
    """
    first = F.min(F.struct((-F.col("load")).alias("o"), F.col("rep").alias("a"), F.col("n").alias("n_a"))).alias("p")
    own = stored(members.groupBy("key").agg(first).select("key", "p"), "pivots")
    above = members.join(own, "key").groupBy("rep", "n").agg(F.min("p").alias("up")).where("rep != up.a")
    above = above.join(own.select(F.col("p.a").alias("rep")).distinct(), "rep", "left_semi")
    tried = _compared(above.select(F.col("up.a").alias("a"), F.col("up.n_a").alias("n_a"), F.col("rep").alias("b"), "n"), sets).withColumn("both", F.size(F.array_intersect("names_a", "names_b")))
    near = tried.where((100 + NEAR) * F.col("both") >= NEAR * (F.col("n") + F.col("n_a"))).select("b", F.col("a").alias("up"), F.col("n_a").alias("n_up"))
    return own.join(near, F.col("p.a") == near["b"], "left").select("key", F.coalesce("up", "p.a").alias("a"), F.coalesce("n_up", "p.n_a").alias("n_a"))


def _differences(arrays: DataFrame, percent: int) -> DataFrame:
    """a, b, label, load, n and ``w``, ``sure``, ``extra``, ``lost`` of group members (see ``_linked``).

    The consensus P of a group is its pivot, less the shingles that at least half of
    VOICES members lack, and with those outside it that more than half of them have.
    Any set would do for the bounds; one near the members makes them sharp.
    """
    voices = arrays.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("load"), "b"))).where(F.col("place") <= VOICES)
    size = voices.groupBy("a").agg(F.count("*").alias("m"))
    each = voices.select("a", F.explode("out").alias("e"), F.lit(1).alias("is_out")).union(voices.select("a", F.explode("miss"), F.lit(0)))
    often = (each.groupBy("a", "e", "is_out").agg(F.count("*").alias("c")).join(size, "a")
             .where(F.when(F.col("is_out") == 1, 2 * F.col("c") > F.col("m")).otherwise(2 * F.col("c") >= F.col("m")))
             .groupBy("a").agg(F.collect_list(F.when(F.col("is_out") == 1, F.col("e"))).alias("added"), F.collect_list(F.when(F.col("is_out") == 0, F.col("e"))).alias("removed")))
    none = F.array().cast("array<bigint>")
    both = arrays.join(often, "a", "left").withColumns({"added": F.coalesce("added", none), "removed": F.coalesce("removed", none)})
    both = both.withColumn("extra", F.array_sort(F.concat(F.array_except("out", "added"), F.array_except("removed", "miss"))))
    both = both.withColumn("lost", F.array_sort(F.concat(F.array_except("miss", "removed"), F.array_except("added", "out"))))
    both = both.withColumn("w", (100 * F.size("lost") + percent * F.size("extra")).cast("long"))
    return both.select("a", "b", "n", "load", "label", "w", "extra", "lost", ((100 - percent) * (F.col("n_a") + F.size("added") - F.size("removed"))).alias("sure"))


def _prefixes(group: DataFrame, labels: DataFrame, centre: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n, load, w, sure, left, side): the buckets in which members of a group meet that may still be linked (see ``_linked``)."""
    reach = 100 + percent
    known = _with_labels(group.drop("label"), labels, "b", "label")
    known = known.join(_with_labels(centre, labels, "c", "label_c"), "a").withColumn("core", (F.col("b") == F.col("c")) | (F.col("w") + F.col("w_c") <= F.col("sure")))
    least = known.where("not core").groupBy("a").agg(F.min("w").alias("w_out"))
    alone = F.ceil((F.col("w") - F.col("sure")) / 100)

    def need(partner: str):
        return F.greatest(F.lit(1), alone, F.ceil((F.col("w") + F.col(partner) - F.col("sure")) / reach)).cast("int")

    ways = F.array(F.when(F.col("core"), F.struct(F.lit(0).alias("t"), need("w_out").alias("need"))),
                   F.when(~F.col("core") & (F.col("label") != F.col("label_c")), F.struct(F.lit(0).alias("t"), need("w_c").alias("need"))),
                   F.when(~F.col("core"), F.struct(F.lit(1).alias("t"), need("w_out").alias("need"))))
    ways = (known.join(least, "a").withColumn("elements", F.concat("extra", "lost"))
            .withColumn("way", F.explode(F.filter(ways, lambda x: x.isNotNull() & (x["need"] <= F.size("elements")))))
            .select("a", "b", "n", "load", "label", "core", "w", "sure", "way.t", "way.need", "elements"))
    ways = stored(ways, "ways")
    rows = ways.select("a", "b", "t", "label", "core", F.explode("elements").alias("e"))

    def met(table: DataFrame) -> DataFrame:
        sides = table.groupBy("a", "t", "e").agg(F.count("*").alias("often"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("core").alias("all_core"), F.max("core").alias("any_core"))
        return sides.where("low < high and (t = 1 or (any_core and not all_core))").select("a", "t", "e", "often")

    found = rows.select("a", "b", "t", "e").join(met(rows), ["a", "t", "e"]).groupBy("a", "t", "b").agg(F.sort_array(F.collect_list(F.struct("often", "e"))).alias("found"))
    prefix = (ways.drop("elements").join(found, ["a", "t", "b"]).where("size(found) >= need").withColumn("size", F.size("found"))
              .select("a", "t", "b", "n", "load", "label", "core", "w", "sure", "size", F.posexplode(F.expr("slice(found, 1, size(found) - need + 1)")["e"]).alias("place", "e")))
    prefix = stored(prefix, "prefixes")
    return stored(prefix.join(met(prefix), ["a", "t", "e"])
                  .select(F.xxhash64("a", "t", "e").alias("key"), F.col("b").alias("rep"), "n", "load", "w", "sure", (F.col("size") - F.col("place")).alias("left"), F.when(F.col("t") == 0, F.col("core")).alias("side")), "bucket-members")


def _linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the documents that verified links connect.

    ``members``: key (of a bucket), rep, n (its set's size) and load (how many
    documents share its buckets).  In each round a large bucket has a
    pivot (see ``_pivots``) with which its members are compared on full sets; the
    buckets of one pivot are a group.  Then, for members x, y of a group that are not connected:

    Let P be the group's consensus set, E = x - P and D = P - x.  Then
    |x & y| = |P| - |Dx| - |Dy| + (shared elements of Dx, Dy and of Ex, Ey), and a link
    needs (w_x + w_y - L) / (100 + percent) shared elements, where w = 100|D| + percent|E|
    and L = (100 - percent)|P|; all are whole numbers, so a link at the threshold counts.

    1. If w_x + w_y <= L they are linked, whatever they share.  The member with the
       least w, the centre c, has all these links that any member has, so its star
       connects them: the core.  All others, the outer members, have w > L - w_c.
    2. Else they share an element of D or E, and one of the two is outer.  A core member
       shares at least (w + m - L) / (100 + percent) of its elements with an outer one,
       where m is the least w of an outer member, an outer member at least
       (w + w_c - L) / (100 + percent) with a core one and (w + m - L) / (100 + percent)
       with an outer one; and each at least (w - L) / 100, as no partner can
       share more than it has.  Only elements that a possible partner of another
       component has as well count, so a member with fewer of them than it
       needs is done, and by prefix filtering a pair shares one of the first
       (those elements) - need + 1 of both, the elements that fewest members have
       first.  These elements are the buckets of the next round.

    Small buckets (at most ``SMALL`` members, ``MEET`` if they are of an element) are taken
    apart at once: their pairs that are not connected yet are compared.  A pair whose
    first common element is x's i-th and y's j-th of f_x and f_y shares at most
    min(f_x - i, f_y - j) + 1 (``left``), so it is compared there only if that is
    enough for w_x + w_y; and in buckets of t = 0 a core member meets outer ones only.
    So each pair that shares a bucket is compared, connected, or cannot be linked,
    and no larger bucket is expanded into pairs.
    """
    labels, small = None, SMALL
    reach = 100 + percent
    linked = reach * F.col("both") >= percent * (F.col("n") + F.col("n_a"))
    members = members.select("key", "rep", "n", "load", F.lit(0).alias("w"), F.lit(0).alias("sure"), F.lit(0).alias("left"), F.lit(None).cast("boolean").alias("side"))
    while True:
        many = members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > small).select("key")
        every, members = members, stored(members.join(many, "key"), "large-buckets")
        large = members.limit(1).count()
        few = every
        if large:
            few = every.join(many, "key", "left_anti")
            pairs = members.join(_pivots(members, sets), "key").where("rep != a").select("a", "n_a", F.col("rep").alias("b"), "n", "load").distinct()
            out, miss = F.array_except("names_b", "names_a"), F.array_except("names_a", "names_b")
            seen = stored(_compared(pairs, sets).select("a", "n_a", "b", "n", "load", out.alias("out"), miss.alias("miss")), "differences")
            labels = _joined(labels, seen.withColumn("both", F.col("n") - F.size("out")).where(linked).select("a", "b"))

        few = _with_labels(few.select("key", "rep", "n", "w", "sure", "left", "side"), labels, "rep", "label")
        other = few.select("key", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("w").alias("w_b"), F.col("left").alias("left_b"), F.col("side").alias("side_b"))
        pairs = (few.join(other, "key").where((F.col("rep") < F.col("b")) & (F.col("label") != F.col("label_b")) & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
                                              & (F.col("w") + F.col("w_b") - F.col("sure") <= reach * F.least("left", "left_b")) & (F.col("side").isNull() | (F.col("side") != F.col("side_b"))))
                 .select(F.col("rep").alias("a"), F.col("n").alias("n_a"), "b", F.col("n_b").alias("n")).distinct())
        compared = _compared(pairs, sets).withColumn("both", F.size(F.array_intersect("names_a", "names_b")))
        labels = _joined(labels, stored(compared.where(linked).select("a", "b"), "links"))
        if not large:
            return labels

        group = _with_labels(seen, labels, "b", "label")
        apart = group.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("a")
        group = group.join(apart, "a")
        if not group.limit(1).count():
            return labels
        group = stored(_differences(group, percent), "groups")
        centre = stored(group.groupBy("a").agg(F.min(F.struct("w", "b")).alias("c")).select("a", F.col("c.w").alias("w_c"), F.col("c.b").alias("c")), "centres")
        near = group.join(centre, "a").where((F.col("b") != F.col("c")) & (F.col("w") + F.col("w_c") <= F.col("sure")))
        labels = _joined(labels, stored(near.select(F.col("c").alias("a"), "b").distinct(), "links"))
        members, small = _prefixes(group, labels, centre, percent), MEET
        if not members.limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    texts = _texts(docs)
    kinds = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"
    every = stored(texts.mapInArrow(_signatures(size), kinds), "signatures")
    if every.groupBy("doc_id").count().where("count > 1").limit(1).count():  # one text for each id
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
        every = stored(texts.mapInArrow(_signatures(size), kinds), "signatures")
    classes = stored(every.where("n_shingles > 0").groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")

    reps = every.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    bands = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(bands.join(shared, "key"), "bucket-members")
    load = stored(members.groupBy("rep").agg(F.sum("size").alias("load")), "candidates")
    sets = stored(texts.join(load.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, names array<long>"), "candidate-sets")
    labels = _linked(members.drop("size").join(load, "rep"), sets, percent)

    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").select("n_shingles", "fp1", "fp2", F.coalesce("label", "rep").alias("component_id"))
    out = every.select("doc_id", "n_shingles", "fp1", "fp2").join(of_class, ["n_shingles", "fp1", "fp2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("component_id") == F.col("doc_id"))
    nameless = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_signatures(size), kinds)
    return out.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def first_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, all columns as they were; of rows that repeat an id, each stays or goes with it."""
    gone = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
