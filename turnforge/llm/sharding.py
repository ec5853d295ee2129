"""Shards of nearly equal bytes by sampled splitters; DataFrame functions only.

1. Every row gets a key: hash of its text, hash of its id, its place in the
   input.  Keys are unique, so equal texts stand side by side, yet a group that
   holds a third of all rows can be cut anywhere.
2. Rows are drawn in proportion to their size, and the quantiles of the drawn
   keys are boundaries of ranges.  Exact bytes of each range are summed.
3. A range that holds the place where a shard should end, and more bytes than
   the tolerance besides its largest row, is overfull: a sample of its own rows
   subdivides it, again and again.  Its largest key is always a boundary, so
   every round splits it.
4. The end of a shard is the boundary nearest to it.  Rows are range-partitioned
   by (shard, key) and numbered by their place.

A shard's bytes differ from the mean by at most ``mean / PARTS`` and the largest
row.  What comes to the driver is bounded: about ``(shards - 1) * PIECES *
OVERSAMPLE`` sampled keys and ``(shards - 1) * (PIECES + 2)`` sums a round.

Cases: a null or empty text has size 1; a null id is an id like any other;
repeated rows are placed each; with fewer rows than shards some shards stay
empty; an empty table gives no rows; other columns are ignored, and
``write_shards`` keeps them (columns named shard or slot are replaced).
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnforge.llm.common import stored

SHARDS = 16
PIECES = 32  # parts that a range is split into for each shard end in it
OVERSAMPLE = 16
PARTS = 512  # tolerance: a shard's mean bytes over this

KEY = ("h", "s", "k")
Key = tuple[int, int, int]


def _below(bounds: list[Key]) -> Column:
    """How many ``bounds`` (sorted) are at or below the row's key: a binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    literal = F.expr("array(%s)" % ", ".join("named_struct(%s)" % ", ".join(f"'{n}', {_long(v)}" for n, v in zip(KEY, b, strict=True)) for b in bounds))
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(len(bounds).bit_length()))])
    key = F.struct(*KEY)

    def step(at, size):
        to = at + size
        return F.when((to <= len(bounds)) & (F.get(literal, F.least(to, F.lit(len(bounds))) - 1) <= key), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _long(v: int) -> str:
    return f"{v}L" if v > -(1 << 63) else f"({v + 1}L - 1L)"


def _ranges(rows: DataFrame) -> list:
    return rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("n"),
                                     F.max(F.struct(*KEY)).alias("last")).orderBy("range").collect()


def _sample(rows: DataFrame, strides: dict[int, float], salt: int) -> dict[int, list[tuple[Key, int]]]:
    """Keys of the ranges in ``strides`` by range, each with how often it is drawn: size / stride times on average."""
    stride = F.element_at(F.create_map(*[F.lit(x) for r, s in strides.items() for x in (r, s)]), F.col("range"))
    chance = F.pmod(F.xxhash64(*KEY, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(F.col("range").isin(list(strides))).withColumn("drawn", F.floor(F.col("size") / stride + chance))
    out: dict[int, list[tuple[Key, int]]] = {r: [] for r in strides}
    for r in drawn.where("drawn > 0").select("range", *KEY, "drawn").collect():
        out[r["range"]].append(((r["h"], r["s"], r["k"]), r["drawn"]))
    return out


def _quantiles(drawn: list[tuple[Key, int]], pieces: int) -> list[Key]:
    drawn = sorted(drawn)
    every, seen, out = sum(n for _, n in drawn) / pieces, 0, []
    for key, n in drawn:
        if int((seen + n) / every) > int(seen / every):
            out.append(key)
        seen += n
    return out


def splitters(rows: DataFrame, shards: int) -> tuple[int, list[Key]]:
    """(shards that end before the first row, keys at which the others end) of ``rows`` (size and key)."""
    bounds: list[Key] = []
    for salt in range(1 << 20):
        found = _ranges(rows.withColumn("range", _below(bounds)))
        total = sum(r["bytes"] for r in found)
        upto, at = [], 0
        for r in found:
            at += r["bytes"]
            upto.append(at)
        ends, overfull, around = [], {}, set()
        for shard in range(1, shards):
            want = total * shard / shards
            k = bisect_left(upto, want)  # the range that holds this end
            r = found[k]
            around.update(bounds[max(r["range"] - 1, 0):r["range"] + 1])  # both ends of the range
            if r["n"] > 1 and r["bytes"] - r["largest"] > total / shards / PARTS:
                overfull[k] = overfull.get(k, 0) + 1
            ends.append(r["range"] + (want - (upto[k] - r["bytes"]) > upto[k] - want))  # the nearer boundary, by number
        if not overfull:
            return sum(e == 0 for e in ends), [bounds[e - 1] for e in ends if 0 < e <= len(bounds)]
        strides = {found[k]["range"]: found[k]["bytes"] / (n * PIECES * OVERSAMPLE) for k, n in overfull.items()}
        drawn = _sample(rows.withColumn("range", _below(bounds)), strides, salt)
        new = {tuple(found[k]["last"]) for k in overfull}
        for k, n in overfull.items():
            new.update(_quantiles(drawn[found[k]["range"]], n * PIECES))
        bounds = sorted(new | around)
    raise AssertionError("unreachable: every round splits each overfull range")


def place(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (stored, with size and a unique key) with shard and slot."""
    if rows.limit(1).count() == 0:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    before, keys = splitters(rows.select("size", *KEY), shards)
    order = ["shard", *KEY]
    cut = rows.withColumn("shard", (_below(keys) + before).cast("int")).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = stored(cut.withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    part = F.shiftright("at", 33)  # the partition that the row was written from
    runs = cut.groupBy("shard", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    since = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("shard").alias("of"), F.col("part"), (since - F.col("first")).alias("shift"))  # at most partitions + shards rows
    out = cut.join(F.broadcast(runs), (cut["shard"] == F.col("of")) & (part == F.col("part")))
    return out.select(*rows.columns, "shard", (F.col("at") + F.col("shift")).alias("slot"))


def _narrow(docs: DataFrame, row: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64(F.col("doc_id").cast("long")).alias("s"), row.alias("k"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, text_crc32, shard, slot (its place in the shard)."""
    rows = stored(_narrow(docs, F.monotonically_increasing_id()), "shard-keys")
    return place(rows, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write all columns of ``docs`` with slot to Parquet folders shard=N under ``path``, each in the order of its slots."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    row = "row"
    while row in kept:
        row += "_"
    whole = stored(docs.select(*kept).withColumn(row, F.monotonically_increasing_id()), "shard-records")
    placed = place(stored(_narrow(whole, F.col(row)), "shard-keys"), shards).select(F.col("k").alias(row), "shard", "slot")
    whole.join(placed, row).drop(row).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
