"""Ordered computations that must not put one whole group into one task.

``running_totals`` is a two-level prefix sum over narrow rows (keys, order,
values).  They are range-partitioned by (keys, order) and stored, so a block
is a partition: its bounds are sampled quantiles of the keys, however sparse
or skewed they are, and a group that holds most rows has many blocks.  Level
1 is a window within (group, block); level 2 is a window over the per-block
totals, at most one row per partition and group, joined back.  Wide columns
(texts) are joined on at the end and never sorted.

The order key must be unique within the group; otherwise two rows with the
same key would get an arbitrary order (and the global-window oracle would
disagree).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnforge.session import stored

DEFAULT_BLOCK_BITS = 12


def _same(left: DataFrame, right: DataFrame, names: Mapping[str, str]) -> Column:
    return reduce(Column.__and__, (left[a].eqNullSafe(right[b]) for a, b in names.items()))


def block_totals(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(stored narrow rows with their block ``_blk``, total of each value per group and block)."""
    values = [F.coalesce(c, F.lit(0)).alias(f"_v_{n}") for n, c in sums.items()]
    placed = stored(df.select(*keys, order, *values).repartitionByRange(*keys, order)
                    .withColumn("_blk", F.spark_partition_id()), "ordered")
    totals = placed.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    return placed, totals


def running_totals(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column]) -> DataFrame:
    """Append inclusive running sums ``name`` for each ``sums[name]`` expression.

    Rows whose sum expression is NULL add nothing but still receive the
    running value.
    """
    keys, names = list(keys), list(sums)
    placed, totals = block_totals(df, keys, order, sums)
    inner_w = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumns({f"_in_{n}": F.sum(f"_v_{n}").over(inner_w) for n in names})
    before_w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_blk").alias("_k_blk"),
                            *[F.coalesce(F.sum(f"_t_{n}").over(before_w), F.lit(0)).alias(f"_o_{n}") for n in names])
    both = inner.join(offsets, _same(inner, offsets, {"_blk": "_k_blk", **{k: f"_k_{k}" for k in keys}}))
    numbered = both.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.col(order).alias("_n_order"),
                           *[(F.col(f"_in_{n}") + F.col(f"_o_{n}")).alias(n) for n in names])
    out = df.join(numbered, _same(df, numbered, {order: "_n_order", **{k: f"_n_{k}" for k in keys}}))
    return out.drop("_n_order", *[f"_n_{k}" for k in keys])


def ordinal(df: DataFrame, keys: Sequence[str], order: str, name: str = "pos", base: int = 0) -> DataFrame:
    """0-based (or ``base``-based) position of each row within ``keys`` by ``order``."""
    out = running_totals(df, keys, order, {"_n": F.lit(1)})
    return out.withColumn(name, (F.col("_n") - 1 + base).cast("bigint")).drop("_n")


def previous_value(df: DataFrame, keys: Sequence[str], order: str, value_cols: Sequence[str],
                   prefix: str = "prev_", block_bits: int = DEFAULT_BLOCK_BITS) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` in two levels.

    Inside a block the ordinary ``lag`` applies; the first row of a block takes
    the last row of the nearest earlier non-empty block, found from a small
    per-block summary table.
    """
    keys = list(keys)
    staged = df.withColumn("_blk", F.shiftright(F.col(order), block_bits))
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    inner = staged.withColumns({f"_lag_{v}": F.lag(v).over(w) for v in value_cols}).withColumn(
        "_first", F.row_number().over(w) == 1
    )
    last = inner.groupBy(*keys, "_blk").agg(
        F.max_by(F.struct(*[F.col(v) for v in value_cols]), F.col(order)).alias("_last")
    )
    bw = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_blk")
    carry = last.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_blk").alias("_k_blk"),
        F.lag("_last").over(bw).alias("_carry"),
    )
    cond = [inner["_blk"].eqNullSafe(carry["_k_blk"])] + [inner[k].eqNullSafe(carry[f"_k_{k}"]) for k in keys]
    joined = inner.join(carry, cond, "inner")
    out = joined.withColumns(
        {f"{prefix}{v}": F.when(F.col("_first"), F.col("_carry")[v]).otherwise(F.col(f"_lag_{v}"))
         for v in value_cols}
    )
    drop = ["_blk", "_k_blk", "_first", "_carry"] + [f"_k_{k}" for k in keys]
    drop += [f"_lag_{v}" for v in value_cols]
    return out.drop(*drop)
