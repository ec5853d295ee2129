"""Exact start times of requests under two budgets (W4), as a max-plus prefix scan.

Two buckets, one of requests and one of tokens, are full at time 0, refill
evenly and hold at most a minute's worth.  A request starts, in order, as soon
as the first holds one request and the second its tokens.

With S the last start and F the time at which a bucket is full again, a request
that costs a bucket d seconds of refill, out of 60, starts no earlier than
F - (60 - d), and then the bucket is full at max(F, start) + d.  So the next
(S, F of requests, F of tokens) is a 3 x 3 matrix times this one, where sums are
maxima and products are sums.  Such products are associative: matrices are
multiplied within blocks of rows, then over the blocks (blocks of blocks, while
there are many), and each block gets the state before it.

Times are whole numbers: a unit is 60 / (requests * tokens a minute) seconds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnforge.session import stored

BLOCK_BITS = 12
STATE = ["s", "fr", "ft"]
MATRIX = [f"m{i}{j}" for i in range(3) for j in range(3)]


def _times(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Max-plus products of two rows of matrices."""
    return (later[:, :, :, None] + earlier[:, None, :, :]).max(axis=2)


def _prefixes(m: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, 3 ... matrices, by doubling."""
    out, step = m.copy(), 1
    while step < len(out):
        out[step:] = _times(out[step:].copy(), out[:-step].copy())
        step *= 2
    return out


def _matrices(tokens: np.ndarray, requests_per_minute: int, tokens_per_minute: int) -> np.ndarray:
    r, k = requests_per_minute, tokens_per_minute
    m = np.empty((len(tokens), 3, 3), np.int64)
    wait_r, wait_t = -(r - 1) * k, -(k - tokens) * r  # a start after F of requests, of tokens
    m[:, 0, 0], m[:, 0, 1], m[:, 0, 2] = 0, wait_r, wait_t
    m[:, 1, 0], m[:, 1, 1], m[:, 1, 2] = k, k, k + wait_t
    m[:, 2, 0], m[:, 2, 1], m[:, 2, 2] = tokens * r, tokens * r + wait_r, tokens * r
    return m


def _sorted(table: pa.Table, by: str) -> pa.Table:
    return table.sort_by(by)


def _read_matrices(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in MATRIX], axis=1).reshape(-1, 3, 3)


def _matrix_row(key: str, value: int, m: np.ndarray) -> pa.Table:
    return pa.table({key: pa.array([value], pa.int64()), **{c: pa.array([int(x)], pa.int64()) for c, x in zip(MATRIX, m.ravel(), strict=True)}})


def _states(table: pa.Table, key: str, first: np.ndarray) -> pa.Table:
    """The state before each matrix, from the state before the first."""
    table = _sorted(table, key)
    before = np.concatenate([first[None], (_prefixes(_read_matrices(table)) + first).max(axis=2)[:-1]])
    return pa.table({key: table.column(key), **{c: pa.array(before[:, k]) for k, c in enumerate(STATE)}})


def _before(totals: DataFrame, key: str) -> DataFrame:
    """(key, s, fr, ft): the state before each of the ``totals`` (key, matrix)."""
    schema = f"{key} long, s long, fr long, ft long"
    if totals.limit((1 << BLOCK_BITS) + 1).count() <= 1 << BLOCK_BITS:
        return totals.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: _states(t, key, np.zeros(3, np.int64)), schema)
    up = key + "_"  # the block of a block
    numbered = _numbered(totals, key).withColumn(up, F.shiftright("at", BLOCK_BITS))
    above = stored(_totals(numbered, up, lambda t: _read_matrices(_sorted(t, "at"))), "starts")
    before = _before(above, up).withColumnRenamed(up, "of")

    def inner(left: pa.Table, right: pa.Table) -> pa.Table:
        return _states(left, key, np.array([right.column(c)[0].as_py() for c in STATE], np.int64))

    return numbered.groupBy(up).cogroup(before.groupBy("of")).applyInArrow(inner, schema)


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` stored in order with ``at``, which rises with it and is dense within each partition."""
    return stored(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "starts")


def _totals(rows: DataFrame, by: str, matrices) -> DataFrame:
    """(by, matrix): product of each block's matrices, the latest first."""
    def total(table: pa.Table) -> pa.Table:
        return _matrix_row(by, table.column(by)[0].as_py(), _prefixes(matrices(table))[-1])

    return rows.groupBy(by).applyInArrow(total, f"{by} long, " + ", ".join(f"{c} long" for c in MATRIX))


def start_units(df: DataFrame, order: str, tokens: str, requests_per_minute: int, tokens_per_minute: int) -> DataFrame:
    """(order, start): start of each request in units; every request must fit into the token budget."""
    rows = _numbered(df.select(F.col(order).alias("o"), F.col(tokens).cast("long").alias("c")), "o").withColumn("block", F.shiftright("at", BLOCK_BITS))
    kind = dict(df.dtypes)[order]

    def matrices(table: pa.Table) -> np.ndarray:
        return _matrices(_sorted(table, "at").column("c").to_numpy(), requests_per_minute, tokens_per_minute)

    before = _before(stored(_totals(rows, "block", matrices), "starts"), "block").withColumnRenamed("block", "of")

    def starts(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _sorted(left, "at")
        first = np.array([right.column(c)[0].as_py() for c in STATE], np.int64)
        after = (_prefixes(_matrices(left.column("c").to_numpy(), requests_per_minute, tokens_per_minute)) + first).max(axis=2)
        return pa.table({"o": left.column("o"), "start": pa.array(after[:, 0])})

    return rows.groupBy("block").cogroup(before.groupBy("of")).applyInArrow(starts, f"o {kind}, start long").withColumnRenamed("o", order)
