"""The attempt fold.

The original loop overwrites files and pairs verdicts with texts by list
position.  Here every attempt is a row of an append-only log keyed by
``(custom_id, attempt)``, and the loop's outcome is a closed form:

    a* = min{ a <= M : accepted(a) }
    starter:   text of a*, else text of attempt 0           (T6)
    user turn: text of a*, else the end-of-dialogue marker  (T6)

One exchange on the request key; the per-key group is bounded by M + 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnforge.constants import END_MARKER

POLICIES = ("starter", "turn")


def fold_attempts(attempts: DataFrame, keys: Sequence[str] = ("custom_id",), policy: str = "turn",
                  max_attempt: int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One row per key: ``winning_attempt`` (NULL if none) and ``final_content``.

    ``attempts`` needs ``attempt``, ``content`` and a boolean ``accepted``.
    ``extra`` columns are constant per key and carried through with ``first``.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown fold policy {policy!r}")
    log = attempts if max_attempt is None else attempts.where(F.col("attempt") <= max_attempt)
    acc = F.col("accepted")
    folded = log.groupBy(*keys).agg(
        F.min(F.when(acc, F.col("attempt"))).alias("winning_attempt"),
        F.min_by(F.col("content"), F.when(acc, F.col("attempt"))).alias("_win_content"),
        F.min_by(F.col("content"), F.col("attempt")).alias("_first_content"),
        *[F.first(c).alias(c) for c in extra],
    )
    fallback = F.col("_first_content") if policy == "starter" else F.lit(END_MARKER)
    return folded.withColumn(
        "final_content",
        F.when(F.col("winning_attempt").isNotNull(), F.col("_win_content")).otherwise(fallback),
    ).drop("_win_content", "_first_content")


def evaluated_attempts(attempts: DataFrame, keys: Sequence[str] = ("custom_id",)) -> DataFrame:
    """Rows that a round actually evaluates: attempt r is judged iff 0..r-1 were all rejected."""
    w = Window.partitionBy(*keys)
    return (attempts.withColumn("_win", F.min(F.when(F.col("accepted"), F.col("attempt"))).over(w))
            .where(F.col("_win").isNull() | (F.col("attempt") <= F.col("_win")))
            .drop("_win"))


def round_convergence(attempts: DataFrame, keys: Sequence[str] = ("custom_id",),
                      by: Sequence[str] = ()) -> DataFrame:
    """A1/O2: per round, how many requests were judged and how many were rejected."""
    return evaluated_attempts(attempts, keys).groupBy(*by, "attempt").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_evaluated"),
        F.count_if(~F.col("accepted")).cast("bigint").alias("n_rejected"),
    )


def overlay(originals: DataFrame, replacements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(originals minus replaced) union replacements."""
    keep = originals.join(replacements.select(*keys), list(keys), "left_anti")
    return keep.unionByName(replacements, allowMissingColumns=True)
