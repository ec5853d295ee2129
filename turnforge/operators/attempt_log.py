"""A bucketed attempt log and its winners.

The log is a table bucketed by ``custom_id``, a partition for each round.  A fold
of it aggregates where the rows lie: buckets replace the exchange.  The winners
(one row per id, bucketed alike) are kept beside it: a new round is read alone,
folded, and merged bucket by bucket.  The fold is associative, so the merged
winners are those of the whole log, and the cost of a round is its own rows and
the winners, not the log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnforge.constants import END_MARKER
from turnforge.operators.fold import POLICIES

KEY = "custom_id"
#: What is known of an id: its first attempt with its text, and its first accepted one (null if none).
PARTIAL = "custom_id string, first_attempt int, first_content string, winning_attempt int, win_content string"


def partial_fold(attempts: DataFrame) -> DataFrame:
    """``PARTIAL`` of a set of attempts (custom_id, attempt, content, accepted)."""
    won = F.when(F.col("accepted"), F.col("attempt"))
    return attempts.groupBy(KEY).agg(F.min("attempt").cast("int").alias("first_attempt"), F.min_by("content", "attempt").alias("first_content"),
                                     F.min(won).cast("int").alias("winning_attempt"), F.min_by("content", won).alias("win_content"))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """``PARTIAL`` of two disjoint sets of attempts from those of each; joined by id, so equal bucketing needs no exchange."""
    x, y = left.alias("x"), right.alias("y")
    j = x.join(y, F.col(f"x.{KEY}") == F.col(f"y.{KEY}"), "full_outer")

    def earlier(attempt: str, text: str) -> list:
        a, b = F.col(f"x.{attempt}"), F.col(f"y.{attempt}")
        mine = F.coalesce(a <= b, b.isNull())
        return [F.least(a, b).alias(attempt), F.when(mine, F.col(f"x.{text}")).otherwise(F.col(f"y.{text}")).alias(text)]

    return j.select(F.coalesce(f"x.{KEY}", f"y.{KEY}").alias(KEY), *earlier("first_attempt", "first_content"), *earlier("winning_attempt", "win_content"))


class AttemptLog:
    """Log and winners under ``root``; table names are this object's own."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.name = f"attempts_{uuid.uuid4().hex}"
        self.winners: str | None = None
        self.versions = 0

    def _save(self, df: DataFrame, table: str, *partitions: str) -> None:
        # dealt by the bucket's own hash, so a task writes whole buckets: a file for each, not one for each task
        out = df.repartition(self.buckets, KEY).write.mode("append").bucketBy(self.buckets, KEY).sortBy(KEY)
        (out.partitionBy(*partitions) if partitions else out).option("path", f"{self.root}/{table}").saveAsTable(table)

    def append(self, attempts: DataFrame, round_: int) -> None:
        """Add a round (custom_id, attempt, content, accepted)."""
        rows = attempts.select(KEY, F.col("attempt").cast("int").alias("attempt"), "content", "accepted", F.lit(round_).alias("round"))
        self._save(rows, self.name, "round")

    def log(self) -> DataFrame:
        return self.spark.table(self.name)

    def merge(self, round_: int) -> None:
        """Fold one round and merge it into the winners (a new version; the last one is only read)."""
        new = partial_fold(self.log().where(F.col("round") == round_))
        if self.winners is not None:
            new = merged(self.spark.table(self.winners), new)
        self.versions += 1
        table = f"{self.name}_winners_{self.versions}"
        self._save(new, table)
        self.winners = table

    def folded(self, policy: str) -> DataFrame:
        """custom_id, winning_attempt, final_content from the winners."""
        return finish(self.spark.table(self.winners), policy)

    def folded_from_log(self, policy: str) -> DataFrame:
        """The same from all attempts, without an exchange."""
        return finish(partial_fold(self.log()), policy)


def finish(partial: DataFrame, policy: str) -> DataFrame:
    if policy not in POLICIES:
        raise ValueError(f"unknown fold policy {policy!r}")
    fallback = F.col("first_content") if policy == "starter" else F.lit(END_MARKER)
    return partial.select(KEY, "winning_attempt", F.when(F.col("winning_attempt").isNotNull(), F.col("win_content")).otherwise(fallback).alias("final_content"))
