"""Completions committed a batch at a time.

A paid call must not be made twice.  Requests are dealt over partitions of about
``batch`` rows; a partition is a task, and what a task has completed is
committed to the journal as soon as it ends (output committer version 2), not
when the job does.  A worker or executor that dies repeats the tasks it had not
ended, no others; a job that dies leaves what its tasks committed, and the next
run asks only for requests that are not in the journal.

A request is known by the hash of what is sent (model, messages, parameters), so
a changed prompt under an old id is asked for anew.  A commit that was repeated
leaves two equal rows; readers count a key once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnforge.constants import MAX_TRIES
from turnforge.operators.complete import OUT_SCHEMA, Backend, complete
from turnforge.session import stored

JOURNAL_SCHEMA = OUT_SCHEMA + ", request_key string"
BATCH = 64
TASKS = 4096  # batches of one job; more requests are asked for by several jobs, one after another
KEY = ["custom_id", "attempt", "request_key"]


def request_key(requests: DataFrame) -> Column:
    """Hash of what is sent: model, messages and, if there are any, parameters."""
    return F.sha2(F.to_json(F.struct(*[c for c in ("model", "messages", "params") if c in requests.columns])), 256)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The journal, each request once: an answer before an error, then the smallest text."""
    rows = spark.read.schema(JOURNAL_SCHEMA).parquet(path)
    best = F.min(F.struct(F.col("content").isNull().alias("no_text"), "content", "error", "tries"))
    return rows.groupBy(*KEY).agg(best.alias("b")).select(*KEY, "b.content", "b.error", "b.tries")


def complete_journaled(requests: DataFrame, backend_factory: Callable[[], Backend], path: str, batch: int = BATCH,
                       max_tries: int = MAX_TRIES, retry_errors: bool = False) -> DataFrame:
    """Answers of ``requests`` (unique custom_id, attempt), asking only for those that the journal at ``path`` lacks.

    With ``retry_errors`` requests whose tries all failed are asked for again.
    """
    spark = requests.sparkSession
    asked = stored(requests.withColumn("request_key", request_key(requests)).withColumn("attempt", F.col("attempt").cast("int")), "journal-requests")
    if asked.groupBy("custom_id", "attempt").count().where("count > 1").limit(1).count():
        raise ValueError("requests repeat a (custom_id, attempt)")
    spark.createDataFrame([], JOURNAL_SCHEMA).write.mode("append").parquet(path)  # so that there is a journal
    done = read(spark, path)
    if retry_errors:
        done = done.where("content is not null")
    todo = stored(asked.join(done, KEY, "left_anti"), "journal-todo")
    n = todo.count()
    batches = math.ceil(n / batch)
    jobs = math.ceil(batches / TASKS)
    for job in range(jobs):
        part = todo.where(F.pmod(F.xxhash64("custom_id", "attempt", F.lit(1)), F.lit(jobs)) == job)
        dealt = part.repartition(math.ceil(batches / jobs), "custom_id", "attempt")
        got = _answers(dealt, backend_factory, max_tries)
        got.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    known = read(spark, path)
    return asked.select(*KEY).join(known, KEY, "left").select("custom_id", "attempt", "content", "error", "tries")


def _answers(requests: DataFrame, backend_factory: Callable[[], Backend], max_tries: int) -> DataFrame:
    """``complete`` whose backend gets plain ids; the key travels with the id."""
    key = F.to_json(F.struct("custom_id", "request_key"))
    rows = requests.withColumn("custom_id", key)
    out = complete(rows, lambda: _Unwrapped(backend_factory()), max_tries)
    pair = F.from_json("custom_id", "custom_id string, request_key string")
    return out.select(pair["custom_id"].alias("custom_id"), "attempt", "content", "error", "tries", pair["request_key"].alias("request_key"))


class _Unwrapped(Backend):
    def __init__(self, inner: Backend):
        self.inner = inner

    def complete(self, batch):
        import json
        return self.inner.complete(batch.assign(custom_id=[json.loads(c)["custom_id"] for c in batch["custom_id"]]))
