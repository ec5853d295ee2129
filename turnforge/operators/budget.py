"""Request budgets (A5, W4, W5, ST2 in batch form).

The original throttles an async HTTP loop.  Here the same limits are a plan
over the request table: token estimates per request, the earliest start
time each request can have under per-minute request and token budgets, the
retry ledger, and per-minute load.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnforge.constants import COMPAT_COMPLETION_ALLOWANCE, MAX_TRIES
from turnforge.operators.ordering import ordinal
from turnforge.operators.starts import start_units


def chars_estimator(text: Column, chars_per_token: int = 4) -> Column:
    """Default token estimator: ``ceil(chars / chars_per_token)`` (built-in, JVM side)."""
    return F.ceil(F.length(text) / F.lit(chars_per_token)).cast("bigint")


def estimate_tokens(messages: Column, allowance: Column | int = COMPAT_COMPLETION_ALLOWANCE,
                    chars_per_token: int = 4) -> Column:
    """A5: sum over messages of (4 + tokens(role) + tokens(content)) + 2 + allowance.

    ``allowance`` is 15 in compat mode (T12) or ``params.max_tokens``.
    """
    per = F.aggregate(
        messages, F.lit(0).cast("bigint"),
        lambda acc, m: acc + 4 + chars_estimator(m["role"], chars_per_token)
        + chars_estimator(m["content"], chars_per_token))
    allow = allowance if isinstance(allowance, Column) else F.lit(allowance)
    return (per + 2 + allow.cast("bigint")).cast("bigint")


def rate_plan(df: DataFrame, order: str, tokens: str, requests_per_minute: int,
              tokens_per_minute: int) -> DataFrame:
    """W4 (+ W2 ``task_id``): start (seconds) of each request under both budgets, in ``order``.

    All requests are ready at t=0, admission is in order, and both buckets are
    full then and never hold more than a minute's worth: the times are those
    of the sequential loop (``turnforge.operators.starts``).  Requests estimated
    above a minute's tokens can never be admitted (T13): flagged ``oversize``,
    given no start, and no budget is spent on them.
    """
    over = F.col(tokens) > F.lit(tokens_per_minute)
    rt = ordinal(df.withColumn("oversize", over), [], order, "task_id")     # W2
    units = start_units(df.where(~over), order, tokens, requests_per_minute, tokens_per_minute)
    units = units.select(F.col(order).alias("_o"), "start")
    seconds = F.round(F.col("start") * F.lit(60.0) / F.lit(float(requests_per_minute * tokens_per_minute)), 6)
    return rt.join(units, rt[order] == units["_o"], "left").withColumn("start_s", seconds).drop("_o", "start")


def retry_ledger(attempts: DataFrame, task: str, order: Sequence[str], success: Column, error_kind: Column,
                 message: Column, max_tries: int = MAX_TRIES) -> DataFrame:
    """W5 + A7: tries used (<= max_tries), outcome, ordered error kinds and error texts per task.

    ``row_number() <= max_tries`` lets Spark push a per-task limit below the
    shuffle (WindowGroupLimit), so a task with millions of rows ships only
    ``max_tries`` rows; the per-task arrays below are bounded by it.
    """
    w = Window.partitionBy(task).orderBy(*order)
    first = (attempts.withColumn("_ok", success).withColumn("_kind", error_kind).withColumn("_msg", message)
             .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_tries))
    g = first.groupBy(task).agg(F.sort_array(F.collect_list(F.struct("_rn", "_ok", "_kind", "_msg"))).alias("_t"))
    fs = F.array_min(F.transform(F.filter("_t", lambda t: t["_ok"]), lambda t: t["_rn"]))
    failed_tries = F.filter("_t", lambda t: t["_rn"] < F.coalesce(fs, F.lit(max_tries + 1)))
    return g.select(
        task,
        F.coalesce(fs, F.size("_t")).cast("bigint").alias("tries"),
        F.when(fs.isNotNull(), "succeeded").when(F.size("_t") >= max_tries, "failed")
        .otherwise("in_progress").alias("status"),
        F.size(failed_tries).cast("bigint").alias("n_errors"),
        F.array_join(F.transform(failed_tries, lambda t: t["_kind"]), ",").alias("errors"),
        F.array_join(F.transform(failed_tries, lambda t: t["_msg"]), "; ").alias("messages"),
    )


def run_counters(ledger: DataFrame) -> DataFrame:
    """A4: run-level counters from the ledger (one row)."""
    errs = F.split(F.col("errors"), ",")
    return ledger.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_started"),
        F.count_if(F.col("status") == "succeeded").cast("bigint").alias("n_succeeded"),
        F.count_if(F.col("status") == "failed").cast("bigint").alias("n_failed"),
        F.count_if(F.col("status") == "in_progress").cast("bigint").alias("n_in_progress"),
        F.sum(F.size(F.filter(errs, lambda e: e == "rate_limit"))).cast("bigint").alias("n_rate_limit_errors"),
        F.sum(F.size(F.filter(errs, lambda e: e == "api"))).cast("bigint").alias("n_api_errors"),
        F.sum(F.size(F.filter(errs, lambda e: e == "other"))).cast("bigint").alias("n_other_errors"),
    )


def minute_load(df: DataFrame, ts: str, limit: int) -> DataFrame:
    """ST2 (batch): requests per 1-minute window and whether the limit is exceeded."""
    g = df.groupBy(F.window(F.col(ts), "1 minute").alias("w")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return g.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("minute"), "n",
                    (F.col("n") > limit).alias("over_limit"))
