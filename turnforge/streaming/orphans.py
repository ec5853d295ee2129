"""J7/J2 as a stream: requests and their completions, paired as they arrive.

Both sides are watermarked streams; a completion belongs to a request of the same
id and attempt if it comes within ``bound`` after it.  The join is a left outer
one with a time bound, so the state of a request is dropped, and the request comes
out as an orphan, once the watermark has passed its bound.  A completion that is
delivered again makes an equal pair, which counts once when the pairs are read.

A backlog that has ended moves no watermark: ``heartbeat`` puts a row of attempt -1
into both inputs, which the next run reads as the time that has come.  (It is
dropped when the pairs are read: a filter in the stream would be pushed below the watermark.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUESTS = "custom_id string, attempt bigint, asked timestamp"
COMPLETIONS = "custom_id string, attempt bigint, answered timestamp"


def _stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def paired(requests: DataFrame, completions: DataFrame, bound: str, lateness: str) -> DataFrame:
    """custom_id, attempt, asked, answered (null for a request that was not answered within ``bound``)."""
    r = requests.withWatermark("asked", lateness).alias("r")
    c = completions.withWatermark("answered", lateness).alias("c")
    answered = F.col("c.answered")
    in_time = (answered >= F.col("r.asked")) & (answered <= F.col("r.asked") + F.expr(f"interval {bound}"))
    both = r.join(c, (F.col("r.custom_id") == F.col("c.custom_id")) & (F.col("r.attempt") == F.col("c.attempt")) & in_time, "left_outer")
    return both.select("r.custom_id", "r.attempt", "r.asked", "c.answered")


def run(spark: SparkSession, requests_dir: str, completions_dir: str, out_dir: str, checkpoint: str, bound: str = "30 minutes",
        lateness: str = "10 minutes", max_files_per_trigger: int | None = None) -> None:
    """Pair everything present now and stop (``availableNow``); requests still within their bound stay in the state."""
    r = _stream(spark, requests_dir, REQUESTS, max_files_per_trigger)
    c = _stream(spark, completions_dir, COMPLETIONS, max_files_per_trigger)
    q = (paired(r, c, bound, lateness).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out_dir))
    q.awaitTermination()


def heartbeat(spark: SparkSession, requests_dir: str, completions_dir: str, at: str) -> None:
    """Tell both streams that the time is ``at`` (a timestamp)."""
    now = spark.sql(f"select 'heartbeat {at}' as custom_id, -1L as attempt, timestamp '{at}' as t").coalesce(1)
    now.withColumnRenamed("t", "asked").write.mode("append").parquet(requests_dir)
    now.withColumnRenamed("t", "answered").write.mode("append").parquet(completions_dir)


def pairs(spark: SparkSession, out_dir: str) -> DataFrame:
    """Each request once: custom_id, attempt, asked, and its first completion (null for an orphan)."""
    return spark.read.schema(f"{REQUESTS}, answered timestamp").parquet(out_dir).where("attempt >= 0").groupBy("custom_id", "attempt", "asked").agg(F.min("answered").alias("answered"))
