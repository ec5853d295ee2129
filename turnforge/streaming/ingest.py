"""ST1: ingest completion files that land out of order, may repeat and may contradict each other.

``readStream`` (text lines, no inference) -> parse -> a state for each id and
attempt -> one row of what is known so far, per micro-batch.  The attempt is the
``attempt=N`` folder a file is in (0 without one): regenerated completions keep
their ``custom_id``.  A line without an id is a dead letter, told from others by
the hash of its text.

The state folds lines in any order to the same result: an answer replaces an
error, the smallest of several answers stays (as ``complete.replay`` has it),
lines are counted, and answers that differ are a conflict.  It is an aggregate of
Spark's own, so no key costs a call of Python, and lines of one task and key are
folded before they move.  A state covers a span of ``expire_ms`` in the time at
which lines are read (so no line is late) and expires when the span is over; a
line that comes later opens a new state, and ``latest`` folds the states of a key,
so expiry changes no result.  States are kept in RocksDB: their texts need not fit
into the executors' memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnforge.plans.fixtures import parse_completion_lines

KEYS = ["line_key", "attempt"]
STATE = "custom_id string, least string, most string, error string, n_lines long, n_answers long, since long"
OUT = f"line_key string, attempt int, {STATE}"
EXPIRE_MS = 24 * 3600 * 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def completion_lines(spark: SparkSession, src_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The stream of parsed lines: line_key, attempt, custom_id, content, error, arrived."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    attempt = F.regexp_extract(F.col("_metadata.file_path"), "/attempt=([0-9]+)/", 1)
    lines = reader.load(src_dir).select("value", F.coalesce(attempt.try_cast("int"), F.lit(0)).alias("attempt"),
                                        F.current_timestamp().alias("arrived"))
    parsed = parse_completion_lines(lines)
    key = F.coalesce(F.concat(F.lit("id:"), "custom_id"), F.concat(F.lit("text:"), F.sha2(F.coalesce("value", F.lit("")), 256)))
    return parsed.select(key.alias("line_key"), "attempt", "custom_id", "content", "error", "arrived").withWatermark("arrived", "0 seconds")


def completion_stream(spark: SparkSession, src_dir: str, max_files_per_trigger: int | None = None, expire_ms: int = EXPIRE_MS) -> DataFrame:
    """What is known of each key that a micro-batch has lines of."""
    lines = completion_lines(spark, src_dir, max_files_per_trigger)
    known = lines.groupBy(*KEYS, F.window("arrived", f"{expire_ms} milliseconds").alias("span")).agg(
        F.min("custom_id").alias("custom_id"), F.min("content").alias("least"), F.max("content").alias("most"), F.min("error").alias("error"),
        F.count(F.lit(1)).alias("n_lines"), F.count("content").alias("n_answers"))
    return known.withColumn("since", F.unix_millis(F.col("span.start"))).select(*[c.split()[0] for c in OUT.split(", ")])


def ingest(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str, max_files_per_trigger: int | None = None,
           expire_ms: int = EXPIRE_MS) -> None:
    """Run the ingest over everything present now and stop (``availableNow``); a micro-batch that is run again replaces its folder."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    writer = (completion_stream(spark, src_dir, max_files_per_trigger, expire_ms).writeStream.outputMode("update").foreachBatch(sink)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query takes the settings of its start
    try:
        q = writer.start()
    finally:
        spark.conf.set(PROVIDER, was)
    q.awaitTermination()


def latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """custom_id, attempt, content, error, n_lines, conflict: what is known of each key over all states it had."""
    log = spark.read.schema(f"{OUT}, batch_id bigint").parquet(out_dir)
    last = log.groupBy(*KEYS, "since").agg(F.max_by(F.struct("custom_id", "least", "most", "error", "n_lines"), "batch_id").alias("s"))
    every = last.groupBy(*KEYS).agg(F.min("s.custom_id").alias("custom_id"), F.min("s.least").alias("content"), F.max("s.most").alias("most"),
                                    F.min("s.error").alias("error"), F.sum("s.n_lines").alias("n_lines"))
    return every.select("custom_id", "attempt", "content", F.when(F.col("content").isNull(), F.col("error")).alias("error"), "n_lines",
                        F.coalesce(F.col("content") != F.col("most"), F.lit(False)).alias("conflict"))
