"""ST2: per-minute request load against a rate limit, as a stream.

Each micro-batch is counted by minute and written to a folder of its own,
named by the batch (a batch that is run again replaces it).  The load of a
minute is the sum over batches, so events may come in any order and any
number of triggers: none is late, and no state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG_SCHEMA = "minute string, n bigint, batch_id bigint"


def load_stream(spark: SparkSession, src_dir: str, schema: StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(src_dir)


def run(spark: SparkSession, src_dir: str, schema: StructType, out_dir: str, checkpoint: str, ts: str = "ts",
        max_files_per_trigger: int | None = None) -> None:
    def sink(batch: DataFrame, batch_id: int) -> None:
        minute = F.date_format(F.window(F.col(ts), "1 minute")["start"], "yyyy-MM-dd HH:mm:ss")
        (batch.where(F.col(ts).isNotNull()).groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}"))

    q = (load_stream(spark, src_dir, schema, max_files_per_trigger).writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest(spark: SparkSession, out_dir: str, limit: int) -> DataFrame:
    """Load per minute over all batches so far."""
    g = spark.read.schema(LOG_SCHEMA).parquet(out_dir).groupBy("minute").agg(F.sum("n").cast("bigint").alias("n"))
    return g.select("minute", "n", (F.col("n") > limit).alias("over_limit"))
