"""Scans and sinks (S1-S10), integrity checks (J7) and the parameter check.

Every reader takes a declared schema: no inference.  Writers never overwrite
their own input: each round / turn goes to a new path, and the attempt log
is partitioned by ``attempt`` (and ``run_id``) instead of renamed backups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnforge import schemas as S
from turnforge.functions.identity import decode_row_idx
from turnforge.operators.render import request_json
from turnforge.plans.fixtures import parse_completion_lines

JSON5_OPTIONS = {"allowComments": "true", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}


def read_scenes_json5(spark: SparkSession, path: str, scene_field: str | None = None) -> DataFrame:
    """A JSON5-style array of scenes; element order gives ``scene_id``.

    Comments, single quotes and bare keys are accepted; trailing commas are
    not.  A multi-line array is one unsplittable task, so large seed sets
    belong in JSONL or Parquet (``read_scenes``).  ``path`` is one file:
    ids are positions in its array.
    """
    raw = spark.read.text(path, wholetext=True)
    arr = F.from_json(F.col("value"), "array<string>", JSON5_OPTIONS)
    out = raw.select(F.posexplode(arr).alias("scene_id", "scene"))
    if scene_field:
        out = out.withColumn("scene", F.get_json_object("scene", f"$.{scene_field}"))
    return out.select(F.col("scene_id").cast("bigint"), "scene")


def read_scenes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scenes from JSONL or Parquet (splittable)."""
    if fmt == "parquet":
        return spark.read.schema(S.SCENES).parquet(path)
    return spark.read.schema(S.SCENES).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSONL with a fixed schema; malformed lines land in ``_corrupt_record``."""
    opts = {"mode": "PERMISSIVE"}
    if "_corrupt_record" in schema.fieldNames():
        opts["columnNameOfCorruptRecord"] = "_corrupt_record"
    return spark.read.schema(schema).options(**opts).json(path)


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    """S2 + P12: completion lines to ``custom_id, content, error, is_error``."""
    lines = spark.read.text(path)
    extra = [c for c in lines.columns if c != "value"]  # partition columns, e.g. the attempt
    return parse_completion_lines(lines).select("custom_id", *extra, "content", "error", "is_error")


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """S3: the dialogue table with its declared schema (partition columns discovered)."""
    return spark.read.schema(S.DIALOGUES).parquet(path)


def write_requests_jsonl(requests: DataFrame, path: str, sort_for_export: bool = False) -> None:
    """One JSON request per line.  Order only matters for export (O1): by row index, as a number, then by id."""
    out = requests.select(request_json(requests).alias("value"), "custom_id")
    if sort_for_export:
        out = out.orderBy(decode_row_idx(F.col("custom_id")).asc_nulls_last(), "custom_id")
    out.select("value").write.mode("overwrite").text(path)


def write_completions_jsonl(completions: DataFrame, path: str) -> None:
    """Normalised ``{custom_id, response.body.choices[0].message}`` lines.

    A row without content is written in the failure form, its body a list with
    the error; ``model`` is kept if the table has it; an ``attempt`` column
    becomes the folder ``attempt=N``.
    """
    model = F.col("model") if "model" in completions.columns else F.lit(None).cast("string")
    error = F.col("error") if "error" in completions.columns else F.lit(None).cast("string")
    msg = F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content"))
    body = F.struct(model.alias("model"), F.array(F.struct(msg.alias("message"))).alias("choices"))
    good = F.to_json(F.struct(F.col("custom_id"), F.struct(body.alias("body")).alias("response")))
    failed = F.array(F.coalesce(error, F.lit("empty")))
    bad = F.to_json(F.struct(F.col("custom_id"), F.struct(failed.alias("body")).alias("response")))
    parts = ["attempt"] if "attempt" in completions.columns else []
    out = completions.select(F.when(F.col("content").isNotNull(), good).otherwise(bad).alias("value"), *parts)
    out.write.mode("overwrite").partitionBy(*parts).text(path)


def write_dialogues(dialogues: DataFrame, path: str, partition_by: Sequence[str] = ("lang",),
                    files_per_partition: int | None = None) -> None:
    """Write the dialogue table to a **new** path, partitioned.

    Repartitioning by the partition columns first keeps the file count to a
    few per partition (no small-file explosion over the grid of cells).
    """
    out = dialogues
    if partition_by:
        cols = [F.col(c) for c in partition_by]
        out = out.repartition(files_per_partition, *cols) if files_per_partition else out.repartition(*cols)
    out.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def in_cells(table: DataFrame, wanted: DataFrame, cells: Sequence[str]) -> DataFrame:
    """The rows of a partitioned ``table`` whose partition is among ``wanted``.

    Which partitions are wanted is known at run time only; Spark turns the
    join on partition columns into a dynamic pruning filter of the scan, if
    ``wanted`` is a filtered table.  Its rows are distinct here, so no row is doubled.
    """
    return table.join(wanted.select(*cells).distinct(), list(cells))


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Append a round to the attempt log, partitioned by run and attempt."""
    attempts.write.mode("append").partitionBy("run_id", "attempt").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The job manifest (remote job id -> local input path)."""
    return spark.read.schema(S.MANIFEST).json(path)


def manifest_progress(manifest: DataFrame, completions: DataFrame, path_col: str = "input_path") -> DataFrame:
    """Requests and completions per job, aggregated before the join."""
    per = completions.groupBy(path_col).agg(F.count(F.lit(1)).alias("n_requests"),
                                            F.count_if(~F.col("is_error")).alias("n_completed"))
    return manifest.join(per, manifest["input_file_local"] == per[path_col], "left")


def orphans(verdicts: DataFrame, completions: DataFrame, key: str = "custom_id") -> DataFrame:
    """Ids on one side only, both directions, from one full outer join."""
    v = verdicts.select(F.col(key).alias("_v"))
    c = completions.select(F.col(key).alias("_c"))
    j = v.join(c, v["_v"] == c["_c"], "full_outer")
    return j.agg(F.count_if(F.col("_c").isNull()).alias("verdict_without_completion"),
                 F.count_if(F.col("_v").isNull()).alias("completion_without_verdict"))


def param_check(requests: DataFrame, by: str = "model", order: str = "row_idx") -> DataFrame:
    """O4 (T11): the first row's parameters, and whether all rows agree."""
    return requests.groupBy(by).agg(F.count_distinct("params").alias("n_param_sets"),
                                    F.min_by("params", order).alias("first_params"))
