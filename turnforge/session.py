"""SparkSession helpers.

On a cluster the session is built by the platform; ``configure`` only fills in
what is unset.  ``checkpoint_root`` always reads ``spark.checkpoint.dir`` from
the session and invents a scratch folder only when it is unset (local tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a local run needs; a cluster session keeps whatever it already has.
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.speculation": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "turnforge", cores: str = "*", extra: dict | None = None) -> SparkSession:
    """A local[N] session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**LOCAL_DEFAULTS, "spark.driver.memory": "16g", **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session that names no folder takes the one its context was given
    (``setCheckpointDir``).  With neither, a local master (tests) gets a
    temporary folder; any other master raises, because executors could not
    see a folder that the driver made for itself.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = context.getCheckpointDir()
        root = given.rpartition("/")[0] if given else None  # Spark appends a folder of its own
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="turnforge-chk-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never-reused path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/turnforge/{label}-{uuid.uuid4().hex}"


def stored(df, label: str):
    """Write ``df`` to the shared folder as Parquet and return the written table.

    Cuts the lineage: a lost executor never re-runs what led to the table, and
    branches that read different columns of it are pruned by the scan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

