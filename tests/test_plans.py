"""Plan tests: built-in expressions only, no single-task windows over row data,
pushdown and pruning reach the scan."""

import pytest
from pyspark.sql import functions as F

from turnforge.plans.catalog import QUERIES
from turnforge.sources import io

from .conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
ALLOWED_PYTHON: set = set()
# Run a stream, a loop or the backend while they are built.
EAGER = {"stream_ingest", "stream_rate_audit", "turn_loop", "starter_loop", "echo_complete"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - EAGER))
def test_no_python_outside_the_backend(spark, key):
    p = plan(QUERIES[key](spark, SF_SMALL))
    has_python = any(n in p for n in PYTHON_NODES)
    assert has_python == (key in ALLOWED_PYTHON), p[:2000]


def test_backend_output_is_read_from_storage(spark):
    p = plan(QUERIES["echo_complete"](spark, SF_SMALL))
    assert "MapInPandas" not in p and "FileScan parquet" in p


def test_rate_plan_has_no_unpartitioned_window_over_rows(spark):
    p = plan(QUERIES["rate_plan"](spark, SF_SMALL))
    # The only window without partition keys runs over per-block totals (an aggregate's output).
    windows = [ln for ln in p.splitlines() if "Window [" in ln]
    assert windows and all("_blk" in ln for ln in windows)
    assert "text" not in "".join(ln for ln in p.splitlines() if "Sort [" in ln or "SinglePartition" in ln)


def test_scan_prunes_columns(spark):
    df = QUERIES["stratified_sample"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in p.splitlines() if "FileScan parquet" in ln or "Scan parquet" in ln]
    assert scan and all("text" not in ln.split("ReadSchema")[-1] for ln in scan)


def test_topk_limit_is_pushed_below_the_shuffle(spark):
    df = QUERIES["stratified_sample"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_filters_reach_the_scan(spark):
    from turnforge.plans.fixtures import Fixtures
    df = Fixtures(spark, SF_SMALL).msgs.where(F.col("conv_id") < 5)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(conv_id), LessThan(conv_id,5)" in p or "LessThan(conv_id,5)" in p


def test_ledger_first_tries_limited_before_shuffle(spark):
    p = plan(QUERIES["attempt_ledger"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_one_cell_of_the_grid_reads_one_partition(spark, scratch):
    d = spark.range(12).selectExpr("id AS row_idx", "concat('l', id % 3) AS lang", "concat('u', id % 2) AS user_model")
    io.write_dialogues(d, scratch, ("lang", "user_model"))
    cell = spark.read.schema("row_idx bigint, lang string, user_model string").parquet(scratch).where("lang = 'l1' and user_model = 'u0'")
    p = plan(cell)
    assert "PartitionFilters: [isnotnull(lang" in p and "(lang" in p.split("PartitionFilters")[1] and cell.count() == 2


def test_same_plan_at_every_size(spark):
    from turnforge.sources.tables import read_table

    from .conftest import SF_MID
    assert all("Exchange" not in plan(read_table(spark, sf, "documents")) for sf in (SF_SMALL, SF_MID))


def test_no_cartesian_products(spark):
    for key in sorted(set(QUERIES) - EAGER):
        p = plan(QUERIES[key](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key


def scans(node):
    """The file scans of an executed plan, inside stages of an adaptive plan too."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scans(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return scans(node.plan())
    if name == "FileSourceScanExec":
        return [node]
    children = node.children()
    return [x for k in range(children.size()) for x in scans(children.apply(k))]


def test_wanted_cells_prune_the_stored_partitions(spark, scratch):
    rows = spark.range(64).select(F.col("id").alias("row_idx"), (F.col("id") % 16).cast("string").alias("lang"))
    io.write_dialogues(rows, f"{scratch}/table", ("lang",))
    spark.range(16).select(F.col("id").cast("string").alias("lang"), (F.col("id") * 10).alias("n")).write.parquet(f"{scratch}/cells")
    table = spark.read.schema("row_idx bigint, lang string").parquet(f"{scratch}/table")
    df = io.in_cells(table, spark.read.parquet(f"{scratch}/cells").where("n < 20"), ("lang",))
    assert "dynamicpruning" in plan(df)
    assert sorted(r.row_idx for r in df.collect()) == sorted([*range(0, 64, 16), *range(1, 64, 16)])
    read = [s for s in scans(df._jdf.queryExecution().executedPlan()) if "dynamicpruning" in s.toString()]
    assert [s.metrics().apply("numPartitions").value() for s in read] == [2]


def test_registered_cells_prune(spark):
    assert "dynamicpruning" in plan(QUERIES["thin_cells"](spark, SF_SMALL))
