"""Streaming parity and late-data behaviour."""

import datetime as dt

from pyspark.sql import functions as F

from turnforge.plans.catalog import QUERIES
from turnforge.plans.fixtures import Fixtures, parse_completion_lines
from turnforge.streaming import audit
from turnforge.streaming.ingest import completion_stream, ingest, latest

from .conftest import SF_SMALL


def test_stream_ingest_equals_batch(spark):
    got = sorted((tuple(r) for r in QUERIES["stream_ingest"](spark, SF_SMALL).collect()), key=repr)
    lines = Fixtures(spark, SF_SMALL).completion_lines.select("value", "attempt")
    want = sorted((tuple(r) for r in parse_completion_lines(lines).select("custom_id", "attempt", "content", "error").collect()), key=repr)
    assert got == want


GOOD = '{"custom_id":"a-1","response":{"body":{"choices":[{"message":{"role":"user","content":"%s"}}]}}}'


def test_every_malformed_line_is_a_dead_letter(spark, scratch):
    spark.createDataFrame([("{oops",), ("",), ("[1, 2",), ("{oops",)], "value string").coalesce(1).write.text(f"{scratch}/in")
    ingest(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/chk")
    out = latest(spark, f"{scratch}/out")
    assert sorted(r.n_lines for r in out.collect()) == [1, 1, 2] and out.where("custom_id is null and error = 'malformed'").count() == 3


def test_a_regenerated_completion_keeps_its_attempt(spark, scratch):
    df = spark.createDataFrame([(GOOD % "first", 0), (GOOD % "second", 1)], "value string, attempt int")
    df.write.partitionBy("attempt").text(f"{scratch}/in")
    ingest(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/chk")
    assert sorted((r.attempt, r.content) for r in latest(spark, f"{scratch}/out").collect()) == [(0, "first"), (1, "second")]


def test_replayed_files_are_deduplicated(spark, scratch):
    rows = [('{"custom_id":"a-1","response":{"body":{"choices":[{"message":{"role":"user","content":"x"}}]}}}',)]
    df = spark.createDataFrame(rows, "value string")
    for _ in range(3):
        df.write.mode("append").text(f"{scratch}/in")
    ingest(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/chk", max_files_per_trigger=1)
    want = [("a-1", 0, "x", None, 3, False)]
    assert [tuple(r) for r in latest(spark, f"{scratch}/out").collect()] == want
    # a second run over the same folder adds nothing (checkpointed offsets)
    ingest(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/chk", max_files_per_trigger=1)
    assert [tuple(r) for r in latest(spark, f"{scratch}/out").collect()] == want


def test_stream_audit_counts_late_events(spark, scratch):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    first = spark.createDataFrame([(1, t0 + dt.timedelta(minutes=30))], "event_id long, ts timestamp")
    late = spark.createDataFrame([(2, t0)], "event_id long, ts timestamp")
    first.write.parquet(f"{scratch}/in/a")
    audit.run(spark, f"{scratch}/in/*", first.schema, f"{scratch}/out", f"{scratch}/chk")
    late.write.parquet(f"{scratch}/in/b")
    audit.run(spark, f"{scratch}/in/*", first.schema, f"{scratch}/out", f"{scratch}/chk")
    minutes = {r.minute: r.n for r in audit.latest(spark, f"{scratch}/out", 2).collect()}
    assert minutes == {"2024-01-01 12:30:00": 1, "2024-01-01 12:00:00": 1}


def test_stream_audit_one_file_a_trigger_loses_nothing(spark, scratch):
    ev = spark.range(1000).select("id", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id * 7919 % 1000 as int))").alias("ts"))
    ev.repartition(6).write.parquet(f"{scratch}/in")
    audit.run(spark, f"{scratch}/in", ev.schema, f"{scratch}/out", f"{scratch}/chk", max_files_per_trigger=1)
    assert audit.latest(spark, f"{scratch}/out", 2).agg(F.sum("n")).first()[0] == 1000


def test_stream_audit_equals_batch(spark):
    a = sorted(tuple(r) for r in QUERIES["stream_rate_audit"](spark, SF_SMALL).collect())
    b = sorted(tuple(r) for r in QUERIES["rate_audit"](spark, SF_SMALL).collect())
    assert a == b


def test_the_state_of_a_key_costs_no_call_of_python(spark, scratch):
    """the fold is an aggregate of Spark's own; its result holds over triggers, and states are not kept in memory."""
    rows = [(GOOD.replace("a-1", f"a-{k % 500}") % f"x{k}",) for k in range(1500)]
    spark.createDataFrame(rows, "value string").repartition(3).write.text(f"{scratch}/in")
    plan = completion_stream(spark, f"{scratch}/in")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "Python" not in plan
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ingest(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/chk", max_files_per_trigger=1)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == was
    got = {r.custom_id: (r.content, r.n_lines, r.conflict) for r in latest(spark, f"{scratch}/out").collect()}
    assert got == {f"a-{k}": (min(f"x{k + 500 * i}" for i in range(3)), 3, True) for k in range(500)}
    assert spark.read.text(f"{scratch}/chk/offsets").where("value like '%RocksDB%'").count() >= 3
