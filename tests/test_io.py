"""Sources and sinks."""

import os

from pyspark.sql import functions as F

from turnforge.operators import render
from turnforge.sources import io
from turnforge.plans.fixtures import Fixtures

from .conftest import SF_SMALL


def test_json5_scenes(spark, scratch):
    os.makedirs(scratch, exist_ok=True)
    path = f"{scratch}/seed.json5"
    with open(path, "w") as f:
        f.write("[\n  // a comment\n  'first scene',\n  \"second scene\"\n]\n")
    got = [(r.scene_id, r.scene) for r in io.read_scenes_json5(spark, path).orderBy("scene_id").collect()]
    assert got == [(0, "first scene"), (1, "second scene")]


def test_request_and_completion_jsonl_roundtrip(spark, scratch):
    d = Fixtures(spark, SF_SMALL).dialogues.select("row_idx", F.col("seed_scene").alias("scene"), "lang")
    req = render.starter_requests(d, "r1", "fx", "org/m1")
    io.write_requests_jsonl(req, f"{scratch}/req")
    back = spark.read.json(f"{scratch}/req")
    assert back.count() == req.count()
    assert set(back.columns) == {"custom_id", "method", "url", "body"}
    comp = req.select("custom_id", F.lit("hello").alias("content"))
    io.write_completions_jsonl(comp, f"{scratch}/comp")
    parsed = io.read_completions(spark, f"{scratch}/comp")
    assert parsed.where(~F.col("is_error")).count() == req.count()


def test_dialogue_table_written_partitioned(spark, scratch):
    d = Fixtures(spark, SF_SMALL).dialogues.select("row_idx", "source", "scene", "lang", "dialogue", "models",
                                                    "ended")
    io.write_dialogues(d, f"{scratch}/dialogues", ("lang",))
    back = io.read_dialogues(spark, f"{scratch}/dialogues")
    assert back.count() == d.count()
    assert back.where(F.col("lang") == "english").count() == d.where(F.col("lang") == "english").count()


def test_orphans_both_ways(spark):
    v = spark.createDataFrame([("a",), ("b",)], "custom_id string")
    c = spark.createDataFrame([("b",), ("c",), ("d",)], "custom_id string")
    r = io.orphans(v, c).first()
    assert (r.verdict_without_completion, r.completion_without_verdict) == (1, 2)


def test_overlay_equals_left_anti_union(spark):
    from turnforge.operators.fold import overlay
    orig = spark.createDataFrame([("a", "a0"), ("b", "b0"), ("c", "c0")], "custom_id string, content string")
    repl = spark.createDataFrame([("b", "b1"), ("d", "d1")], "custom_id string, content string")
    got = sorted(tuple(r) for r in overlay(orig, repl, ["custom_id"]).collect())
    assert got == [("a", "a0"), ("b", "b1"), ("c", "c0"), ("d", "d1")]


def test_attempt_log_is_partitioned_by_run_and_attempt(spark, scratch):
    rows = [("x", "r1", 0, "t0"), ("x", "r1", 1, "t1"), ("y", "r2", 0, "u0")]
    df = spark.createDataFrame(rows, "custom_id string, run_id string, attempt int, content string")
    io.append_attempts(df.where("attempt = 0"), f"{scratch}/log")
    io.append_attempts(df.where("attempt = 1"), f"{scratch}/log")
    back = spark.read.parquet(f"{scratch}/log")
    assert back.count() == 3
    assert back.where((F.col("run_id") == "r1") & (F.col("attempt") == 1)).first().content == "t1"
    assert os.path.isdir(f"{scratch}/log/run_id=r1/attempt=1".removeprefix("file:"))


def test_manifest_progress(spark, scratch):
    os.makedirs(scratch, exist_ok=True)
    with open(f"{scratch}/manifest.json", "w") as f:
        f.write('{"id": "job-1", "input_file_id_openai": "file-a", "input_file_local": "req/en", "created_at": 1}\n')
        f.write('{"id": "job-2", "input_file_id_openai": "file-b", "input_file_local": "req/fr", "created_at": 2}\n')
    man = io.read_manifest(spark, f"{scratch}/manifest.json")
    comp = spark.createDataFrame([("req/en", False), ("req/en", True), ("req/fr", False)],
                                 "input_path string, is_error boolean")
    got = {r.id: (r.n_requests, r.n_completed) for r in io.manifest_progress(man, comp).collect()}
    assert got == {"job-1": (2, 1), "job-2": (1, 1)}


def test_jsonl_with_declared_schema_keeps_corrupt_lines(spark, scratch):
    from turnforge import schemas as S
    os.makedirs(scratch, exist_ok=True)
    with open(f"{scratch}/c.jsonl", "w") as f:
        f.write('{"custom_id":"a-1","response":{"body":{"choices":[{"message":{"role":"user","content":"x"}}]}}}\n')
        f.write('{"custom_id":"a-2","resp\n')
    df = io.read_jsonl(spark, f"{scratch}/c.jsonl", S.COMPLETION_WIRE)
    collected = df.collect()
    rows = {r.custom_id: r for r in collected}
    assert rows["a-1"].response.body.choices[0].message.content == "x"
    # (Spark refuses a query that reads only the corrupt-record column of a raw scan.)
    assert sum(r._corrupt_record is not None for r in collected) == 1


def test_sorted_export(spark, scratch):
    d = Fixtures(spark, SF_SMALL).dialogues.select("row_idx", F.col("seed_scene").alias("scene"), "lang")
    req = render.starter_requests(d, "r1", "fx", "m1")
    io.write_requests_jsonl(req, f"{scratch}/sorted", sort_for_export=True)
    files = spark.read.text(f"{scratch}/sorted").select(F.input_file_name()).distinct().collect()
    ids = [r.custom_id for f in sorted(r[0] for r in files) for r in spark.read.json(f).collect()]
    assert [int(x.rpartition("-")[2]) for x in ids] == sorted(r.row_idx for r in d.collect())  # 2 before 10
    assert len(ids) == req.count()
