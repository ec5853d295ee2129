"""Segmented dialogues, the result journal, the attempt log, exact start times, keyed completions, orphans."""

import os
import random

import pytest
from pyspark.sql import functions as F

from turnforge.constants import END_MARKER
from turnforge.functions.text import history_text
from turnforge.operators import attempt_log, budget, fold, journal, segments, starts
from turnforge.operators.complete import EchoBackend
from turnforge.operators.render import message_json
from turnforge.session import scratch_path
from turnforge.streaming import ingest, orphans

MSGS = "conv_id long, pos long, role string, content string"


def messages(spark, lengths):
    rows = [(c, p, "user" if p % 2 == 0 else "assistant", f"m{c}-{p}\nx") for c, n in enumerate(lengths) for p in range(n)]
    return spark.createDataFrame(rows, MSGS)


# --- segments ------------------------------------------------------------------

def test_segments_are_bounded_and_chained(spark):
    msgs = messages(spark, [0, 1, 4, 5, 23])
    s = segments.to_segments(msgs, 4)
    rows = s.collect()
    assert max(r.n for r in rows) == 4 and sum(r.n for r in rows) == 33
    whole = {r.conv_id: r.digest for r in segments.to_segments(msgs, 1000).collect()}
    ends = {r.conv_id: r for r in segments.heads(s).collect()}
    assert {c: e.digest for c, e in ends.items()} == whole and ends[4].next_pos == 23
    for r in rows:
        before = sum((x.digest for x in rows if x.conv_id == r.conv_id and x.segment < r.segment), 0)
        assert r.digest_before == before


def test_history_up_to_a_position(spark):
    s = segments.to_segments(messages(spark, [9, 3]), 4, chained=False)
    asks = spark.createDataFrame([(0, 0), (0, 4), (0, 7), (1, 3)], "conv_id long, upto long")
    texts = {(r.conv_id, r.upto): r.history for r in segments.texts_before(s, asks).collect()}
    full = segments.dialogues_before(s, asks)
    assert texts == {(r.conv_id, r.upto): r.h or "" for r in full.select("conv_id", "upto", history_text(F.col("dialogue"), "delete").alias("h")).collect()}
    assert {(r.conv_id, r.upto): len(r.dialogue) for r in full.collect()} == {(0, 0): 0, (0, 4): 4, (0, 7): 7, (1, 3): 3}
    assert texts[0, 4] == "\n".join(f"{'user' if p % 2 == 0 else 'assistant'}: m0-{p}x" for p in range(4))


def test_append_writes_one_segment_and_repeats_change_nothing(spark, scratch):
    segments.to_segments(messages(spark, [5, 2, 3]), 4).write.parquet(scratch)
    turns = spark.createDataFrame([(0, "user: new"), (0, "user: zzz"), (1, END_MARKER), (2, None)], "conv_id long, content string")
    new = segments.append(segments.heads(segments.read(spark, scratch)), turns, "user", "m")
    assert sorted((r.conv_id, r.first_pos, r.n, r.ended) for r in new.collect()) == [(0, 5, 1, False), (1, 2, 0, True)]
    held = spark.createDataFrame(new.collect(), new.schema)
    for _ in range(2):
        segments.attach(spark, scratch, held)
    table = segments.read(spark, scratch)
    assert {r.conv_id: r.next_pos for r in segments.heads(table).collect()} == {0: 6, 1: 2, 2: 3}
    assert {r.conv_id: (r.last_role, r.last_content) for r in segments.last_messages(table).collect()}[0] == ("user", "new")
    other = held.withColumn("messages", F.transform("messages", lambda m: m.withField("content", F.lit("other")))).withColumn("digest", F.col("digest") + 1)
    with pytest.raises(ValueError):
        segments.attach(spark, scratch, other.select(held.columns))
    full = segments.compact(segments.read(spark, scratch), 4)
    assert sorted((r.conv_id, r.segment, r.n) for r in full.collect()) == [(0, 0, 4), (0, 1, 2), (1, 0, 2), (2, 0, 3)]


# --- journal -----------------------------------------------------------------------

class Fragile(EchoBackend):
    """Notes every id it is asked for; its worker dies once, in the batch of the id ``r42``."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, batch):
        for c in batch["custom_id"]:
            with open(f"{self.folder}/calls", "a") as f:
                f.write(c + "\n")
        if "r42" in set(batch["custom_id"]) and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        return super().complete(batch)


def requests(spark, n, text="hello"):
    return spark.range(n).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("custom_id"), F.lit(0).alias("attempt"), F.lit("m").alias("model"),
                                 F.array(F.struct(F.lit("user").alias("role"), F.lit(text).alias("content"))).alias("messages"))


def test_after_a_death_only_unfinished_batches_are_asked_again(spark, tmp_path):
    path, folder = f"{tmp_path}/journal", str(tmp_path)
    with pytest.raises(Exception, match="exited unexpectedly|crashed"):
        journal.complete_journaled(requests(spark, 400), lambda: Fragile(folder), path, batch=10)
    done = {r.custom_id for r in journal.read(spark, path).collect()}
    first = open(f"{folder}/calls").read().split()
    assert "r42" not in done and len(done) < 400
    out = journal.complete_journaled(requests(spark, 400), lambda: Fragile(folder), path, batch=10)
    assert {(r.custom_id, r.content, r.error) for r in out.collect()} == {(f"r{k}", "echo: hello", None) for k in range(400)}
    second = open(f"{folder}/calls").read().split()[len(first):]
    assert sorted(second) == sorted({f"r{k}" for k in range(400)} - done)
    journal.complete_journaled(requests(spark, 400), lambda: Fragile(folder), path, batch=10)
    assert len(open(f"{folder}/calls").read().split()) == len(first) + len(second)


def test_a_changed_prompt_is_asked_for_anew(spark, tmp_path):
    path = f"{tmp_path}/journal"
    journal.complete_journaled(requests(spark, 20, "a"), EchoBackend, path)
    out = journal.complete_journaled(requests(spark, 30, "b"), EchoBackend, path)
    assert {r.content for r in out.collect()} == {"echo: b"} and out.count() == 30
    assert journal.read(spark, path).count() == 50
    with pytest.raises(ValueError):
        journal.complete_journaled(requests(spark, 2).unionByName(requests(spark, 2)), EchoBackend, path)


# --- attempt log --------------------------------------------------------------------

@pytest.mark.parametrize("policy", ["starter", "turn"])
def test_merged_winners_equal_the_fold_of_the_log(spark, policy):
    pick = random.Random(3)
    rows = [(f"id{k}", a, f"t{k}-{a}", pick.choice([True, False, None])) for k in range(60) for a in range(4) if pick.random() < 0.7]
    a = spark.createDataFrame(rows, "custom_id string, attempt int, content string, accepted boolean")
    log = attempt_log.AttemptLog(spark, scratch_path(spark, "log"), buckets=4)
    for r in (2, 0, 3, 1):  # in any order
        log.append(a.where(F.col("attempt") == r), r)
        log.merge(r)
    columns = ["custom_id", "winning_attempt", "final_content"]
    want = sorted(map(tuple, fold.fold_attempts(a, ["custom_id"], policy).select(columns).collect()))
    assert sorted(map(tuple, log.folded(policy).select(columns).collect())) == want
    assert sorted(map(tuple, log.folded_from_log(policy).select(columns).collect())) == want


def test_bucketed_fold_and_merge_have_no_exchange(spark):
    a = spark.createDataFrame([("a", 0, "x", False), ("b", 0, "y", True)], "custom_id string, attempt int, content string, accepted boolean")
    log = attempt_log.AttemptLog(spark, scratch_path(spark, "log"), buckets=4)
    for r in (0, 1):
        log.append(a.withColumn("attempt", F.lit(r)), r)
        log.merge(r)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(log.folded_from_log("turn"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = attempt_log.merged(spark.table(log.winners), attempt_log.partial_fold(log.log().where("round = 1")))
        assert "Join" in plan(both) and "Exchange" not in plan(both)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# --- start times ---------------------------------------------------------------------

def sequential(tokens, r, k):
    """The loop with two buckets, in whole units of 60 / (r * k) seconds."""
    now, level_r, level_t, out = 0, r * k, k * r, []  # a request costs k units, a token r; a full bucket holds a minute
    for c in tokens:
        wait = max(0, k - level_r, c * r - level_t)
        now += wait
        level_r, level_t = min(r * k, level_r + wait) - k, min(k * r, level_t + wait) - c * r
        out.append(now)
    return out


@pytest.mark.parametrize("r,k,top", [(3, 50, 50), (100, 40, 40), (1, 7, 5), (20, 1000, 90)])
def test_starts_equal_the_sequential_loop(spark, monkeypatch, r, k, top):
    pick = random.Random(r)
    tokens = [pick.choice([0, 1, pick.randint(0, top)]) for _ in range(700)]
    df = spark.createDataFrame([(5 * i, c) for i, c in enumerate(tokens)], "o long, c long").repartition(3)
    monkeypatch.setattr(starts, "BLOCK_BITS", 3)  # blocks of blocks
    got = [x.start for x in starts.start_units(df, "o", "c", r, k).orderBy("o").collect()]
    assert got == sequential(tokens, r, k)


def test_rate_plan_skips_requests_that_never_fit(spark):
    df = spark.createDataFrame([(0, 5), (1, 99), (2, 10), (3, 10)], "id long, c long")
    rows = budget.rate_plan(df, "id", "c", 60, 10).orderBy("id").collect()
    assert [(x.task_id, x.oversize, x.start_s) for x in rows] == [(0, False, 0.0), (1, True, None), (2, False, 30.0), (3, False, 90.0)]


# --- streams ------------------------------------------------------------------------------

def line(cid, text):
    return f'{{"custom_id": "{cid}", "response": {{"body": {{"choices": [{{"message": {{"role": "assistant", "content": "{text}"}}}}]}}}}}}'


def test_an_answer_replaces_an_error_whatever_comes_first(spark, scratch):
    error = '{"custom_id": "%s", "response": {"body": ["late"]}}'
    steps = [[error % "a", error % "c", "broken", "broken"], [line("a", "yes"), line("b", "two"), line("b", "two")], [line("b", "one"), error % "b", error % "c"]]
    for lines in steps:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{scratch}/in/attempt=2")
        ingest.ingest(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/chk")
    got = {r.custom_id: (r.attempt, r.content, r.error, r.n_lines, r.conflict) for r in ingest.latest(spark, f"{scratch}/out").collect()}
    assert got == {"a": (2, "yes", None, 2, False), "b": (2, "one", None, 4, True), "c": (2, None, "late", 2, False), None: (2, None, "malformed", 2, False)}


def test_expired_states_are_folded(spark, scratch):
    for cid, text in (("a", "zz"), ("b", "x"), ("a", "aa")):  # the time moves on between the two
        spark.createDataFrame([(line(cid, text),)], "value string").coalesce(1).write.mode("append").text(f"{scratch}/in")
        ingest.ingest(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/chk", expire_ms=1)
    got = sorted(tuple(r) for r in ingest.latest(spark, f"{scratch}/out").collect())
    assert got == [("a", 0, "aa", None, 2, True), ("b", 0, "x", None, 1, False)]
    assert len({r.since for r in spark.read.parquet(f"{scratch}/out").where("custom_id = 'a'").collect()}) == 2


def test_orphans_come_out_after_their_bound(spark, scratch):
    def put(side, column, rows):
        spark.createDataFrame([(c, 0, f"2024-01-01 {t}") for c, t in rows], f"custom_id string, attempt bigint, {column} string").withColumn(
            column, F.col(column).cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{scratch}/{side}")

    def run():
        orphans.run(spark, f"{scratch}/r", f"{scratch}/c", f"{scratch}/out", f"{scratch}/chk")
        return {r.custom_id: r.answered is not None for r in orphans.pairs(spark, f"{scratch}/out").collect()}

    put("r", "asked", [("a", "10:00:00"), ("b", "10:01:00"), ("c", "10:02:00")])
    put("c", "answered", [("a", "10:05:00"), ("a", "10:05:00"), ("x", "10:06:00"), ("c", "10:40:00")])
    assert run() == {"a": True}
    orphans.heartbeat(spark, f"{scratch}/r", f"{scratch}/c", "2024-01-02 00:00:00")
    assert run() == {"a": True, "b": False, "c": False}


# --- rendering ------------------------------------------------------------------------------

def test_wrapped_models_are_sent_typed_parts(spark):
    row = "array(named_struct('role', 'user', 'content', 'hi')) as messages"
    got = spark.sql(f"select 'org/gemma-3-x' as model, {row} union all select 'org/other', {row}").select("model", message_json(F.col("messages"), F.col("model")).alias("j"))
    assert {r.model: r.j for r in got.collect()} == {"org/gemma-3-x": '[{"role":"user","content":[{"type":"text","text":"hi"}]}]', "org/other": '[{"role":"user","content":"hi"}]'}
