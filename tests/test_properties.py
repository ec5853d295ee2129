"""Property tests: loop = fold, order invariance, idempotent replay, nothing lost."""

from pyspark.sql import functions as F

from turnforge.operators import complete, fold
from turnforge.plans.catalog import QUERIES
from turnforge.plans.fixtures import Fixtures

from .conftest import SF_SMALL


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_loop_equals_fold(spark):
    """Where every answer came, the loop ends as the fold does; ids without an answer stay in."""
    for flow in ("turn", "starter"):
        fold_rows = {r[0]: r for r in QUERIES[f"{flow}_fold"](spark, SF_SMALL).collect()}
        loop_rows = {r[0]: r for r in QUERIES[f"{flow}_loop"](spark, SF_SMALL).collect()}
        lost = {k for k in fold_rows if int(k.rsplit("-", 1)[1]) % 13 == 6}
        assert set(loop_rows) == set(fold_rows) and lost
        assert all(loop_rows[k] == fold_rows[k] for k in set(fold_rows) - lost)


def test_fold_is_invariant_to_row_order_and_partitioning(spark):
    a = Fixtures(spark, SF_SMALL).attempts.where(F.col("flow") == "turn")
    base = _sorted(fold.fold_attempts(a, policy="turn"))
    shuffled = a.orderBy(F.rand(7)).repartition(5)
    assert _sorted(fold.fold_attempts(shuffled, policy="turn")) == base


def test_replaying_a_completion_file_twice_changes_nothing(spark):
    fx = Fixtures(spark, SF_SMALL)
    saved = fx.attempts.select("custom_id", "attempt", "content", F.lit(None).cast("string").alias("error"))
    reqs = fx.attempts.select("custom_id", "attempt")
    once = complete.replay(reqs, saved)
    twice = complete.replay(reqs, saved.unionByName(saved))
    assert _sorted(once) == _sorted(twice)


def test_no_id_lost_in_triage(spark):
    a = Fixtures(spark, SF_SMALL).attempts
    ev = fold.evaluated_attempts(a)
    counts = ev.groupBy().agg(F.count_if("accepted").alias("acc"), F.count_if(~F.col("accepted")).alias("rej"),
                              F.count(F.lit(1)).alias("n")).first()
    assert counts.acc + counts.rej == counts.n
    assert fold.fold_attempts(a.where(F.col("flow") == "turn"), policy="turn").count() == \
        a.where((F.col("flow") == "turn") & (F.col("attempt") == 0)).count()


def test_mapinpandas_backend_retries_then_dead_letters(spark):
    from turnforge.operators.complete import Backend

    class Flaky(Backend):
        calls = 0

        def complete(self, batch):
            Flaky.calls += 1
            raise RuntimeError("rate limit reached")

    reqs = spark.createDataFrame([("a-1", 0, "m", [("user", "x")])],
                                 "custom_id string, attempt int, model string, messages array<struct<role:string,content:string>>")
    r = complete.complete(reqs, Flaky, max_tries=3).first()
    assert r.content is None and r.tries == 3 and r.error.count("rate limit") == 3


REQUEST = "custom_id string, attempt int, model string, messages array<struct<role:string,content:string>>"


def test_one_poison_request_does_not_cost_the_others(spark):
    from turnforge.operators.complete import EchoBackend

    class Poison(EchoBackend):
        def complete(self, batch):
            if (batch["custom_id"] == "a-2").any():
                raise RuntimeError("poison")
            return super().complete(batch)

    reqs = spark.createDataFrame([(f"a-{i}", 0, "m", [("user", f"x{i}")]) for i in range(4)], REQUEST).coalesce(1)
    got = {r.custom_id: (r.content, r.tries, r.error) for r in complete.complete(reqs, Poison, 5).collect()}
    assert got["a-2"] == (None, 5, "; ".join(["poison"] * 5))
    assert all(got[f"a-{i}"] == (f"echo: x{i}", 1, None) for i in (0, 1, 3))


def test_a_short_answer_is_an_error_and_tried_again(spark):
    from turnforge.operators.complete import EchoBackend

    class Short(EchoBackend):
        def complete(self, batch):
            texts = super().complete(batch)
            return texts[:-1] if len(texts) > 1 else [None if batch["custom_id"].iloc[0] == "a-3" else texts[0]]

    reqs = spark.createDataFrame([(f"a-{i}", 0, "m", [("user", f"x{i}")]) for i in range(4)], REQUEST).coalesce(1)
    got = {r.custom_id: r for r in complete.complete(reqs, Short, 2).collect()}
    assert all(got[f"a-{i}"].content == f"echo: x{i}" for i in range(3))
    assert got["a-3"].content is None and got["a-3"].error == "no text; no text" and got["a-3"].tries == 2


def test_loop_keeps_an_id_without_a_completion(spark, scratch):
    from turnforge.plans.loop import run_loop
    base = spark.range(4).select(F.concat(F.lit("id-"), F.col("id").cast("string")).alias("custom_id"), F.lit("b").alias("base"), F.lit("p").alias("prompt"))
    gen = lambda p: p.where("custom_id != 'id-2'").select("custom_id", "attempt", F.lit("t").alias("content"))
    jud = lambda c: c.select("custom_id", "attempt", F.lit("Yes").alias("verdict"))
    res = run_loop(spark, base, gen, jud, "turn", 2, scratch)
    assert res.remaining == [1, 1, 1] and res.folded.count() == 4
    assert res.folded.where("winning_attempt is null").first().custom_id == "id-2"


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Yes.", "No.", "n/a", None, "Not sure", "No. Yes"]),
                         min_size=4, max_size=4), min_size=1, max_size=12),
       st.sampled_from(["turn", "starter"]))
def test_loop_equals_fold_on_random_verdicts(spark, verdict_rows, flow):
    from turnforge.plans.loop import run_loop
    from turnforge.session import scratch_path
    rounds = 3
    rows = [(f"id-{i}", a, f"text {i}/{a}", v) for i, vs in enumerate(verdict_rows) for a, v in enumerate(vs)]
    answers = spark.createDataFrame(rows, "custom_id string, attempt int, content string, verdict string")
    base = answers.where("attempt = 0").select("custom_id", F.lit("b").alias("base"), F.lit("p").alias("prompt"))
    gen = lambda p: p.join(answers.select("custom_id", "attempt", "content"), ["custom_id", "attempt"])
    jud = lambda c: c.join(answers.select("custom_id", "attempt", "verdict"), ["custom_id", "attempt"])
    res = run_loop(spark, base, gen, jud, flow, rounds, scratch_path(spark, "prop-loop"))
    from turnforge.operators.triage import FLOW_POLICY, accepted
    log = answers.withColumn("accepted", accepted(F.col("verdict"), FLOW_POLICY[flow]))
    want = fold.fold_attempts(log, policy=flow, max_attempt=rounds)
    assert _sorted(res.folded) == _sorted(want)
    # the loop stops as soon as nothing is rejected, and never runs past the limit
    assert len(res.remaining) <= rounds + 1 and all(n > 0 for n in res.remaining[:-1])


def test_loop_with_a_python_backend_calls_it_once_per_round(spark, scratch):
    """U1 inside the loop: generation output is stored before the judge and the join read it."""
    import os

    from turnforge.operators.complete import Backend, complete
    from turnforge.plans.loop import run_loop

    calls_dir = f"{scratch}-calls"
    os.makedirs(calls_dir, exist_ok=True)

    class Counting(Backend):
        def complete(self, batch):
            for cid, a in zip(batch["custom_id"], batch["attempt"]):
                open(f"{calls_dir}/{cid}-{a}", "a").write("x")
            return [f"draft {a}" for a in batch["attempt"]]

    base = spark.range(6).select(F.concat(F.lit("id-"), F.col("id").cast("string")).alias("custom_id"),
                                 F.lit("b").alias("base"), F.lit("p").alias("prompt"))

    def gen(p):
        reqs = p.select("custom_id", "attempt", F.lit("m").alias("model"),
                        F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
                        .alias("messages"))
        return complete(reqs, Counting)

    jud = lambda c: c.select("custom_id", "attempt",
                             F.when(F.col("attempt") >= 1, "Yes.").otherwise("No.").alias("verdict"))
    res = run_loop(spark, base, gen, jud, "turn", 3, scratch)
    assert res.remaining == [6, 0]
    assert res.folded.where(F.col("winning_attempt") == 1).count() == 6
    counts = [len(open(f"{calls_dir}/{f}").read()) for f in os.listdir(calls_dir)]
    assert len(counts) == 12 and set(counts) == {1}
