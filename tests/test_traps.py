"""Edge tests for the semantic traps T1-T17.

Expected values are written by hand from the stated semantics, not produced
by the code under test.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnforge.functions import text as X
from turnforge.functions.identity import decode_row_idx, model_short, turn_custom_id
from turnforge.operators import budget, fold, render, transcript, triage
from turnforge.plans.fixtures import parse_completion_lines
from turnforge.schemas import MESSAGES


def one_col(spark, values, name="s", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


def test_t1_compat_cleaning_strips_character_sets(spark):
    df = one_col(spark, ["user: hello there", "user: sure", '"quoted"', '"user: hi"', "plain", "ésta user: "])
    got = [r[0] for r in df.select(X.clean_compat(F.col("s"))).collect()]
    assert got == ["hello th", "", "quoted", "hi", "plain", "ésta"]


def test_t1_prefix_cleaning_removes_one_anchored_prefix(spark):
    df = one_col(spark, ["user: hello there", "user: sure", '"user: hi"', "plain user: x", '"a"'])
    got = [r[0] for r in df.select(X.clean_prefix(F.col("s"))).collect()]
    assert got == ["hello there", "sure", "hi", "plain user: x", "a"]


def test_t2_opposite_triage_defaults(spark):
    df = one_col(spark, ["Not sure", "Note", "n/a", "No. Yes, fine", "Yes.", "yes", None], "v")
    rows = df.select(triage.reject_if_no(F.col("v")).alias("a"), triage.accept_if_yes(F.col("v")).alias("b")).collect()
    assert [r.a for r in rows] == [False, False, True, False, True, True, False]
    assert [r.b for r in rows] == [False, False, False, True, True, False, False]


def test_t3_t15_real_remaining_counts(spark, scratch):
    from turnforge.plans.loop import run_loop
    base = spark.range(300).select(F.concat(F.lit("id-"), F.col("id").cast("string")).alias("custom_id"),
                                   F.lit("b").alias("base"), F.lit("p").alias("prompt"))
    gen = lambda p: p.select("custom_id", "attempt", F.lit("text").alias("content"))
    # rejected in round 0, all accepted in round 1 (the last allowed round)
    jud = lambda c: c.select("custom_id", "attempt",
                             F.when(F.col("attempt") == 0, "No").otherwise("Yes").alias("verdict"))
    res = run_loop(spark, base, gen, jud, "turn", 1, scratch)
    assert res.remaining == [300, 0]          # not 300 % 256, and converged in the last round
    assert res.folded.where(F.col("winning_attempt") == 1).count() == 300


def test_t4_null_verdict_is_rejected_and_kept(spark):
    df = spark.createDataFrame([("a", None), ("b", "Yes")], "id string, v string")
    out = df.withColumn("acc", triage.accept_if_yes(F.col("v")))
    assert out.count() == 2
    assert {r.id: r.acc for r in out.collect()} == {"a": False, "b": True}
    out2 = df.withColumn("acc", triage.reject_if_no(F.col("v")))
    assert {r.id: r.acc for r in out2.collect()} == {"a": False, "b": True}


def _log(spark, rows):
    return spark.createDataFrame(rows, "custom_id string, attempt int, content string, accepted boolean")


def test_t5_pairing_by_key_not_position(spark):
    rows = [("x", 0, "x0", False), ("x", 1, "x1", True), ("y", 0, "y0", True), ("y", 1, "y1", False)]
    a = fold.fold_attempts(_log(spark, rows), policy="turn").orderBy("custom_id").collect()
    b = fold.fold_attempts(_log(spark, list(reversed(rows))).repartition(3), policy="turn").orderBy(
        "custom_id").collect()
    assert a == b
    assert [(r.custom_id, r.winning_attempt, r.final_content) for r in a] == [("x", 1, "x1"), ("y", 0, "y0")]


def test_t6_exhausted_fallbacks_differ_by_flow(spark):
    rows = [("x", 0, "first", False), ("x", 1, "second", False)]
    s = fold.fold_attempts(_log(spark, rows), policy="starter").collect()[0]
    t = fold.fold_attempts(_log(spark, rows), policy="turn").collect()[0]
    assert (s.winning_attempt, s.final_content) == (None, "first")
    assert (t.winning_attempt, t.final_content) == (None, "END_OF_DIALOGUE")


def test_t7_new_table_end_marker_compat(spark):
    comp = spark.createDataFrame([("r-d-en-m-0", "END_OF_DIALOGUE"), ("r-d-en-m-1", "user: hi")],
                                 "custom_id string, content string")
    reqs = spark.createDataFrame(
        [("r-d-en-m-0", [("system", "s"), ("user", "scene0")]), ("r-d-en-m-1", [("system", "s"), ("user", "scene1")])],
        T.StructType([T.StructField("custom_id", T.StringType()), T.StructField("messages", MESSAGES)]))
    dflt = {r.row_idx: r for r in transcript.new_dialogues(comp, reqs, "user", "m", "en").collect()}
    compat = {r.row_idx: r for r in transcript.new_dialogues(comp, reqs, "user", "m", "en",
                                                             compat_ended=True).collect()}
    assert dflt[0].ended is True and dflt[0].dialogue == []
    assert compat[0].ended is False and compat[0].dialogue == [] and compat[0].ended_now is True
    assert dflt[1].dialogue[0].content == "hi" and dflt[1].scene == "scene1" and dflt[1].source == "r-d-en-m-1"


def _dialogue_df(spark, ended=False):
    schema = T.StructType([T.StructField("row_idx", T.LongType()), T.StructField("scene", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("dialogue", MESSAGES),
                           T.StructField("ended", T.BooleanType())])
    return spark.createDataFrame([(17, "calm", "english", [("user", "a\nb"), ("assistant", "c")], ended)], schema)


def test_t8_regeneration_base_drops_the_cue(spark):
    d = _dialogue_df(spark)
    first = d.select(render.user_turn_prompt(F.col("scene"), F.col("dialogue"), "NEXT?").alias("p")).first().p
    base = d.select(render.user_turn_prompt(F.col("scene"), F.col("dialogue"), None).alias("p")).first().p
    assert first.endswith("\n\nNEXT?") and first == base + "NEXT?" and not base.endswith("NEXT?")


def test_t9_newlines_deleted_in_generation_kept_in_verdict(spark):
    d = _dialogue_df(spark)
    gen = d.select(render.user_turn_prompt(F.col("scene"), F.col("dialogue"), "cue").alias("p")).first().p
    ver = d.select(render.turn_verdict_prompt(F.col("scene"), F.col("dialogue"), F.lit("user"),
                                              F.lit("r")).alias("p")).first().p
    ev = d.select(render.dialogue_eval_prompt(F.col("dialogue")).alias("p")).first().p
    assert "user: ab\n" in gen and "user: a\nb\n" in ver and "user: a\nb" in ev


def test_t10_evaluation_includes_ended_generation_skips(spark):
    d = _dialogue_df(spark, ended=True)
    assert render.user_turn_requests(d, "r1", "m", 1).count() == 0
    assert render.dialogue_eval_requests(d, F.lit("p"), "j").count() == 1


def test_t11_param_homogeneity(spark):
    from turnforge.sources.io import param_check
    reqs = spark.createDataFrame([(2, "m", 0.9), (1, "m", 1.5), (3, "m", 0.9)], "row_idx long, model string, t double")
    reqs = reqs.withColumn("params", render.params_struct(temperature=None)).withColumn(
        "params", F.struct(F.col("t").alias("temperature")))
    r = param_check(reqs).first()
    assert r.n_param_sets == 2 and r.first_params.temperature == 1.5


def test_t12_completion_allowance(spark):
    df = spark.createDataFrame([([("user", "abcdefgh")], 100)],
                               T.StructType([T.StructField("m", MESSAGES), T.StructField("mt", T.IntegerType())]))
    r = df.select(budget.estimate_tokens(F.col("m")).alias("c"),
                  budget.estimate_tokens(F.col("m"), F.col("mt")).alias("d")).first()
    # 4 + ceil(4/4) + ceil(8/4) + 2 = 9, plus the allowance
    assert (r.c, r.d) == (9 + 15, 9 + 100)


def test_t13_oversize_requests_never_admitted(spark):
    df = spark.createDataFrame([(1, 10), (2, 999), (3, 10), (4, 10)], "id long, tok long")
    out = {r.id: r for r in budget.rate_plan(df, "id", "tok", 2, 100).collect()}
    assert out[2].oversize and out[2].start_s is None
    # request 4 is the 3rd admitted: 60 * (3 - 2) / 2 = 30 s
    assert out[4].start_s == 30.0 and out[1].start_s == 0.0


def test_t14_error_list_and_malformed_lines(spark):
    lines = spark.createDataFrame([
        ('{"custom_id":"en_r1_m_turn-1-17","response":{"body":{"choices":[{"message":{"role":"assistant","content":"hi"}}]}}}',),
        ('{"custom_id":"en_r1_m_turn-1-18","response":{"body":["timeout","rate limit"]}}',),
        ('{"custom_id":"en_r1_m_turn-1-19","resp',),
        ('{"custom_id":"en_r1_m_turn-1-20","response":{"body":{"choices":[]}}}',),
    ], "value string")
    got = {r.custom_id: (r.content, r.error, r.is_error)
           for r in parse_completion_lines(lines).collect() if r.custom_id}
    assert got["en_r1_m_turn-1-17"] == ("hi", None, False)
    assert got["en_r1_m_turn-1-18"] == (None, "timeout; rate limit", True)
    assert got["en_r1_m_turn-1-20"] == (None, "empty", True)
    triples = spark.createDataFrame([
        ('[7, {"custom_id":"x-7","method":"POST"}, {"choices":[{"message":{"role":"assistant","content":"[ok]"}}]}]',),
        ('[8, {"custom_id":"x-8"}, ["e1", "e2"], {"row": 1}]',)], "value string")
    assert [(r.custom_id, r.content, r.error) for r in parse_completion_lines(triples).orderBy("custom_id").collect()] == [
        ("x-7", "[ok]", None), ("x-8", None, "e1; e2")]
    malformed = [r for r in parse_completion_lines(lines).collect() if r.error == "malformed"]
    assert len(malformed) == 1 and malformed[0].content is None


def test_t16_fresh_paths_per_run(spark):
    from turnforge.session import scratch_path
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_t17_scene_fields_render_as_lines(spark):
    df = spark.createDataFrame([("a park", "curious", None)], "scene string, persona string, gender string")
    got = df.select(X.scene_text({"Scene": "scene", "Persona": "persona", "Gender": "gender"}).alias("s")).first().s
    assert got == "Scene: a park\nPersona: curious"


def test_identity_decode_only_last_field(spark):
    df = spark.createDataFrame([("org/chat-x-4",)], "model string")
    r = df.select(turn_custom_id(F.lit("en"), "r1", model_short(F.col("model")), 3, F.lit(42)).alias("c")).first()
    assert r.c == "en_r1_chat-x-4_turn-3-42"
    bad = one_col(spark, ["a-b-12", "a-b-x", "noidx", None], "c")
    assert [r[0] for r in bad.select(decode_row_idx(F.col("c"))).collect()] == [12, None, None, None]


def test_new_dialogues_keeps_languages_and_requests_apart(spark):
    """The same row index in two languages; one request has no completion, one has two equal ones."""
    reqs = spark.createDataFrame(
        [(f"r-d-{la}-m-{i}", [("user", f"{la}{i}")]) for la in ("en", "fr") for i in range(2)],
        T.StructType([T.StructField("custom_id", T.StringType()), T.StructField("messages", MESSAGES)]))
    comp = spark.createDataFrame([("r-d-en-m-0", "a"), ("r-d-fr-m-0", "b"), ("r-d-fr-m-0", "b"), ("r-d-en-m-1", "c")],
                                 "custom_id string, content string")
    out = {r.source: r for r in transcript.new_dialogues(comp, reqs, "user", "m", None).collect()}
    assert len(out) == 4
    assert out["r-d-fr-m-0"].dialogue[0].content == "b" and out["r-d-en-m-0"].scene == "en0"
    assert out["r-d-fr-m-1"].missing and out["r-d-fr-m-1"].dialogue == []
    import pytest
    with pytest.raises(ValueError, match="1 requests without"):
        transcript.require_same_ids(comp, reqs)


def test_error_class_is_where_it_failed(spark):
    df = spark.createDataFrame([("The server had an error", True), ("Cannot connect to host api.x.com", False),
                                ("Rate Limit reached", True), ("rate limit", False), (None, True)], "m string, b boolean")
    assert [r[0] for r in df.select(triage.error_kind(F.col("m"), F.col("b"))).collect()] == [
        "api", "other", "rate_limit", "other", None]


def test_tokens_of_all_scripts(spark):
    df = one_col(spark, ["cœur 你好 Über-maß don't 3x"])
    assert df.select(X.tokens("s")).first()[0] == ["cœur", "你", "好", "über", "maß", "don", "t", "x"]


def test_two_equal_chinese_messages_are_a_repetition(spark):
    from turnforge.operators import rules
    msgs = spark.createDataFrame([(1, 0, "user", "你好世界"), (1, 1, "user", "你好世界")], "conv_id long, pos long, role string, content string")
    assert {r.pos: (r.metric, r.flag) for r in rules.repetition(msgs).collect()} == {0: (0.0, False), 1: (1.0, True)}


def test_append_turn_twice_the_same_completion(spark):
    schema = T.StructType([T.StructField("row_idx", T.LongType()), T.StructField("dialogue", MESSAGES),
                           T.StructField("models", T.ArrayType(T.StringType())), T.StructField("ended", T.BooleanType())])
    d = spark.createDataFrame([(1, [("user", "a")], ["u"], False)], schema)
    new = spark.createDataFrame([(1, "r"), (1, "r")], "row_idx long, content string")
    rows = transcript.append_turn(d, new, ["row_idx"], "assistant", "bot").collect()
    assert len(rows) == 1 and len(rows[0].dialogue) == 2


def test_checkpoint_root_needs_a_shared_folder_on_a_cluster():
    import pytest

    from turnforge.session import checkpoint_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_append_turn_left_join_keeps_unmatched(spark):
    schema = T.StructType([T.StructField("row_idx", T.LongType()), T.StructField("dialogue", MESSAGES),
                           T.StructField("models", T.ArrayType(T.StringType())),
                           T.StructField("ended", T.BooleanType())])
    d = spark.createDataFrame([(1, [("user", "a")], ["u"], False), (2, [("user", "b")], ["u"], False),
                               (3, [("user", "c")], ["u"], False)], schema)
    new = spark.createDataFrame([(1, '"reply"'), (2, "bye END_OF_DIALOGUE")], "row_idx long, content string")
    out = {r.row_idx: r for r in transcript.append_turn(d, new, ["row_idx"], "assistant", "bot").collect()}
    assert [m.content for m in out[1].dialogue] == ["a", "reply"] and out[1].models == ["u", "bot"]
    assert out[2].ended and len(out[2].dialogue) == 1
    assert not out[3].ended and len(out[3].dialogue) == 1
