"""Registered queries: one per SURVEY §7.3 key.

Each takes ``(spark, sf_dir)`` and returns a DataFrame of flat scalar
columns (counts BIGINT, doubles rounded to 6) whose names match the SQL
oracle in ``turnforge.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnforge import constants as K
from turnforge.functions.identity import decode_row_idx, model_short, turn_custom_id
from turnforge.functions.text import clean_compat, clean_prefix, has_end_marker, history_text
from turnforge.operators import attempt_log, budget, complete, fold, journal, judge, render, rules, segments, transcript, triage
from turnforge.sources import io
from turnforge.operators.ordering import ordinal
from turnforge.plans.fixtures import ASSISTANT_MODEL, GEN_MODEL, RUN_ID, STARTER_DATASET, Fixtures
from turnforge.session import scratch_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REPETITION_THRESHOLD = 0.1      # fixture threshold (library default is 0.5)
GRID_USERS = ["user-a", "user-b"]
GRID_TARGETS = [f"bot-{i}" for i in range(1, 9)]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def _params(*names: str) -> list:
    return [F.col(f"params.{n}").cast("bigint" if n == "max_tokens" else "string" if n == "response_format" else "double").alias(n) for n in names]


SAMPLING = ("temperature", "top_p", "frequency_penalty", "presence_penalty", "max_tokens")


def _last_content(requests: DataFrame) -> F.Column:
    return F.element_at(F.col("messages"), -1)["content"]


# --- identity and dialogue table ---------------------------------------------

@query
def q_dialogue_table(spark, sf):
    """S7 + S3: the table is written by language and read back with its declared schema."""
    path = scratch_path(spark, "dialogues")
    table = Fixtures(spark, sf).dialogues
    io.write_dialogues(table, path, ("lang",))
    d = io.read_dialogues(spark, path).withColumn("conv_id", F.col("row_idx"))
    role_count = lambda r: F.size(F.filter("dialogue", lambda m: m["role"] == r)).cast("bigint")
    return d.select("conv_id", F.size("dialogue").cast("bigint").alias("n_msgs"),
                    role_count("user").alias("n_user"), role_count("assistant").alias("n_assistant"),
                    history_text(F.col("dialogue"), "delete").alias("transcript"))


@query
def q_custom_ids(spark, sf):
    d = Fixtures(spark, sf).dialogues
    model = F.lit("org/chat-x-4")
    cid = turn_custom_id(F.col("lang"), RUN_ID, model_short(model), 0, F.col("row_idx"))
    return d.select("conv_id", cid.alias("custom_id")).select(
        "conv_id", "custom_id", model_short(model).alias("model_short"),
        decode_row_idx(F.col("custom_id")).alias("decoded_idx"))


# --- requests ----------------------------------------------------------------

def _doc_scenes(spark, sf) -> DataFrame:
    """Scenes from ``documents``: the whole text is the scene (no prefix)."""
    docs = Fixtures(spark, sf).table("documents").select("doc_id", "lang", F.col("text").alias("scene"))
    return ordinal(docs, ["lang"], "doc_id", "row_idx")


@query
def q_starter_requests(spark, sf):
    req = render.starter_requests(_doc_scenes(spark, sf), RUN_ID, "docs", GEN_MODEL)
    return req.select("custom_id", "row_idx", "lang", _last_content(req).alias("user_content"),
                      F.col("params.temperature").alias("temperature"),
                      F.col("params.max_tokens").cast("bigint").alias("max_tokens"))


@query
def q_seed_scenes(spark, sf):
    """Scenes written as JSON lines and as a JSON5-style array (one language), read back."""
    path = scratch_path(spark, "scenes")
    scenes = _doc_scenes(spark, sf).select(F.col("row_idx").alias("scene_id"), "scene", "lang")
    scenes.select("scene_id", "scene").write.json(f"{path}/lines")
    return io.read_scenes(spark, f"{path}/lines", "json").select("scene_id", "scene")


def _evaluated(spark, sf, flow: str) -> DataFrame:
    """Every attempt that a round judges: attempt n only if all before it were rejected."""
    return fold.evaluated_attempts(Fixtures(spark, sf).attempts.where(F.col("flow") == flow))


@query
def q_starter_verdict_requests(spark, sf):
    req = render.starter_verdict_requests(_evaluated(spark, sf, "starter"), K.TURN_VERDICT_MODEL)
    return req.select("custom_id", F.col("attempt").cast("bigint").alias("attempt"), _last_content(req).alias("user_content"),
                      F.col("params.temperature").alias("temperature"),
                      F.col("params.max_tokens").cast("bigint").alias("max_tokens"))


def _turn_snapshots(fx: Fixtures) -> DataFrame:
    """User turns ``pos > 0``; dialogues with ``conv_id % 6 = 5`` are ended first (F1)."""
    return fx.snapshots("user", 1).withColumn("ended", F.col("conv_id") % 6 == 5)


@query
def q_user_turn_requests(spark, sf):
    """P6 over segmented dialogues: the history is rendered a segment at a time; only a prompt's texts are gathered."""
    fx = Fixtures(spark, sf)
    asks = _asks(fx, "user", 1).where(F.col("conv_id") % 6 != 5)      # F1
    history = segments.texts_before(_segments(fx), asks).select(F.col("conv_id").alias("_c"), F.col("upto").alias("turn"), "history")
    heads = fx.dialogues.select("conv_id", "row_idx", "lang", "scene", "ended")
    rows = heads.join(history, heads["conv_id"] == history["_c"])
    req = render.user_turn_requests(rows, RUN_ID, GEN_MODEL, "turn")
    return req.select("custom_id", _last_content(req).alias("prompt"), *_params(*SAMPLING))


SEGMENT = 4     # fixture size; the library's default is larger


def _segments(fx: Fixtures) -> DataFrame:
    return segments.to_segments(fx.msgs, SEGMENT, chained=False)


def _asks(fx: Fixtures, role: str, min_pos: int) -> DataFrame:
    return fx.msgs.where((F.col("role") == role) & (F.col("pos") >= min_pos)).select("conv_id", F.col("pos").alias("upto"))


def _assistant_requests(fx: Fixtures) -> DataFrame:
    before = segments.dialogues_before(_segments(fx), _asks(fx, "assistant", 0)).select(F.col("conv_id").alias("_c"), F.col("upto").alias("turn"), "dialogue")
    heads = fx.dialogues.select("conv_id", "row_idx", "lang", "ended")
    rows = heads.join(before, heads["conv_id"] == before["_c"])
    return render.assistant_turn_requests(rows, RUN_ID, ASSISTANT_MODEL, "turn")


@query
def q_assistant_turn_requests(spark, sf):
    req = _assistant_requests(Fixtures(spark, sf))
    return req.select("custom_id", "params", F.posexplode("messages").alias("msg_pos", "m")).select(
        "custom_id", F.col("msg_pos").cast("bigint").alias("msg_pos"),
        F.col("m.role").alias("role"), F.col("m.content").alias("content"), *_params(*SAMPLING))


@query
def q_typed_parts(spark, sf):
    req = _assistant_requests(Fixtures(spark, sf))
    model = F.when(F.col("row_idx") % 2 == 0, F.lit("org/gemma-3-x")).otherwise(F.lit("org/chat-y"))
    req = req.withColumn("model", model).where(render.wrapped(F.col("model")))
    typed = req.select("custom_id", F.posexplode(render.typed_parts(F.col("messages"), F.col("model")))
                       .alias("msg_pos", "m"))
    return typed.select("custom_id", F.col("msg_pos").cast("bigint").alias("msg_pos"),
                        F.explode("m.parts").alias("p")).select(
        "custom_id", "msg_pos", F.col("p.type").alias("part_type"), F.col("p.text").alias("part_text"))


def _decoded_turn(custom_id: F.Column) -> F.Column:
    return F.substring_index(F.substring_index(custom_id, "-", -2), "-", 1).try_cast("bigint")


@query
def q_turn_verdict_requests(spark, sf):
    fx = Fixtures(spark, sf)
    c = _evaluated(spark, sf, "turn").select(
        "custom_id", "content", "attempt", "lang",
        decode_row_idx(F.col("custom_id")).alias("row_idx"), _decoded_turn(F.col("custom_id")).alias("turn"))
    req = render.turn_verdict_requests(c, fx.snapshots("user", 1), on=("lang", "row_idx", "turn"))
    return req.select("custom_id", F.col("attempt").cast("bigint").alias("attempt"), _last_content(req).alias("prompt"),
                      *_params(*SAMPLING))


@query
def q_dialogue_eval_requests(spark, sf):
    d = Fixtures(spark, sf).dialogues
    path = F.concat(F.lit("dialogues/"), F.col("lang"), F.lit("/user-a_bot-1"))
    req = render.dialogue_eval_requests(d, path, "judge-model")
    return req.select("custom_id", _last_content(req).alias("prompt"),
                      *_params("temperature", "top_p", "max_tokens", "response_format"))


def _history(attempts: DataFrame) -> DataFrame:
    """One row per request with its sorted tries (at most M + 1 entries)."""
    t = F.struct(F.col("attempt"), "content", "verdict", "accepted")
    return attempts.groupBy("custom_id").agg(F.sort_array(F.collect_list(t)).alias("tries"),
                                             F.first("conv_id").alias("row_idx"), F.first("pos").alias("turn"),
                                             F.first("lang").alias("lang"))


@query
def q_regen_requests(spark, sf):
    fx = Fixtures(spark, sf)
    h = _history(fx.attempts.where(F.col("flow") == "turn"))
    ctx = _turn_snapshots(fx)
    ctx = triage.open_only(ctx).select(
        "lang", "row_idx", "turn", render.user_turn_prompt(F.col("scene"), F.col("dialogue"), None).alias("base"))
    j = h.join(ctx, ["lang", "row_idx", "turn"])
    out = render.regeneration_prompts(j, K.MAX_TURN_ROUNDS)
    return out.select("custom_id", F.col("attempt").cast("bigint").alias("attempt"), "prompt")


@query
def q_starter_regen(spark, sf):
    fx = Fixtures(spark, sf)
    h = _history(fx.attempts.where(F.col("flow") == "starter"))
    win = F.array_min(F.transform(F.filter("tries", lambda t: t["accepted"]), lambda t: t["attempt"]))
    upper = F.least(F.coalesce(win, F.lit(K.MAX_STARTER_ROUNDS)), F.lit(K.MAX_STARTER_ROUNDS))
    todo = h.select("custom_id", "lang", "row_idx", F.explode(render.attempt_range(upper)).alias("attempt"))
    scenes = fx.dialogues.select("row_idx", F.col("seed_scene").alias("scene"), "lang")
    j = todo.join(scenes, ["lang", "row_idx"])      # J1
    req = render.starter_requests(j.withColumnRenamed("attempt", "_a"), RUN_ID, STARTER_DATASET, GEN_MODEL,
                                  attempt=F.col("_a"))
    return req.select("custom_id", F.col("attempt").cast("bigint").alias("attempt"),
                      _last_content(req).alias("user_content"))


REQUEST_LINE = ("custom_id string, method string, url string, body struct<model string, "
                "messages array<struct<role string, content string>>, temperature double, top_p double, "
                "frequency_penalty double, presence_penalty double, max_tokens int>")


@query
def q_request_jsonl(spark, sf):
    """Requests exported in order as JSON lines, read back with the declared line schema."""
    req = render.starter_requests(_doc_scenes(spark, sf), RUN_ID, "docs", GEN_MODEL)
    path = scratch_path(spark, "requests")
    io.write_requests_jsonl(req, path, sort_for_export=True)
    back = spark.read.schema(REQUEST_LINE).json(path)
    return back.select("custom_id", "method", "url", F.col("body.model").alias("model"),
                       F.size("body.messages").cast("bigint").alias("n_messages"),
                       F.element_at("body.messages", -1)["content"].alias("user_content"),
                       F.col("body.temperature").alias("temperature"), F.col("body.top_p").alias("top_p"),
                       F.col("body.max_tokens").cast("bigint").alias("max_tokens"))


# --- completions ---------------------------------------------------------------

def _completion_files(spark, sf) -> str:
    """The raw lines of all attempts as text files, one folder per attempt."""
    path = scratch_path(spark, "completion-lines")
    Fixtures(spark, sf).completion_lines.select("value", "attempt").write.partitionBy("attempt").text(path)
    return path


def _as_attempts(df: DataFrame) -> DataFrame:
    return df.withColumn("attempt", F.col("attempt").cast("bigint"))


@query
def q_completion_extract(spark, sf):
    """S2 + P12: files of raw lines, all attempts, to texts and errors."""
    got = io.read_completions(spark, _completion_files(spark, sf))
    return _as_attempts(got).select("custom_id", "attempt", "content", "error", "is_error")


@query
def q_completion_files(spark, sf):
    """Completions written in the normalised shape and read back."""
    path = scratch_path(spark, "completions")
    got = io.read_completions(spark, _completion_files(spark, sf)).where(F.col("custom_id").isNotNull())
    io.write_completions_jsonl(got.select("custom_id", "attempt", "content", "error"), path)
    return _as_attempts(io.read_completions(spark, path)).select("custom_id", "attempt", "content", "error")


@query
def q_replay_complete(spark, sf):
    """Saved attempts 0 to 3, each saved twice; later ones are missing."""
    fx = Fixtures(spark, sf)
    saved = io.read_completions(spark, _completion_files(spark, sf)).where((F.col("attempt") <= 3) & F.col("custom_id").isNotNull())
    saved = _as_attempts(saved).select("custom_id", "attempt", "content", "error")
    out = complete.replay(fx.attempts.select("custom_id", "attempt"), saved.unionByName(saved))
    return out.select("custom_id", "attempt", "content", "error")


class RefusingEcho(complete.EchoBackend):
    """Fails the whole call if one of its ids ends in 7 at attempt 0."""

    def complete(self, batch):
        if any(c.endswith("7") and a == 0 for c, a in zip(batch["custom_id"], batch["attempt"], strict=True)):
            raise RuntimeError("refused")
        return super().complete(batch)


@query
def q_echo_complete(spark, sf):
    a = Fixtures(spark, sf).attempts
    reqs = a.select("custom_id", "attempt", F.lit(GEN_MODEL).alias("model"),
                    F.array(render.msg("system", F.lit("s")), render.msg("user", F.col("content"))).alias("messages"))
    out = complete.complete_to_table(reqs, RefusingEcho, scratch_path(spark, "echo-complete"))
    return _as_attempts(out).select("custom_id", "attempt", "content", "error", F.col("tries").cast("bigint").alias("tries"))


@query
def q_journal_complete(spark, sf):
    """A first run asks for some requests, a second one for all; those in the journal are not asked for again."""
    a = Fixtures(spark, sf).attempts
    reqs = a.select("custom_id", "attempt", F.lit(GEN_MODEL).alias("model"),
                    F.array(render.msg("system", F.lit("s")), render.msg("user", F.col("content"))).alias("messages"))
    path = scratch_path(spark, "journal")
    batch = 512
    journal.complete_journaled(reqs.where(F.col("attempt") <= 1), RefusingEcho, path, batch)
    out = journal.complete_journaled(reqs, RefusingEcho, path, batch)
    return _as_attempts(out).select("custom_id", "attempt", "content", "error", F.col("tries").cast("bigint").alias("tries"))


@query
def q_clean_response(spark, sf):
    a = Fixtures(spark, sf).attempts
    return a.select("conv_id", "pos", "attempt", clean_compat(F.col("content")).alias("compat_text"),
                    clean_prefix(F.col("content")).alias("prefix_text"))


# --- triage and fold -------------------------------------------------------------

def _triage(spark, sf, flow):
    a = Fixtures(spark, sf).attempts.where(F.col("flow") == flow)
    return triage.triage_counts(fold.evaluated_attempts(a), ["lang"])


@query
def q_starter_triage(spark, sf):
    return _triage(spark, sf, "starter")


@query
def q_turn_triage(spark, sf):
    return _triage(spark, sf, "turn")


def _fold(fx: Fixtures, flow: str) -> DataFrame:
    a = fx.attempts.where(F.col("flow") == flow)
    return fold.fold_attempts(a, ["custom_id"], flow, extra=["conv_id", "pos"])


@query
def q_starter_fold(spark, sf):
    f = _fold(Fixtures(spark, sf), "starter")
    return f.select("custom_id", F.col("winning_attempt").cast("bigint").alias("winning_attempt"), "final_content")


@query
def q_turn_fold(spark, sf):
    f = _fold(Fixtures(spark, sf), "turn")
    return f.select("custom_id", F.col("winning_attempt").cast("bigint").alias("winning_attempt"), "final_content")


@query
def q_turn_fold_merged(spark, sf):
    """The log is bucketed by id and grows a round at a time; each round is folded alone and merged into the winners."""
    a = Fixtures(spark, sf).attempts.where(F.col("flow") == "turn").select("custom_id", "content", "accepted", F.col("attempt").cast("int").alias("attempt"))
    a = stored(a, "turn-attempts")
    log = attempt_log.AttemptLog(spark, scratch_path(spark, "log"), buckets=8)
    for r in range(K.MAX_TURN_ROUNDS + 1):
        log.append(a.where(F.col("attempt") == r), r)
        log.merge(r)
    f = log.folded("turn")
    return f.select("custom_id", F.col("winning_attempt").cast("bigint").alias("winning_attempt"), "final_content")


@query
def q_round_convergence(spark, sf):
    """S8 + A1: the rounds appended to the attempt log, read back and counted."""
    path = scratch_path(spark, "attempt-log")
    a = Fixtures(spark, sf).attempts
    io.append_attempts(a.select("flow", "custom_id", "accepted", F.lit(RUN_ID).alias("run_id"), "attempt"), path)
    log = spark.read.schema("flow string, custom_id string, accepted boolean, run_id string, attempt bigint").parquet(path)
    r = fold.round_convergence(log, ["run_id", "custom_id"], by=["flow"])
    return r.select("flow", F.col("attempt").cast("bigint").alias("attempt"), "n_evaluated", "n_rejected")


# --- transcript ------------------------------------------------------------------

@query
def q_append_turn(spark, sf):
    """J5 on segments: each dialogue up to its last user turn, the new text appended as a segment of its own."""
    fx = Fixtures(spark, sf)
    path = scratch_path(spark, "segments")
    last_user = fx.msgs.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("pos"))).alias("_p"))
    m = fx.msgs.join(last_user, "conv_id")
    m = m.where(F.coalesce((F.col("_p") == 0) | (F.col("pos") < F.col("_p")), F.lit(True)))
    segments.to_segments(m.select("conv_id", "pos", "role", "content"), SEGMENT).write.parquet(path)
    table = segments.read(spark, path)
    turns = _fold(fx, "turn").join(last_user, "conv_id").where(F.col("pos") == F.col("_p")).select("conv_id", F.col("final_content").alias("content"))
    new = stored(segments.append(segments.heads(table), turns, "user", GEN_MODEL, "prefix"), "appended")
    segments.attach(spark, path, new)
    table = segments.read(spark, path)
    every = fx.dialogues.select("conv_id")
    ended = new.select("conv_id", F.col("ended"))
    counts = segments.heads(table).select("conv_id", "next_pos")
    out = every.join(counts, "conv_id", "left").join(ended, "conv_id", "left").join(segments.last_messages(table), "conv_id", "left")
    return out.select("conv_id", F.coalesce("next_pos", F.lit(0)).cast("bigint").alias("n_msgs"), F.coalesce("ended", F.lit(False)).alias("ended"),
                      "last_role", "last_content")


@query
def q_new_dialogues(spark, sf):
    """J6 over the starters of all languages, whose row indexes overlap; some have no completion, some two."""
    docs = _doc_scenes(spark, sf).select("doc_id", "row_idx", "lang", "scene")
    reqs = stored(render.starter_requests(docs, RUN_ID, "docs", GEN_MODEL).select("custom_id", "messages", "lang"), "starters")
    ids = reqs.select("custom_id", decode_row_idx(F.col("custom_id")).alias("i"))
    text = F.when(F.col("i") % 10 == 3, F.lit(K.END_MARKER)).otherwise(F.concat(F.lit('"user: Hello '), "custom_id", F.lit('"')))
    comp = ids.where(F.col("i") % 11 != 5).select("custom_id", text.alias("content"))
    comp = comp.unionByName(comp.where(decode_row_idx(F.col("custom_id")) % 4 == 0))
    new = lambda compat: transcript.new_dialogues(comp, reqs, "user", GEN_MODEL, F.col("lang"), "prefix", compat)
    compat = new(True).select(F.col("source").alias("_s"), F.col("ended").alias("ended_compat"))
    d = new(False)
    d = d.join(compat, d["source"] == compat["_s"])
    return d.select("row_idx", "source", "lang", "scene", F.size("dialogue").cast("bigint").alias("n_msgs"),
                    F.try_element_at("dialogue", F.lit(1))["content"].alias("first_content"),
                    F.col("ended").alias("ended_default"), "ended_compat", "missing")


@query
def q_end_rates(spark, sf):
    fx = Fixtures(spark, sf)
    f = _fold(fx, "turn").select("conv_id", "pos", has_end_marker(F.col("final_content")).alias("ends"))
    first = f.where("ends").groupBy("conv_id").agg(F.min("pos").alias("turn"))
    new = first.groupBy("turn").agg(F.count(F.lit(1)).alias("_new"))
    turns = fx.msgs.where((F.col("role") == "user") & (F.col("pos") > 0)).select(F.col("pos").alias("turn")).distinct()
    n = fx.dialogues.agg(F.count(F.lit(1))).scalar()        # scalar subquery, no join
    j = turns.join(new, "turn", "left").withColumns({"_new": F.coalesce("_new", F.lit(0)), "_n": n})
    # One row per turn position (an aggregate's output, as long as the longest dialogue): a plain
    # ordered window is enough here.
    w = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    r = j.withColumn("_cum", F.sum("_new").over(w))
    return r.select(F.col("turn").cast("bigint").alias("turn"),
                    F.round(F.lit(100.0) * F.col("_cum") / F.col("_n"), 6).alias("pct_ended"),
                    F.round(F.lit(100.0) * F.col("_new") / F.col("_n"), 6).alias("pct_new"))


@query
def q_orphan_check(spark, sf):
    """J7 over all attempts' ids."""
    fx = Fixtures(spark, sf)
    key = F.concat("custom_id", F.lit("/"), F.col("attempt").cast("string")).alias("custom_id")
    v = fx.attempts.where(F.col("conv_id") % 12 != 0).select(key)
    c = fx.completion_lines.where(F.col("conv_id") % 12 != 1).select(key)
    counts = io.orphans(v, c)
    side = lambda n: F.struct(F.lit(n).alias("side"), F.col(n).cast("bigint").alias("n"))
    return counts.select(F.explode(F.array(side("verdict_without_completion"), side("completion_without_verdict"))).alias("r")).select("r.*")


@query
def q_job_manifest(spark, sf):
    """The manifest written as JSON lines and read back, with the progress of each job's lines."""
    fx = Fixtures(spark, sf)
    path = F.concat(F.lit("requests/lang="), F.col("lang"))
    where = scratch_path(spark, "manifest")
    fx.dialogues.select(F.concat(F.lit("job-"), (F.col("conv_id") % 6).cast("string")).alias("id"),
                        path.alias("input_file_local")).distinct().write.json(where)
    comp = fx.parsed_lines.select(path.alias("input_path"), "is_error")
    got = io.manifest_progress(io.read_manifest(spark, where), comp)
    count = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    return got.select(F.col("id").alias("job_id"), F.col("input_file_local").alias("input_path"), count("n_requests"), count("n_completed"))


@query
def q_param_check(spark, sf):
    d = Fixtures(spark, sf).dialogues.select(
        "row_idx", F.concat(F.lit("m"), (F.col("conv_id") % 2).cast("string")).alias("model"),
        F.struct(F.when(F.col("conv_id") % 8 == 1, F.lit(1.5)).otherwise(F.lit(0.9)).alias("temperature")).alias("params"))
    return io.param_check(d).select("model", F.col("n_param_sets").cast("bigint").alias("n_param_sets"),
                                    F.col("first_params.temperature").alias("first_temperature"))


def _cell(conv_id: F.Column, names: list[str], every: int) -> F.Column:
    at = F.floor(conv_id / every) % len(names) + 1
    return F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int"))


GRID_CELLS = ("lang", "user_model", "target_model")


def _stored_grid(spark, sf) -> DataFrame:
    """Dialogues stored by (language, user model, target model)."""
    d = Fixtures(spark, sf).dialogues.withColumns({"user_model": _cell(F.col("conv_id"), GRID_USERS, 6),
                                                   "target_model": _cell(F.col("conv_id"), GRID_TARGETS, 12)})
    path = scratch_path(spark, "grid")
    io.write_dialogues(d.select("row_idx", *GRID_CELLS), path, GRID_CELLS)
    return spark.read.schema("row_idx bigint, lang string, user_model string, target_model string").parquet(path)


@query
def q_eval_grid(spark, sf):
    """J9 + S9: each cell of the grid counts its stored dialogues."""
    counts = _stored_grid(spark, sf).groupBy(*GRID_CELLS).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    g = judge.grid(spark, lang=K.LANGUAGES, user_model=GRID_USERS, target_model=GRID_TARGETS)
    return g.join(counts, list(GRID_CELLS), "left").select(*GRID_CELLS, F.coalesce("n", F.lit(0).cast("bigint")).alias("n_dialogues"))


@query
def q_thin_cells(spark, sf):
    """The dialogues of cells with fewer than the mean of all cells, read from those partitions only."""
    table = _stored_grid(spark, sf)
    counts = stored(table.groupBy(*GRID_CELLS).agg(F.count(F.lit(1)).alias("n")), "cells")
    mean = counts.agg((F.sum("n") / F.count(F.lit(1)))).first()[0] or 0.0
    return io.in_cells(table, counts.where(F.col("n") < mean), GRID_CELLS).select("row_idx", *GRID_CELLS)


# --- budget ---------------------------------------------------------------------------

@query
def q_token_estimates(spark, sf):
    docs = Fixtures(spark, sf).table("documents")
    msgs = F.array(render.msg("user", F.col("text")))
    return docs.select("doc_id", budget.estimate_tokens(msgs, K.COMPAT_COMPLETION_ALLOWANCE).alias("est_tokens"))


PLAN_RPM, PLAN_TPM = 200, 5000


@query
def q_rate_plan(spark, sf):
    docs = Fixtures(spark, sf).table("documents").select(
        "doc_id", budget.chars_estimator(F.col("text")).alias("est_tokens"))
    plan = budget.rate_plan(docs, "doc_id", "est_tokens", PLAN_RPM, PLAN_TPM)
    return plan.select("doc_id", "task_id", "start_s", "oversize")


def _ledger(spark, sf) -> DataFrame:
    ev = Fixtures(spark, sf).table("events")
    et = F.col("event_type")
    task = (F.col("user_id") * 10 + F.col("event_id") % 10).alias("task")
    # Failed tries: two kinds of error bodies and an exception, whose text names the API and a rate limit.
    message = (F.when(et == "error", F.lit("Rate limit reached, retry later"))
               .when(et == "view", F.lit("The server had an error"))
               .when(et == "signup", F.lit("Cannot connect to host api.x.com: rate limit?")))
    return budget.retry_ledger(ev.select(task, "ts", "event_id", "event_type"), "task", ["ts", "event_id"],
                               et.isin("click", "purchase"), triage.error_kind(message, et != "signup"), message)


@query
def q_attempt_ledger(spark, sf):
    return _ledger(spark, sf)


@query
def q_run_counters(spark, sf):
    return budget.run_counters(_ledger(spark, sf))


AUDIT_LIMIT = 2


@query
def q_rate_audit(spark, sf):
    return budget.minute_load(Fixtures(spark, sf).table("events"), "ts", AUDIT_LIMIT)


# --- rules ----------------------------------------------------------------------------

@query
def q_rule_concise(spark, sf):
    return rules.concise(Fixtures(spark, sf).rules_msgs)


@query
def q_rule_placeholder(spark, sf):
    return rules.placeholder(Fixtures(spark, sf).rules_msgs)


def _shared_rules_msgs(fx: Fixtures) -> DataFrame:
    """``fx_rules`` read by several branches of one plan: materialised once."""
    return stored(fx.rules_msgs, "rules-messages")


@query
def q_rule_repetition(spark, sf):
    return rules.repetition(_shared_rules_msgs(Fixtures(spark, sf)), REPETITION_THRESHOLD)


def _language_flags(fx: Fixtures) -> DataFrame:
    return rules.language(fx.rules_msgs, rules.language_profile(fx.table("documents")))


@query
def q_rule_language(spark, sf):
    return _language_flags(Fixtures(spark, sf))


@query
def q_rule_role(spark, sf):
    return rules.role_confusion(_shared_rules_msgs(Fixtures(spark, sf)))


@query
def q_clean_dialogues(spark, sf):
    fx = Fixtures(spark, sf)
    msgs = _shared_rules_msgs(fx)
    lang = rules.language(msgs, rules.language_profile(fx.table("documents")))
    return rules.clean_dialogues(rules.role_confusion(msgs), lang)


# --- judge ------------------------------------------------------------------------------

def _parsed(fx: Fixtures) -> DataFrame:
    return judge.parse_judgements(fx.judgements.select("doc_id", "custom_id", "raw"))


@query
def q_judge_parse(spark, sf):
    return _parsed(Fixtures(spark, sf)).select("custom_id", "issue", "label", "is_valid")


@query
def q_issue_rates(spark, sf):
    """A8 by evaluator, language and model; the narrow judgements get their language before they are unfolded."""
    fx = Fixtures(spark, sf)
    docs = fx.table("documents").select("doc_id", "lang")
    d = F.col("doc_id")
    raw = fx.judgements.select("doc_id", "raw").join(docs, "doc_id").select(
        F.concat(F.lit("judge-"), (d % 2).cast("string")).alias("evaluator"), "lang",
        F.concat(F.lit("bot-"), (d % 3 + 1).cast("string")).alias("model"), "raw")
    return judge.issue_rates(judge.parse_judgements(raw))


@query
def q_judge_agreement(spark, sf):
    lab = Fixtures(spark, sf).table("labels")
    d, t = F.col("doc_id"), F.col("toxic")
    judges = F.array(F.struct(F.lit("judge_a").alias("judge"), judge.flip_when(t, d % 10 == 0).alias("pred")),
                     F.struct(F.lit("judge_b").alias("judge"), judge.flip_when(t, d % 4 == 1).alias("pred")))
    long = lab.select("toxic", F.explode(judges).alias("j")).select("toxic", "j.judge", "j.pred")
    return judge.agreement(long, "judge", "toxic", "pred")


@query
def q_stratified_sample(spark, sf):
    docs = Fixtures(spark, sf).table("documents").select("lang", "doc_id")
    return judge.stratified_sample(docs, "lang", "doc_id", 5)


# --- streaming and the driver loop -------------------------------------------------------

def _ingested(spark, sf, contradict: bool) -> DataFrame:
    """ST1: errors come before their answers, in triggers of their own; then lines of all attempts arrive in reversed order,
    some twice; then, with ``contradict``, other answers to some."""
    from turnforge.streaming import ingest
    base = scratch_path(spark, "stream-ingest")
    fx = Fixtures(spark, sf)
    columns = ["value", "attempt", "custom_id", "conv_id", "e", (F.col("conv_id") % 4).alias("_f")]
    lines = stored(fx.completion_lines.join(fx.attempts.select("custom_id", "attempt", "content"), ["custom_id", "attempt"]).select(*columns, "content"), "stream-lines")

    def put(rows: DataFrame) -> None:
        rows.select("value", "attempt").repartition("attempt").write.mode("append").partitionBy("attempt").text(f"{base}/in")

    def body(inner) -> F.Column:
        return F.to_json(F.struct("custom_id", F.struct(F.struct(inner).alias("body")).alias("response")))

    failed = F.to_json(F.struct("custom_id", F.struct(F.array(F.lit("zz")).alias("body")).alias("response")))
    put(lines.where((F.col("e") != 1) & (F.col("conv_id") % 5 == 2)).withColumn("value", failed))
    ingest.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/chk")
    for k in (3, 2, 1, 0, 1):
        put(lines.where(F.col("_f") == k))
    ingest.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/chk", max_files_per_trigger=24)
    if not contradict:
        return _as_attempts(ingest.latest(spark, f"{base}/out"))
    other = body(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.concat("content", F.lit("~")).alias("content")).alias("message"))).alias("choices"))
    put(lines.where(~F.col("e").isin(0, 1, 3) & (F.col("conv_id") % 7 == 3)).withColumn("value", other))
    ingest.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/chk")
    return _as_attempts(ingest.latest(spark, f"{base}/out"))


@query
def q_stream_ingest(spark, sf):
    """ST1: the answer of each id and attempt, whatever arrived first; no line is lost."""
    return _ingested(spark, sf, False).select("custom_id", "attempt", "content", "error")


@query
def q_stream_conflicts(spark, sf):
    """ST1: lines and contradictions of each id and attempt."""
    return _ingested(spark, sf, True).select("custom_id", "attempt", "n_lines", "conflict")


ORPHAN_SLICES = 2


@query
def q_stream_orphans(spark, sf):
    """Requests and completions as two streams in slices of time; a request that is not answered in 30 minutes is an orphan."""
    from turnforge.streaming import orphans
    base = scratch_path(spark, "stream-orphans")
    conv, pos, att = F.col("conv_id"), F.col("pos"), F.col("attempt")
    minute = conv * 2 + pos
    delay = (conv * 13 + pos * 7 + att * 5) % 50
    at = lambda m: F.timestamp_seconds(F.lit(1_700_000_000) + m * 60)
    rows = stored(Fixtures(spark, sf).attempts.select("custom_id", "attempt", minute.alias("m"), (minute + delay).alias("a"),
                                                      ((conv * 3 + pos + att) % 11 != 0).alias("comes")), "orphan-rows")
    last = rows.agg(F.max("a")).first()[0] or 0
    sides = (("requests", "m", "asked", rows), ("completions", "a", "answered", rows.where("comes")))
    for k in range(ORPHAN_SLICES):
        for name, when, column, side in sides:
            part = side.where(F.floor(F.col(when) * ORPHAN_SLICES / (last + 1)) == k).select("custom_id", "attempt", at(F.col(when)).alias(column))
            (part.unionByName(part.limit(5)) if name == "completions" else part).write.mode("append").parquet(f"{base}/{name}")
        orphans.run(spark, f"{base}/requests", f"{base}/completions", f"{base}/out", f"{base}/chk")
    orphans.heartbeat(spark, f"{base}/requests", f"{base}/completions", "2100-01-01 00:00:00")
    orphans.run(spark, f"{base}/requests", f"{base}/completions", f"{base}/out", f"{base}/chk")
    return orphans.pairs(spark, f"{base}/out").select("custom_id", "attempt", F.col("answered").isNotNull().alias("answered"))


@query
def q_stream_rate_audit(spark, sf):
    """ST2: the per-minute load of ``rate_audit`` over several triggers of unordered files."""
    from turnforge.streaming import audit
    # NTZ -> TIMESTAMP -> formatted minute round-trips the wall clock.
    ev = Fixtures(spark, sf).table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    base = scratch_path(spark, "stream-audit")
    ev.repartition(6, "event_id").write.parquet(f"{base}/in")
    audit.run(spark, f"{base}/in", ev.schema, f"{base}/out", f"{base}/chk", "ts", max_files_per_trigger=2)
    return audit.latest(spark, f"{base}/out", AUDIT_LIMIT)


def _replay_loop(spark, sf, flow: str):
    from turnforge.plans.loop import run_loop
    fx = Fixtures(spark, sf)
    a = fx.attempts.where(F.col("flow") == flow)
    root = scratch_path(spark, f"{flow}-loop")
    # The replay backend's saved answers: a table on shared storage, written once.
    kept = ~((F.col("conv_id") % 13 == 6) & (F.col("attempt") == 0))  # answers that never came
    a.where(kept).select("custom_id", "content", "verdict", "attempt").write.partitionBy("attempt").parquet(f"{root}/answers")
    answers = spark.read.schema("custom_id string, content string, verdict string, attempt bigint").parquet(f"{root}/answers")
    first = a.where(F.col("attempt") == 0).select("custom_id", F.col("conv_id").alias("row_idx"),
                                                   F.col("pos").alias("turn"))
    if flow == "turn":
        ctx = fx.snapshots("user", 1).select(
            "row_idx", "turn",
            render.user_turn_prompt(F.col("scene"), F.col("dialogue"), None).alias("base"),
            render.user_turn_prompt(F.col("scene"), F.col("dialogue"), "").alias("prompt"))
        base = first.join(ctx, ["row_idx", "turn"]).select("custom_id", "base", "prompt")
    else:
        scenes = fx.dialogues.select("row_idx", F.col("scene").alias("prompt"))
        base = first.join(scenes, "row_idx").select("custom_id", F.col("prompt").alias("base"), "prompt")
    of_round = [answers.where(F.col("attempt") == r) for r in range(K.MAX_STARTER_ROUNDS + 1)]  # one partition each
    gen_round, jud_round = iter(of_round), iter(of_round)
    gen = lambda p: p.join(next(gen_round).select("custom_id", "content"), "custom_id")
    jud = lambda c: c.join(next(jud_round).select("custom_id", "verdict"), "custom_id")
    rounds = K.MAX_TURN_ROUNDS if flow == "turn" else K.MAX_STARTER_ROUNDS
    # Both steps are joins against the stored answer table, so they need no extra write per round.
    res = run_loop(spark, base, gen, jud, flow, rounds, root, store_steps=False)
    return res.folded.select("custom_id", F.col("winning_attempt").cast("bigint").alias("winning_attempt"),
                             "final_content")


@query
def q_turn_loop(spark, sf):
    """O2: the round-by-round loop with a replay backend; must equal ``turn_fold``."""
    return _replay_loop(spark, sf, "turn")


@query
def q_starter_loop(spark, sf):
    """O2: the starter loop (no feedback, attempt-0 fallback); must equal ``starter_fold``."""
    return _replay_loop(spark, sf, "starter")
