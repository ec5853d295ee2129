"""Prompt and request rendering.

All renderers are row-preserving projections built from built-in
expressions; history rendering works on the dialogue array in the row
(``transform`` + ``array_join``), never on a window that repeats history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnforge import constants as K
from turnforge import prompts as P
from turnforge.functions.identity import decode_row_idx, model_short, starter_custom_id, turn_custom_id
from turnforge.functions.text import history_text

REQUEST_COLUMNS = ["custom_id", "kind", "lang", "run_id", "model", "role", "turn", "row_idx",
                   "attempt", "messages", "params"]


def params_struct(temperature=None, top_p=None, frequency_penalty=None, presence_penalty=None,
                  max_tokens=None, response_format=None) -> Column:
    def d(v):
        return F.lit(v).cast("double")
    return F.struct(
        d(temperature).alias("temperature"), d(top_p).alias("top_p"),
        d(frequency_penalty).alias("frequency_penalty"), d(presence_penalty).alias("presence_penalty"),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
        F.lit(response_format).cast("string").alias("response_format"),
    )


def msg(role, content) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"))


def _request(df: DataFrame, custom_id: Column, kind: str, lang: Column, run_id, model, role: str,
             turn, row_idx: Column, attempt, messages: Column, params: Column) -> DataFrame:
    return df.select(
        custom_id.alias("custom_id"), F.lit(kind).alias("kind"), lang.alias("lang"),
        F.lit(run_id).cast("string").alias("run_id"),
        (model if isinstance(model, Column) else F.lit(model)).cast("string").alias("model"),
        F.lit(role).alias("role"),
        (turn if isinstance(turn, Column) else F.lit(turn)).cast("int").alias("turn"),
        row_idx.cast("bigint").alias("row_idx"),
        (attempt if isinstance(attempt, Column) else F.lit(attempt)).cast("int").alias("attempt"),
        messages.alias("messages"), params.alias("params"),
    )


def starter_user_content(scene, lang) -> Column:
    """``{scene}\\nLanguage/Culture: {lang}``."""
    return F.concat(F.col(scene) if isinstance(scene, str) else scene, F.lit(P.LANG_LINE),
                    F.col(lang) if isinstance(lang, str) else lang)


def starter_requests(scenes: DataFrame, run_id: str, dataset: str, model: str,
                     prompts: Mapping[str, str] = P.DEFAULT_PROMPTS,
                     params: Mapping = K.STARTER_PARAMS, attempt=0) -> DataFrame:
    """One request per scene (``row_idx, scene, lang``)."""
    content = starter_user_content("scene", "lang")
    messages = F.array(msg("system", F.lit(prompts["starter_system"])), msg("user", content))
    cid = starter_custom_id(run_id, dataset, F.col("lang"), model_short(F.lit(model)), F.col("row_idx"))
    return _request(scenes, cid, "starter", F.col("lang"), run_id, model, "user", 0, F.col("row_idx"),
                    attempt, messages, params_struct(**params))


def starter_verdict_requests(completions: DataFrame, model: str,
                             prompts: Mapping[str, str] = P.DEFAULT_PROMPTS,
                             params: Mapping = K.STARTER_VERDICT_PARAMS) -> DataFrame:
    """P5: the generated starter text alone, judged at low temperature."""
    messages = F.array(msg("system", F.lit(prompts["starter_verdict_system"])), msg("user", F.col("content")))
    lang = F.col("lang") if "lang" in completions.columns else F.lit(None).cast("string")
    attempt = F.col("attempt") if "attempt" in completions.columns else 0
    return _request(completions, F.col("custom_id"), "verdict", lang, None, model, "user", 0,
                    decode_row_idx(F.col("custom_id")), attempt, messages, params_struct(**params))


def user_turn_prompt(scene: Column, dialogue: Column | None, cue: str | None, history: Column | None = None) -> Column:
    """Scene, history with newlines deleted (T9), then the closing cue.

    ``history`` is the text of the messages if it is rendered already.

    ``cue=None`` gives the regeneration base, which drops the cue (T8).
    """
    parts = [F.lit(P.SCENE_HEAD), scene, F.lit("\n" + P.HISTORY_HEAD),
             history if history is not None else history_text(dialogue, "delete"), F.lit("\n\n")]
    if cue is not None:
        parts.append(F.lit(cue))
    return F.concat(*parts)


def user_turn_requests(dialogues: DataFrame, run_id: str, model: str, turn,
                       prompts: Mapping[str, str] = P.DEFAULT_PROMPTS,
                       params: Mapping = K.USER_TURN_PARAMS) -> DataFrame:
    """P6 over open dialogues only (F1); a ``history`` column (text) stands for ``dialogue``."""
    open_rows = dialogues.where(~F.coalesce(F.col("ended"), F.lit(False)))
    texts = (None, F.col("history")) if "history" in dialogues.columns else (F.col("dialogue"), None)
    prompt = user_turn_prompt(F.col("scene"), texts[0], prompts["user_turn_cue"], texts[1])
    messages = F.array(msg("system", F.lit(prompts["user_turn_system"])), msg("user", prompt))
    turn_c = F.col(turn) if isinstance(turn, str) else F.lit(turn)
    cid = turn_custom_id(F.col("lang"), run_id, model_short(F.lit(model)), turn_c, F.col("row_idx"))
    return _request(open_rows, cid, "turn", F.col("lang"), run_id, model, "user", turn_c, F.col("row_idx"),
                    0, messages, params_struct(**params))


def assistant_turn_requests(dialogues: DataFrame, run_id: str, model: str, turn,
                            prompts: Mapping[str, str] = P.DEFAULT_PROMPTS,
                            params: Mapping = K.USER_TURN_PARAMS) -> DataFrame:
    """System message followed by the whole dialogue, unchanged."""
    open_rows = dialogues.where(~F.coalesce(F.col("ended"), F.lit(False)))
    messages = F.concat(F.array(msg("system", F.lit(prompts["assistant_system"]))), F.col("dialogue"))
    turn_c = F.col(turn) if isinstance(turn, str) else F.lit(turn)
    cid = turn_custom_id(F.col("lang"), run_id, model_short(F.lit(model)), turn_c, F.col("row_idx"))
    return _request(open_rows, cid, "turn", F.col("lang"), run_id, model, "assistant", turn_c,
                    F.col("row_idx"), 0, messages, params_struct(**params))


def turn_verdict_prompt(scene: Column, dialogue: Column, role: Column, response: Column) -> Column:
    """Scene, history with newlines kept, then the response under test."""
    return F.concat(F.lit(P.SCENE_HEAD), scene, F.lit("\n\n" + P.HISTORY_HEAD),
                    history_text(dialogue, "keep", terminate=True), F.lit(P.RESPONSE_HEAD),
                    role, F.lit(": "), F.coalesce(response, F.lit("")))


def turn_verdict_requests(completions: DataFrame, dialogues: DataFrame, on: Sequence[str] = ("lang", "row_idx"),
                          role: str = "user", model: str = K.TURN_VERDICT_MODEL,
                          prompts: Mapping[str, str] = P.DEFAULT_PROMPTS,
                          params: Mapping = K.TURN_VERDICT_PARAMS) -> DataFrame:
    """J3 + P8 + P17: completion joined to its dialogue by language and row index (and turn).

    A row index is unique inside one language only.  The verdict keeps the
    turn's sampling parameters but for the temperature.
    """
    joined = completions.join(dialogues.select(*dict.fromkeys([*on, "scene", "dialogue", "lang"])), list(on), "inner")
    prompt = turn_verdict_prompt(F.col("scene"), F.col("dialogue"), F.lit(role), F.col("content"))
    messages = F.array(msg("system", F.lit(prompts["turn_verdict_system"])), msg("user", prompt))
    attempt = F.col("attempt") if "attempt" in completions.columns else 0
    turn = F.col("turn") if "turn" in joined.columns else 0
    return _request(joined, F.col("custom_id"), "verdict", F.col("lang"), None, model, "user", turn,
                    F.col("row_idx"), attempt,
                    messages, params_struct(**params))


def regeneration_block(content: Column, verdict: Column) -> Column:
    """One *(failed text, feedback)* block of P9."""
    return F.concat(F.lit(P.REGEN_BLOCK_HEAD), F.coalesce(content, F.lit("")), F.lit(P.REGEN_BLOCK_REASON),
                    F.coalesce(verdict, F.lit("")), F.lit("\n"))


def attempt_range(upper: Column) -> Column:
    """``[1 .. upper]``, empty when ``upper < 1`` (``sequence`` would count down)."""
    return F.when(upper >= 1, F.sequence(F.lit(1).cast("bigint"), upper.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>"))


def regeneration_prompts(history: DataFrame, max_rounds: int) -> DataFrame:
    """P9 for every attempt ``n >= 1`` whose earlier attempts were all rejected.

    ``history`` has one row per request: ``custom_id``, ``base`` (T8 prompt),
    ``tries`` = sorted array of ``struct(attempt, content, verdict, accepted)``
    (bounded by ``max_rounds + 1`` entries), plus any pass-through columns.
    The prompt of attempt n is the base plus one block per attempt ``0..n-1``.
    """
    accepted_at = F.array_min(F.transform(F.filter("tries", lambda t: t["accepted"]), lambda t: t["attempt"]))
    last = F.array_max(F.transform("tries", lambda t: t["attempt"]))
    upper = F.least(F.coalesce(accepted_at, last + 1), F.lit(max_rounds))
    with_n = history.withColumn("attempt", F.explode(attempt_range(upper)))
    blocks = F.transform(F.slice("tries", 1, F.col("attempt")),
                         lambda t: regeneration_block(t["content"], t["verdict"]))
    return with_n.withColumn("prompt", F.concat(F.col("base"), F.array_join(blocks, "")))


def dialogue_eval_prompt(dialogue: Column) -> Column:
    """The whole dialogue with newlines kept."""
    return F.concat(F.lit(P.DIALOGUE_HEAD), F.coalesce(history_text(dialogue, "keep"), F.lit("")))


def dialogue_eval_requests(dialogues: DataFrame, path: Column | str, judge_model: str,
                           prompts: Mapping[str, str] = P.DEFAULT_PROMPTS,
                           params: Mapping = K.JUDGE_PARAMS) -> DataFrame:
    """P11 over every dialogue, ended ones included."""
    from turnforge.functions.identity import eval_custom_id
    path_c = F.col(path) if isinstance(path, str) else path
    messages = F.array(msg("system", F.lit(prompts["judge_system"])),
                       msg("user", dialogue_eval_prompt(F.col("dialogue"))))
    return _request(dialogues, eval_custom_id(path_c, F.col("row_idx")), "judge", F.col("lang"), None,
                    judge_model, "user", 0, F.col("row_idx"), 0, messages,
                    params_struct(**params, response_format="json_object"))


def typed_parts(messages: Column, model: Column) -> Column:
    """For models tagged ``gemma-3`` each content becomes a list of typed parts.

    Returns ``array<struct<role, parts: array<struct<type, text>>>>``; untagged
    models get a single plain part so the column type is uniform; callers use
    ``wrapped`` to tell them apart.
    """
    return F.transform(messages, lambda m: F.struct(
        m["role"].alias("role"),
        F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))).alias("parts")))


def wrapped(model: Column) -> Column:
    return F.coalesce(model.contains(K.TYPED_PARTS_MODEL_TAG), F.lit(False))


def message_json(messages: Column, model: Column) -> Column:
    """The messages as JSON: a wrapped model (P14) gets each content as a list of typed parts, the others as a string."""
    typed = F.transform(typed_parts(messages, model), lambda m: F.struct(m["role"].alias("role"), m["parts"].alias("content")))
    return F.when(wrapped(model), F.to_json(typed)).otherwise(F.to_json(messages))


def request_json(requests: DataFrame) -> Column:
    """The request envelope as one JSON line (S4); messages of wrapped models are typed parts."""
    body = F.struct(
        F.col("model").alias("model"), F.parse_json(message_json(F.col("messages"), F.col("model"))).alias("messages"),
        F.col("params.temperature").alias("temperature"), F.col("params.top_p").alias("top_p"),
        F.col("params.frequency_penalty").alias("frequency_penalty"),
        F.col("params.presence_penalty").alias("presence_penalty"),
        F.col("params.max_tokens").alias("max_tokens"),
        F.when(F.col("params.response_format").isNotNull(),
               F.struct(F.col("params.response_format").alias("type"))).alias("response_format"),
    )
    return F.to_json(F.struct(F.col("custom_id"), F.lit("POST").alias("method"),
                              F.lit(K.CHAT_URL).alias("url"), body.alias("body")))
