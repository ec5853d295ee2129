"""Dialogue table maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnforge.functions.identity import decode_row_idx
from turnforge.functions.text import clean, has_end_marker
from turnforge.schemas import MESSAGES


def dialogues_from_messages(msgs: DataFrame, key: str = "conv_id", order: str = "turn",
                            model_of_role: Column | None = None, keep: Column | None = None,
                            extra: dict | None = None) -> DataFrame:
    """Long-form messages to one row per dialogue, messages in ``order``.

    One row per dialogue is the table's data model; the array is as large as
    the dialogue, and each dialogue is gathered once (not per turn).
    ``keep`` selects which rows become messages; ``extra`` adds aggregates
    computed in the same pass (e.g. the seed scene).
    """
    model = model_of_role if model_of_role is not None else F.lit(None).cast("string")
    item = F.struct(F.col(order).alias("o"), F.col("role").alias("role"), F.col("content").alias("content"),
                    model.alias("model"))
    if keep is not None:
        item = F.when(keep, item)
    extra = extra or {}
    g = msgs.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_items"),
                              *[c.alias(n) for n, c in extra.items()])
    return g.select(
        key, *extra.keys(),
        F.transform("_items", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        .cast(MESSAGES).alias("dialogue"),
        F.transform("_items", lambda m: m["model"]).alias("models"),
    )


def append_turn(dialogues: DataFrame, turns: DataFrame, on: Sequence[str], role: str, model: str,
                clean_mode: str = "prefix") -> DataFrame:
    """Left join new texts onto the dialogue table.

    A text containing the end marker ends the dialogue and appends nothing;
    unmatched dialogues pass through unchanged.  A key with several texts
    counts once (the smallest text), so a dialogue is never duplicated.
    """
    new = turns.groupBy(*on).agg(F.min("content").alias("_new")).withColumn("_matched", F.lit(True))
    j = dialogues.join(new, list(on), "left")
    ends = F.coalesce(F.col("_matched"), F.lit(False)) & has_end_marker(F.col("_new"))
    add = F.coalesce(F.col("_matched"), F.lit(False)) & ~ends & F.col("_new").isNotNull()
    message = F.struct(F.lit(role).alias("role"), clean(F.col("_new"), clean_mode).alias("content"))
    return j.withColumns({
        "dialogue": F.when(add, F.array_append(F.col("dialogue"), message)).otherwise(F.col("dialogue")),
        "models": F.when(add, F.array_append(F.col("models"), F.lit(model))).otherwise(F.col("models")),
        "ended": F.coalesce(F.col("ended"), F.lit(False)) | ends,
        "ended_now": ends,
    }).drop("_new", "_matched")


def require_same_ids(completions: DataFrame, requests: DataFrame) -> None:
    """Raise unless both sides have the same ids (one count each; run before a table is built)."""
    from turnforge.sources.io import orphans
    row = orphans(completions.select("custom_id").distinct(), requests.select("custom_id").distinct()).first()
    if row[0] or row[1]:
        raise ValueError(f"{row[0]} completions without request, {row[1]} requests without completion")


def new_dialogues(completions: DataFrame, requests: DataFrame, role: str, model: str, lang,
                  clean_mode: str = "prefix", compat_ended: bool = False) -> DataFrame:
    """A fresh dialogue table from starter completions and their requests, one row per request.

    Joined on the whole ``custom_id`` (a row index repeats across languages).
    ``source`` is the request id and ``scene`` the last request message.  A
    request without completion keeps an empty dialogue, ``missing = true``; an
    id completed more than once counts once (the smallest text).  With
    ``compat_ended`` a starter carrying the end marker still yields
    ``ended = false`` (T7); by default it is ended.
    """
    c = completions.groupBy("custom_id").agg(F.min("content").alias("content")).withColumnRenamed("custom_id", "_id")
    lang_c = lang if isinstance(lang, Column) else F.lit(lang)
    r = requests.select(decode_row_idx(F.col("custom_id")).alias("row_idx"), F.col("custom_id").alias("source"),
                        F.element_at(F.col("messages"), -1)["content"].alias("scene"), lang_c.cast("string").alias("lang"))
    j = r.join(c, F.col("source") == F.col("_id"), "left")
    ends = has_end_marker(F.col("content"))
    none = ends | F.col("content").isNull()
    message = F.struct(F.lit(role).alias("role"), clean(F.col("content"), clean_mode).alias("content"))
    return j.select(
        "row_idx", "source", "scene", "lang",
        F.when(none, F.array().cast(MESSAGES)).otherwise(F.array(message)).alias("dialogue"),
        F.when(none, F.array().cast("array<string>")).otherwise(F.array(F.lit(model))).alias("models"),
        (F.lit(False) if compat_ended else ends).alias("ended"),
        ends.alias("ended_now"), F.col("content").isNull().alias("missing"),
    )


def end_rate(dialogues: DataFrame) -> DataFrame:
    """A3: percent of dialogues ended overall and in this step (empty table -> NULL, not an error)."""
    n = F.count(F.lit(1))
    return dialogues.agg(
        F.when(n > 0, 100.0 * F.count_if(F.col("ended")) / n).alias("pct_ended"),
        F.when(n > 0, 100.0 * F.count_if(F.col("ended_now")) / n).alias("pct_new"),
    )
