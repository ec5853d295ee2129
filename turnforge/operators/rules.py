"""Deterministic data-quality rules (Q1-Q5).

The original delegates these checks to a model judge.  These columns are
*proxies* for the same criteria, computed over the long-form message table
``(conv_id, pos, role, content)``; they measure mechanics, not meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnforge.functions.text import has_speaker_tag, placeholder_hits, sentence_count, tokens
from turnforge.operators.ordering import previous_value
from turnforge.operators.similarity import nearest_earlier
from turnforge.session import stored

KEY, POS = "conv_id", "pos"
HEAVY, HEAVY_LETTERS = 1000, 64  # rows and letters of the broadcast table of common tokens


def concise(msgs: DataFrame, role: str = "user", max_sentences: int = 2) -> DataFrame:
    """More than ``max_sentences`` sentences is flagged."""
    m = msgs.where(F.col("role") == role)
    return m.select(KEY, POS, sentence_count(F.col("content")).alias("metric")).withColumn(
        "flag", F.col("metric") > max_sentences)


def placeholder(msgs: DataFrame) -> DataFrame:
    """Q3/F8: placeholder person names such as ``PersonX``."""
    return msgs.select(KEY, POS, placeholder_hits(F.col("content")).alias("metric")).withColumn(
        "flag", F.col("metric") > 0)


def repetition(msgs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Q2: max Jaccard with an earlier same-role message; flagged at ``threshold``."""
    s = nearest_earlier(msgs, [KEY, "role"])
    return s.select(KEY, POS, F.round(F.col("sim"), 6).alias("metric")).withColumn(
        "flag", F.col("metric") >= threshold)


def language_profile(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(tok, lang): for every token of the corpus the language it is most frequent in (ties by name).

    Frequencies are counts divided by the language's tokens.  Partial
    aggregation shrinks the token stream to one row per (language, token)
    and task before the shuffle.
    """
    counts = docs.select(F.col(lang).alias("lang"), F.explode(tokens(F.col(text))).alias("tok")).groupBy(
        "lang", "tok").agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.groupBy("lang").agg(F.sum("cnt").alias("total"))
    share = counts.join(total, "lang").withColumn("share", F.col("cnt") / F.col("total"))
    return share.groupBy("tok").agg(
        F.min_by("lang", F.struct((-F.col("share")).alias("s"), F.col("lang").alias("l"))).alias("lang"))


def heavy_tokens(words: DataFrame, limit: int = HEAVY) -> DataFrame:
    """The tokens of ``words`` (column tok) that make up at least one in ``limit`` of all: at most ``limit`` rows.

    Only tokens of at most ``HEAVY_LETTERS`` letters are taken, so the table's bytes are bounded too.
    """
    counts = stored(words.where("tok is not null").groupBy("tok").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where((F.col("n") * limit >= total) & (F.length("tok") <= HEAVY_LETTERS)).select("tok")


def detect_language(msgs: DataFrame, profile: DataFrame, limit: int = HEAVY) -> DataFrame:
    """Language with most token hits per message (ties by name), ``unknown`` if none.

    A heavy-light join: heavy tokens (counted, see ``heavy_tokens``) meet their languages in a
    broadcast of at most ``limit`` rows and are added up per message before anything moves; the
    others are joined through a shuffle, where no token has one in ``limit`` of the rows.
    A message without any hit keeps a row of its own.  The winner is ``min_by(lang, (-hits, lang))``.
    """
    words = msgs.select(KEY, POS, "role", F.explode(tokens(F.col("content"))).alias("tok"))
    profile = stored(profile.select("tok", "lang"), "profile")  # read twice; a row for each token of the corpus
    heavy = heavy_tokens(words, limit)
    known = stored(heavy.join(profile, "tok", "left").select("tok", F.col("lang").alias("heavy_lang"), F.lit(True).alias("heavy")), "heavy-tokens")
    marked = words.join(F.broadcast(known), "tok", "left")
    often = marked.where("heavy and heavy_lang is not null").select(KEY, POS, "role", F.col("heavy_lang").alias("lang"))
    seldom = marked.where("heavy is null").select(KEY, POS, "role", "tok").join(profile, "tok").select(KEY, POS, "role", "lang")
    none = msgs.select(KEY, POS, "role", F.lit(None).cast("string").alias("lang"))
    hits = often.groupBy(KEY, POS, "role", "lang").agg(F.count(F.lit(1)).alias("_h")).unionByName(
        seldom.groupBy(KEY, POS, "role", "lang").agg(F.count(F.lit(1)).alias("_h"))).unionByName(none.withColumn("_h", F.lit(0).cast("bigint")))
    per_lang = hits.groupBy(KEY, POS, "role", "lang").agg(F.sum("_h").alias("_h"))
    best = per_lang.groupBy(KEY, POS, "role").agg(
        F.min_by(F.col("lang"), F.struct((-F.col("_h")).alias("h"), F.col("lang").alias("l"))).alias("detected"))
    return best.withColumn("detected", F.coalesce(F.col("detected"), F.lit("unknown")))


def language(msgs: DataFrame, profile: DataFrame) -> DataFrame:
    """Q4: language of each message against the first user message of its dialogue.

    ``unknown`` counts as a mismatch unless the first user message is unknown too.
    """
    det = detect_language(msgs, profile)
    # The first user message per dialogue is a partial aggregate, joined back: no dialogue is
    # gathered into one window.
    first = det.where(F.col("role") == "user").groupBy(F.col(KEY).alias("_k")).agg(
        F.min_by("detected", POS).alias("_first"))
    j = det.join(first, F.col(KEY) == F.col("_k"), "left")
    return j.select(KEY, POS, F.col("detected").alias("metric"),
                    F.coalesce(F.col("detected") != F.col("_first"), F.lit(False)).alias("flag"))


def role_confusion(msgs: DataFrame, copy_threshold: float = 0.5) -> DataFrame:
    """Q5: alternation break (same role as the previous message), a speaker tag
    in the text, or a near-copy of an earlier assistant message.

    ``metric`` counts how many of the three fire.
    """
    prev = previous_value(msgs, [KEY], POS, ["role"])
    alt = F.coalesce(F.col("prev_role") == F.col("role"), F.lit(False))
    sim = nearest_earlier(msgs, [KEY], F.col("role") == "assistant", (copy_threshold,))  # exact from the threshold on
    j = prev.join(sim, [KEY, POS], "left")
    copy = F.coalesce(F.col("sim") >= copy_threshold, F.lit(False))
    metric = alt.cast("bigint") + has_speaker_tag(F.col("content")).cast("bigint") + copy.cast("bigint")
    return j.select(KEY, POS, metric.alias("metric")).withColumn("flag", F.col("metric") > 0)


def clean_dialogues(role_flags: DataFrame, language_flags: DataFrame) -> DataFrame:
    """Keep a dialogue iff no message has a role or a language flag."""
    u = role_flags.select(KEY, "flag").unionByName(language_flags.select(KEY, "flag"))
    return u.groupBy(KEY).agg((~F.bool_or("flag")).alias("keep"))
