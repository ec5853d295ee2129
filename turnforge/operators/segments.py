"""Dialogues as bounded segments.

A dialogue is rows ``(conv_id, segment, first_pos, n, messages, digest,
digest_before)``; a segment holds at most SEGMENT_MESSAGES messages, so no row
and no task holds a whole dialogue, however long.  ``digest`` is the sum of the
hashes of a segment's messages (position, role, content), ``digest_before``
that of all messages before it: sums do not depend on how messages are cut.

* ``to_segments``: long-form messages to segments.
* ``heads``: where each dialogue ends, from the narrow columns alone.
* ``append``: a new text is one new segment of one message; nothing that is there
  is read or rewritten.  ``attach`` writes it once: a segment whose place is
  taken by the same message is left out, one that follows another history is
  a conflict.
* ``before``: the messages before given positions, a segment at a time; only
  ``dialogues_before`` and ``texts_before`` (exports) gather them.
* ``compact``: small segments to full ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnforge.functions.text import clean, has_end_marker, message_line
from turnforge.operators.ordering import running_totals
from turnforge.schemas import MESSAGES
from turnforge.session import stored

SEGMENT_MESSAGES = 64
KEY = "conv_id"
SCHEMA = ("conv_id bigint, segment bigint, first_pos bigint, n bigint, messages array<struct<pos:bigint,role:string,content:string,model:string>>, "
          "digest decimal(38,0), digest_before decimal(38,0)")


def _hash(pos: Column, role: Column, content: Column) -> Column:
    return F.xxhash64(pos.cast("bigint"), role, content).cast("decimal(20,0)")


def _digest(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("decimal(38,0)"), lambda a, m: (a + _hash(m["pos"], m["role"], m["content"])).cast("decimal(38,0)"))


def to_segments(msgs: DataFrame, size: int = SEGMENT_MESSAGES, model: Column | None = None, chained: bool = True) -> DataFrame:
    """Segments of ``msgs`` (conv_id, pos, role, content); positions are dense from 0.

    ``chained=False`` leaves ``digest_before`` null, for segments that are read only.
    """
    item = F.struct(F.col("pos").cast("bigint").alias("pos"), "role", "content", (model if model is not None else F.lit(None)).cast("string").alias("model"))
    cut = msgs.groupBy(KEY, F.floor(F.col("pos") / size).cast("bigint").alias("segment")).agg(F.sort_array(F.collect_list(item)).alias("messages"))
    cut = cut.select(KEY, "segment", F.get("messages", F.lit(0))["pos"].alias("first_pos"), F.size("messages").cast("bigint").alias("n"),
                     "messages", _digest(F.col("messages")).alias("digest"))
    if not chained:
        return cut.withColumn("digest_before", F.lit(None).cast("decimal(38,0)"))
    upto = running_totals(cut, [KEY], "segment", {"_upto": F.col("digest")})
    return upto.select(*cut.columns, (F.col("_upto") - F.col("digest")).cast("decimal(38,0)").alias("digest_before"))


def heads(segments: DataFrame) -> DataFrame:
    """(conv_id, next_pos, last_segment, digest): the end of each dialogue."""
    return segments.groupBy(KEY).agg(F.max(F.col("first_pos") + F.col("n")).alias("next_pos"), F.max("segment").alias("last_segment"),
                                     F.sum("digest").cast("decimal(38,0)").alias("digest"))


def append(ends: DataFrame, turns: DataFrame, role: str, model: str, clean_mode: str = "prefix") -> DataFrame:
    """New segments for ``turns`` (conv_id, content) behind ``ends`` (as of ``heads``), with ``ended``.

    A text with the end marker ends its dialogue: its row has no message.  A
    dialogue with several texts takes the smallest, one without a text has no row.
    """
    new = turns.where(F.col("content").isNotNull()).groupBy(KEY).agg(F.min("content").alias("_new"))
    j = ends.join(new, KEY)
    ends_now = has_end_marker(F.col("_new"))
    pos = F.coalesce("next_pos", F.lit(0)).cast("bigint")
    one = F.array(F.struct(pos.alias("pos"), F.lit(role).alias("role"), clean(F.col("_new"), clean_mode).alias("content"), F.lit(model).alias("model")))
    messages = F.when(ends_now, F.slice(one, 1, 0)).otherwise(one)
    out = j.select(KEY, (F.coalesce("last_segment", F.lit(-1)) + 1).cast("bigint").alias("segment"), pos.alias("first_pos"),
                   F.size(messages).cast("bigint").alias("n"), messages.alias("messages"),
                   F.coalesce("digest", F.lit(0)).cast("decimal(38,0)").alias("digest_before"), ends_now.alias("ended"))
    return out.select(KEY, "segment", "first_pos", "n", "messages", _digest(F.col("messages")).alias("digest"), "digest_before", "ended")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def attach(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Append segments to the table at ``path``, each once.

    A segment that is there already (same place, same messages) is left out, so a
    repeated write changes nothing; one whose place is taken by other messages, or
    whose history is not the table's, raises and nothing is written.
    """
    new = new.where("n > 0").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    there = read(spark, path)
    place = there.select(F.col(KEY).alias("_k"), F.col("first_pos").alias("_p"), F.col("digest").alias("_d"))
    ends = heads(there).select(F.col(KEY).alias("_h"), "next_pos", F.col("digest").alias("_all"))
    j = new.join(place, (new[KEY] == place["_k"]) & (new["first_pos"] == place["_p"]), "left").join(ends, new[KEY] == ends["_h"], "left")
    there_already = F.coalesce(F.col("_d") == F.col("digest"), F.lit(False))
    follows = (F.coalesce("next_pos", F.lit(0)) == F.col("first_pos")) & (F.coalesce("_all", F.lit(0).cast("decimal(38,0)")) == F.col("digest_before"))
    checked = stored(j.select(*new.columns, there_already.alias("_there"), follows.alias("_follows")), "new-segments")
    if checked.where("not (_there or _follows)").limit(1).count():
        raise ValueError("a segment does not follow the stored history of its dialogue")
    checked.where("not _there").select(*new.columns).write.mode("append").parquet(path)


def before(segments: DataFrame, asks: DataFrame) -> DataFrame:
    """(conv_id, upto, segment, messages): what stands before position ``upto``, a row for each segment.

    ``asks`` is (conv_id, upto); one without earlier messages has a single row with a null segment.
    """
    s = segments.select(F.col(KEY).alias("_k"), "segment", "first_pos", "messages")
    j = asks.join(s, (asks[KEY] == F.col("_k")) & (F.col("first_pos") < asks["upto"]), "left")
    return j.select(asks[KEY], "upto", "segment", F.filter("messages", lambda m: m["pos"] < F.col("upto")).alias("messages"))


def texts_before(segments: DataFrame, asks: DataFrame, newline: str = "delete", sep: str = "\n") -> DataFrame:
    """(conv_id, upto, history): the lines before ``upto``; each segment is rendered where it is, the texts are gathered."""
    part = before(segments, asks).select(KEY, "upto", F.struct("segment", F.array_join(F.transform("messages", lambda m: message_line(m, newline)), sep).alias("text")).alias("part"))
    parts = part.groupBy(KEY, "upto").agg(F.sort_array(F.collect_list(F.when(F.col("part.segment").isNotNull(), F.col("part")))).alias("parts"))
    return parts.select(KEY, "upto", F.array_join(F.col("parts.text"), sep).alias("history"))


def dialogues_before(segments: DataFrame, asks: DataFrame) -> DataFrame:
    """(conv_id, upto, dialogue): the messages before ``upto`` as one array (an export)."""
    part = before(segments, asks).select(KEY, "upto", F.when(F.col("segment").isNotNull(), F.struct("segment", "messages")).alias("part"))
    parts = part.groupBy(KEY, "upto").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    every = F.transform(F.flatten(F.col("parts.messages")), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return parts.select(KEY, "upto", every.cast(MESSAGES).alias("dialogue"))


def last_messages(segments: DataFrame) -> DataFrame:
    """(conv_id, last_role, last_content): the last message of each dialogue, the others are not gathered."""
    last = F.try_element_at("messages", F.lit(-1))
    return segments.where("n > 0").groupBy(KEY).agg(F.max_by(F.struct(last["role"].alias("role"), last["content"].alias("content")), "first_pos").alias("m")).select(
        KEY, F.col("m.role").alias("last_role"), F.col("m.content").alias("last_content"))


def compact(segments: DataFrame, size: int = SEGMENT_MESSAGES) -> DataFrame:
    """The same dialogues in full segments."""
    m = segments.select(KEY, F.explode("messages").alias("m")).select(KEY, "m.*")
    return to_segments(m, size, F.col("model"))
