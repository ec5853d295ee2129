"""Tables derived inside the query from the read-only inputs (FIXTURES.md §3).

Every derivation is a plain deterministic formula over ``conversations``,
``documents``, ``labels`` and ``events``, so the DuckDB oracle
(``turnforge.plans.oracle``) can build the same rows independently.  Work
grows with the input tables; nothing is synthesised from fixed small input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnforge.constants import LANGUAGES, MAX_STARTER_ROUNDS, MAX_TURN_ROUNDS, RATING_KEY
from turnforge.functions.identity import starter_custom_id, turn_custom_id
from turnforge.operators.ordering import ordinal
from turnforge.operators.render import starter_user_content
from turnforge.operators.triage import accepted_by_flow
from turnforge.operators.transcript import dialogues_from_messages
from turnforge.schemas import COMPLETION_ERRORS_WIRE, COMPLETION_WIRE
from turnforge.sources.tables import read_table

# Fixed fixture values (FIXTURES.md).
RUN_ID = "r1"
STARTER_DATASET = "fx"
GEN_MODEL = "m1"
ASSISTANT_MODEL = "m2"
ERROR_STRINGS = ["timeout", "rate limit"]


def lang_of(conv_id: Column) -> Column:
    """``LANGS[conv_id % 6]`` in the order chinese, english, french, german, portuguese, spanish."""
    return F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (conv_id % len(LANGUAGES) + 1).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


class Fixtures:
    """Lazily built fixture DataFrames for one input directory.

    ``Fixtures(spark, sf_dir)`` returns one shared instance per session and
    directory, so the (lazy, immutable) plans are built once on the driver and
    reused by every query; each query still reads and computes its data.
    """

    _instances: dict = {}

    def __new__(cls, spark: SparkSession, sf_dir: str):
        key = (id(spark), spark.sparkContext.applicationId, sf_dir)
        inst = cls._instances.get(key)
        if inst is None:
            inst = super().__new__(cls)
            inst.spark = spark
            inst.sf_dir = sf_dir
            inst._tables = {}
            cls._instances[key] = inst
        return inst

    def __init__(self, spark: SparkSession, sf_dir: str):
        pass

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.sf_dir, name)
        return self._tables[name]

    # -- 3.1 ----------------------------------------------------------------
    @cached_property
    def msgs(self) -> DataFrame:
        """``fx_msgs(conv_id, turn, pos, role, content)``: user and assistant messages."""
        c = (self.table("conversations").where(F.col("role").isin("user", "assistant"))
             .select("conv_id", "turn", "role", F.col("text").alias("content")))
        return ordinal(c, ["conv_id"], "turn", "pos")

    # -- 3.2 ----------------------------------------------------------------
    @cached_property
    def dialogues(self) -> DataFrame:
        """``fx_dialogues``: one row per conversation with the message array.

        A single aggregation over ``conversations`` (seed scene and messages
        together); queries that need only ``conv_id``/``lang`` get the
        ``collect_list`` pruned away by the optimizer.
        """
        conv = self.table("conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
        is_msg = F.col("role").isin("user", "assistant")
        model = F.when(F.col("role") == "user", "user-a").otherwise("bot-1")
        g = dialogues_from_messages(conv, "conv_id", "turn", model, keep=is_msg, extra={
            "_sys": F.max(F.when(F.col("role") == "system", F.col("content")))})
        lang = lang_of(F.col("conv_id"))
        seed_scene = F.coalesce(F.col("_sys"), F.concat(F.lit("Scene "), _s(F.col("conv_id"))))
        return g.select(
            "conv_id",
            F.col("conv_id").alias("row_idx"),
            lang.alias("lang"),
            F.concat(F.lit("fx-"), _s(F.col("conv_id"))).alias("source"),
            seed_scene.alias("seed_scene"),
            starter_user_content(seed_scene, lang).alias("scene"),
            "dialogue", "models",
            F.lit(False).alias("ended"),
        )

    def snapshots(self, role: str = "user", min_pos: int = 1) -> DataFrame:
        """Dialogue as it stood before each ``role`` message at ``pos >= min_pos``.

        Positions come from the row's own array (``posexplode``), so no join
        and no window is needed; ``turn`` = position of the message.
        """
        d = self.dialogues.select("*", F.posexplode("dialogue").alias("turn", "_m"))
        d = d.where((F.col("_m.role") == role) & (F.col("turn") >= min_pos))
        return d.withColumn("dialogue", F.slice("dialogue", 1, F.col("turn"))).withColumn(
            "turn", F.col("turn").cast("bigint")).drop("_m")

    # -- 3.3 ----------------------------------------------------------------
    @cached_property
    def attempts(self) -> DataFrame:
        """``fx_attempts(flow, conv_id, pos, attempt, custom_id, lang, content, verdict, accepted)``."""
        m = self.msgs.where(F.col("role") == "user")
        conv, pos = F.col("conv_id"), F.col("pos")
        flow = F.when(pos == 0, "starter").otherwise("turn")
        top = F.when(pos == 0, MAX_STARTER_ROUNDS).otherwise(MAX_TURN_ROUNDS).cast("bigint")
        m = m.withColumn("attempt", F.explode(F.sequence(F.lit(0).cast("bigint"), top)))
        att = F.col("attempt")
        text = F.col("content")
        d = (conv * 7 + pos * 3) % 20
        base = (F.when(d == 0, F.concat(F.lit('"'), text, F.lit('"')))
                .when(d == 1, F.concat(F.lit("user: "), text))
                .when(d == 2, F.concat(F.lit('"user: '), text, F.lit('"')))
                .when(d == 3, F.lit("END_OF_DIALOGUE"))
                .when(d == 4, F.concat(text, F.lit(" PersonY")))
                .when(d == 5, F.concat(text, F.lit(" user: ")))
                .otherwise(text))
        content = F.when(att > 0, F.concat(base, F.lit(" [retry "), _s(att), F.lit("]"))).otherwise(base)
        g = (conv * 11 + pos * 5) % 23
        verdict = (F.when(g == 0, F.lit(None).cast("string"))
                   .when(g == 1, F.lit("n/a"))
                   .when(g == 2, F.lit("Not sure"))
                   .when(g == 3, F.lit("No. Yes, but too long"))
                   .when(g == 4, F.concat(F.lit("No. exhausted "), _s(att)))
                   .when((conv * 31 + pos * 17 + att * 7) % 10 < 4, F.concat(F.lit("No. retry "), _s(att)))
                   .otherwise(F.lit("Yes.")))
        lang = lang_of(conv)
        cid = F.when(pos == 0, starter_custom_id(RUN_ID, STARTER_DATASET, lang, GEN_MODEL, conv)).otherwise(
            turn_custom_id(lang, RUN_ID, GEN_MODEL, pos, conv))
        out = m.select(flow.alias("flow"), "conv_id", "pos", "attempt", cid.alias("custom_id"), lang.alias("lang"),
                       content.alias("content"), verdict.alias("verdict"))
        return out.withColumn("accepted", accepted_by_flow(F.col("verdict"), F.col("flow")))

    # -- 3.4 ----------------------------------------------------------------
    @cached_property
    def completion_lines(self) -> DataFrame:
        """``fx_completions`` as raw lines, one per attempt, in all shapes of P12."""
        a = self.attempts
        e = (F.col("conv_id") + F.col("pos") + F.col("attempt")) % 17
        ok = F.to_json(F.struct(
            F.col("custom_id"),
            F.struct(F.struct(F.array(F.struct(F.struct(F.lit("user").alias("role"), F.col("content").alias("content"))
                                               .alias("message"))).alias("choices")).alias("body")).alias("response")))
        err = F.to_json(F.struct(
            F.col("custom_id"),
            F.struct(F.array(*[F.lit(x) for x in ERROR_STRINGS]).alias("body")).alias("response")))
        # The throttled caller's [task_id, request, response or errors, metadata].
        request = F.to_json(F.struct(F.col("custom_id"), F.lit("POST").alias("method")))
        answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content"))
                                                     .alias("message"))).alias("choices")))
        head = F.concat(F.lit("["), _s(F.col("conv_id")), F.lit(","), request, F.lit(","))
        line = (F.when(e == 0, err)
                .when(e == 1, F.substring(ok, F.lit(1), F.floor(F.length(ok) / 2).cast("int")))
                .when(e == 2, F.concat(head, answer, F.lit("]")))
                .when(e == 3, F.concat(head, F.lit('["boom","again"],{"k":1}]')))
                .otherwise(ok))
        return a.select("conv_id", "pos", "flow", "lang", "custom_id", "attempt", e.alias("e"), line.alias("value"))

    @cached_property
    def parsed_lines(self) -> DataFrame:
        """``completion_lines`` with content, error and is_error."""
        return parse_completion_lines(self.completion_lines)

    # -- 3.6 ----------------------------------------------------------------
    @cached_property
    def rules_msgs(self) -> DataFrame:
        """``fx_rules``: messages with three injected faults."""
        m = self.msgs
        # Text at pos 0 of each conversation = its earliest user/assistant message.
        donor = (self.table("conversations").where(F.col("role").isin("user", "assistant"))
                 .groupBy("conv_id").agg(F.min_by("text", "turn").alias("_donor"))
                 .select((F.col("conv_id") - 1).alias("conv_id"), "_donor"))
        switch = (F.col("conv_id") % 10 == 7) & (F.col("pos") == 2)
        j = m.join(donor, "conv_id", "left")
        content = (F.when(switch & F.col("_donor").isNotNull(), F.col("_donor"))
                   .when((F.col("conv_id") % 9 == 2) & (F.col("pos") == 0), F.concat(F.col("content"), F.lit(" PersonY")))
                   .otherwise(F.col("content")))
        keep = ~((F.col("conv_id") % 10 == 3) & (F.col("pos") == 1))
        return j.where(keep).select("conv_id", "pos", "role", content.alias("content"))

    # -- 3.7 ----------------------------------------------------------------
    @cached_property
    def judgements(self) -> DataFrame:
        """``fx_judgements(doc_id, custom_id, raw, toxic, quality)`` from ``labels``."""
        lab = self.table("labels")
        doc, toxic, quality = F.col("doc_id"), F.col("toxic"), F.col("quality")
        k = doc % 13
        rating = F.when(k == 3, F.lit(9)).otherwise(1 + 3 * quality + doc % 2)
        unsafe_label = F.when(k == 2, F.concat(F.lit('"'), _s(toxic), F.lit('"'))).otherwise(_s(toxic))
        body = F.concat(F.lit('{"unsafe":{"label":'), unsafe_label, F.lit(',"comment":""},"'), F.lit(RATING_KEY),
                        F.lit('":{"label":'), _s(rating), F.lit(',"comment":""}}'))
        raw = (F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
               .when(k == 1, F.substring(body, F.lit(1), F.floor(F.length(body) / 2).cast("int")))
               .otherwise(body))
        return lab.select("doc_id", F.concat(F.lit("eval-"), _s(doc)).alias("custom_id"), raw.alias("raw"),
                          "toxic", "quality")


def parse_completion_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Pull the text out of a completion line, keeping failures as an error column.

    Three shapes: the batch line ``{custom_id, response}``, its form whose
    body is a list of error strings, and the throttled caller's array
    ``[task_id, request, response or errors, metadata?]``, whose id is the
    request's.  Fixed schemas, no inference: a malformed line, an error list
    or a missing choice gives NULL content and a reason, never an exception (T14).
    """
    is_array = F.ltrim(F.col(col)).startswith("[")
    # An array's elements differ in type: each is taken as JSON text, then parsed by its own schema.
    parts = F.when(is_array, F.from_json(F.col(col), "array<string>"))
    triple = F.struct(F.get_json_object(F.try_element_at(parts, F.lit(2)), "$.custom_id").alias("custom_id"),
                      F.try_element_at(parts, F.lit(3)).alias("body"))
    opts = {"columnNameOfCorruptRecord": "_corrupt_record"}
    out = lines.withColumn("_t", triple).withColumn(
        "_p", F.when(~is_array, F.from_json(F.col(col), COMPLETION_WIRE, opts)))
    choices = F.coalesce(F.col("_p.response.body.choices"),
                         F.from_json(F.col("_t.body"), COMPLETION_WIRE["response"].dataType["body"].dataType)["choices"])
    out = out.withColumn("_c", F.try_element_at(choices, F.lit(1))["message"]["content"])
    failed = F.col("_c").isNull()
    errs = F.when(failed & ~is_array, F.from_json(F.col(col), COMPLETION_ERRORS_WIRE)["response"]["body"]).when(
        failed & F.col("_t.body").startswith("["), F.from_json(F.col("_t.body"), "array<string>"))
    out = out.withColumn("_e", errs)
    broken = F.when(is_array, F.col("_t.custom_id").isNull() | F.col("_t.body").isNull()).otherwise(
        F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull())
    error = (F.when(~failed, F.lit(None).cast("string")).when(F.col("_e").isNotNull(), F.array_join("_e", "; "))
             .when(F.coalesce(broken, F.lit(True)), F.lit("malformed")).otherwise(F.lit("empty")))
    cols = {"content": F.col("_c"), "error": error, "is_error": failed}
    if "custom_id" not in lines.columns:
        cols["custom_id"] = F.coalesce(F.col("_p.custom_id"), F.col("_t.custom_id"))
    return out.withColumns(cols).drop("_p", "_e", "_t", "_c")
