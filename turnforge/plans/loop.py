"""The bounded regeneration loop (O2), run round by round on Spark.

Each round: render requests for the ids still pending -> ``generate`` ->
``judge`` -> join verdict to completion on ``(custom_id, attempt)`` (J2, no
positional pairing) -> triage -> **write the round to Parquet** (S8) -> one
count of what is still rejected.  The log is append-only, partitioned by
``attempt``; every round reads back what was written, so lineage is cut at
each round and a lost executor never re-runs a model call of an earlier
round.  The result is the fold of the log (A2), which the closed form
predicts exactly; the loop reports the real number still rejected per
round (T3, T15), not an exit code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnforge.operators.fold import fold_attempts
from turnforge.operators.render import regeneration_block
from turnforge.operators.triage import accepted as policy_accepts
from turnforge.operators.triage import FLOW_POLICY

Step = Callable[[DataFrame], DataFrame]
LOG_SCHEMA = "custom_id string, content string, verdict string, error string, accepted boolean, attempt int"


@dataclass
class LoopResult:
    folded: DataFrame
    remaining: list[int] = field(default_factory=list)
    log_path: str = ""


def run_loop(spark: SparkSession, base: DataFrame, generate: Step, judge: Step, flow: str, max_rounds: int,
             root: str, feedback: bool | None = None, store_steps: bool = True) -> LoopResult:
    """Run the loop for ``base`` (``custom_id``, ``base``, ``prompt``).

    ``prompt`` is the round-0 prompt; later rounds use ``base`` plus, in the
    user-turn flow, one feedback block per earlier rejected attempt (P9); the
    starter flow re-sends the same request (P10).
    An id that ``generate`` or ``judge`` leaves out stays pending.
    ``generate`` maps ``(custom_id, attempt, prompt)`` to ``(custom_id,
    attempt, content)``; ``judge`` maps that to ``(custom_id, attempt,
    verdict)``.  With ``store_steps`` (the default, required for model
    backends) each step's output is written before anything reads it, so a
    model is called once per request and round even though the completions
    feed both the judge and the join; replay steps that are already joins
    against a stored table may pass ``store_steps=False``.
    """
    policy = FLOW_POLICY[flow]
    feedback = (flow == "turn") if feedback is None else feedback
    log_path = f"{root}/attempts"

    def stored(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    # Rendered once and read back: every round reuses it without re-running its lineage.
    pending = stored(base.select("custom_id", F.lit(0).alias("attempt"), "prompt", "base"), f"{root}/pending/round=0")
    remaining: list[int] = []
    for r in range(max_rounds + 1):
        asked = pending.select("custom_id", "attempt", "prompt")
        comp = generate(asked).select("custom_id", "attempt", "content")
        if store_steps:
            comp = stored(comp, f"{root}/completions/round={r}")
        verd = judge(comp).select("custom_id", "attempt", "verdict")
        if store_steps:
            verd = stored(verd, f"{root}/verdicts/round={r}")
        # Every pending id stays: one without a text is a rejected attempt with an error.
        att = (pending.select("custom_id", "attempt").join(comp, ["custom_id", "attempt"], "left")
               .join(verd, ["custom_id", "attempt"], "left"))
        has_text = F.col("content").isNotNull()
        att = att.select("custom_id", "content", "verdict", F.when(~has_text, F.lit("missing")).alias("error"),
                         (has_text & policy_accepts(F.col("verdict"), policy)).alias("accepted"))
        this_round = stored(att, f"{log_path}/attempt={r}")
        rejected = this_round.where(~F.col("accepted"))
        remaining.append(rejected.count())
        if remaining[-1] == 0 or r == max_rounds:
            break
        again = pending.drop("attempt").join(rejected.select("custom_id", "content", "verdict"), "custom_id")
        if feedback:  # the prompt so far and the newest block
            so_far = F.concat("base", regeneration_block(F.col("content"), F.col("verdict")))
            again = again.withColumn("base", so_far).withColumn("prompt", F.col("base"))
        pending = stored(again.select("custom_id", F.lit(r + 1).alias("attempt"), "prompt", "base"),
                         f"{root}/pending/round={r + 1}")
    log = spark.read.schema(LOG_SCHEMA).parquet(log_path)
    return LoopResult(fold_attempts(log, ["custom_id"], flow), remaining, log_path)
