"""Batch completion (U1) and replay.

The model is an opaque row -> text function behind a backend.  Spark may run
a task twice and a lazy plan re-runs the call on every action, so callers
must **write the output to Parquet first** and build downstream from that
file (``turnforge.plans.loop`` does), keep speculation off, and de-duplicate
by ``(custom_id, attempt)``.  Concurrency is the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnforge.constants import MAX_TRIES

OUT_SCHEMA = "custom_id string, attempt int, content string, error string, tries int"


class Backend:
    """Completes a batch: ``prompts`` (pandas DataFrame with ``custom_id``,
    ``attempt``, ``model``, ``messages``) -> list of texts, same order.

    Built once per partition (model load happens in ``__init__``).
    """

    def complete(self, batch: pd.DataFrame) -> list[str]:  # pragma: no cover - interface
        raise NotImplementedError


class EchoBackend(Backend):
    """Toy deterministic backend: echoes the last message."""

    def complete(self, batch: pd.DataFrame) -> list[str]:
        return ["echo: " + (m[-1]["content"] if len(m) else "") for m in batch["messages"]]


def _answers(backend: Backend, pdf: pd.DataFrame) -> list:
    """One text per request; fewer, more or missing texts are an error of the call."""
    texts = list(backend.complete(pdf))
    if len(texts) != len(pdf):
        raise ValueError(f"{len(texts)} answers for {len(pdf)} requests")
    return texts


def _run_batch(backend: Backend, pdf: pd.DataFrame, max_tries: int) -> pd.DataFrame:
    """Completes a batch; a batch that fails is halved down to single requests.

    A single request has ``max_tries`` tries of its own, so one that always
    fails costs the others nothing.  A NULL text is an error, not an answer.
    """
    content: list = [None] * len(pdf)
    errors: list[list[str]] = [[] for _ in range(len(pdf))]
    tries = [0] * len(pdf)
    todo = [list(range(len(pdf)))] if len(pdf) else []
    while todo:
        rows = todo.pop()
        try:
            texts = _answers(backend, pdf.iloc[rows])
            why = "no text"
        except Exception as exc:  # noqa: BLE001 - backend errors are data here
            texts, why = None, str(exc) or type(exc).__name__
        if texts is None and len(rows) > 1:
            half = len(rows) // 2
            todo += [rows[half:], rows[:half]]
            continue
        for k, i in enumerate(rows):
            text = texts[k] if texts is not None else None
            tries[i] += 1
            if text is not None:
                content[i] = text
                continue
            errors[i].append(why)
            if tries[i] < max_tries:
                todo.append([i])
    return pd.DataFrame({
        "custom_id": pdf["custom_id"].values,
        "attempt": pdf["attempt"].astype("int32").values,
        "content": pd.Series(content, dtype=object).values,
        "error": ["; ".join(e) if c is None else None for c, e in zip(content, errors, strict=True)],
        "tries": pd.Series(tries, dtype="int32").values,
    })


def complete(requests: DataFrame, backend_factory: Callable[[], Backend], max_tries: int = MAX_TRIES) -> DataFrame:
    """``mapInPandas`` over Arrow batches, one backend per partition.

    Each request is tried up to ``max_tries`` times (see ``_run_batch``); one that
    never succeeds gets NULL content and its error messages (dead letter),
    not an exception.
    """
    cols = requests.select("custom_id", F.col("attempt").cast("int").alias("attempt"), "model", "messages")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = backend_factory()
        for pdf in batches:
            yield _run_batch(backend, pdf, max_tries)

    return cols.mapInPandas(run, OUT_SCHEMA)


def replay(requests: DataFrame, completions: DataFrame) -> DataFrame:
    """Completions come from a saved table; a missing one is an error row.

    A key saved more than once counts once: an answer before an error, then
    the smallest text, so that replaying a file twice changes nothing.
    """
    best = F.min(F.struct(F.col("content").isNull().alias("no_text"), "content", "error"))
    saved = completions.groupBy("custom_id", "attempt").agg(best.alias("_s"))
    j = requests.select("custom_id", "attempt").join(saved, ["custom_id", "attempt"], "left")
    return j.select("custom_id", "attempt", F.col("_s.content").alias("content"),
                    F.when(F.col("_s").isNull(), F.lit("missing")).otherwise(F.col("_s.error")).alias("error"))


def complete_to_table(requests: DataFrame, backend_factory: Callable[[], Backend], path: str,
                      max_tries: int = MAX_TRIES) -> DataFrame:
    """U1, the safe way: run the backend once, write its output to ``path``, read it back.

    Downstream plans read the written table, so re-running an action (or a
    lost executor re-running a stage) never calls the model again.  Spark
    commits one attempt of each task, so the table has a row per request;
    requests must have unique keys, which is checked before any call.
    """
    if requests.groupBy("custom_id", "attempt").count().where("count > 1").limit(1).count():
        raise ValueError("requests repeat a (custom_id, attempt)")
    complete(requests, backend_factory, max_tries).write.mode("errorifexists").parquet(path)
    return requests.sparkSession.read.schema(OUT_SCHEMA).parquet(path)
