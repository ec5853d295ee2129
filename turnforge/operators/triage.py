"""Verdict triage.

The two original rules have opposite defaults and are kept as two named
policies (T2).  Both are case-sensitive substring tests; a NULL verdict is
never accepted (T4: ``NOT contains(NULL)`` would silently drop the row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reject_if_no(verdict: Column) -> Column:
    """Starter rule: rejected iff the verdict contains ``No`` (``Not sure`` rejects, ``n/a`` passes)."""
    return ~F.coalesce(verdict.contains("No"), F.lit(True))


def accept_if_yes(verdict: Column) -> Column:
    """Turn rule: accepted iff the verdict contains ``Yes`` (``No. Yes...`` passes)."""
    return F.coalesce(verdict.contains("Yes"), F.lit(False))


POLICIES = {"reject_if_no": reject_if_no, "accept_if_yes": accept_if_yes}
FLOW_POLICY = {"starter": "reject_if_no", "turn": "accept_if_yes"}


def accepted(verdict: Column, policy: str) -> Column:
    return POLICIES[policy](verdict)


def accepted_by_flow(verdict: Column, flow: Column) -> Column:
    expr = None
    for name, pol in FLOW_POLICY.items():
        branch = POLICIES[pol](verdict)
        expr = F.when(flow == name, branch) if expr is None else expr.when(flow == name, branch)
    return expr.otherwise(F.lit(False))


def triage_counts(df: DataFrame, by: Sequence[str], flag: str = "accepted") -> DataFrame:
    """A1: accepted / rejected counts per group (one partial + final aggregate)."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(flag)).cast("bigint").alias("n_accepted"),
        F.count_if(~F.col(flag)).cast("bigint").alias("n_rejected"),
    )


def error_kind(message: Column, from_body: Column) -> Column:
    """an error that the service sent in a response body is an API error, any
    other (the call raised) is ``other``; only a body's text can tell a rate limit."""
    limited = F.coalesce(F.lower(message).contains("rate limit"), F.lit(False))
    return (F.when(message.isNull(), F.lit(None).cast("string"))
            .when(~F.coalesce(from_body, F.lit(False)), F.lit("other"))
            .when(limited, F.lit("rate_limit")).otherwise(F.lit("api")))


def open_only(df: DataFrame, ended: str = "ended") -> DataFrame:
    """keep dialogues that have not ended."""
    return df.where(~F.coalesce(F.col(ended), F.lit(False)))
