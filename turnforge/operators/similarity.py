"""Nearest earlier message of each message (J11), without comparing all pairs.

The similarity is the Jaccard index of token sets, within a scope (a dialogue,
or a dialogue and role).  Its exact maximum over earlier messages is found by a
threshold-descending prefix-filter join:

* An equal set stands earlier: 1.  Of equal sets only the first is searched.
* One shared token: the best such partner is the smallest earlier message that
  holds the token, which is looked up, not joined: per token and size only the
  first position is kept.  This gives every message a first bound.
* Two or more: tokens are ordered by rarity in the scope.  For a similarity of
  at least t two messages share c = max(2, ceil(t n)) tokens, so both hold the
  first shared one among their n - c + 1 rarest, the second among n - c + 2.
  A rare token is a key by itself; a heavy one (in more messages than half the
  tokens these have on average) only together with a second one.  Messages meet by key, by
  size, and only with earlier ones; what meets is compared once.

Levels t descend.  A message whose best partner reaches t leaves; one that has
a bound already looks for better ones only, so its prefix is shorter.

The sets, sizes and candidates of a message meet by join; no dialogue is
gathered.  Many different sets that share the same heavy pairs of tokens (near
copies of one message) still meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnforge.functions.text import token_set
from turnforge.session import stored

LEVELS = (0.4, 0.0)
RARE = 4  # a token in at most so many messages of a scope is never heavy
POS = "pos"


def _on(left: str, right: str, scope: Sequence[str], *more: Column) -> Column:
    cond = F.lit(True)
    for c in scope:
        cond = cond & (F.col(f"{left}.{c}") == F.col(f"{right}.{c}"))
    for c in more:
        cond = cond & c
    return cond


def token_sets(msgs: DataFrame, scope: Sequence[str], partner: Column) -> DataFrame:
    """scope, pos, partner, n, toks (rarest first), heavy (of each), best (bound by equal sets and by one shared token), first (of its set)."""
    sets = msgs.select(*scope, POS, partner.alias("partner"), token_set(F.col("content")).alias("ts")).withColumn("n", F.size("ts"))
    toks = sets.where("n > 0").select(*scope, POS, "partner", "n", F.explode("ts").alias("tok"))
    toks = toks.repartition(*scope, "tok")  # dealt once: the counts below and the join with them find each token in its place
    # Per token: messages that hold it, and per size the first partner.  A token has at most as many sizes as messages have lengths.
    sized = toks.groupBy(*scope, "tok", "n").agg(F.count(F.lit(1)).alias("m"), F.min(F.when(F.col("partner"), F.col(POS))).alias("first"))
    known = sized.groupBy(*scope, "tok").agg(
        F.sum("m").alias("df"), (F.sum(F.col("m") * F.col("n")) / F.sum("m")).alias("mean"),
        F.collect_list(F.when(F.col("first").isNotNull(), F.struct("n", "first"))).alias("sizes"))
    least = F.array_min(F.transform(F.filter("sizes", lambda s: s["first"] < F.col(POS)), lambda s: s["n"]))
    each = toks.join(known, [*scope, "tok"]).select(
        *scope, POS, "partner", "n", F.struct("df", "tok", (F.col("df") > F.greatest(F.lit(RARE), F.col("mean") / 2)).alias("heavy")).alias("t"),
        (1 / (F.col("n") + least - 1)).alias("one"))
    rows = each.groupBy(*scope, POS).agg(F.first("partner").alias("partner"), F.first("n").alias("n"),
                                         F.sort_array(F.collect_list("t")).alias("t"), F.max("one").alias("one"))
    # Read twice below: stored, or all of the above would run (and shuffle) twice.
    rows = stored(rows.select(*scope, POS, "partner", "n", F.col("t.tok").alias("toks"), F.col("t.heavy").alias("heavy"), "one"), "nearest-sets")
    same = rows.groupBy(*scope, "toks").agg(F.min(F.when(F.col("partner"), F.col(POS))).alias("first"))
    best = F.when(F.col("first") < F.col(POS), F.lit(1.0)).otherwise(F.coalesce("one", F.lit(0.0)))
    return rows.join(same, [*scope, "toks"]).select(*scope, POS, "n", "toks", "heavy", best.alias("best"), (F.col("first") == F.col(POS)).alias("first"))


def _keyed(rows: DataFrame, scope: Sequence[str], at_least: Column) -> DataFrame:
    """A row for each key by which a message with a partner of at least this similarity is found.

    ``rest``: so many tokens two messages share at most, if the key is the first token (or two) that they share.
    """
    c = F.greatest(F.lit(2), F.ceil(at_least * F.col("n") - 1e-9).cast("int"))
    alone = F.col("n") - c + 1  # so many of the rarest tokens hold the first shared one

    def keys(tok, i):
        later = F.slice("toks", i + 2, F.greatest(alone - i, F.lit(0)))
        return F.when(F.get("heavy", i), F.transform(later, lambda u, k: F.struct(tok.alias("a"), u.alias("b"), (F.col("n") - i - k).alias("rest")))).otherwise(
            F.array(F.struct(tok.alias("a"), F.lit("").alias("b"), (F.col("n") - i).alias("rest"))))

    head = F.slice("toks", F.lit(1), F.greatest(alone, F.lit(0)))
    return rows.where("n > 1").select(*scope, POS, "n", at_least.alias("at_least"), F.explode(F.flatten(F.transform(head, keys))).alias("key"))


def candidates(probes: DataFrame, partners: DataFrame, scope: Sequence[str], t: float) -> DataFrame:
    """(scope, pos, other): pairs to compare, each once.

    Messages of n and m tokens that are as similar as ``s`` differ in size by no more than that factor and share
    s (n + m) / (1 + s) tokens at least, at the key that they share first: no pair is lost by these bounds.
    """
    x = _keyed(probes, scope, F.greatest(F.lit(t), F.col("best"))).alias("x")
    y = _keyed(partners, scope, F.lit(t)).drop("at_least").alias("y")
    s = F.col("x.at_least")
    fits = (F.col("y.n") >= s * F.col("x.n") - 1e-9) & (F.col("x.n") >= s * F.col("y.n") - 1e-9)
    enough = F.least("x.key.rest", "y.key.rest") * (1 + s) >= s * (F.col("x.n") + F.col("y.n")) - 1e-6
    met = x.join(y, _on("x", "y", scope, F.col("x.key.a") == F.col("y.key.a"), F.col("x.key.b") == F.col("y.key.b"), F.col(f"y.{POS}") < F.col(f"x.{POS}"), fits, enough))
    return met.select(*[f"x.{c}" for c in scope], f"x.{POS}", F.col(f"y.{POS}").alias("other")).distinct()


def _level(probes: DataFrame, partners: DataFrame, scope: Sequence[str], t: float) -> DataFrame:
    """``probes`` with their best similarity: exact if it is at least t."""
    pairs = candidates(probes, partners, scope, t).alias("p")
    x, y = probes.alias("x"), partners.alias("y")
    both = pairs.join(x, _on("p", "x", scope, F.col(f"p.{POS}") == F.col(f"x.{POS}"))).join(y, _on("p", "y", scope, F.col("p.other") == F.col(f"y.{POS}")))
    shared = F.size(F.array_intersect("x.toks", "y.toks"))
    found = both.groupBy(*[F.col(f"p.{c}").alias(c) for c in scope], F.col(f"p.{POS}").alias(POS)).agg(
        F.max(shared / (F.col("x.n") + F.col("y.n") - shared)).alias("found"))
    out = x.join(found.alias("f"), _on("x", "f", scope, F.col(f"x.{POS}") == F.col(f"f.{POS}")), "left")
    return out.select("x.*", F.greatest("x.best", "f.found").alias("now")).drop("best").withColumnRenamed("now", "best")


def nearest_earlier(msgs: DataFrame, scope: Sequence[str], partner: Column | None = None, levels: Sequence[float] = LEVELS) -> DataFrame:
    """scope, pos, sim: highest similarity to an earlier message of the scope (0 if none shares a token).

    ``partner`` tells which messages count as earlier ones.  Exact where it is
    at least the last of ``levels``, which descend; below that a lower bound.
    """
    rows = stored(token_sets(msgs, scope, F.coalesce(partner, F.lit(False)) if partner is not None else F.lit(True)), "nearest")
    partners = rows.where("first")
    sims, left = rows.where("best >= 1"), rows.where("best < 1")
    for t in levels:
        found = _level(left, partners, scope, t)
        if t == levels[-1]:
            left = found
        else:
            found = stored(found, "nearest")
            sims, left = sims.unionByName(found.where(F.col("best") >= t)), found.where(F.col("best") < t)
    sims = sims.unionByName(left)
    s = sims.select(*[F.col(c).alias(f"_{c}") for c in scope], F.col(POS).alias("_pos"), "best")
    cond = F.col(POS) == F.col("_pos")
    for c in scope:
        cond = cond & (F.col(c) == F.col(f"_{c}"))
    return msgs.join(s, cond, "left").select(*scope, POS, F.coalesce("best", F.lit(0.0)).alias("sim"))
