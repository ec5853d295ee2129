"""Nearest earlier message: exact against all pairs, and few candidates in a long dialogue."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from turnforge.operators import rules as R
from turnforge.operators import similarity as S


def brute(rows, same_role, partner=None):
    out = {}
    sets = [(c, p, r, set(t.split())) for c, p, r, t in rows]
    for c, p, r, x in sets:
        best = 0.0
        for c2, p2, r2, y in sets:
            if c2 == c and p2 < p and (not same_role or r2 == r) and (partner is None or r2 == partner) and x | y:
                best = max(best, len(x & y) / len(x | y))
        out[c, p] = best
    return out


def dialogue(seed, n, words, conv=1, size=(0, 12)):
    pick = random.Random(seed)
    rows = []
    for pos in range(n):
        if rows and pick.random() < 0.2:  # copies and near copies
            text = pick.choice(rows)[3].split()
            if text and pick.random() < 0.6:
                text[pick.randrange(len(text))] = pick.choice(words)
            text = " ".join(text)
        else:
            text = " ".join(pick.choice(words) for _ in range(pick.randint(*size)))
        rows.append((conv, pos, pick.choice(["user", "assistant"]), text))
    return rows


LETTERS = "abcdefghijklmnopqrstuvwxyz"
FEW = [a for a in LETTERS[:6]]
MANY = [a + b for a in LETTERS for b in LETTERS]


@pytest.mark.parametrize("words", [FEW, MANY, FEW * 100 + MANY])
def test_exact_for_all_messages(spark, words):
    rows = dialogue(1, 90, words) + dialogue(2, 40, words, conv=2) + dialogue(3, 30, words, conv=3, size=(20, 60))
    msgs = spark.createDataFrame(rows, "conv_id long, pos long, role string, content string")
    got = {(r.conv_id, r.pos): r.sim for r in S.nearest_earlier(msgs, ["conv_id", "role"]).collect()}
    want = brute(rows, True)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_exact_from_the_threshold_on_and_never_above(spark):
    rows = dialogue(4, 120, FEW * 20 + MANY)
    msgs = spark.createDataFrame(rows, "conv_id long, pos long, role string, content string")
    got = {(r.conv_id, r.pos): r.sim for r in S.nearest_earlier(msgs, ["conv_id"], F.col("role") == "assistant", (0.5,)).collect()}
    want = brute(rows, False, "assistant")
    assert all(got[k] <= want[k] + 1e-12 and (got[k] >= 0.5) == (want[k] >= 0.5) for k in want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want if want[k] >= 0.5)


def test_a_common_word_in_a_long_dialogue_makes_few_candidates(spark):
    """10,000 messages share a word: no message meets as many as 50 others, and the similarities stay exact."""
    n = 10_000
    words = F.array(F.lit("common"), *[F.translate(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9000)).cast("string"), "0123456789", "abcdefghij") for k in range(9)])
    msgs = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("pos"), F.lit("user").alias("role"), F.array_join(words, " ").alias("content"))
    rows = S.token_sets(msgs, ["conv_id", "role"], F.lit(True))
    pairs = sum(S.candidates(rows.where("best < 1"), rows.where("first"), ["conv_id", "role"], t).count() for t in S.LEVELS)
    assert pairs < 50 * n
    got = {r.pos: r.sim for r in S.nearest_earlier(msgs, ["conv_id", "role"]).collect()}
    sets = [set(r.content.split()) for r in msgs.orderBy("pos").collect()]
    for pos in range(0, n, 997):
        assert abs(got[pos] - max([len(sets[pos] & y) / len(sets[pos] | y) for y in sets[:pos]], default=0.0)) < 1e-12


def test_no_messages_and_empty_texts(spark):
    none = spark.createDataFrame([], "conv_id long, pos long, role string, content string")
    assert S.nearest_earlier(none, ["conv_id"]).collect() == []
    rows = [(1, 0, "user", ""), (1, 1, "user", ""), (1, 2, "user", None), (2, 0, "user", "a"), (2, 1, "user", "A!")]
    msgs = spark.createDataFrame(rows, none.schema)
    assert sorted((r.conv_id, r.pos, r.sim) for r in S.nearest_earlier(msgs, ["conv_id"]).collect()) == [(1, 0, 0.0), (1, 1, 0.0), (1, 2, 0.0), (2, 0, 0.0), (2, 1, 1.0)]


def test_common_tokens_go_through_the_broadcast_alone(spark):
    pick = random.Random(5)
    profile = {"the": "en", "der": "de", **{f"w{chr(97 + k)}": pick.choice(["en", "de", "fr"]) for k in range(26)}}
    rows = [(c, p, "user", " ".join(["the"] * (p % 3 == 0) + ["der", "qq"] + pick.choices(list(profile), k=pick.randrange(6)))) for c in range(20) for p in range(8)]
    rows += [(99, 0, "user", ""), (99, 1, "user", None), (99, 2, "user", "zz zz")]
    msgs = spark.createDataFrame(rows, "conv_id long, pos long, role string, content string")
    table = spark.createDataFrame(list(profile.items()), "tok string, lang string")
    words = msgs.select(F.explode(F.split("content", " ")).alias("tok"))
    assert {"der", "qq"} <= {r.tok for r in R.heavy_tokens(words, 10).collect()} and R.heavy_tokens(words, 10).count() <= 10

    want = {}
    for c, p, _, text in rows:
        hits = collections.Counter(profile[t] for t in re.findall(r"[a-z]+", text or "") if t in profile)
        want[c, p] = min(hits, key=lambda x: (-hits[x], x)) if hits else "unknown"
    for limit in (1, 5, 1000):  # no, some or all tokens are heavy
        assert {(r.conv_id, r.pos): r.detected for r in R.detect_language(msgs, table, limit).collect()} == want


def test_pairs_too_different_in_size_or_place_do_not_meet(spark):
    """a message whose best partner is known meets only those that can be as similar; none that can is lost."""
    rows = dialogue(11, 150, FEW * 5 + MANY, size=(1, 40))
    msgs = spark.createDataFrame(rows, "conv_id long, pos long, role string, content string")
    sets = S.token_sets(msgs, ["conv_id"], F.lit(True)).withColumn("best", F.lit(0.5))
    got = {(r.pos, r.other) for r in S.candidates(sets.where("first"), sets.where("first"), ["conv_id"], 0.0).collect()}
    first = {r.pos for r in sets.where("first").collect()}
    words = {p: set(t.split()) for _, p, _, t in rows if p in first}
    for x, y in ((x, y) for x in words for y in words if y < x):
        shared = len(words[x] & words[y])
        if shared > 1 and 2 * shared >= len(words[x] | words[y]):
            assert (x, y) in got
    assert got and all(len(words[y]) >= 0.5 * len(words[x]) and len(words[x]) >= 0.5 * len(words[y]) for x, y in got)


def test_tokens_are_shuffled_once(spark):
    """counts of tokens and the join with them share one exchange of the tokens."""
    msgs = spark.createDataFrame(dialogue(12, 30, MANY), "conv_id long, pos long, role string, content string")
    stages = []
    store = S.stored
    try:
        S.stored = lambda df, label: stages.append(df) or store(df, label)
        S.token_sets(msgs, ["conv_id", "role"], F.lit(True))
    finally:
        S.stored = store
    plan = stages[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(stages) == 1 and plan.count("RepartitionByExpression") == 2  # equal ones: Spark runs one of them
    assert plan.count("Generate explode") == 2
