"""Hashed maximum-entropy language model, scored and trained in numpy batches.

P(word | history) = P(class | history) * P(word | class).

* Classes: the end of a text, the ``SINGLES`` commonest words, and ``SUFFIXES`` classes
  of all other words by a hash of their last three bytes, so that an unseen word
  has a class as well.
* P(class | history): softmax over summed weights of hashed features, the last word,
  the word before it (skip) and both together.  ``BUCKETS`` rows of weights,
  whatever the corpus; this is all that is broadcast and sent to the driver.
* P(word | class) = (c + 0.5) / (N_class + 0.5 (V_class + 1)) from counts over the
  training texts: known words and one place for unknown ones sum to one.

Training starts at the smoothed log ratio of observed counts of (feature, class), divided
among the features.  Each round, tasks sum the expected counts over all training
texts, Spark adds the tasks' blocks up, and the weights take a step along the
gradient, observed minus expected, divided by the counts.

Counts of the commonest words, at most ``HEAD``, travel with the tasks; the other words of a text
are joined with the table of counts.

Cases: a null or empty text is one token, the end; without training texts all counts are
zero; repeated rows are scored each and each counts in training; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnforge.llm import words as W
from turnforge.llm.common import chunks, fold_of, stored

SINGLES = 15
SUFFIXES = 32
CLASSES = 1 + SINGLES + SUFFIXES
BUCKETS = 1 << 15
FEATURES = 3
HEAD = 1 << 17
ROUNDS = 2
RATE = 0.6
PRIOR = 200.0
BLOCK = 256  # rows of weights in a block that tasks send
END = np.uint64(0x454E44)  # the end's name; words' names are mixed hashes
CHUNK = 1 << 20
STEP = 1 << 12  # tokens scored at once: their scores stay in the processor's cache


@dataclass
class Tokens:
    name: np.ndarray  # with an end after each text's words
    suffix: np.ndarray  # class by suffix, from 0
    first: np.ndarray  # place of each text's first token, and one more


def tokens(buf: np.ndarray, off: np.ndarray) -> Tokens:
    starts, ends, first = W.spans(buf, off, W.NOT_SPACE)
    n = len(off) - 1
    low = W.LOWER[buf] if len(buf) else np.zeros(1, np.uint8)
    tail = np.zeros(len(starts), W.U)
    for k in (1, 2, 3):
        tail = tail * W.U(257) + np.where(ends - k >= starts, low[np.maximum(ends - k, 0)].astype(W.U) + W.U(1), W.U(0))
    doc = np.repeat(np.arange(n), np.diff(first))
    at = np.arange(len(starts)) + doc
    name = np.full(len(starts) + n, END, W.U)
    name[at] = W.names(buf, starts, ends)
    suffix = np.zeros(len(name), np.int64)
    suffix[at] = (W.mix(tail) % W.U(SUFFIXES)).astype(np.int64)
    return Tokens(name, suffix, first + np.arange(n + 1))


def lookup(sorted_names: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each name in ``sorted_names`` and whether it is there."""
    if not len(sorted_names):
        return np.zeros(len(name), np.int64), np.zeros(len(name), bool)
    at = np.minimum(np.searchsorted(sorted_names, name), len(sorted_names) - 1)
    return at, sorted_names[at] == name


def classes(t: Tokens, singles: np.ndarray) -> np.ndarray:
    """0 for the end, 1.. for the singles (sorted names), then the suffix classes."""
    at, found = lookup(singles, t.name)
    return np.where(t.name == END, 0, np.where(found, 1 + at, 1 + SINGLES + t.suffix))


def features(t: Tokens) -> np.ndarray:
    """(tokens, FEATURES) buckets."""
    before = np.zeros((2, len(t.name)), W.U)
    place = np.arange(len(t.name)) - np.repeat(t.first[:-1], np.diff(t.first))
    for k in (1, 2):
        before[k - 1, k:] = t.name[:-k]
        before[k - 1][place < k] = W.U(k)  # begins before the text does
    low = W.U(BUCKETS - 1)
    return np.stack([W.mix(before[0] + W.U(1)) & low, W.mix(before[1] * W.MULT + W.U(2)) & low, W.mix(W.mix(before[0]) * W.MULT + before[1]) & low], axis=1).astype(np.int64)


def raw_scores(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Summed weights of each token's features, by class; the bias is in the weights (``with_bias``)."""
    z = weights.take(f[:, 0], axis=0)
    part = np.empty_like(z)
    for k in range(1, FEATURES):
        np.take(weights, f[:, k], axis=0, out=part, mode="clip")
        z += part
    return z


def with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights that sum to at most 3 * 25 for any history, so that their exponentials need no shift."""
    return (np.clip(weights, -20, 20) + bias / FEATURES).astype(np.float32)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _count(batches):
    kept: list[tuple] = []

    def flush():
        name, suffix, n = (np.concatenate([k[i] for k in kept]) for i in range(3))
        order = np.argsort(name, kind="stable")
        name, suffix, n = name[order], suffix[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(name[new].view(np.int64)), pa.array(suffix[new].astype(np.int32)), pa.array(np.add.reduceat(n, new))], ["name", "suffix", "n"])

    for batch in batches:
        for _, _, buf, off in chunks(batch):
            t = tokens(buf, off)
            name, at, n = np.unique(t.name, return_index=True, return_counts=True)
            kept.append((name, t.suffix[at], n.astype(np.int64)))
        if sum(len(k[0]) for k in kept) > 2_000_000:
            yield flush()
            kept = []
    if kept:
        yield flush()


def _blocks(total: np.ndarray):
    for b in range(0, BUCKETS, BLOCK):
        part = total[b:b + BLOCK]
        if part.any():
            yield b // BLOCK, np.ascontiguousarray(part, np.float32).tobytes()


def _observed(singles):
    def observe(batches):
        total = np.zeros(BUCKETS * CLASSES, np.int64)
        for batch in batches:
            for _, _, buf, off in chunks(batch, limit=CHUNK):
                t = tokens(buf, off)
                c = classes(t, singles)
                f = features(t)
                for k in range(FEATURES):
                    total += np.bincount(f[:, k] * CLASSES + c, minlength=len(total))
        yield _packed(total.reshape(BUCKETS, CLASSES))
    return observe


def _packed(total: np.ndarray) -> pa.RecordBatch:
    rows = list(_blocks(total))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "cells"])


def _expected(model):
    def expect(batches):
        weights = model.value
        total = np.zeros((CLASSES, BUCKETS))
        for batch in batches:
            for _, _, buf, off in chunks(batch, limit=CHUNK):
                f = features(tokens(buf, off))
                by_class = np.empty((CLASSES, len(f)), np.float32)
                for lo in range(0, len(f), STEP):
                    p = raw_scores(weights, f[lo:lo + STEP])
                    np.exp(p, out=p)
                    p /= p.sum(axis=1, keepdims=True)
                    by_class[:, lo:lo + STEP] = p.T
                for bucket in np.ascontiguousarray(f.T):
                    for c in range(CLASSES):
                        total[c] += np.bincount(bucket, by_class[c], BUCKETS)
        yield _packed(total.T)
    return expect


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(cells, np.float32)
            sums[b] = sums[b] + part if b in sums else part.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "cells"])


def _table(train: DataFrame, function) -> np.ndarray:
    """Sums over all tasks of (BUCKETS, CLASSES) cells; the result is of this fixed size."""
    kinds = "block int, cells binary"
    got = train.mapInArrow(function, kinds).repartition("block").mapInArrow(_add_up, kinds).toArrow()
    out = np.zeros((BUCKETS // BLOCK, BLOCK * CLASSES))
    for b, cells in zip(got["block"].to_pylist(), got["cells"].to_pylist(), strict=True):
        out[b] = np.frombuffer(cells, np.float64)
    return out.reshape(BUCKETS, CLASSES)


@dataclass
class Model:
    counts: DataFrame  # name, suffix, c of the training tokens
    n: int
    v: int
    head: tuple[np.ndarray, np.ndarray]  # names, sorted, and counts
    singles: np.ndarray
    class_norm: np.ndarray  # log10(N_class + 0.5 (V_class + 1))
    weights: np.ndarray  # with the bias


def train(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> Model:
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(texts.mapInArrow(_count, "name long, suffix int, n long").groupBy("name").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("c")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the commonest words: those above the least power-of-two step that at most ``head`` words reach
    steps = counts.groupBy(F.floor(F.log2("c") * 64).cast("int").alias("step")).agg(F.count("*").alias("words")).collect()
    enough = min((r["step"] for r in steps if sum(q["words"] for q in steps if q["step"] >= r["step"]) <= head), default=1 << 20)
    top = counts.where(F.floor(F.log2("c") * 64) >= enough).toArrow()
    name, c = top["name"].to_numpy().view(np.uint64), top["c"].to_numpy()
    singles = np.sort(name[np.lexsort((name, -c))][:SINGLES + 1])
    singles = singles[singles != END][:SINGLES]
    order = np.argsort(name)

    single = F.col("name").isin([int(s) for s in singles.view(np.int64)])
    label = F.when(F.col("name") == int(END), F.lit(-2)).when(single, F.lit(-1)).otherwise(F.col("suffix"))
    by_class = counts.where(~single).groupBy(label.alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    n_class[1 + np.searchsorted(singles, singles)], v_class[1:1 + len(singles)] = [c[name == s][0] for s in singles], 1
    for row in by_class:
        at = 0 if row["class"] == -2 else 1 + SINGLES + row["class"]
        n_class[at], v_class[at] = row["n"], row["v"]

    observed = _table(texts, _observed(singles))
    share = (n_class + 0.5) / (n_class.sum() + 0.5 * CLASSES)
    of_bucket = observed.sum(axis=1, keepdims=True)
    weights = (np.log((observed + PRIOR * share) / (of_bucket + PRIOR)) - np.log(share)) / FEATURES
    bias = np.log(share)
    for _ in range(rounds):
        model = docs.sparkSession.sparkContext.broadcast(with_bias(weights, bias))
        expected = _table(texts, _expected(model))
        model.unpersist()
        weights = weights + RATE * (observed - expected) / (np.maximum(observed, expected) + PRIOR * share)
    return Model(counts, int(total["n"]), int(total["v"]), (name[order], c[order]), singles, np.log10(n_class + 0.5 * (v_class + 1)), with_bias(weights, bias))


ROWS = "row long, doc_id long, n_tokens long, known long, head_log double, class_log double, rare array<struct<name:long,tf:int>>"


def _score(shared):
    def score(batches):
        (names, counts), singles, norm, weights = shared.value
        log_c = np.log10(counts + 0.5)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, buf, off in chunks(batch, limit=CHUNK):
                t = tokens(buf, off)
                n = hi - lo
                c = classes(t, singles)
                f = features(t)
                token = np.empty(len(c))
                for i in range(0, len(f), STEP):
                    z = raw_scores(weights, f[i:i + STEP])
                    own = z[np.arange(len(z)), c[i:i + STEP]]
                    token[i:i + STEP] = own - np.log(np.exp(z, out=z).sum(axis=1))
                token = token / np.log(10) - norm[c]
                at, found = lookup(names, t.name)
                doc = np.repeat(np.arange(n), np.diff(t.first))
                sums = lambda x, doc=doc, n=n: np.bincount(doc, x, n)
                rare, of = t.name[~found], doc[~found]
                order = np.lexsort((rare, of))
                rare, of = rare[order], of[order]
                new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])])) if len(rare) else np.empty(0, np.int64)
                tf = np.diff(np.append(new, len(rare))).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(rare[new].view(np.int64)), pa.array(tf)], ["name", "tf"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[new], np.arange(n + 1)).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), batch.column("doc_id").slice(lo, n), pa.array(np.diff(t.first)), pa.array(sums(found & True).astype(np.int64)),
                                                  pa.array(sums(np.where(found, log_c[at] if len(log_c) else 0.0, 0.0))), pa.array(sums(token)), lists],
                                                 ["row", "doc_id", "n_tokens", "known", "head_log", "class_log", "rare"])
                row += n
    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (both log10) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.head, model.singles, model.class_norm, model.weights))
    rows = stored(_text(docs).mapInArrow(_score(shared), ROWS), "scored-rows")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.name", "r.tf")
    c = F.coalesce("c", F.lit(0))
    of_rare = (rare.join(model.counts.select("name", "c"), "name", "left").groupBy("row")
               .agg(F.sum(F.col("tf") * F.log10(c + F.lit(0.5))).alias("rare_log"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known")))
    words = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0))
    base = F.lit(float(np.log10(model.n + 0.5 * (model.v + 1))))
    return rows.drop("rare").join(of_rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        (words - F.col("n_tokens") * base).alias("base_score"), (words + F.col("class_log")).alias("score"))


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Scores of all rows by a model trained on those outside the held-out fold (crc32 of the id modulo 5 is 1)."""
    model = train(docs.where(fold_of() != 1))
    return score(docs, model).withColumn("held_out", fold_of() == 1).withColumn("train_tokens", F.lit(model.n).cast("long"))
