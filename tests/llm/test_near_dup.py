import itertools
import random

import numpy as np
import pytest

from tests.llm.cases import as_set, lower_ascii, no_docs, odd_docs, odd_rows, prose, with_clashes, words_of
from turnforge.llm import near_dup as N
from turnforge.llm.graph import components


def shingle_set(text, size):
    w = words_of(lower_ascii(text))
    if not w:
        return frozenset()
    return frozenset({tuple(w)} if len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)})


def brute(rows, size, percent):
    texts = {}
    for d, text, *_ in rows:
        if d is not None:
            texts[d] = min(texts.get(d, text or ""), text or "")
    sets = {d: shingle_set(t, size) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force_on_odd_rows(spark, size):
    got = N.near_duplicates(with_clashes(odd_docs(spark)), size, 80)
    want = brute(odd_rows(), size, 80)
    rows = as_set(got.where("doc_id is not null"), "doc_id", "n_shingles", "component_id", "kept")
    assert rows == sorted(((d, *want[d], d == want[d][1]) for d in want), key=repr)
    assert as_set(got.where("doc_id is null"), "component_id", "kept") == [(None, True)] * 3


def chain_rows():
    """A chain of small edits, a star of edits of one text, and texts that share a passage only."""
    pick = random.Random(3)
    text = prose(100, 150).split()
    rows = []
    for k in range(40):  # each differs from the last in two words: the ends are far apart
        rows.append((1000 + k, " ".join(text)))
        for _ in range(2):
            text[pick.randrange(len(text))] = f"w{pick.randrange(10**6)}"
    base = prose(200, 150).split()
    for k in range(60):
        w = list(base)
        for _ in range(pick.randrange(1, 12)):
            w[pick.randrange(len(w))] = f"v{pick.randrange(10**6)}"
        rows.append((2000 + pick.randrange(10**6), " ".join(w)))
    passage = prose(300, 60)
    rows += [(4_000_000 + k, passage + " " + prose(400 + k, 12)) for k in range(40)]
    pick.shuffle(rows)
    return rows


def test_chains_stars_and_shared_passages(spark):
    rows = chain_rows()
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    want = brute(rows, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def linked_sets(spark, sets, pivot, percent=80):
    """Components (by smallest member) of sets that are all in one bucket, ``pivot`` the most loaded."""
    members = spark.createDataFrame([(1, k, len(s), 1000 if k == pivot else 1) for k, s in sets.items()], "key long, rep long, n long, load long")
    arrays = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "doc_id long, names array<long>")
    label = {r.node: r.label for r in N._linked(members, arrays, percent).collect()}
    return {k: label.get(k, k) for k in sets}


def components_of(sets, percent=80):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}


def test_a_link_at_the_threshold_in_a_large_bucket(spark):
    p = set(range(90))
    sets = {k: p | {1000 + 10 * k, 1001 + 10 * k} for k in range(24)}  # 72/92 of the last one
    sets[0] |= {5000, 5001}
    sets[50] = set(p)
    sets[51] = set(range(72))  # 72/90 of 50 only
    want = components_of(sets)
    assert want[51] == 0 and components_of({k: s for k, s in sets.items() if k != 50})[51] == 51
    assert linked_sets(spark, sets, 0) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_large_buckets_equal_brute_force_near_the_threshold(spark, seed):
    pick = random.Random(seed)
    p = list(range(90))
    sets = {0: set(p) | {5000, 5001, 5002}, 1: set(p)}
    for k in range(2, 60):
        lost = pick.choice([0, 3, 9, 17, 18, 18, 19])
        sets[k] = set(pick.sample(p, 90 - lost)) | {100 + pick.randrange(60) for _ in range(pick.choice([0, 0, 1, 9, 20]))}
    assert linked_sets(spark, sets, 0) == components_of(sets)


def cluster(pick, n, p=range(90)):
    """A base, and copies of which some are linked with it, some with each other only, some with none."""
    p = list(p)
    sets = {0: set(p), 1: set(p[1:]) | {99}}
    shared = [{200 + 10 * j + i for i in range(9)} for j in range(4)]
    for k in range(2, n):
        lost = pick.choice([1, 4, 9, 14, 18, 19])
        sets[k] = set(pick.sample(p, 90 - lost)) | {10_000 + 100 * k + i for i in range(pick.choice([0, 2, 6, 12]))}
        sets[k] |= pick.choice([set(), set(), *shared])
    return sets


def test_near_pivots_make_one_group(spark, monkeypatch):
    """Buckets without the base are those of its group: no member is taken apart twice."""
    pick = random.Random(7)
    sets = cluster(pick, 60)
    load = {k: 1000 if k == 0 else 200 - k for k in sets}
    buckets = {1: list(sets)} | {key: pick.sample(range(2, 60), 14) for key in range(2, 12)}
    members = spark.createDataFrame([(key, k, len(sets[k]), load[k]) for key, ks in buckets.items() for k in ks], "key long, rep long, n long, load long")
    arrays = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "doc_id long, names array<long>")
    rows = {}

    def counted(df, label, stored=N.stored):
        rows.setdefault(label, []).append((out := stored(df, label)).count())
        return out
    monkeypatch.setattr(N, "stored", counted)
    label = {r.node: r.label for r in N._linked(members, arrays, 80).collect()}
    assert {k: label.get(k, k) for k in sets} == components_of(sets)
    assert rows["differences"][0] == len(sets) - 1


@pytest.mark.parametrize("meet", [2, 256])
def test_element_buckets_of_either_kind_equal_brute_force(spark, monkeypatch, meet):
    monkeypatch.setattr(N, "MEET", meet, raising=False)
    sets = cluster(random.Random(11), 120)
    assert linked_sets(spark, sets, 0) == components_of(sets)


def test_empty_table(spark):
    assert N.near_duplicates(no_docs(spark)).count() == 0


def test_first_of_each_keeps_columns(spark):
    docs = odd_docs(spark)
    kept = N.first_of_each(docs, 5, 80)
    want = brute(odd_rows(), 5, 80)
    assert kept.columns == docs.columns
    assert as_set(kept, "doc_id") == sorted(((r[0],) for r in odd_rows() if r[0] is None or want[r[0]][1] == r[0]), key=repr)


def test_sketch_fills_and_estimates():
    pick = np.random.default_rng(1)
    for n in (1, 3, 40, 400, 5000):
        pool = pick.integers(0, 2**63, 2 * n, dtype=np.uint64)
        share = n * 4 // 5
        a, b = pool[:n], np.concatenate([pool[:share], pool[n:2 * n - share]])
        s = N.sketches(np.concatenate([a, b]), np.repeat([0, 1], [n, n]), 2)
        assert (s != np.iinfo(np.uint64).max).all()
        true = share / (2 * n - share)
        assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / N.SKETCH) ** 0.5 + 1e-9


def test_components_of_a_long_path(spark):
    path = spark.range(300).selectExpr("(id * 7) % 300 AS a", "((id + 1) * 7) % 300 AS b").where("a != 0 or b != 7")
    assert {r.label for r in components(path).collect()} == {0}
