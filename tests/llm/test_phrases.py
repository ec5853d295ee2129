import random
import re
from collections import Counter, defaultdict

import numpy as np

from tests.llm.cases import lower_ascii, no_docs, odd_docs, odd_rows, with_clashes
from turnforge.llm import phrases as P
from turnforge.llm import words as W

U = W.U


def brute(rows, least, top, cover=80):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower_ascii(text)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                count[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in found.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i:i + k]] = max(longer[g[i:i + k]], a)
        rows = []
        for g, a in found.items():
            if longer[g] and 100 * longer[g] >= cover * a:
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, r, g.decode(), -a, x, y, total[lang], -s) for r, (s, a, g, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def same(df, rows, least, top):
    want = brute(rows, least, top)
    assert sorted(map(tuple, df.collect())) == want
    return want


def test_odd_rows_against_brute_force(spark):
    assert same(P.collocations(with_clashes(odd_docs(spark)), 3, 40), [(r[1], r[2]) for r in odd_rows()], 3, 40)


def test_nested_and_tied_phrases_of_several_languages(spark):
    pick = random.Random(4)
    stems = ["New York City Hall", "new york", "is\tof", "AB,cd ef", "é ü ß", "x x x x x x", "one. two three", "漢字 と かな", "a b\x0bc d\x1fe"]
    rows = [(" ".join(pick.choice(stems) for _ in range(30)), pick.choice(["en", "de", None, "und"])) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    want = same(P.collocations(docs, 5, 1000, held=50), rows, 5, 1000)  # tasks build many transducers
    assert {r[0] for r in want} == {"en", "de", "und"} and same(P.collocations(docs, 5, 7), rows, 5, 7)


def test_a_bitmap_too_small_changes_nothing(spark):
    rows = [(r[1], r[2]) for r in odd_rows()]
    same(P.collocations(odd_docs(spark), 4, 100, bits=8), rows, 4, 100)


def test_empty_table_and_nothing_frequent(spark):
    assert P.collocations(no_docs(spark)).collect() == []
    assert P.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).collect() == []


def test_transducers_unite_and_look_up_like_counters():
    pick = np.random.default_rng(8)
    every, packed = Counter(), []
    for _ in range(4):
        paths = np.zeros((500, 4), U)
        length = pick.integers(1, 5, 500)
        for k in range(4):
            paths[:, k] = np.where(length > k, pick.integers(1, 6, 500), 0)
        n = pick.integers(1, 400, 500)
        for p, w in zip(paths.tolist(), n.tolist(), strict=True):
            every[tuple(p)] += w
        packed.append(P.Counts.of(*P._sum_sorted(paths, n)).pack())
    whole = P.Counts.unpack(P.union(packed).pack())
    assert dict(zip(map(tuple, whole.paths()[0].tolist()), whole.paths()[1].tolist(), strict=True)) == dict(every)
    asked = np.array([list(p) for p in every] + [[9, 0, 0, 0], [1, 9, 0, 0], [1, 2, 3, 9]], U)
    assert whole.weights(asked).tolist() == [every[tuple(p)] for p in asked.tolist()]
    assert P.union([P.Counts([]).pack()]).paths()[0].shape == (0, 4)


def test_products_past_64_bits_stay_exact(spark):
    a, l, r = 9_000_000_000_000_000, 9_500_000_000_000_001, 9_200_000_000_000_007
    got = spark.sql(f"select (cast({a} as decimal(20, 0)) * {P.SCALE}) div (cast({l} as decimal(20, 0)) + {r}) as score").first()[0]
    assert got == P.SCALE * a // (l + r)
