import hashlib
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.cases import no_docs, odd_docs, odd_rows, with_clashes
from turnforge.llm import alignment as A

PATHS = A.default_paths()
TEXTS = ["  a  b ", "a  b 　c", "日本語 テスト。 x", "<|endoftext|> hi </s>", " <s>", "x " * 3 + "\n\n\t y", "''s 's it 's", "à la é  ü", "ab  cd \u0085 e \u0000 z",
         "🙂 🙂🙂  x", " ", "   ", "▁a ▁ b", "<0x41> <unk>", "ÀÅ x", "  1234567 89", "don't  CAN'T", " ​ x", "x" * 3000, "é" * 999 + " " * 1000 + "q", "ab" * 500 + " zz"]


def brute(rows):
    """Every column from whole-text encodings, cuts by set intersection."""
    a, b, t = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), A.tokens(PATHS)
    a.encode_special_tokens = True
    groups, held = [], Counter()
    for _, text in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        token = [[table[i] for i in side] for table, side in zip((t.a_bytes, t.b_bytes), ids, strict=True)]
        if not all(b"".join(x) == f" {text}".encode() for x in token):
            ids = ([], [])
        ends = [np.cumsum([len(x) for x in side]).tolist() if ids[0] else [] for side in token]
        cuts, at, found = sorted(set(ends[0]) & set(ends[1])), (0, 0), []
        for c in cuts:
            to = tuple(e.index(c, i) + 1 for e, i in zip(ends, at, strict=True))
            found.append([side[i:j] for side, i, j in zip(ids, at, to, strict=True)])
            at = to
        groups.append(found)
        held.update({(x, y) for g in found for x in g[0] for y in g[1]})
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (d, _), found in zip(rows, groups, strict=True):
        links = [(x, y) for g in found for x in g[0] for y in g[1]]
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in found)
        out.append((d, sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), len(links), sum(held[p] == most[p[0]] for p in links),
                    sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if found else ""))
    return out


def same(df, rows):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_odd_rows_against_brute_force(spark):
    same(A.token_alignment(with_clashes(odd_docs(spark))), [r[:2] for r in odd_rows()])


def test_spaces_special_tokens_and_scripts_against_brute_force(spark):
    rows = list(enumerate(TEXTS))
    same(A.token_alignment(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_groups_are_the_operators_output(spark):
    got = A.aligned(spark.createDataFrame([(1, "hello big world")], "doc_id long, text string")).where("counted_pair is null").first()
    assert got.groups.count(";") + 1 == got.n_groups and got.groups.replace(";", ",").replace("|", ",").count(",") + 1 == got.n_a + got.n_b


def test_empty_table(spark):
    assert A.token_alignment(no_docs(spark)).collect() == []


def test_cuts_of_random_intervals():
    """Long intervals without a cut, and cuts at one side only, found as by intersection."""
    pick = np.random.default_rng(5)
    for n, share in ((400, 0.5), (3000, 0.02), (3000, 0.0), (1, 1.0)):
        ends = np.arange(1, 2 * n + 1)
        both = pick.random(2 * n) < share
        side = pick.random(2 * n) < 0.5
        both[-1] = True
        x, y = ends[both | side], ends[both | ~side]
        got = A.shared_cuts(x, y, np.array([0, len(x)]), np.array([0, len(y)]))
        assert x[got[0] - 1].tolist() == y[got[1] - 1].tolist() == np.intersect1d(x, y).tolist()


def test_large_groups_are_counted_by_their_ids(monkeypatch):
    pick = np.random.default_rng(6)
    a, b = pick.integers(0, 9, 300), pick.integers(0, 7, 500)
    ends_a, ends_b, text = np.array([1, 300]), np.array([2, 500]), np.array([0, 1])
    plain = A._pairs(a, b, ends_a, ends_b, text, 7, 63)
    monkeypatch.setattr(A, "WHOLE", 10)
    monkeypatch.setattr(A, "LINKS", 20)
    assert [x.tolist() for x in A._pairs(a, b, ends_a, ends_b, text, 7, 63)] == [x.tolist() for x in plain]
    assert plain[2].sum() == 2 + 299 * 498
