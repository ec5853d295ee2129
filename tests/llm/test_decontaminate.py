import hashlib

from pyspark.sql import functions as F

from tests.llm.cases import as_set, lower_ascii, no_docs, odd_docs, odd_rows, prose, with_clashes, words_of
from turnforge.llm import decontaminate as D

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ITEMS = [(1, prose(8, 80)), (2, "ONE, two"), (3, "one"), (4, None), (5, "?! ."), (6, prose(8, 80)), (7, prose(99, 50)), (7, prose(99, 50)), (None, prose(8, 80)), (8, "the same line here the same line"), (9, prose(1, 120)[:200])]


def brute(rows, items, window=10):
    wins = {}
    for i, text in items:
        w = words_of(lower_ascii(text), ALNUM)
        n = min(window, len(w))
        if i is not None and n:
            for p in range(len(w) - n + 1):
                wins.setdefault(tuple(w[p:p + n]), set()).add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for d, text, *_ in rows:
        w = words_of(lower_ascii(text), ALNUM)
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[p:p + n]))):
                    hit.update(range(p, p + n))
                    found |= got
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_equals_brute_force_on_odd_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(with_clashes(odd_docs(spark)), with_clashes(items))
    assert as_set(got, "doc_id", "n_words", "n_hit", "item_ids") == brute(odd_rows(), ITEMS)


def test_items_without_an_id_hit_and_contaminate(spark):
    items = spark.createDataFrame([(None, prose(8, 80)), (None, None), (4, "?")], "item_id long, text string")
    docs = odd_docs(spark)
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in D.contamination(docs, items).where("n_hit > 0").collect()}
    assert got == {d: (80, []) for d in (50, 51, 52)}
    assert as_set(D.clean(docs, items), "doc_id") == sorted(((r[0],) for r in odd_rows() if r[0] not in got), key=repr)


def test_a_full_bitmap_changes_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(odd_docs(spark), items, bits=7)
    assert as_set(got, "doc_id", "n_words", "n_hit", "item_ids") == brute(odd_rows(), ITEMS)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(no_docs(spark), items).count() == 0
    got = D.contamination(odd_docs(spark), items.limit(0))
    assert got.count() == len(odd_rows()) and got.where("n_hit > 0").count() == 0


def test_clean_keeps_columns_and_clean_rows(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    docs = odd_docs(spark)
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    bad = {r[0] for r in brute(odd_rows(), ITEMS[:1]) if r[2]}
    assert bad == {50, 51, 52}
    assert as_set(kept, "doc_id") == sorted(((r[0],) for r in odd_rows() if r[0] not in bad), key=repr)


def test_digest_of_no_items(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0]
