import zlib
from collections import Counter

import pytest

from tests.llm.cases import no_docs, odd_docs, odd_rows, with_clashes
from turnforge.llm import sharding as S
from turnforge.session import scratch_path


def check_law(rows, shards=16):
    """Slots gapless, bytes near the mean: no further than the tolerance and the largest row."""
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    by = Counter()
    for r in rows:
        by[r.shard] += r.size
    for shard in range(shards):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
        assert abs(by[shard] - total / shards) <= total / shards / S.PARTS + largest
    assert set(by) <= set(range(shards))


def test_odd_rows(spark):
    rows = S.assign(with_clashes(odd_docs(spark))).collect()
    raw = [(d, (t or "").encode()) for d, t, *_ in odd_rows()]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(((d, len(b) + 1, zlib.crc32(b)) for d, b in raw), key=repr)
    check_law(rows)


@pytest.mark.parametrize("text", ["one text for all", None])
def test_one_group_of_copies_is_cut(spark, text):
    rows = S.assign(spark.createDataFrame([(k % 50, text) for k in range(2000)], "doc_id long, text string")).collect()
    check_law(rows)
    assert Counter(r.shard for r in rows) == {k: 125 for k in range(16)}


def test_third_of_rows_in_one_group_and_some_huge_ones(spark):
    docs = [(k, "hot " * 10 if k % 3 else f"text {k} " * (1 + k % 40)) for k in range(3000)] + [(5000 + k, f"{k} " * 9000) for k in range(3)]
    rows = S.assign(spark.createDataFrame(docs, "doc_id long, text string"), 7).collect()
    check_law(rows, 7)
    ends = [r for r in rows if r.size > 9000]
    assert len(rows) == 3003 and len(ends) == 3


def test_result_does_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame([(k, f"text {k * 7919 % 1000} " * (1 + k % 13)) for k in range(1500)], "doc_id long, text string")
    got = [sorted(map(tuple, S.assign(d).collect())) for d in (docs.repartition(2), docs.orderBy("text").repartition(5, "text"))]
    assert got[0] == got[1]


def test_fewer_rows_than_shards_and_empty(spark):
    check_law(S.assign(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string")).collect())
    assert S.assign(no_docs(spark)).collect() == []


def test_written_shards_hold_all_rows_in_order(spark):
    path = scratch_path(spark, "test-shards")
    docs = with_clashes(odd_docs(spark)).selectExpr("*", "'x' as shard", "'y' as slot")
    S.write_shards(docs, path, 3)
    back = spark.read.parquet(path)
    assert sorted((repr(r.doc_id), r.text or "") for r in back.collect()) == sorted((repr(d), t or "") for d, t, *_ in odd_rows())
    assert set(docs.columns) == set(back.columns)
    for shard in range(3):
        slots = [r.slot for r in back.where(f"shard = {shard}").collect()]
        assert sorted(slots) == list(range(len(slots)))


def test_no_python_in_the_plan(spark):
    plan = S.assign(odd_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
