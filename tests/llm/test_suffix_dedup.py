import hashlib
import struct

import numpy as np
import pytest

from tests.llm.cases import as_set, no_docs, odd_docs, odd_rows, prose, with_clashes
from turnforge.llm import suffix_dedup as S


def brute(rows):
    first = {}
    for d, text, *_ in rows:
        raw = (text or "").encode()
        if d is not None:
            for p in range(len(raw) - 49):
                s = raw[p:p + 50]
                if d < first.get(s, d + 1):
                    first[s] = d
    out = []
    for d, text, *_ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if d is not None:
            for p in range(len(raw) - 49):
                if first[raw[p:p + 50]] < d:
                    gone[p:p + 50] = True
        gone = gone[:len(raw)]
        starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def short(rows):
    return [r for r in rows if len(r[1] or "") < 50_000]


def test_equals_brute_force_on_odd_rows(spark):
    rows = short(odd_rows())
    docs = spark.createDataFrame(rows, odd_docs(spark).schema)
    assert as_set(S.remove_repeats(with_clashes(docs)), *COLUMNS) == brute(rows)


def test_long_and_periodic_texts(spark):
    rows = [(1, "ab" * 3000), (2, "x" + "ab" * 2000 + "y"), (3, "ab" * 24 + "a"), (4, "ab" * 25), (5, "z" * 5000), (6, "z" * 49), (7, "z" * 51)]
    assert as_set(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), *COLUMNS) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_edited_copies_and_shared_passages(spark, seed):
    pick = np.random.default_rng(seed)
    base, rows = prose(seed, 150), []
    for k in range(40):
        text = list(base)
        for _ in range(pick.integers(0, 9)):
            text[pick.integers(len(text))] = "é"
        lo, hi = sorted(pick.integers(0, len(text), 2))
        rows.append((int(pick.integers(0, 10**9)), "".join(text[lo:hi]) + prose(1000 + k, 15) + base[:int(pick.integers(40, 70))]))
    assert as_set(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), *COLUMNS) == brute(rows)


def test_small_chunks_and_segments(spark, monkeypatch):
    """Runs of one name over several chunks, and a text over several segments, change nothing."""
    import pyarrow as pa
    rows = [(k, prose(5, 40) + prose(50 + k, 5)) for k in range(30)]
    whole = pa.RecordBatch.from_pylist([{"doc_id": 1, "row_hash": 0, "text": "".join(prose(k, 200) for k in range(3)), "names": []}])
    plain = [b.to_pydict() for b in S._anchor_names([whole])]
    monkeypatch.setattr(S, "SEGMENT", 256)
    cut = [b.to_pydict() for b in S._anchor_names([whole])]
    assert {n for b in plain for n in b["name"]} == {n for b in cut for n in b["name"]}
    monkeypatch.undo()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_set(S.remove_repeats(docs), *COLUMNS) == brute(rows)


def test_rank_runs_in_pieces(monkeypatch):
    import pyarrow as pa
    head = struct.Struct("<qiB").pack
    runs = [{"name": 7, "doc_id": d, "stop": 0, "run": head(100 * d, 0, 20) + b"l" * 20 + b"r" * (14 + d % 3)} for d in range(60)]
    schema = pa.schema([("name", pa.int64()), ("doc_id", pa.int64()), ("stop", pa.int64()), ("run", pa.binary())])
    batches = [pa.RecordBatch.from_pylist(runs[k:k + 7], schema) for k in range(0, 60, 7)]
    ranges = lambda: sorted(tuple(r.values()) for b in S._rank_runs(batches) for r in b.to_pylist())
    whole = ranges()
    monkeypatch.setattr(S, "CHUNK", 200)
    assert ranges() == whole and len(whole) == 59


def test_empty_table(spark):
    assert S.remove_repeats(no_docs(spark)).count() == 0
