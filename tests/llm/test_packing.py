import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.cases import no_docs, odd_docs, odd_rows, with_clashes
from turnforge.llm import packing as P
from turnforge.llm.common import stored

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_equal_the_tokenizer_on_odd_rows(spark):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d, text, *_ in odd_rows():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4")
            want.append((d, k, at, len(part), zlib.crc32(part.tobytes())))
    rows = P.pack_documents(with_clashes(odd_docs(spark)), PATH).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    total = sum(r.length for r in rows)
    assert check_layout(rows, 4096) <= -(-total // 4096) + 1


def test_words_are_cut_where_the_tokenizer_cuts():
    tokenizer = Tokenizer.from_file(PATH)
    encoder = P.word_ids(PATH)
    texts = ["Hello,World. 'S I'm it's 3.14, ΑΣ. İstanbul é. x.́y a b\x1cc ..., ok!!.  <|endoftext|> it's.'ve 5,000.", "“quoted,” naïve—dash… ﬁ Å.　x", "", ".", " .a,b", "K K", "é.a ́b", "a" * 500 + "."]
    raw = [t.encode() for t in texts]
    ids, first = encoder.of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        assert ids[first[k]:first[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_rounds_place_every_piece_once_and_near_the_bound():
    pick = np.random.default_rng(3)
    for capacity, sizes in ((64, pick.integers(1, 65, 5000)), (64, np.full(999, 33)), (64, np.full(1000, 64)), (10, pick.integers(1, 4, 1000)), (8, np.empty(0, int))):
        counts = np.bincount(sizes, minlength=capacity + 1)
        runs = P.rounds(counts)
        placed, filled = np.zeros(capacity + 1, int), {}
        for length, rank, n, seq, offset in zip(*runs.values(), strict=True):
            assert rank == placed[length]
            placed[length] += n
            for k in range(seq, seq + n):
                assert filled.get(k, 0) == offset
                filled[k] = offset + length
        assert (placed == counts).all() and all(v <= capacity for v in filled.values())
        least = max(-(-sizes.sum() // capacity), (sizes > capacity / 2).sum())
        assert len(filled) <= least * 1.03 + 1


def test_small_capacity_and_a_hot_length(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('river ', cast(case when id % 3 = 0 then 6 else id % 11 end as int)) AS text")
    rows = P.pack(stored(P.pieces_of(docs, PATH, 16), "pieces"), 16).collect()
    assert len(rows) == 3000
    n = check_layout(rows, 16)
    assert n <= sum(r.length for r in rows) / 16 * 1.03 + 1


def test_empty_table(spark):
    assert P.pack_documents(no_docs(spark), PATH).count() == 0

def test_remembered_words_are_small_and_those_in_use_stay(monkeypatch):
    """pipeline, pack: a word takes tens of bytes in a worker, not hundreds; the least used go first and are encoded anew."""
    monkeypatch.setattr(P, "CACHE_WORDS", 1000)
    encoder, tokenizer = P.WordIds(PATH), Tokenizer.from_file(PATH)
    for turn in range(8):
        texts = ["river the", " ".join(f"w{k}x{turn}" for k in range(400)), "a" * 300, "the w1x0"]
        raw = [t.encode() for t in texts]
        ids, first = encoder.of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for k, t in enumerate(texts):
            assert ids[first[k]:first[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
        assert (np.diff(encoder.name.astype(object)) > 0).all() and len(encoder.name) <= 2000
    columns = (encoder.name, encoder.begin, encoder.size, encoder.used, encoder.flat)
    assert sum(c.nbytes for c in columns) < 64 * len(encoder.name) and encoder.flat.base is None or encoder.flat.base.nbytes < 64 * len(encoder.name)
    calls = []
    encode = encoder.encode
    encoder.encode = lambda words, **k: calls.append(words) or encode(words, **k)
    encoder.of(np.frombuffer(b"the river", np.uint8), np.array([0, 9]))
    assert not any(calls)
