import gzip

import pytest

from tests.llm.cases import as_set, with_clashes
from turnforge.llm import warc
from turnforge.session import scratch_path

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    best = {}
    for p, _, body in rows:
        raw = (body or "").encode()
        if len(raw) >= least:
            best[raw] = max(best.get(raw, -(1 << 70)), -(1 << 69) if p is None else p)
    out = []
    for p, _, body in rows:
        raw = (body or "").encode()
        again = len(raw) >= least and p != best[raw] and not (p is None and best[raw] == -(1 << 69))
        out.append((p, len(raw), warc.sha1_base32(raw), "revisit" if again else "response", best[raw] if again else None))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
ROWS = [(1, "http://a.example.com/x?q=1", "<p>é"), (2, "http://a.example.com/x?q=1", "<p>é"), (3, None, None), (4, "", ""), (5, "not a url", "WARC/1.1\r\n\r\nx"), (6, "http://[bad", "y" * 300_000),
        (7, "http://b.example.com:8080/", "\r\n\r\n"), (8, "https://u@WWW.Example.com/a\r\nb", "z"), (9, "http://a.example.com/x?q=1", "z"), (-3, "http://c.org", "<p>é"), (2**62, "http://c.org", "w"), (2**62 + 1, "http://c.org", "w")]


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip_on_odd_pages(spark, least):
    pages = with_clashes(spark.createDataFrame(ROWS, SCHEMA))
    assert as_set(warc.round_trip(pages, least), *COLUMNS) == brute(ROWS, least)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "http://a.org", "q"), (5, "http://a.org", "q"), (7, "http://b.org", "r"), (7, "http://b.org", "r")]
    got = as_set(warc.round_trip(spark.createDataFrame(rows, SCHEMA)), "page_id", "record_type", "refers_to")
    assert got == sorted([(None, "revisit", 5), (5, "response", None), (7, "response", None), (7, "response", None)], key=repr)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_blocks_and_one_hot_host(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    pages = spark.range(500).selectExpr("id AS page_id", "concat('http://hot.example.com/', id % 3) AS url", "concat('<p>', id % 50) AS html")
    root = scratch_path(spark, "warc-test")
    manifest = warc.write_index(warc.write_archives(pages, f"{root}/a"), f"{root}/i")
    index = warc.Index(f"{root}/i", manifest)
    keys = [(warc.reversed_host(f"http://hot.example.com/{k % 3}"), k) for k in range(500)]
    assert all([c[1] for c in index.find(*key)] == [key[1]] for key in keys[::7])
    assert list(index.find("com,example,hot)/0", 1)) == [] and list(index.find("zz", 0)) == [] and list(index.find("", None)) == []
    got = warc.look_up(pages.where("page_id % 5 = 0"), f"{root}/a", f"{root}/i", manifest).collect()
    assert sorted(r.page_id for r in got) == list(range(0, 500, 5)) and {r.record_type for r in got if r.page_id < 450} == {"revisit"}


def test_records_parse_back_and_broken_ones_raise():
    raw = warc.record(7, "http://a.org/\n", b"x\r\n\r\ny")
    said, payload = warc.parse(gzip.decompress(gzip.compress(raw)))
    assert payload == b"x\r\n\r\ny" and said["page_id"] == 7 and said["url"] == "http://a.org/%0A" and said["payload_bytes"] == 6
    with pytest.raises(ValueError, match="as long"):
        warc.parse(raw[:-3])
    with pytest.raises(ValueError, match="not what"):
        warc.parse(raw.replace(b"\r\ny", b"\r\nz"))


def test_keys_sort_by_host():
    assert warc.reversed_host("https://M.a.example.com:443/p/q?x=1#f") == "com,example,a,m)/p/q?x=1"
    assert warc.reversed_host("http://a.org:81") == "org,a:81)/" and warc.reversed_host(None) == "" and warc.reversed_host("http://[x") == "http://[x"
