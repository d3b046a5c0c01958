import gzip
from pathlib import Path

import pytest

from loam.llm import common
from loam.llm import warc as m

ROWS = [(1, "u1", "<p>x</p>"), (2, "u2", "<p>x</p>"), (3, None, None), (4, "a\r\nb", ""), (5, "u5", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (6, "u6", "é" * 50_000), (7, "u7", "<p>x</p>"), (8, "u8", "é" * 50_000)]


def back(spark, rows, **kw):
    path = m.new_path(spark, "warc-test")
    m.write(spark.createDataFrame([(*r, "z", 1, "u", 2) for r in rows], "page_id long, url string, html string, record string, n int, best string, rid int"), path, m.DATE, **kw)
    return path, {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in m.resolved(spark, path).collect()}


def test_round_trip(spark):
    path, got = back(spark, ROWS, piece_bytes=1, pieces=2)
    assert got == m.brute(ROWS)
    assert {r.url for r in m.read(spark, path).collect()} >= {"a%0D%0Ab", ""}


def test_small_payloads_are_responses(spark):
    _, got = back(spark, ROWS, min_bytes=9)
    assert got == m.brute(ROWS, 9) and got[1][2] == "response"


def test_pages_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in m.query(spark, small).collect()}
    assert got == m.brute(rows)


def test_empty_table_and_null_ids(spark):
    _, got = back(spark, [])
    assert got == {}
    _, got = back(spark, [(None, "u", "x"), (1, "v", "x")])
    assert got[None][2:] == ("revisit", 1)


def test_many_revisits_of_one_response(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_FROM", 3)
    rows = [(i, f"u{i}", "same" if i % 4 else f"own {i // 8}") for i in range(60)]
    assert back(spark, rows)[1] == m.brute(rows)


def test_rows_with_one_page_id(spark):
    path, _ = back(spark, [(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "d", "z")])
    assert sorted((r.page_id, r.url, r.record_type, r.refers_to) for r in m.resolved(spark, path).collect()) == [(1, "a", "revisit", 1), (1, "b", "response", None), (1, "c", "response", None), (2, "d", "response", None)]


@pytest.mark.parametrize("rows, hot", [(0, 1000), (0, 2)])
def test_many_digests_join_by_a_shuffle(spark, monkeypatch, rows, hot):
    monkeypatch.setattr(m, "BEST_ROWS", rows)
    monkeypatch.setattr(common, "HOT_FROM", hot)
    assert back(spark, ROWS)[1] == m.brute(ROWS)


def test_a_member_for_each_record_and_long_ones(spark):
    rows = ROWS + [(9, "long", "ab" * (9 << 20))]
    path, got = back(spark, rows, piece_bytes=1)
    assert got == m.brute(rows)
    files = [x.read_bytes() for x in Path(path.removeprefix("file:")).glob("part-*")]
    for content in files:  # another reader takes the file as a whole, and each record stands alone
        whole = gzip.decompress(content)
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert b"".join(m.members(content)) == whole and all(x.startswith(b"WARC/1.1") or not x for x in m.members(content))
    assert sum(x.count(b"WARC-Refers-To-Date: 2000-01-01") for x in map(gzip.decompress, files)) == 4
