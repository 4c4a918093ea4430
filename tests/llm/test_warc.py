from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from labreports.llm.warc import assemble, inflated, parse_records, read_records, write_archives

LONG_PAGE = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 20_000


def round_trip(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, key string, kind string")
    path = str(tmp_path / "archives")
    write_archives(pages, path, **options)
    return assemble(read_records(spark, path)).collect()


def test_round_trip(spark, tmp_path):
    rows = [
        (1, "http://a.b/c?d", "same", "k", "x"), (2, "http://a.b", "same", "k", "x"), (9, "https://a.b/", "same", "k", "x"),
        (3, None, None, "k", "x"), (4, "u\r\nWARC-Type: x", "", "k", "x"), (5, "u", LONG_PAGE, "k", "x"),
        (6, "u", "once", "k", "x"), (6, "u", "once", "k", "x"), (None, "n1", "n", "k", "x"), (None, "n2", "n", "k", "x"),
        (2**62 + 1, "u", "large id", "k", "x"),
    ]
    got = round_trip(spark, tmp_path, rows)
    assert len(got) == 10 and sum(r.page_id == "None" for r in got) == 2
    by_id = {r.page_id: r for r in got}
    assert {k: (r.kind, r.refers_to_page) for k, r in by_id.items() if k in "129345"} == {
        "1": ("revisit", "9"), "2": ("revisit", "9"), "9": ("response", None),
        "3": ("revisit", "4"), "4": ("response", None), "5": ("response", None),
    }
    for page, url, html, *_ in rows:
        data, row = (html or "").encode(), by_id[str(page)]
        assert row.payload_bytes == len(data)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert row.request.block.startswith(b"GET ") and b"length: " in row.metadata.block
        if row.kind == "response":
            assert row.block.partition(b"\r\n\r\n")[2] == data
    assert str(2**62 + 1) in by_id


def test_small_payloads_are_never_revisits(spark, tmp_path):
    rows = [(k, "u", "abc", None, None) for k in range(3)] + [(k, "u", "abcd", None, None) for k in (7, 8)]
    got = {r.page_id: r.kind for r in round_trip(spark, tmp_path, rows, least_bytes=4)}
    assert got == {"0": "response", "1": "response", "2": "response", "7": "revisit", "8": "response"}


def archives(tmp_path):
    return [p.read_bytes() for p in sorted((tmp_path / "archives").glob("archive=*/part-*"))]


def test_archives_are_plain_warc(spark, tmp_path):
    round_trip(spark, tmp_path, [(1, "http://a", "x", None, None)])
    data = b"".join(inflated(b"".join(archives(tmp_path))))
    both = gzip.compress(b"a") + gzip.compress(b"b")
    assert b"".join(inflated(both)) == b"ab" and b"".join(inflated(data)) == data
    kinds = [headers["warc-type"] for headers, _ in parse_records([data])]
    assert kinds == ["response", "request", "metadata"] and data.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(parse_records([data[:-3]]))
    with pytest.raises(ValueError):
        list(parse_records([b"x" + data]))
    with pytest.raises(ValueError):
        list(inflated(gzip.compress(data)[:-20]))


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_records_are_read_from_any_parts(spark, tmp_path, step):
    round_trip(spark, tmp_path, [(k, "http://a", f"{k}\r\n\r\nWARC/1.1\r\n" * 9, None, None) for k in range(3)])
    packed = archives(tmp_path)
    data = b"".join(b"".join(inflated(x)) for x in packed)
    whole = list(parse_records([data]))
    parted = [part for x in packed for part in inflated(x, step)]
    assert max(map(len, parted)) <= step and list(parse_records(parted)) == whole and len(whole) == 9


def test_two_versions_of_a_page_are_two_captures(spark, tmp_path):
    rows = [(1, "u", "a", None, None), (1, "u", "b", None, None), (1, "u", "b", None, None), (2, "u", "b", None, None)]
    got = sorted((r.page_id, r.kind, r.refers_to_page, r.payload_digest) for r in round_trip(spark, tmp_path, rows))
    digest = {text: base64.b32encode(hashlib.sha1(text.encode()).digest()).decode() for text in "ab"}
    assert got == sorted(
        [("1", "response", None, digest["a"]), ("1", "revisit", "2", digest["b"]), ("2", "response", None, digest["b"])],
        key=str,
    )
    records = list(parse_records(b"".join(inflated(x)) for x in archives(tmp_path)))
    ids = {headers["warc-record-id"] for headers, _ in records}
    assert len(ids) == 9
    assert all(headers.get("warc-refers-to") in ids | {None} for headers, _ in records)


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(k, "u", f"{k} " + "x" * 1000 * (k % 5), None, None) for k in range(60)]
    got = round_trip(spark, tmp_path, rows, archive_bytes=10_000)
    assert len(got) == 60
    sizes = [sum(map(len, inflated(x))) for x in archives(tmp_path)]
    assert max(sizes) <= 10_000 + 6_000 and len(sizes) > 10


def test_copies_of_records_and_strays(spark, tmp_path):
    round_trip(spark, tmp_path, [(1, "http://a", "x", None, None)])
    records = read_records(spark, str(tmp_path / "archives"))
    assert assemble(records.union(records)).count() == 1
    assert assemble(records.where("kind <> 'request'")).first().request is None
    assert assemble(records.where("kind = 'request'")).count() == 0


def test_no_pages(spark, tmp_path):
    assert round_trip(spark, tmp_path, []) == []
