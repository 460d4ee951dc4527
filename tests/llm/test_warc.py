import gzip
import io

import pytest

from ledgerline.llm import warc
from ledgerline.storage import scratch_path

SCHEMA = "page_id bigint, url string, html string, file string, digest_ok string"
ROWS = [(k, f"http://x/{k}?a=%20b", f"<p>é{k}</p>\r\n\r\nWARC/1.1\r\n" * (k % 9), "f", "d") for k in range(200)]
ODD = [(None, None, None, "f", "d"), (1000, "", "", "f", "d"), (1001, "a b\r\nX: y%0A\t", "\r\n\r\n", "f", "d"), (1, "http://same", "same", "f", "d"), (1, "http://same", "same", "f", "d"), (-5, "ü", "x" * 3_000_000, "f", "d")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS + ODD, SCHEMA).repartition(3)
    got = warc.round_trip(spark, pages).collect()
    key = lambda r: tuple((x is not None, x or type(x)()) if x is not None else (False, "") for x in r)
    assert sorted(((r.page_id, r.url, r.html) for r in got), key=lambda r: repr(r)) == sorted((r[:3] for r in ROWS + ODD), key=lambda r: repr(r))
    assert all(r.digest_ok and r.content_length == len((r.html or "").encode()) for r in got)
    assert key(("a", None)) == key(("a", None))
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def parse(data):
    return [(h.get("x-page-id"), b) for h, b in warc.records(io.BytesIO(data))]


def test_one_member_a_record_and_pieces_of_any_size(monkeypatch):
    data = b"".join(warc.record(k, None, "body " * k) for k in range(20))
    whole = parse(data)
    assert whole == [(str(k), b"body " * k) for k in range(20)]
    assert parse(gzip.decompress(data)) == whole  # a plain file
    assert parse(gzip.compress(gzip.decompress(data))) == whole  # many records in a member
    for piece in (1, 7, 100):
        monkeypatch.setattr(warc, "PIECE", piece)
        assert parse(data) == whole
    assert parse(b"") == []


@pytest.mark.parametrize("damage", [lambda d: d[:-9], lambda d: d + b"no gzip", lambda d: d + warc.record(1, None, "x")[:40]])
def test_damaged_files_give_what_comes_before(spark, damage):
    good = b"".join(warc.record(k, "u", "text") for k in range(5))
    base = scratch_path(spark, "damaged").removeprefix("file://")
    import os

    os.makedirs(base)
    with open(f"{base}/a.warc.gz", "wb") as f:
        f.write(damage(good))
    rows = warc.read_warc(spark.createDataFrame([(f"file://{base}/a.warc.gz",), (None,)], "file string")).collect()
    errors = [r for r in rows if r.error]
    assert len(errors) == 1 and len(rows) - 1 >= 4 and all(r.digest_ok for r in rows if not r.error)


def test_wrong_digests_are_told(spark):
    plain = gzip.decompress(warc.record(1, "u", "text")).replace(b"text\r\n\r\n", b"tExt\r\n\r\n")
    (headers, block), = warc.records(io.BytesIO(gzip.compress(plain)))
    assert warc._row("f", 0, headers, block)["digest_ok"] is False
    del headers["warc-block-digest"]
    assert warc._row("f", 0, headers, block)["digest_ok"] is None


@pytest.mark.parametrize("length", ["\u00b2", "-1", "", "1e3", "99999999999999999999", "9999999999"])
def test_malformed_lengths_are_damage(length):
    plain = gzip.decompress(warc.record(1, "u", "text")).replace(b"Content-Length: 4", f"Content-Length: {length}".encode())
    with pytest.raises(warc.Corrupt):
        list(warc.records(io.BytesIO(gzip.compress(plain))))


def test_page_ids_that_are_no_bigints_are_null():
    for given, expected in (("9" * 19, None), (str(2**63 - 1), 2**63 - 1), (str(-(2**63)), -(2**63)), ("x", None), ("\u0663", None)):
        assert warc._row("f", 0, {"x-page-id": given}, b"")["page_id"] == expected


def test_errors_are_numbered_after_the_records_before_them(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.record(k, "u", "text") for k in range(5)) + b"no gzip")
    rows = warc.read_warc(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "file string")).collect()
    assert sorted(r.record_no for r in rows) == list(range(6)) and next(r for r in rows if r.error).record_no == 5
