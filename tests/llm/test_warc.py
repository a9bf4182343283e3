import gzip
import hashlib

from basketlens.llm import warc

BIG = "<p>" + "ü" * 600
ODD = "x" * 1000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"


def archive(spark, tmp_path, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, **more)
    return path


def rows_of(*pages):
    return [(i, u, h, "clash") for i, u, h in pages]


def test_round_trip_and_revisits(spark, tmp_path):
    rows = rows_of(
        (1, "http://a", BIG), (2, None, BIG), (5, "http://c\r\nX: y", BIG), (3, "u", "small"), (4, "u", "small"),
        (6, "u", None), (7, "u", ""), (8, "u", ODD), (None, "u", ODD), (9, "u", "y" * 200_000),
    )
    path = archive(spark, tmp_path, rows)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    for page_id, url, html, _ in rows:
        data = (html or "").encode()
        r = got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert bytes(r["payload"]) == (data if r["record_type"] == "response" else b"")
        assert r["url"] == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 5, 2: 5, None: 8}
    assert got[1]["refers_to_record"] == got[5]["record_id"]


def test_archives_are_small_and_readable_by_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    path = archive(spark, tmp_path, rows_of(*((i, "u", f"{i}" * 400) for i in range(200))))
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) > 8
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert len(list(warc.parse_archive(whole))) == 200 == warc.read_archives(spark, path, payload=False).count()


def test_repeated_rows_and_empty_table(spark, tmp_path):
    path = archive(spark, tmp_path, rows_of((1, "u", BIG), (1, "u", BIG), (None, "v", BIG + "2"), (None, "v", BIG + "2")))
    assert {r["record_type"] for r in warc.read_archives(spark, path).collect()} == {"response"}
    (tmp_path / "e").mkdir()
    path = archive(spark, tmp_path / "e", [])
    assert warc.read_archives(spark, path).count() == 0
