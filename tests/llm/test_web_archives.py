"""Archives of both formats against plain values, and pages through both."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from helixframe.llm import web_archives
from helixframe.session import delete, new_folder

HTML = [None, "", "a", "\r\n\r\n", "x\r\n\r\n", "\r\r\n\r\n\r\n\r\n\n\n", "WARC/1.1\r\n\r\nWARC-Type: x", "http://a 0.0.0.0 20240101000000 text/html 5\nabcde", "é\r\n", "\r", "\n" * 9, "a" * 300_000, "\r\n" * 5000]
SCHEMA = "page_id long, url string, html string, digest string, value binary, file long"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def rows():
    return [(100 - i if i % 7 else None, f"http://h/ {i}\n" if i % 3 else None, h, "clash", b"", 1) for i, h in enumerate(HTML * 3)]


@pytest.mark.parametrize("least", [0, 3])
def test_every_page_comes_back(spark, rows, least):
    got = web_archives.archive(spark.createDataFrame(rows, SCHEMA).repartition(3), least).collect()
    size = lambda h: len((h or "").encode())
    first = {}
    for p, _, h, *_ in rows:
        if size(h) >= least:
            key = digest(h)
            first[key] = min(first.get(key, (True, 0)), (p is None, p or 0))
    named = [(p, size(h), digest(h)) for p, _, h, *_ in rows]
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest) for r in got))) == sorted(map(str, named))
    assert all(r.intact for r in got) and len({r.record_id for r in got}) == len(rows)
    for key in {x[2] for x in named}:
        group = [r for r in got if r.payload_digest == key]
        if key not in first:
            assert all(r.record_type == "response" and r.refers_to is None for r in group)
            continue
        kept = [r for r in group if r.record_type == "response"]
        number = None if first[key][0] else first[key][1]
        assert [r.page_id for r in kept] == [number]
        assert all(r.record_type == "revisit" and r.refers_to == number for r in group if r not in kept)


def test_no_pages(spark):
    assert web_archives.archive(spark.createDataFrame([], SCHEMA)).collect() == []


def arc(version, records):
    block = f"{version} 0 Org\n{web_archives.FIELDS[version]}\n"
    head = {1: f"filedesc://old-{version}.arc 0.0.0.0 19970101120000 text/plain {len(block)}\n", 2: f"filedesc://old-{version}.arc 0.0.0.0 19970101120000 text/plain 200 - - 0 old.arc {len(block)}\n"}
    return head[version].encode() + block.encode() + b"\n" + b"".join(line + b"\n" + body + b"\n" for line, body in records)


def test_legacy_headers_of_both_versions(spark, tmp_path):
    html = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\nx\r\n\r\ny</p>"
    one = [(b"http://a/b c 10.0.0.1 19961031235959 text/html; charset=x %d" % len(html), html), (b"dns:a 10.0.0.2 199610312359 text/dns 7", b"A 1.2.3"), (b"http://a/none 10.0.0.1 19961031235959 no-type 0", b"")]
    two = [(b"http://b/ 10.0.0.3 20011231000000 text/html 200 abc - 123 old.arc %d" % len(html), html), (b"ftp://b/f 10.0.0.3 20011231000000 application/x 226 - - 999 old.arc 50", b"\0\xff cut short")]
    folder = tmp_path / "arcs"
    folder.mkdir()
    for v, records in ((1, one), (2, two)):
        (folder / f"old-{v}.arc.gz").write_bytes(gzip.compress(arc(v, records)))
    got = {r.url: r for r in web_archives.read_arc(spark, str(folder)).collect()}
    assert set(got) == {"filedesc://old-1.arc", "filedesc://old-2.arc", "http://a/b c", "dns:a", "http://a/none", "http://b/", "ftp://b/f"}
    assert (got["http://a/b c"].ip, got["http://a/b c"].date, got["http://a/b c"].mime) == ("10.0.0.1", "1996-10-31T23:59:59Z", "text/html; charset=x")
    assert got["dns:a"].date == "1996-10-31T23:59:00Z" and bytes(got["http://b/"].body) == html
    assert got["http://b/"].n_payload == len(b"<p>\nx\r\n\r\ny</p>") and got["ftp://b/f"].truncated and not got["dns:a"].truncated
    warcs = new_folder(spark, "warc")
    web_archives.convert(spark, str(folder), warcs)
    back = {r.url: r for r in web_archives.read_warc(spark, warcs).collect() if r.record_type != "warcinfo"}
    assert {u: r.record_type for u, r in back.items()} == {"http://a/b c": "response", "dns:a": "response", "http://a/none": "resource", "http://b/": "revisit", "ftp://b/f": "resource"}
    assert back["http://b/"].refers_id == back["http://a/b c"].record_id and bytes(back["http://a/b c"].payload) == b"<p>\nx\r\n\r\ny</p>"
    assert all(r.intact for r in back.values())
    delete(spark, warcs)


def test_files_are_archives(spark, tmp_path):
    web_archives.write_arc(spark.createDataFrame([(1, "http://a/", "<p>x</p>", "", b"", 1)], SCHEMA).coalesce(1), str(tmp_path / "a"))
    web_archives.convert(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path / "w").glob("*.gz")))
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"\r\n\r\n") and b"WARC-Type: response" in text and b"WARC-Payload-Digest: sha1:" + digest("<p>x</p>").encode() in text
    old = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "a").glob("*.gz"))
    assert old.startswith(b"filedesc://pages-00000.arc 0.0.0.0 20240101000000 text/plain ") and old.endswith(b"<p>x</p>\n")
