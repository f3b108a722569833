import base64
import gzip
import hashlib

import pytest

from tickweave.llm import warc


def by_hand(rows, least=0):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least and page is not None:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = sum((h or "").encode() == raw for _, _, h in rows) > 1 and len(raw) >= least
        again = same and raw in first and first[raw] != page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a.example/x y\n", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "", None), (4, "http://b.example/é", ""), (5, "u", "WARC/1.1\r\n\r\nx\r\n\r\n"), (0, "z", "a\n\nb\r\n\r\n"),
    (7, "q", "ñ" * 30_000), (8, "q", "ñ" * 30_000), (8, "q", "ñ" * 30_000), (None, "n", "<p>one</p>"), (None, "n", "alone"), (-4, "neg", "<p>one</p>"),
]


@pytest.mark.parametrize("least", [0, 11])
def test_records_as_by_hand(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    got = warc.read_warc(spark, warc.convert(spark, warc.write_arc(pages, file_rows=2), least_bytes=least, file_rows=3)).drop("target_uri", "warc_date")
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(ROWS, least)


def test_many_files_and_the_bytes_of_a_record(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    warc.write_arc(pages, f"{tmp_path}/arc", 4)
    raw = [p.read_bytes() for p in sorted((tmp_path / "arc").glob("*.gz"))]
    assert len(raw) == 3 and all(gzip.decompress(r).startswith(b"filedesc://") for r in raw)
    bodies = [body.partition(b"\r\n\r\n")[2] for r in raw for _, _, _, body in warc.arc_records(r)]
    assert sorted(bodies) == sorted((h or "").encode() for _, _, h in ROWS)


def test_both_versions_of_header_lines_and_members():
    one = b"filedesc://a 0.0.0.0 20240102030405 text/plain 70\n" + b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n".ljust(70, b"\n") + b"http://a 1.2.3.4 20240102030405 text/html 5\nab\ncd\n"
    said = b"2 0 x\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://b 0.0.0.0 20240102030405 text/plain 200 - - 0 b %d\n" % len(said) + said + b"\nhttp://b 1.2.3.4 20240102030405 text/html 200 - - 0 b 3\nxyz\n"
    assert list(warc.arc_records(one)) == [("http://a", "20240102030405", "text/html", b"ab\ncd")]
    assert list(warc.arc_records(gzip.compress(two[:50]) + gzip.compress(two[50:]))) == [("http://b", "20240102030405", "text/html", b"xyz")]
    with pytest.raises(ValueError, match="ends"):
        list(warc.arc_records(one[:-4]))


def test_urls_with_other_spaces_and_of_a_version_block(spark):
    urls = [*(f"http://a.example/x{c}y" for c in "\u1680\u2003\u2028\u2029\u202f\u205f\u3000"), "http://a.example/\u3000a\u2003b\u2028c\u202fd\u1680e", "filedesc://page.arc", "filedesc://a\u3000b"]
    rows = [(i, url, f"<p>{i}</p>") for i, url in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = warc.archived(pages)
    assert sorted(map(tuple, got.select("page_id", "target_uri").collect())) == [r[:2] for r in rows]
    assert sorted(map(tuple, got.drop("target_uri", "warc_date").collect()), key=str) == by_hand(rows)


def test_archives_that_follow_one_another(spark, tmp_path):
    pages = spark.createDataFrame([(1, "filedesc://p", "1 0 x\nURL IP-address ")], "page_id long, url string, html string").coalesce(1)
    warc.write_arc(pages, f"{tmp_path}/arc")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "arc").glob("*.gz"))
    assert [r[0] for r in warc.arc_records(raw * 2)] == ["filedesc://p"] * 2


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
