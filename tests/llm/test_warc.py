import hashlib

import pytest

from kerbline.llm import warc
from kerbline.session import Written

SCHEMA = "page_id long, url string, html string, digest string, file string"


def awkward_pages():
    long = "<p>" + "word " * 60 + "</p>"
    fake = "text\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 3 + long
    rows = [(i, f"http://h/{i}", f"<html>{i}{'é' * i}</html>" * (1 + i % 7), "x", "y") for i in range(40)]
    rows += [(100 + i, "u", long, "x", "y") for i in range(8)] + [(i, "u", fake, "x", "y") for i in (60, 50, 70)]
    rows += [(80, None, None, None, None), (81, "u\r\nWARC-Type: revisit", "", "x", "y"), (82, "u", "x" * 99, "x", "y"), (83, "u", "x" * 99, "x", "y"),
             (84, "u", "WARC/1.0\r\n", "x", "y"), (85, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n" + "z" * 200, "x", "y"),
             (86, "u", "x" * 40_000, "x", "y"), (None, "u", long, "x", "y"), (None, None, None, None, None), (100, "u", long, "x", "y"), (104, "u", long, "x", "y")]
    return rows


def expected(rows):
    least = {}
    for i, _, html, *_ in rows:
        if i is not None and len((html or "").encode()) >= 100:
            least[html] = min(least.get(html, i), i)
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        first = least.get(html) if i is not None else None
        again = first is not None and i > first
        out.append((i is None, i or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else -1))
    return sorted(out)


@pytest.mark.parametrize("split", ["134217728", "300", "4000"])
def test_round_trip(spark, split):
    """Also when every file is read in many pieces, so that the chain runs from split to split."""
    rows = awkward_pages()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        pages = spark.createDataFrame(rows, SCHEMA).coalesce(2)
        got = warc.page_records(pages).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == expected(rows)


def test_files_are_warc(spark, tmp_path):
    """A plain reader that trusts only lengths finds the same records."""
    rows = awkward_pages()
    written = Written(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"), written)
    found = 0
    for path in (tmp_path / "w").glob("part-*"):
        data, at = path.read_bytes(), 0
        while at < len(data):
            head, _, rest = data[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.0\r\nWARC-Type: ")
            length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert rest[length:length + 4] == b"\r\n\r\n"
            at += len(head) + 4 + length + 4
            found += 1
        assert at == len(data)
    assert found == len(rows)


def test_broken_chain_ends_the_file(spark, tmp_path):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\nabcde\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record.format(1, 5) + record.format(2, 7) + record.format(3, 5)).encode())
    (tmp_path / "b.warc").write_bytes((record.format(4, 5) + record.format(5, 5)).encode()[:-3])
    (tmp_path / "c.warc").write_bytes(b"junk" + record.format(6, 5).encode())
    got = warc.read_archives(spark, str(tmp_path), Written(spark, "test")).collect()
    assert sorted(r.record_id for r in got) == ["<urn:page:1>", "<urn:page:4>"]
    assert {r.payload_digest for r in got} == {hashlib.sha256(b"abcde").hexdigest()}


@pytest.mark.parametrize("split", ["300", "134217728"])
def test_bad_boundaries_in_any_split(spark, tmp_path, split):
    """A record counts if both its ends are boundaries, wherever the file is cut."""
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    good = [record.format(i, 5 + i, "a" * (5 + i)) for i in range(12)]
    expected = set()
    for name, bad, text in (("a", 4, record.format(4, 7, "abcde")), ("b", 7, record.format(7, 100, "abcde")), ("c", 11, record.format(11, 4, "abcde")),
                            ("d", 9, record.format(9, 10**6, "abcde")), ("e", 2, record.format(2, "x", "abcde"))):
        (tmp_path / f"{name}.warc").write_text("".join([*good[:bad], text, *good[bad + 1:]]), newline="")
        expected |= {(f"{name}.warc", f"<urn:page:{i}>") for i in range(bad)}
    inner = record.format(50, 3, "xyz")
    (tmp_path / "f.warc").write_text("".join([good[0], record.format(1, len(inner) * 3, inner * 3), *good[2:]]), newline="")
    expected |= {("f.warc", f"<urn:page:{i}>") for i in range(12)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = warc.read_archives(spark, str(tmp_path), Written(spark, "test")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.file.rsplit("/", 1)[1], r.record_id) for r in got} == expected and len(got) == len(expected)
    assert {r.payload_bytes for r in got if r.file.endswith("f.warc") and r.record_id == "<urn:page:1>"} == {3 * len(inner)}


def test_no_pages(spark):
    assert warc.page_records(spark.createDataFrame([], SCHEMA)).collect() == []
