"""Packages against what was written, and the reader of directories against packages made by other means."""

import gzip
import hashlib
import io
import json
import random
import uuid
import zipfile

import pytest

from lodestar.llm import packages as P
from lodestar.llm.common import table
from lodestar.operators.store import shared_folder

SCHEMA = "page_id long, url string, html string, digest string, id int"


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) by the definition."""
    made = [(k, (h or "").encode()) for k, _, h, *_ in rows]
    first = {}
    for k, b in made:
        if len(b) >= P.LEAST_BYTES and k is not None:
            first[b] = min(first.get(b, k), k)
    again = lambda k, b: b in first and k != first[b]
    return sorted(((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again(k, b) else "response", first[b] if again(k, b) else None) for k, b in made), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_whole_table(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    assert got(P.archive_digest(df)) == plain(df.select("page_id", "url", "html").collect())


def odd_rows():
    rng = random.Random(4)
    copy, short = "é<p>copy</p>\r\n\r\n" * 20, "x" * 99
    rows = [(k, f"http://a.org/{k}", copy, "clash", 1) for k in range(30, 90)]  # one payload holds most rows
    rows += [(k, "http://b.org/", short, None, None) for k in range(100, 110)]
    rows += [(200, None, None, "", 0), (201, "", "", "", 0), (202, "no url\r\nX: y", "WARC/1.1\r\n\r\nPK\x05\x06" * 50, "", 0), (203, "http://c.org/ä b?q=%20#\x00", "<\x00>" * 40, "", 0)]
    rows += [(300, "http://d.org/", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(700_000)), "", 0), (5, "http://e.org/", "y" * 100, "", 0), (4, "http://e.org/2", "y" * 100, "", 0)]
    rows += [(400, "http://f.org/", "twin" * 50, "", 0)] * 3  # repeated rows
    return [*rows, (None, "http://g.org/", "y" * 100, "", 0), (None, "http://g.org/", "only nulls" * 20, "", 0), (None, "http://g.org/", "only nulls" * 20, "", 0)]


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(P.archive_digest(df)) == plain(rows)


def test_empty_table(spark):
    assert P.archive_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_packages_stretches_and_index_ranges(spark, monkeypatch):
    """Records, urls and places are right however small packages, index ranges and stretches are."""
    for name, value in (("INDEX_BYTES", 300), ("STRETCH_BYTES", 2000), ("BATCH_BYTES", 1000)):
        monkeypatch.setattr(P, name, value)
    rows = odd_rows()
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4()}"
    written = P.write(spark.createDataFrame(rows, SCHEMA).repartition(3), folder)
    assert P.listed(spark, folder).count() == written.count() and written.agg({"records": "sum"}).first()[0] == len(rows)
    back = P.read(P.listed(spark, folder)).collect()
    assert len(back) == len(rows)
    assert sorted(str(r.url) for r in back) == sorted(str(None if u is None else P._escaped(u)) for _, u, *_ in rows)
    texts = {r.record_id: r.payload.decode() for r in back if r.record_type == "response" and r.record_id != "<urn:row>"}
    assert texts["<urn:row:300>"] == next(h for k, _, h, *_ in rows if k == 300) and texts["<urn:row:201>"] == ""
    assert all(r.stated_digest == r.payload_digest for r in back if r.record_type == "response")


@pytest.mark.parametrize("limit", [10, 1 << 31])
@pytest.mark.parametrize("before", [b"", b"something before" * 10])
def test_directories(monkeypatch, limit, before):
    """Members of files with 64-bit directories, with a comment that looks like an end, and with something before them."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    out = io.BytesIO()
    content = {f"m/{k}-ü": bytes([k]) * (k * 7) for k in range(40)}
    with zipfile.ZipFile(out, "w", allowZip64=True) as z:
        for name, data in content.items():
            z.writestr(name, data, zipfile.ZIP_DEFLATED if name.startswith("m/3") else zipfile.ZIP_STORED)
        z.comment = b"PK\5\6 not the end PK\5\6" + b"\0" * 40
    data = before + out.getvalue()
    read = lambda offset, length: data[offset : offset + length]
    found = P.members(read, len(data))
    assert [(m.name, m.size) for m in found] == [(n, len(c)) for n, c in content.items()]
    for m in found:
        start = P.data_start(read, m)
        assert m.method == P.DEFLATED or read(start, m.packed) == content[m.name]
    if limit == 10:
        assert P.END64 in data


def test_broken_files():
    for data in (b"", b"PK", b"x" * 1000, b"PK\5\6" + b"\xff" * 30):
        with pytest.raises(ValueError):
            P.members(lambda offset, length: data[offset : offset + length], len(data))  # noqa: B023


def foreign(path, *, compressed_index=False, deflated_index=False, deflated_archive=False, lost=False):
    """A package as others make them: a plain WARC file, lines of a block index, two archives."""
    archives, lines = {"a.warc": b"", "b.warc": b""}, []
    for k in range(50):
        name = "a.warc" if k % 2 else "b.warc"
        data = P.record(str(k), f"http://x.org/{k}", b"payload %d" % k, len(b"payload %d" % k), "0", None)
        lines.append(f"org,x)/{k} 20200101000000 " + json.dumps({"filename": "lost.warc" if lost else name, "offset": len(archives[name]), "length": str(len(data))}))
        archives[name] += data
    index = ("!meta 0 {}\n" + "\n".join(lines)).encode()
    with zipfile.ZipFile(path, "w") as z:
        for name, data in archives.items():
            z.writestr(f"archive/{name}", data, zipfile.ZIP_DEFLATED if deflated_archive else zipfile.ZIP_STORED)
        packed = gzip.compress(index[:400]) + gzip.compress(index[400:])
        z.writestr("indexes/index.cdx.gz" if compressed_index else "indexes/index.cdxj", packed if compressed_index else index, zipfile.ZIP_DEFLATED if deflated_index else zipfile.ZIP_STORED)


@pytest.mark.parametrize("options", [{}, {"compressed_index": True}, {"deflated_index": True}])
def test_packages_of_others(spark, tmp_path, options):
    foreign(f"{tmp_path}/one.wacz", **options)
    back = P.read(P.listed(spark, str(tmp_path))).collect()
    assert sorted((r.record_id, r.payload) for r in back) == sorted((f"<urn:row:{k}>", b"payload %d" % k) for k in range(50))


@pytest.mark.parametrize("options", [{"deflated_archive": True}, {"lost": True}])
def test_archives_that_cannot_be_read_in_place(spark, tmp_path, options):
    foreign(f"{tmp_path}/one.wacz", **options)
    with pytest.raises(Exception, match="no stored archive"):
        P.read(P.listed(spark, str(tmp_path))).count()


def test_lines_of_ranges():
    data = b"".join(b"%d\n" % 10**k for k in range(9)) + b"last"
    read = lambda offset, length: data[offset : offset + length]
    for step in range(1, len(data) + 2):
        lines = [x for begin in range(0, len(data), step) for x in P._lines(read, 0, len(data), begin, begin + step)]
        assert lines == data.split(b"\n")
