import base64
import gzip
import hashlib
import io
import os
from collections import defaultdict

import pytest
from voxframe.llm import warc
from voxframe.workspace import new_path


def plain(rows, min_bytes=0):
    by = defaultdict(list)
    for i, h in rows:
        by[(h or "").encode()].append(i)
    out = []
    for h, ids in by.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            again = len(h) >= min_bytes and i != top
            out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


ODD = [(1, "u", None), (2, "u\r\nX: y", ""), (3, None, "<p>é</p>\r\n\r\nWARC/1.1\r\n\r\n"), (4, "u", "<p>é</p>\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "lone"), (None, "u", "long " * 300_000), (7, "u", "lone"), (8, "u", "z"), (8, "u", "z"), (6, "u", "z")]


@pytest.mark.parametrize("compress", [None, 1])
@pytest.mark.parametrize("min_bytes", [0, 3])
def test_odd_pages(spark, compress, min_bytes):
    pages = spark.createDataFrame([(*r, "x") for r in ODD], "page_id long, url string, html string, digest string")
    folder = new_path(spark, "w")
    warc.write(pages, folder, compress=compress, min_bytes=min_bytes, file_bytes=1000)
    assert got(warc.read(spark, folder)) == got(warc.read(spark, folder, "none")) == plain([(i, h) for i, _, h in ODD], min_bytes)
    bodies = {r.page_id: r.payload for r in warc.read(spark, folder).where("record_type = 'response' and page_id in (3, 4)").collect()}
    assert bodies == {4: ODD[3][2].encode()} or min_bytes == 0 and 4 in bodies


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = new_path(spark, "w")
    warc.write(pages, folder)
    rows = warc.read(spark, folder)
    assert got(rows) == plain([(r.page_id, r.html) for r in pages.collect()])
    assert {r.page_id: r.url for r in rows.collect()} == {r.page_id: r.url for r in pages.collect()}


def test_predicates_reach_the_source(spark, sf):
    folder = new_path(spark, "w")
    warc.write(spark.read.parquet(f"{sf}/pages.parquet"), folder)
    df = warc.read(spark, folder, "none").where("record_type = 'response' and page_id >= 10 and page_id < 20")
    assert df.count() == sum(1 for r in warc.read(spark, folder).collect() if r.record_type == "response" and 10 <= r.page_id < 20)
    reader = warc.WarcReader({"path": folder})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"x")])) == [warc.EqualTo(("payload",), b"x")]
    assert len(reader.tests) == 1


def test_predicates_on_what_payloads_tell(spark, tmp_path):
    """Heads of others have no lengths, and may lack digests: rows are tested by what they show."""
    (tmp_path / "x.warc").write_bytes(b"".join(foreign("resource", b, [("Content-Type", "a/b")]) for b in (b"", b"five5", b"eleven chars")))
    for payload in ("verify", "full"):
        whole = warc.read(spark, f"file://{tmp_path}", payload)
        for test in ("payload_bytes > 5", "payload_bytes = 0", "payload_bytes is null", "payload_digest is not null", "payload_digest is null", "payload_bytes in (0, 12) and record_type = 'resource'"):
            assert sorted(map(tuple, whole.where(test).collect()), key=repr) == sorted((tuple(r) for r in spark.createDataFrame(whole.collect(), whole.schema).where(test).collect()), key=repr), test
    assert warc.read(spark, f"file://{tmp_path}").where("payload_bytes > 5").count() == 1
    heads = warc.WarcReader({"path": "x", "payload": "none"})
    assert list(heads.pushFilters([warc.GreaterThan(("payload_bytes",), 5)])) == []


def test_empty_and_cut(spark):
    folder = new_path(spark, "w")
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder) == []
    assert warc.read(spark, folder).count() == 0
    data = warc.record(1, "u", b"abc", "D")
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-8])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data + data[:30])))


def foreign(kind, block, fields=(), **more):
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x:{kind}{len(block)}>"), ("WARC-Date", "2020-02-02T02:02:02Z"), *fields, *more.items(), ("Content-Length", len(block))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def hashed(kind, body, form):
    digest = hashlib.new(kind, body).digest()
    return f"{kind}:{digest.hex() if form == 'hex' else base64.b32encode(digest).decode()}"


def test_foreign_archives(spark, tmp_path):
    """Archives that this writer didn't make: all record types, other digests, chunked bodies, one member for all records, plain files, and damage."""
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    good = [
        foreign("warcinfo", b"software: none\r\n", [("Content-Type", "application/warc-fields")]),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", [("Content-Type", "application/http; msgtype=request")]),
        foreign("response", http + b"one", [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", hashed("sha256", b"one", "hex"))]),
        foreign("response", http + b"three", [("Content-Type", "application/http"), ("WARC-Payload-Digest", hashed("md5", b"three", "base32"))]),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nfou\r\n1;x=y\r\nr\r\n0\r\n\r\n", [("Content-Type", "application/http"), ("WARC-Payload-Digest", hashed("sha1", b"four", "base32"))]),
        foreign("resource", b"\0\1two", [("Content-Type", "image/x"), ("WARC-Payload-Digest", hashed("sha1", b"\0\1two", "base32"))]),
        foreign("metadata", b"a: b\r\n\r\nc", [("Content-Type", "application/warc-fields")]),
    ]
    want = [("metadata", b"a: b\r\n\r\nc"), ("request", b""), ("resource", b"\0\1two"), ("response", b"four"), ("response", b"one"), ("response", b"three"), ("warcinfo", b"software: none\r\n")]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in good))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(good)))
    (tmp_path / "plain.warc").write_bytes(b"".join(good))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in rows) == sorted(want * 3) and not any(r.error for r in rows)
    heads = warc.read(spark, str(tmp_path), "none").collect()
    assert sorted((r.record_type, r.record_id) for r in heads) == sorted((r.record_type, r.record_id) for r in rows)
    only = warc.read(spark, str(tmp_path)).where("record_type = 'resource'").collect()
    assert [bytes(r.payload) for r in only] == [b"\0\1two"] * 3

    (tmp_path / "a_cut.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in good)[:-60])
    (tmp_path / "b_wrong.warc").write_bytes(foreign("resource", b"x", [("WARC-Payload-Digest", hashed("sha1", b"y", "base32"))]) + foreign("resource", b"z", [("WARC-Payload-Digest", "crc9:12")]))
    (tmp_path / "c_none.warc").write_bytes(b"<html>no archive\r\n\r\n")
    (tmp_path / "d_length.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\nx")
    (tmp_path / "e_empty.warc").write_bytes(b"")
    rows = warc.read(spark, str(tmp_path)).collect()
    wrong = sorted(r.error.rpartition("/")[2] for r in rows if r.error)
    assert [w.split(".")[0] for w in wrong] == ["a_cut", "b_wrong", "b_wrong", "c_none", "d_length"]
    assert len(rows) == 3 * len(good) + len(good) - 1 + 5
    with pytest.raises(Exception, match="digest doesn't hold|is cut|no record"):
        warc.read(spark, str(tmp_path), errors="raise").count()


class Counted(io.BytesIO):
    got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


@pytest.mark.parametrize("level", [None, 1])
def test_unwanted_payloads_are_not_read(level):
    body = os.urandom(300_000)
    data = [warc.record(i, "u", body, "D") for i in range(20)]
    file = Counted(b"".join(x if level is None else warc.member(x, level) for x in data))
    assert [h["x-page-id"] for h, _ in warc.records(file, warc.FEW)] == [str(i) for i in range(20)]
    assert file.got < file.getbuffer().nbytes / 10
    file = io.BytesIO(file.getvalue())
    assert [warc.payload_of(h, block()) for h, block in warc.records(file)] == [body] * 20
    assert level is None or gzip.decompress(warc.member(data[0], level)) == data[0]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(file.getvalue()[:-100_000]), warc.FEW))
