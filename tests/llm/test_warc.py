"""WARC round trips and broken archives."""

import hashlib
import io
import random

import pytest

from gustlab.llm import warc as W


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        revisit = i is not None and len(b) >= 100 and first[b] < i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None, u))
    return sorted(out, key=str)


def test_roundtrip(spark):
    g = random.Random(0)
    texts = ["", None, "short", "<p>é</p>" * 30, "x" * 99, "x" * 100, "\r\n\r\n" * 60, "y" * 3_000_000,
             "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9]
    rows = [(i, g.choice(["http://a/é ü", None, "", "http://b/\r\nX: y", "u" * 5000]), g.choice(texts)) for i in range(120)]
    rows += [(500, "u", "z" * 400), (500, "u", "z" * 400), (501, "v", "z" * 400), (None, "w", "z" * 400), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = sorted([tuple(r) for r in W.roundtrip(df).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url").collect()], key=str)
    assert got == expected(rows)
    assert W.roundtrip(df.limit(0)).collect() == []


def test_payloads_come_back(spark):
    from gustlab.session import scratch_path

    df = spark.createDataFrame([(1, "u", "é" * 200), (2, "u", "é" * 200), (3, "u", "")], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    got = W.read_archives(spark, folder, W.write_pages(df, folder, file_bytes=1), payloads=True).collect()
    assert {r["page_id"]: (bytes(r["payload"]) if r["payload"] is not None else None) for r in got} == {
        1: ("é" * 200).encode(), 2: None, 3: b""}


def test_broken_records():
    rec = [W.record(i, "u", b"payload %d" % i * 50, hashlib.sha256(b"payload %d" % i * 50).hexdigest()) for i in range(3)]
    whole = b"".join(rec)
    got = list(W.members(io.BytesIO(whole), "f"))
    assert [o for o, _ in got] == [0, len(rec[0]), len(rec[0]) + len(rec[1])]
    for _, c in got:
        W.parse(c, "f")
    with pytest.raises(W.WarcError, match="ends inside"):
        list(W.members(io.BytesIO(whole[:-5]), "f"))
    with pytest.raises(W.WarcError):
        list(W.members(io.BytesIO(whole + b"junk"), "f"))
    c = got[1][1]
    with pytest.raises(W.WarcError, match="digest"):
        W.parse(c.replace(b"payload 1", b"payload 7", 1), "f")
    with pytest.raises(W.WarcError, match="frame"):
        W.parse(c + b"x", "f")


def foreign(kind, block, *fields, version="WARC/1.0"):
    import gzip

    head = "\r\n".join([version, f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]).encode()
    return gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark):
    import base64

    from gustlab.llm.files import open_folder
    from gustlab.session import scratch_path

    b32 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    http, body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n", b"<p>one</p>" * 20
    is_http = "Content-Type: application/http; msgtype=response"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 3\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    records = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "WARC-Target-URI: <http://a/>", "Content-Type: application/http; msgtype=request"),
        foreign("response", http + body, "WARC-Target-URI: http://a/", is_http, f"WARC-Block-Digest: {b32(http + body)}",
                f"WARC-Payload-Digest: {b32(body)}"),
        foreign("response", chunked, "WARC-Target-URI: http://b/", is_http, "WARC-Payload-Digest: blake9:ABC"),
        foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 999\r\n\r\ncut", "WARC-Truncated: length", is_http),
        foreign("revisit", b"", "WARC-Target-URI: http://c/", f"WARC-Payload-Digest: {b32(body)}"),
        foreign("resource", b"dns", "WARC-Target-URI: dns:a", "Content-Type: text/dns", version="WARC/1.1"),
        foreign("metadata", b"a: b", "X-Long: one\r\n two\r\n\tthree"),
        W.record(9, "u", body, hashlib.sha256(body).hexdigest()),
    ]
    folder = scratch_path(spark, "warc-foreign")
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/x.warc.gz", compression=None) as f:
        f.write(b"".join(records))
    got = W.read_archives(spark, folder, spark.createDataFrame([("x.warc.gz",)], "file string"), payloads=True).orderBy("offset").collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rest = chunked.partition(b"\r\n\r\n")[2]
    assert [(r["page_id"], r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"],
             bytes(r["payload"]) if r["payload"] is not None else None) for r in got] == [
        (None, None, "warcinfo", 13, sha(b"software: x\r\n"), b"software: x\r\n"),
        (None, "http://a/", "request", 0, sha(b""), b""),
        (None, "http://a/", "response", len(body), sha(body), body),
        (None, "http://b/", "response", len(rest), sha(rest), rest),
        (None, None, "response", 3, sha(b"cut"), b"cut"),
        (None, "http://c/", "revisit", None, b32(body), None),
        (None, "dns:a", "resource", 3, sha(b"dns"), b"dns"),
        (None, None, "metadata", 4, sha(b"a: b"), b"a: b"),
        (9, "u", "response", len(body), sha(body), body)]
    content = next(W.members(io.BytesIO(records[7]), "x"))[1]
    assert W.parse(content, "x")["fields"]["x-long"] == "one two three"
    for bad in (foreign("response", http + body, is_http, f"WARC-Payload-Digest: {b32(b'other')}"),
                foreign("response", http + body, is_http, "WARC-Block-Digest: sha256:zz"),
                foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\nsix", is_http)):
        with pytest.raises(W.WarcError):
            W.parse(next(W.members(io.BytesIO(bad), "x"))[1], "x")
