"""WARC archives: written one gzip member per record, and read back by a sequential reader.

The writer gives each page a ``response`` record, or a ``revisit`` record where an equal payload of at least
``MIN_REVISIT`` bytes stands under a smaller page id. The reader streams an archive in pieces of ``PIECE`` bytes through
incremental decompression, one gzip member after the other; a record's block is framed by its Content-Length, which
must end where the member ends, and the digests it states must hold: anything else is an error that names the file and the
offset. It takes archives of other writers too: records of any type, digests in hexadecimal or base 32 by any algorithm
of ``hashlib`` (others are not checked) or none at all, folded header lines, HTTP headers without a length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustlab.llm import blocks as B
from gustlab.llm.files import fresh_name, open_folder
from gustlab.session import cut_lineage, scratch_path

MIN_REVISIT = 100
PIECE = 1 << 18
FILE_BYTES = 1 << 27
LEVEL = 4
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that breaks the format or fails a digest."""


def _header_safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """The gzip member of a record: a response with its HTTP block, or a revisit whose block ends after the HTTP header.

    The URI is written with controls and spaces percent-encoded; the field ``Page-Id`` carries the id (left out if null),
    and ``Page-Url`` an unaltered url in JSON form (left out if null).
    """
    import json

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    block_digest = hashlib.sha256(block).hexdigest()
    name = hashlib.sha256(f"{page_id}|{digest}|{url}".encode()).hexdigest()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:sha256:{name}>", f"WARC-Date: {_DATE}",
            f"WARC-Target-URI: {_header_safe(url or '')}", "Content-Type: application/http;msgtype=response",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{block_digest}",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if url is not None:
        head.append(f"Page-Url: {json.dumps(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"Refers-To-Page-Id: {refers_to}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(stream, name: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, decompressed piece by piece."""
    offset, at, z, parts = 0, 0, None, []
    raw = stream.read(PIECE)
    while raw:
        if z is None:
            z, parts, offset = zlib.decompressobj(31), [], at
        try:
            parts.append(z.decompress(raw))
        except zlib.error as e:
            raise WarcError(f"{name} at {offset}: {e}") from e
        if z.eof:
            at += len(raw) - len(z.unused_data)
            raw = z.unused_data
            z = None
            yield offset, b"".join(parts)
            if raw:
                continue
        else:
            at += len(raw)
        raw = stream.read(PIECE)
    if z is not None:
        raise WarcError(f"{name} at {offset}: the archive ends inside a member")


def parse(content: bytes, where: str) -> dict:
    """Fields, type, HTTP header and payload of a member's record, its framing and digests checked."""
    head, sep, rest = content.partition(b"\r\n\r\n")
    rows = head.decode("utf-8", "strict").split("\r\n")
    if not sep or not rows[0].startswith("WARC/"):
        raise WarcError(f"{where}: no WARC header")
    fields, k = {}, None
    for row in rows[1:]:
        if row[:1] in (" ", "\t") and k is not None:  # a folded line goes on with the field before
            fields[k] = f"{fields[k]} {row.strip()}".strip()
            continue
        k, colon, v = row.partition(":")
        if not colon:
            raise WarcError(f"{where}: a header line without a colon")
        k = k.strip().lower()
        fields[k] = v.strip()
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError(f"{where}: no Content-Length") from e
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"{where}: Content-Length {size} does not frame the record")
    if not _digest_holds(fields.get("warc-block-digest"), block):
        raise WarcError(f"{where}: block digest")
    kind = fields.get("warc-type", "").lower()
    http, payload, length = b"", block, len(block)
    if kind == "revisit" or fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
        length = int(said[1]) if said else None if kind == "revisit" else len(payload)
    if kind != "revisit":
        whole = "warc-truncated" not in fields and not re.search(rb"(?im)^transfer-encoding:", http)
        if whole and length != len(payload):
            raise WarcError(f"{where}: HTTP Content-Length")
        if whole and not _digest_holds(fields.get("warc-payload-digest"), payload):
            raise WarcError(f"{where}: payload digest")
        length = len(payload)
    return {"fields": fields, "kind": kind, "http": http, "payload": payload, "length": length}


def _digest_bytes(stated: str | None) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a field ``algorithm:value``, the value in hexadecimal or base 32; None where it is unknown."""
    name, _, value = (stated or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    try:
        size = hashlib.new(name).digest_size
    except (ValueError, TypeError):
        return None
    try:
        if len(value) == 2 * size:
            return name, bytes.fromhex(value)
        return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return name, b""


def _digest_holds(stated: str | None, content: bytes) -> bool:
    """Whether the content has the stated digest; true where none is stated or its algorithm is unknown."""
    got = _digest_bytes(stated)
    return got is None or hashlib.new(got[0], content).digest() == got[1]


def _payload_digest(r: dict) -> str | None:
    """SHA-256 of the payload in hexadecimal; of a revisit, whose payload is elsewhere, the stated digest (``algorithm:value``
    as it stands where it is no SHA-256), null if none."""
    if r["kind"] != "revisit":
        return hashlib.sha256(r["payload"]).hexdigest()
    stated = r["fields"].get("warc-payload-digest")
    got = _digest_bytes(stated)
    return got[1].hex() if got is not None and got[0] == "sha256" else stated


def write_pages(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html",
                file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row under ``folder``; returns the manifest, checkpointed: column ``file``, a row per archive.

    A null page is an empty payload. A payload of at least ``MIN_REVISIT`` bytes is a revisit where an equal payload
    stands under a smaller id. Rows with a null id, and all rows that share the smallest id, are responses.
    """
    raw = F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "UTF-8")
    src = pages.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{url}`").cast("string").alias("url"),
                       raw.alias("payload"), F.sha2(raw, 256).alias("digest"))
    keys = src.where(F.length("payload") >= MIN_REVISIT).where("id is not null").select("id", "digest")
    # only digests that stand under several ids matter; summed before the shuffle, so a hot payload is one row a task
    first = keys.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    first = cut_lineage(first.select("digest", "first"))
    ids = cut_lineage(keys.join(first, "digest").where("id > first").select("id", "digest", "first").distinct())
    # joined by page, not by payload: a page is a revisit of at most one row per payload it has
    rows = src.join(ids, ["id", "digest"], "left").select("id", "url", "payload", "digest", "first")

    def run(batches):
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        out, name, size = None, None, 0
        try:
            for b in batches:
                for i in range(b.num_rows):
                    if out is None or size >= file_bytes:
                        if out is not None:
                            out.close()
                            yield pa.RecordBatch.from_pydict({"file": [name]})
                        name, size = fresh_name("pages", ".warc.gz"), 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    got = record(*[b.column(k)[i].as_py() for k in range(5)])
                    out.write(got)
                    size += len(got)
        finally:
            if out is not None:
                out.close()
        if name is not None:
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return cut_lineage(rows.mapInArrow(run, "file string"))


def read_archives(spark: SparkSession, folder: str, files: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives named in column ``file``: page_id, url, record_type, refers_to, payload_bytes (from
    the HTTP header, so a revisit's too), payload_digest, file, offset, and the payload if asked for (null for revisits).
    One task reads an archive from its begin to its end; a broken record ends the job.

    Records of other writers have a null page_id and refers_to, and their WARC-Target-URI as url. The payload is what
    follows the HTTP header, as stored (chunks and content codings are left), or the whole block of a record without one;
    the digest is its SHA-256. A revisit has the size and digest that it states, null where it states none."""
    import json

    schema = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
              "file string, offset bigint" + (", payload binary" if payloads else ""))
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        fs, root = open_folder(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows, size = [], 0
                    for offset, content in members(f, name):
                        r = parse(content, f"{name} at {offset}")
                        x = r["fields"]
                        page, ref = x.get("page-id"), x.get("refers-to-page-id")
                        url = json.loads(x["page-url"]) if "page-url" in x else x.get("warc-target-uri", "").strip("<>") or None
                        rows.append((int(page) if page is not None else None, url,
                                     r["kind"], int(ref) if ref is not None else None, r["length"],
                                     _payload_digest(r), name, offset,
                                     *([r["payload"] if r["kind"] != "revisit" else None] if payloads else [])))
                        size += len(content) if payloads else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = max(1, min(files.count(), spark.sparkContext.defaultParallelism * 64))
    return files.select("file").repartition(n).mapInArrow(run, schema)


def roundtrip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder and read them back, a row per page (columns of
    :func:`read_archives`). Repeated rows keep a row each; an empty table gives an empty result. A revisit whose response
    is not in the archives with the same digest and size is an error."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    got = read_archives(spark, folder, write_pages(pages, folder, id, url, html))
    got = cut_lineage(got)
    asked = got.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    lost = asked.join(got.where("record_type = 'response'").select("page_id", "payload_digest", "payload_bytes"),
                      ["page_id", "payload_digest", "payload_bytes"], "left_anti")
    if not lost.isEmpty():
        raise WarcError("a revisit refers to a response that is not there")
    return got
