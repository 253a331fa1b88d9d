"""WARC archives: written as monolithic gzip streams, normalised to a member per record.

A writer packs a few MB of records into one gzip stream, as crawlers that compress a whole file
do. The normaliser inflates each stream once, from front to back, cuts it at record boundaries
and rewrites every record as a gzip member of its own, beside an index of their offsets; a
reader then opens single records by offset. Archives are rows of tables in the shared folder,
the index is a column of its own that is read without the data.

Of records with equal payloads, that of the least page_id is the response; the others are
revisits, which hold no payload but its digest, its length and whose record they repeat. Null
html is an empty payload; empty payloads are equal to each other. Rows without a page_id are
responses, named by a uuid that follows from their url and payload. Rows of one page_id with the
same payload are all what the page is. An empty table gives an empty one; columns of pages other
than page_id, url and html are not read. Each archive begins with a warcinfo record.

write_files() exports archives as .warc.gz files, each with a sidecar .idx file of lines (offset,
length, type, record id), which any reader of gzip can open.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm.common import remove, stored

#: Inflated bytes after which a writer begins another archive.
ARCHIVE_BYTES = 8 << 20
CHUNK = 1 << 16
#: Revisits up to which their list is broadcast (some 60 bytes each).
BROADCAST_REVISITS = 500_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response, or the revisit of another page's response."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    content = http if refers_to is not None else http + payload
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(content)}",
    ]
    own = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {digest}')}"
    lines.insert(2, f"WARC-Record-ID: <{own}>")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def info() -> bytes:
    """What an archive begins with."""
    content = b"software: geoquilt\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, content.decode())
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n"
    head += f"Content-Type: application/warc-fields\r\nContent-Length: {len(content)}\r\n\r\n"
    return head.encode() + content + b"\r\n\r\n"


def headers(data: bytes, start: int = 0) -> tuple[dict[str, str], int]:
    """Named fields of a header block by lower-case name, and where what follows it begins."""
    end = data.index(b"\r\n\r\n", start)
    fields = {}
    for line in data[start:end].decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    return fields, end + 4


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of inflated chunks; at most one record and one chunk are held."""
    held = bytearray()
    need = -1
    for chunk in stream:
        held += chunk
        while True:
            if need < 0:
                if held.find(b"\r\n\r\n") < 0:
                    break
                fields, body = headers(bytes(held[: held.find(b"\r\n\r\n") + 4]))
                need = body + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError("the stream ends inside a record")


def inflated(data: bytes) -> Iterator[bytes]:
    """Chunks of all gzip members of data, one pass."""
    at = 0
    while at < len(data):
        engine = zlib.decompressobj(31)
        while not engine.eof and at < len(data):
            piece = data[at : at + CHUNK]
            at += len(piece)
            if out := engine.decompress(piece):
                yield out
        if not engine.eof:
            raise ValueError("the stream ends inside a gzip member")
        at -= len(engine.unused_data)


def deflated(data: bytes, level: int) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def normalise(data: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """An archive with a gzip member per record, and the (offset, length) of each."""
    out, index, at = [], [], 0
    for one in records(inflated(data)):
        member = deflated(one, 6)
        index.append((at, len(member)))
        out.append(member)
        at += len(member)
    return b"".join(out), index


def read_record(archive: bytes, offset: int, length: int) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of the member
    at an offset; a revisit's payload is None, a warcinfo has its type alone. A response whose payload doesn't have the digest
    that it names raises ValueError."""
    data = zlib.decompress(archive[offset : offset + length], 31)
    fields, body = headers(data)
    if fields["warc-type"] == "warcinfo":
        return {"record_type": "warcinfo"}
    http, start = headers(data, body)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    payload = None
    size = int(http["content-length"])
    if kind == "response":
        payload = data[start : body + int(fields["content-length"])]
        if payload_digest(payload) != digest or len(payload) != size:
            raise ValueError(f"damaged payload of {fields.get('warc-record-id')}")
    number = lambda key: int(fields[key][len("<urn:page:") : -1]) if fields.get(key, "").startswith("<urn:page:") else None
    return {
        "page_id": number("warc-record-id"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number("warc-refers-to"), "payload": payload,
    }


def _digests(batches):
    for batch in batches:
        digests = [payload_digest(h.encode()) for h in batch.column("__html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(digests)], names=["page_id", "digest"])


def _archived(batches):
    engine, out, held, n = None, [], 0, 0

    def closed():
        return pa.RecordBatch.from_arrays(
            [pa.array([b"".join([*out, engine.flush()])], pa.binary()), pa.array([n], pa.int64())], names=["data", "n"]
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "__html", "__firsts")]
        for page_id, url, source, firsts in zip(*columns, strict=True):
            payload = source.encode()
            refers_to = dict(firsts).get(payload_digest(payload)) if firsts else None
            if engine is None:
                engine = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.append(engine.compress(info()))
            one = record(page_id, url, payload, refers_to)
            out.append(engine.compress(one))
            held += len(one)
            n += 1
            if held >= ARCHIVE_BYTES:
                yield closed()
                engine, out, held, n = None, [], 0, 0
    if engine is not None:
        yield closed()


def _normalised(batches):
    for batch in batches:
        for data in batch.column("data").to_pylist():
            archive, index = normalise(data)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([archive], pa.binary()),
                    pa.array([[o for o, _ in index]], pa.list_(pa.int64())),
                    pa.array([[n for _, n in index]], pa.list_(pa.int64())),
                ],
                names=["data", "offsets", "lengths"],
            )


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reread(batches):
    names = [f.split()[0] for f in _READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for data, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in ("data", "offsets", "lengths")), strict=True):
            rows = [read_record(data, o, n) for o, n in zip(offsets, lengths, strict=True)]
            rows = [r for r in rows if r["record_type"] != "warcinfo"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names=names
            )


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, firsts): of pages that repeat another's payload, its digest and the least page
    that has it. Minima are taken before the shuffle; a digest that a third of all pages share
    meets a one-row side in the join."""
    digests = pages.select("page_id", "__html").where("page_id is not null").mapInArrow(_digests, "page_id long, digest string")
    digests = digests.distinct()
    least = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = digests.join(least, "digest").where("page_id <> first")
    return again.groupBy("page_id").agg(F.collect_list(F.struct("digest", "first")).alias("__firsts"))


def write_archives(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, str]:
    """Monolithic archives (data, n) of pages (page_id, url, html), and their path."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("__html"),
    )
    firsts, path = stored(spark, revisits(rows), "revisits")
    if firsts.count() <= BROADCAST_REVISITS:
        firsts = F.broadcast(firsts)
    # entries, as a worker reads a list of structs slowly
    joined = rows.join(firsts, "page_id", "left").withColumn(
        "__firsts", F.map_from_entries("__firsts")
    )
    out = stored(spark, joined.mapInArrow(_archived, "data binary, n long"), "monolithic")
    remove(spark, path)
    return out


def normalise_archives(spark: SparkSession, archives: DataFrame) -> tuple[DataFrame, str]:
    """Archives (data, ...) with a gzip member per record and their index (offsets, lengths)."""
    made = archives.select("data").mapInArrow(_normalised, "data binary, offsets array<long>, lengths array<long>")
    return stored(spark, made, "members")


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """(file, records) of normalised archives, each written from its task to the folder, which all
    executors share, as <file>.warc.gz and its index <file>.idx. A file appears under its name
    once it is whole; a task that runs again writes the same names."""

    def run(batches):
        from pyspark import TaskContext

        task, nth = TaskContext.get(), 0
        fs, at = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            for data, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in ("data", "offsets", "lengths")), strict=True):
                name = f"part-{task.partitionId():05d}-{nth:05d}"
                lines = []
                for offset, length in zip(offsets, lengths, strict=True):
                    fields, _ = headers(zlib.decompress(data[offset : offset + length], 31))
                    lines.append(f"{offset}\t{length}\t{fields['warc-type']}\t{fields['warc-record-id']}\n")
                for suffix, content in ((".idx", "".join(lines).encode()), (".warc.gz", data)):
                    aside = f"{at.rstrip('/')}/.{name}{suffix}.{task.taskAttemptId()}"
                    with fs.open_output_stream(aside, compression=None) as f:
                        f.write(content)
                    fs.move(aside, f"{at.rstrip('/')}/{name}{suffix}")
                nth += 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(offsets)], pa.int64())], names=["file", "records"])

    return archives.select("data", "offsets", "lengths").mapInArrow(run, "file string, records long")


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back
    from the normalised archives."""
    whole, path = write_archives(spark, pages)
    members, again = normalise_archives(spark, whole)
    remove(spark, path)
    result = members.mapInArrow(_reread, _READ).checkpoint()
    remove(spark, again)
    return result
