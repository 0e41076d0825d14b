"""WARC archives: one gzip member per record, written by tasks and read back in sequence.

A task writes its pages into archives of bounded size in the shared folder; the manifest of what
committed tasks have written is a stored table, so files of lost or repeated attempts are never read.
The reader goes through an archive once, in bounded memory: it inflates member after member as the
bytes arrive, frames each block by its content length and verifies both digests on the way.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.shared import partitions, scratch, store

LEAST_REVISIT = 1000            # payload bytes from which equal payloads are written once
ARCHIVE_BYTES = 64 << 20        # an archive is closed beyond this size
CHUNK = 1 << 18                 # bytes read, or inflated, at once
HEAD_BYTES = 1 << 20            # longest header that is accepted
DATE = "1970-01-01T00:00:00Z"   # pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

RECORDS = ("archive string, offset long, record_id string, record_type string, refers_to_id string, target_uri string, "
           "payload_bytes long, payload_digest string, problem string")


def header_value(text: str) -> bytes:
    """A header's value: blanks and control characters, which would break the header, are percent-encoded."""
    return re.sub(rb"[\x00-\x20\x7F]", lambda m: b"%%%02X" % m[0][0], text.encode("utf-8", "surrogatepass"))


def record_id(page_id: int | None, digest: str) -> bytes:
    """The id of a page's record. Repeated rows share it."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>".encode()


def member(headers: list[tuple[str, bytes]], block: bytes, level: int) -> bytes:
    """One record as a gzip member of its own."""
    headers = [*headers, ("WARC-Block-Digest", b"sha1:" + hashlib.sha1(block).hexdigest().encode()), ("Content-Length", b"%d" % len(block))]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = b"WARC/1.1\r\n" + b"".join(k.encode() + b": " + v + b"\r\n" for k, v in headers) + b"\r\n"
    return b"".join([packer.compress(head), packer.compress(block), packer.compress(END), packer.flush()])


def page_record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, revisit: bool, level: int) -> bytes:
    """A page as a response, or as a revisit of the response of page ``keeper`` with the same payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Type", b"revisit" if revisit else b"response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE.encode()),
               ("Content-Type", b"application/http;msgtype=response"), ("WARC-Payload-Digest", b"sha1:" + digest.encode())]
    if url is not None:
        headers.append(("WARC-Target-URI", header_value(url)))
    if revisit:
        headers += [("WARC-Profile", PROFILE.encode()), ("WARC-Refers-To", record_id(keeper, digest))]
    return member(headers, http if revisit else http + payload, level)


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the manifest (archive, records, bytes).

    Of the rows with one payload of at least ``least`` bytes those with the largest page_id are
    responses, the others revisit them (a null page_id is below every other; where all are null, all
    are responses). Smaller payloads are never looked up, so a payload that very many small or empty
    pages share moves nothing. Null html is an empty payload, a null url leaves its header out.
    """
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    large, small = own.where(F.octet_length("payload") >= least), own.where(F.octet_length("payload") < least)
    keyed = large.withColumn("key", F.sha2("payload", 256))
    copied = (keyed.groupBy("key").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
              .select(F.col("key").alias("of_key"), "keeper"))
    joined = keyed.join(copied, F.col("key") == F.col("of_key"), "left")
    decided = (joined.select("page_id", "url", "payload", "keeper", (F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"))
               .unionByName(small.select("*", F.lit(None).cast("long").alias("keeper"), F.lit(False).alias("revisit"))))
    folder = scratch(spark, "warc")

    def archived(batches):
        store_fs, base = pafs.FileSystem.from_uri(folder)
        store_fs.create_dir(base, recursive=True)
        info = member([("WARC-Type", b"warcinfo"), ("WARC-Record-ID", b"<urn:warcinfo>"), ("WARC-Date", DATE.encode()),
                       ("Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
        out, name, records, size = None, "", 0, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, len(info)
                    out = store_fs.open_output_stream(f"{base}/{name}", compression=None)     # members are compressed one by one
                    out.write(info)
                raw = page_record(*[c[i].as_py() for c in columns], level)
                out.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield manifest_row(f"{folder}/{name}", records, size)
        if out is not None:
            out.close()
            yield manifest_row(f"{folder}/{name}", records, size)

    return store(decided.mapInArrow(archived, "archive string, records long, bytes long"), "warc-manifest")


def manifest_row(*values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v]) for v in values], names=["archive", "records", "bytes"])


class Inflater:
    """The gzip members of a stream, inflated piece by piece."""

    def __init__(self, stream):
        self.stream, self.raw, self.held, self.engine = stream, b"", b"", None
        self.taken = 0          # bytes of the archive inflated so far

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        self.raw = self.raw or self.stream.read(CHUNK)
        self.engine, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self, limit: int = CHUNK) -> bytes:
        """Some bytes of this member, b'' at its end."""
        if self.held:
            out, self.held = self.held[:limit], self.held[limit:]
            return out
        while not self.engine.eof:
            data = self.raw or self.stream.read(CHUNK)
            out = self.engine.decompress(data, limit)
            self.raw = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
            self.taken += len(data) - len(self.raw)
            if out:
                return out
            if not data and not self.engine.eof:
                raise ValueError("the archive ends inside a record")
        return b""

    def until(self, mark: bytes) -> bytes:
        """The bytes before ``mark``, which is read too."""
        got = b""
        while mark not in got:
            piece = self.more()
            if not piece or len(got) > HEAD_BYTES:
                raise ValueError("a header does not end")
            got += piece
        got, _, rest = got.partition(mark)
        self.held = rest + self.held
        return got

    def exactly(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, in pieces."""
        while size:
            piece = self.more(min(size, CHUNK))
            if not piece:
                raise ValueError("a block is shorter than its content length")
            size -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:])}


def read_records(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order. Raises ValueError or zlib.error where it is broken; a
    digest that does not hold is named in ``problem``."""
    members = Inflater(stream)
    while True:
        at = members.taken
        if not members.next_member():
            return
        head = members.until(END)
        if not head.startswith(b"WARC/1."):
            raise ValueError("a member is no WARC record")
        named = fields(head)
        kind, size = named.get("warc-type"), int(named["content-length"])
        block, payload, http, body, length, kept = hashlib.sha1(), hashlib.sha1(), b"", False, 0, []
        is_http = named.get("content-type", "").startswith("application/http")
        for piece in members.exactly(size):
            block.update(piece)
            if is_http and not body:
                http += piece
                if END not in http:
                    continue
                body, (http, _, piece) = True, http.partition(END)
            payload.update(piece)
            length += len(piece)
            if with_payload:
                kept.append(piece)
        if b"".join(members.exactly(len(END))) != END or members.more():
            raise ValueError("a record does not end with its block")
        digest = payload.hexdigest()
        said = named.get("warc-payload-digest", "").removeprefix("sha1:")
        problem = None
        if named.get("warc-block-digest", "").removeprefix("sha1:") not in ("", block.hexdigest()):
            problem = "block digest"
        elif kind == "revisit":
            digest, length = said, int(fields(b"\r\n" + http)["content-length"])
        elif said not in ("", digest):
            problem = "payload digest"
        yield {"offset": at, "record_id": named.get("warc-record-id"), "record_type": kind, "refers_to_id": named.get("warc-refers-to"),
               "target_uri": named.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "problem": problem,
               **({"payload": b"".join(kept)} if with_payload else {})}


def read_archives(manifest: DataFrame, with_payload: bool = False, strict: bool = True) -> DataFrame:
    """The records of all archives named in ``manifest.archive`` (other columns are not read), warcinfo
    records left out. A broken record fails the job, or (``strict`` false) has its ``problem`` named;
    what follows a break inside an archive is not read. A revisit's payload is that of its response:
    its size and digest are what it says of it, see ``resolved``.
    """
    schema = RECORDS + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store_fs, path = pafs.FileSystem.from_uri(archive)
                rows: list[dict] = []
                held = 0
                with store_fs.open_input_stream(path, compression=None) as stream:
                    try:
                        for r in read_records(stream, with_payload):
                            if strict and r["problem"]:
                                raise ValueError(f"record at {r['offset']}: {r['problem']} does not hold")
                            if r["record_type"] in ("response", "revisit"):
                                rows.append(r)
                                held += 256 + len(r.get("payload", b""))
                            if held > 16 << 20:
                                yield rows_batch(rows, archive)
                                rows, held = [], 0
                    except (ValueError, KeyError, zlib.error) as e:
                        if strict:
                            raise ValueError(f"{archive}: {e}") from e
                        rows.append({"problem": str(e)})
                yield rows_batch(rows, archive)

    def rows_batch(rows, archive):
        types = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.record_batch([pa.array([archive if n == "archive" else r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

    spark = manifest.sparkSession
    return manifest.select("archive").repartition(partitions(spark), "archive").mapInArrow(read, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the size and digest of the full payload, a revisit's taken from the response it
    refers to; a revisit whose response is not there has null in both."""
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    whole = responses.groupBy(F.col("record_id").alias("of")).agg(F.max("payload_bytes").alias("size"), F.max("payload_digest").alias("sha1"))
    found = revisits.join(whole, F.col("refers_to_id") == F.col("of"), "left").withColumns({"payload_bytes": F.col("size"), "payload_digest": F.col("sha1")})
    return responses.unionByName(found.select(*records.columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, payload_bytes, payload_digest, record_type and refers_to, all read
    back from archives written of the whole table. Nulls, ties and repeated rows: see
    ``write_archives``; an empty table gives no archives and no rows. Other columns are not read.
    """
    records = store(read_archives(write_archives(pages)), "warc-records")
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] AS BIGINT)")
    return resolved(records).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k"""
