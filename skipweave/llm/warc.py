"""WARC archives as a table of payload chunks (operator 6).

The pages table holds a payload as one value; from there on it passes as chunks of bounded size, each with its record's
identifier and its number, and both the writer and the reader carry the digest of the payload so far from chunk to chunk.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, file_system

#: Bytes of a payload chunk, at most.
CHUNK = 1 << 20
#: Bytes taken from a file at a time.
READ = 1 << 18
LEVEL = 3
#: The tables have no date of capture; fixed, so that equal input gives equal records.
DATE = "2000-01-01T00:00:00Z"
#: A fixed value of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"

SHA1_BASE32 = "sha1:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_kind(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, refers_to): refers_to is the smallest page_id among records of at
    least `least_bytes` with the same payload (SHA-1 and length), or null for that record itself and for lone ones.

    The smallest ids come from a partial aggregation in each task, so a payload that many pages share sends one row per
    task; the rows themselves meet them in a join whose large keys can be split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = rows.join(first, ["sha1", "payload_bytes"], "left")
    own = F.col("first").isNull() | F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return found.select("page_id", "url", "payload", "payload_bytes", "sha1", F.when(~own, F.col("first")).alias("refers_to"))


def in_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of a response's payload, in order (one empty chunk where there is none, as for revisits)."""
    last = F.when(F.col("refers_to").isNull(), F.greatest(F.lit(0), F.expr(f"cast((payload_bytes - 1) div {chunk} as int)"))).otherwise(0)
    rows = records.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "payload_bytes", "sha1", "refers_to", "chunk_no", data.alias("chunk"))


def record_head(page_id: int | None, url: str | None, payload_bytes: int, sha1: bytes, refers_to: int | None) -> bytes:
    """Everything of a record before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID}{page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    fields += [("WARC-Payload-Digest", SHA1_BASE32 + base32(sha1)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + (payload_bytes if refers_to is None else 0)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n" + http


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html; other columns are left out) to .warc.gz files below
    `folder`, which all executors must share, and returns their (path, n_records).

    A null html counts as an empty one, a null url becomes about:blank. Rows with equal ids each give a record; of equal
    payloads those with the smallest id are responses. A null id gives a record without a number and is never the
    smallest. An empty table gives no file. A task that is run again writes files of another name, and only files of the
    attempts that Spark accepted are in the returned list, which passes the driver, a row for each task. A response whose
    chunks do not add up to the digest and length that its head states raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(folder)
        name, n, out, gzip = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, None, None
        so_far, size, due = hashlib.sha1(), 0, None

        def end() -> None:
            if due is not None and due != (so_far.hexdigest(), size):
                raise ValueError("a payload's chunks differ from its digest or length")
            out.write(gzip.compress(b"\r\n\r\n") + gzip.flush())

        try:
            for batch in batches:
                chunks = batch.column("chunk")
                heads = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload_bytes", "sha1", "refers_to", "chunk_no")]
                for k, (page_id, url, payload_bytes, sha1, refers_to, chunk_no) in enumerate(zip(*heads)):
                    if out is None:
                        where.create_dir(base, recursive=True)
                        out = where.open_output_stream(f"{base}/{name}", compression=None)
                    if chunk_no == 0:
                        if n:
                            end()
                        n, gzip = n + 1, zlib.compressobj(LEVEL, wbits=31)
                        so_far, size, due = hashlib.sha1(), 0, (sha1, payload_bytes) if refers_to is None else None
                        out.write(gzip.compress(record_head(page_id, url, payload_bytes, bytes.fromhex(sha1), refers_to)))
                    chunk = chunks[k].as_buffer()
                    so_far.update(chunk)
                    size += len(chunk)
                    out.write(gzip.compress(chunk))
            if n:
                end()
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

    kind = "path string, n_records long"
    # not a table in `folder`: Hadoop's local file system starts a chmod for each file, which for a moment counts as a second executor
    return pages.sparkSession.createDataFrame(in_chunks(with_kind(pages, least_bytes)).mapInArrow(run, kind).collect(), kind)


class Source:
    """Bytes of a gzip file of many members, taken as they are needed."""

    def __init__(self, stream):
        self.stream, self.gzip, self.raw, self.held, self.ended = stream, zlib.decompressobj(wbits=31), b"", b"", False
        self.begun = False  # whether the current member has given bytes

    def _more(self) -> bool:
        """Adds some bytes to those held, never more than READ at once."""
        while not self.ended:
            if self.gzip.eof:
                self.raw, self.gzip, self.begun = self.gzip.unused_data, zlib.decompressobj(wbits=31), False
            self.raw = self.raw or self.stream.read(READ)
            data = self.gzip.decompress(self.raw, READ)  # at the end of the file, what the decompressor still holds
            self.begun = self.begun or bool(self.raw)
            self.ended = not self.raw and not data
            if self.ended and self.begun and not self.gzip.eof:
                raise ValueError("the file ends within a record")
            self.raw = b"" if self.gzip.eof else self.gzip.unconsumed_tail
            if data:
                self.held += data
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """The bytes up to and with the mark; b"" at the end of the file."""
        at = self.held.find(mark)
        while at < 0:
            if not self._more():
                if self.held:
                    raise ValueError("the file ends within a record")
                return b""
            at = self.held.find(mark)
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        """At least one of the next bytes, `most` at most."""
        if not self.held and not self._more():
            raise ValueError("the file ends within a record")
        out, self.held = self.held[:most], self.held[most:]
        return out


def chunks_of(source: Source, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of a file's records, one at a time.

    Records of other kinds than response and revisit (warcinfo, request, metadata, ...) pass with their whole block as
    payload. Digests and lengths are held against those that the record states, where it states them in this form; a
    revisit without them gives null. A record without a Content-Length raises an error, as nothing tells where it ends.
    """
    number = lambda s: int(s) if s and s.lstrip("-").isdigit() else None
    while head := source.until(b"\r\n\r\n"):
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one is due")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}
        if not fields.get("content-length", "").isdigit() or "warc-type" not in fields or "warc-record-id" not in fields:
            raise ValueError("a record without type, identifier or length")
        kind, left = fields["warc-type"], int(fields["content-length"])
        web = kind in ("response", "revisit") and fields.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        http = source.until(b"\r\n\r\n") if web and left else b""
        left -= len(http)
        digest = fields.get("warc-payload-digest" if web else "warc-block-digest", "")
        stated = digest.removeprefix(SHA1_BASE32) if digest.startswith(SHA1_BASE32) else None
        encoded = any(line.lower().startswith("transfer-encoding:") for line in http.decode("utf-8", "replace").split("\r\n"))
        whole = next((int(v) for k, _, v in (line.partition(":") for line in http.decode("utf-8", "replace").split("\r\n")) if k.lower() == "content-length" and v.strip().isdigit()), None)
        row = {
            "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "page_id": number(fields["warc-record-id"].strip("<>").removeprefix(ID)),
            "refers_to": number(fields.get("warc-refers-to", "").strip("<>").removeprefix(ID)),
        }
        sha1, at, chunk_no = hashlib.sha1(), 0, 0
        while True:
            parts, size = [], 0
            while left and size < chunk:
                parts.append(source.take(min(left, chunk - size)))
                size, left = size + len(parts[-1]), left - len(parts[-1])
            data = b"".join(parts)
            sha1.update(data)
            at += size
            so_far = base32(sha1.digest()) if kind != "revisit" else stated
            if not left and kind != "revisit" and not encoded and (so_far != (stated or so_far) or at != (at if whole is None else whole)):
                raise ValueError(f"{row['record_id']}: the payload differs from its digest or length")
            yield row | {"chunk_no": chunk_no, "chunk": data, "bytes_so_far": at if kind != "revisit" else whole, "digest_so_far": so_far, "is_last": not left}
            chunk_no += 1
            if not left:
                break
        if source.until(b"\r\n\r\n") != b"\r\n\r\n":
            raise ValueError("no end of record where one is due")


CHUNKS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_())])


def read_archives(files: DataFrame, n_files: int, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the files (column path): record_id, record_type, page_id, refers_to, chunk_no, chunk,
    bytes_so_far, digest_so_far (base32 SHA-1), is_last. Each file is read by one task, as a stream; a damaged record
    raises an error. A revisit gives one empty chunk with its payload's stated length and digest. n_files: for the number
    of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, name = file_system(path)
                with where.open_input_stream(name, compression=None) as stream:
                    for row in chunks_of(Source(stream), chunk):
                        rows.append(row)
                        size += len(row["chunk"])
                        if size >= BATCH_BYTES or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=CHUNKS)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=CHUNKS)

    kind = "record_id string, record_type string, page_id long, refers_to long, chunk_no int, chunk binary, bytes_so_far long, digest_so_far string, is_last boolean"
    return files.select("path").repartition(max(1, n_files)).mapInArrow(run, kind)


def records(chunks: DataFrame) -> DataFrame:
    """A row for each response and revisit, from its last chunk."""
    return chunks.where("is_last and record_type in ('response', 'revisit')").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
