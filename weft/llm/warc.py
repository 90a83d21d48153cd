"""WARC archives as chunked record tables.

Writing: the payloads are cut into a table of chunk rows (record identifier, chunk number, at most CHUNK bytes), each row
with the digests and the length of all chunks so far. That table is written first; archives are then streamed from its
files chunk by chunk, so no payload is put together again. A record's header needs the whole payload's digest and length,
which are in its last chunk row and come to the writer with the decision on the record. Reading: archives are streamed too,
and a payload leaves as rows of (record_id, chunk_no) with the digest of all chunks so far, the last one marked.

Records: WARC/1.1 in one gzip member each. Of equal payloads one record is a response, the one with the largest page_id
(of records that repeat that id, the last read); the others are revisits of it (identical-payload-digest) that hold the
response's HTTP header only. Decisions are made for records, not for ids, so repeated ids are records of their own.

Scale. Payloads never shuffle: each file of the chunk table becomes part of one archive, and only decisions (about 100
bytes a record) go to the task that has the file. Equality is one aggregate with partial sums, so a page that a third of
the rows repeat sends a row a task. Readers and writers hold a few chunks at a time, however long a record is.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir
from .token_store import file_system

CHUNK = 1 << 20
LEAST_BYTES = 0
#: Chunk rows that a task reads of a chunk table, or sends on, at once.
ROWS = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_CHUNKS = pa.schema([("rid", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.binary()), ("sha256", pa.binary()), ("is_last", pa.bool_())])
_CHUNK_ROW = "rid long, page_id long, url string, chunk_no long, chunk binary, bytes_so_far long, sha1_so_far binary, sha256 binary, is_last boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_table(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", *, chunk: int = CHUNK) -> DataFrame:
    """Writes the chunk rows of all payloads below path: rid (one number a record), page_id, url (first chunk only),
    chunk_no, chunk, bytes_so_far, sha1_so_far, sha256 (last chunk only), is_last. A file holds whole records in order."""

    def cut(batches):
        rows, held = [], 0
        for b in batches:
            for rid, page_id, url, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                payload = memoryview(body.as_buffer()) if body.is_valid else memoryview(b"")
                sha1, sha256, n = hashlib.sha1(), hashlib.sha256(), len(payload)
                for no, at in enumerate(range(0, max(n, 1), chunk)):
                    part = payload[at : at + chunk]
                    sha1.update(part)
                    sha256.update(part)
                    last = at + len(part) == n
                    rows.append((rid, page_id, None if no else url, no, bytes(part), at + len(part), sha1.digest(), sha256.digest() if last else None, last))
                    held += len(part)
                    if held >= 8 << 20 or len(rows) >= 4096:
                        yield _batch(rows, _CHUNKS)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, _CHUNKS)

    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").cast("binary").alias("body"))
    (rows.mapInArrow(cut, _CHUNK_ROW).write.mode("overwrite").option("maxRecordsPerFile", 0).option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path))
    return pages.sparkSession.read.schema(_CHUNK_ROW).parquet(path)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def decide(chunks: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """file, rid, page_id, n, sha1, record_type, refers_rid, refers_to for each record. Equal payloads have the same length, SHA-1 and SHA-256."""
    marks = chunks.where("is_last").select(F.col("_metadata.file_path").alias("file"), "rid", "page_id", F.col("bytes_so_far").alias("n"), F.col("sha1_so_far").alias("sha1"), "sha256")
    order = F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id", "rid")
    groups = marks.where(F.col("n") >= least_bytes).groupBy("sha256", "sha1", "n").agg(F.max(order).alias("r"), F.count("*").alias("k")).where("k > 1")
    groups = groups.select("sha256", "sha1", "n", F.col("r.rid").alias("refers_rid"), F.col("r.page_id").alias("refers_to"))
    out = marks.join(groups, ["sha256", "sha1", "n"], "left")
    revisit = F.col("refers_rid").isNotNull() & (F.col("refers_rid") != F.col("rid"))
    only = lambda c: F.when(revisit, F.col(c))
    return out.select("file", "rid", "page_id", "n", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), only("refers_rid").alias("refers_rid"), only("refers_to").alias("refers_to"))


def _header(kind: str, record: str, url: str, digest: str, http: bytes, length: int, refers: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:weft:record:{record}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {length}"]
    if refers:
        lines += [f"WARC-Refers-To: <urn:weft:record:{refers}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _stored(file: str):
    """(rid, url, chunk, is_last) of a file of the chunk table, a few rows at a time."""
    import pyarrow.parquet as pq

    fs, local = file_system(file)
    with fs.open_input_file(local) as f:
        for b in pq.ParquetFile(f, buffer_size=1 << 20, pre_buffer=False).iter_batches(ROWS, columns=["rid", "url", "chunk", "is_last"]):
            yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("rid", "url", "chunk", "is_last")), strict=True)


def _write_record(out, decision: dict, chunks) -> None:
    """One gzip member: the header, and of a response the chunks as they come."""
    n, whole = decision["n"], decision["record_type"] == "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    refers = None if whole else f"{decision['refers_rid']}:{decision['refers_to']}"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    first = last = False
    while not last:
        rid, url, part, last = next(chunks)
        if rid != decision["rid"]:
            raise ValueError(f"chunk of record {rid} where {decision['rid']} was due")
        if not first:
            first = True
            url = "".join(c for c in url or "" if c not in "\r\n")
            out.write(packer.compress(_header(decision["record_type"], f"{rid}:{decision['page_id']}", url, base32_sha1(decision["sha1"]), http, len(http) + whole * n, refers)))
        if whole:
            out.write(packer.compress(part))
    out.write(packer.compress(b"\r\n\r\n") + packer.flush())


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", *, least_bytes: int = LEAST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Writes one archive a task below path; returns the manifest (file, n_records).

    Null payloads and urls are empty; null ids are written as None and sort before all others. Rows that repeat an id are
    a record each. An empty table makes no file.
    """

    def write(batches):
        from pyspark import TaskContext

        at, out, n, file, chunks = TaskContext.get(), None, 0, None, None
        name = f"{path}/part-{at.partitionId():06d}-{at.taskAttemptId()}.warc.gz"
        for b in batches:
            for decision in b.to_pylist():
                if out is None:
                    fs, local = file_system(name)
                    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)
                if decision["file"] != file:
                    file, chunks = decision["file"], _stored(decision["file"])
                _write_record(out, decision, chunks)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "n_records": n}])

    chunks = chunk_table(pages, f"{path}/chunks", id_col, payload_col, url_col, chunk=chunk)
    plan = decide(chunks, least_bytes)
    n = chunks.where("is_last").select(F.col("_metadata.file_path").alias("file")).agg(F.countDistinct("file")).first()[0]
    dealt = plan.repartition(max(1, min(10_000, n)), "file").sortWithinPartitions("file", "rid")
    dealt.mapInArrow(write, "file string, n_records long").write.mode("overwrite").parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema("file string, n_records long").parquet(f"{path}/manifest")


class _Stream:
    """Bytes of an archive of gzip members, decompressed as they are asked for."""

    def __init__(self, f, chunk: int):
        self.f, self.chunk, self.packed, self.out = f, chunk, b"", bytearray()
        self.z = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.z.eof:
            self.packed = self.z.unused_data or self.packed
            self.z = zlib.decompressobj(31)
        data = self.z.unconsumed_tail or self.packed
        self.packed = b""
        if not data and not (data := self.f.read(self.chunk)):
            return False
        self.out += self.z.decompress(data, self.chunk)
        return True

    def line(self) -> bytes:
        while (at := self.out.find(b"\n")) < 0:
            if not self._more():
                line, self.out = bytes(self.out), bytearray()
                return line
        line = bytes(self.out[: at + 1])
        del self.out[: at + 1]
        return line

    def take(self, n: int) -> bytes:
        """Up to n bytes, at least one unless the archive ends."""
        while not self.out and self._more():
            pass
        part = bytes(self.out[:n])
        del self.out[: len(part)]
        return part


def _headers(s: _Stream) -> dict[str, str]:
    out = {}
    while (line := s.line().strip()) != b"":
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return out


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, *, with_bytes: bool = True) -> DataFrame:
    """Chunk rows of all archives: record_id, page_id, record_type, refers_to, chunk_no, chunk (null if not asked for),
    bytes_so_far, sha1_so_far (base32 of all chunks so far; a revisit's are those its header states), is_last."""

    def number(urn):
        x = urn.rpartition(":")[2].rstrip(">")
        return None if x in ("", "None") else int(x)

    def records(f):
        s = _Stream(f, chunk)
        while True:
            start = s.line()
            if not start:
                return
            if start.strip() == b"":
                continue
            if not start.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head = _headers(s)
            block = int(head["content-length"])
            first = s.line()
            http, used = {}, len(first)
            while (line := s.line()).strip() != b"":
                used += len(line)
                name, _, value = line.partition(b":")
                http[name.strip().lower()] = value.strip()
            used += len(line)
            row = {"record_id": head["warc-record-id"], "page_id": number(head["warc-record-id"]), "record_type": head["warc-type"], "refers_to": number(head.get("warc-refers-to", ""))}
            left, no, sha, n = block - used, 0, hashlib.sha1(), 0
            if head["warc-type"] == "revisit":
                yield row | {"chunk_no": 0, "chunk": None, "bytes_so_far": int(http[b"content-length"]), "sha1_so_far": head["warc-payload-digest"].rpartition(":")[2], "is_last": True}
                continue
            while True:
                part = bytearray()
                while left and len(part) < chunk:
                    got = s.take(min(left, chunk - len(part)))
                    if not got:
                        raise ValueError("record cut short")
                    part += got
                    left -= len(got)
                sha.update(part)
                n += len(part)
                yield row | {"chunk_no": no, "chunk": bytes(part) if with_bytes else None, "bytes_so_far": n, "sha1_so_far": base32_sha1(sha.digest()), "is_last": not left}
                no += 1
                if not left:
                    break
            if base32_sha1(sha.digest()) != head["warc-payload-digest"].rpartition(":")[2]:
                raise ValueError(f"{head['warc-record-id']}: digest")

    def read(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, local = file_system(name)
                with fs.open_input_stream(local, compression=None) as f:
                    rows, held = [], 0
                    for row in records(f):
                        rows.append(row)
                        held += len(row["chunk"] or b"")
                        if held >= 8 * chunk or len(rows) >= 2048:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("is_last", pa.bool_())])
    kind = "record_id string, page_id long, record_type string, refers_to long, chunk_no long, chunk binary, bytes_so_far long, sha1_so_far string, is_last boolean"
    n = max(1, min(10_000, manifest.count()))
    return manifest.select("file").repartition(n, "file").mapInArrow(read, kind)


def archive_and_read(pages: DataFrame, **kw) -> DataFrame:
    """Writes pages to archives in the shared folder, reads their chunk rows back and returns one row per record."""
    manifest = write_warc(pages, new_dir(pages.sparkSession, "warc"), **kw)
    last = read_chunks(manifest, kw.get("chunk", CHUNK)).where("is_last")
    return last.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to")
