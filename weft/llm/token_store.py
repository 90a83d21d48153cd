"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document, in ascending id order; then a skippable frame with the documents' ids and token
counts, then the seek table of the public seekable format: for each frame its compressed size, its decompressed size and
the low half of its XXH64, then the number of frames, a descriptor and the closing magic number. Any zstandard reader can
decompress the whole file; read_documents reads the table's end first and then only the frames asked for.

Scale. One range shuffle of the texts by id; each task encodes, compresses and writes its range as a stream. Files carry
the attempt's number and count once their manifest row is committed, so lost executors leave nothing half read. The
manifest has a row for each file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, staged, text_or_empty

END_ID = 2
#: Fixed values of the zstandard formats: skippable frames (the index here, the seek table) and the seekable format's end.
INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: Bit of an index entry's flags: the document's id is null.
NULL_ID = 1

_INDEX = np.dtype([("id", "<i8"), ("n", "<u4"), ("flags", "u1")])
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])


def file_system(uri: str):
    """The pyarrow file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


class Writer:
    """Appends documents to an open binary stream."""

    def __init__(self, out, wide: bool, level: int = 3):
        import zstandard

        self.out, self.kind = out, "<u4" if wide else "<u2"
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False).compress
        self.index, self.table = [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        raw = ids.astype(self.kind).tobytes()
        frame = self.pack(raw)
        self.out.write(frame)
        self.index.append((doc_id or 0, len(ids), NULL_ID * (doc_id is None)))
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        index = np.array(self.index, _INDEX).tobytes()
        width = bytes([4 if self.kind == "<u4" else 2])
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 1) + width + index)
        table = np.array(self.table, _ENTRY).tobytes()
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC))
        self.out.close()


def read_tables(f) -> tuple[np.ndarray, np.ndarray, str]:
    """Index, seek table and the ids' type of an open file, from its end."""
    end = f.size()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_MAGIC or flags != CHECKSUMS:
        raise ValueError("no seek table")
    at = end - 9 - n * _ENTRY.itemsize
    f.seek(at)
    table = np.frombuffer(f.read(n * _ENTRY.itemsize), _ENTRY)
    f.seek(at - 8 - n * _INDEX.itemsize - 1)
    width = f.read(1)
    return np.frombuffer(f.read(n * _INDEX.itemsize), _INDEX), table, "<u4" if width == b"\4" else "<u2"


def _frames(f, table: np.ndarray, kind: str, which):
    import xxhash
    import zstandard

    unpack, starts = zstandard.ZstdDecompressor().decompress, np.concatenate([[0], np.cumsum(table["packed"].astype(np.int64))])
    for i in which:
        f.seek(int(starts[i]))
        raw = unpack(f.read(int(table["packed"][i])), max_output_size=int(table["size"][i]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != table["sum"][i] or len(raw) != table["size"][i]:
            raise ValueError(f"frame {i}: checksum")
        yield i, np.frombuffer(raw, kind).astype("<u4")


def read_documents(uri: str, doc_ids) -> dict[int, np.ndarray]:
    """Ids of the documents asked for; other frames are neither read nor decompressed."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        index, table, kind = read_tables(f)
        want = np.flatnonzero(np.isin(index["id"], np.array(list(doc_ids), np.int64)) & (index["flags"] & NULL_ID == 0))
        return {int(index["id"][i]): ids for i, ids in _frames(f, table, kind, want)}


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID) -> DataFrame:
    """Writes docs below path; returns the manifest: file, first_null, first_id, n_docs, n_tokens, and start, the ids of all files before.

    Null ids come first, null texts are empty, and an empty text is its end id. Rows that repeat an id follow each other.
    An empty table makes no file.
    """

    def write(batches):
        from pyspark import TaskContext

        from .tokens import encoder

        enc, out, at = encoder(tokenizer), None, TaskContext.get()
        name = f"{path}/part-{at.partitionId():06d}-{at.taskAttemptId()}.tok"
        n_tokens = first = 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, local = file_system(name)
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                out = Writer(fs.open_output_stream(local), enc.tok.get_vocab_size() > 0xFFFF or end_id > 0xFFFF)
                first = b.column(0)[0].as_py()
            ids, starts = enc.encode(b.column(1))
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                out.add(doc_id, np.append(ids[starts[i] : starts[i + 1]], np.uint32(end_id)))
            n_tokens += len(ids) + b.num_rows
        if out is not None:
            n_docs = len(out.index)
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_null": first is None, "first_id": first or 0, "n_docs": n_docs, "n_tokens": n_tokens}])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = staged(rows.mapInArrow(write, "file string, first_null boolean, first_id long, n_docs long, n_tokens long"), f"{path}/manifest")
    before = Window.orderBy(F.col("first_null").desc(), "first_id").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_tokens(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, and the ids (little-endian, 4 bytes each) if asked for."""

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, local = file_system(row["file"])
                with fs.open_input_file(local) as f:
                    index, table, kind = read_tables(f)
                    starts = row["start"] + np.cumsum(index["n"].astype(np.int64)) - index["n"]
                    got: list = []
                    for i, ids in _frames(f, table, kind, range(len(table))):
                        raw = ids.tobytes()
                        got.append({"doc_id": None if index["flags"][i] & NULL_ID else int(index["id"][i]), "start": int(starts[i]), "n_tokens": len(ids), "ids_crc32": zlib.crc32(raw)} | ({"ids": raw} if with_ids else {}))
                        if len(got) >= 4096:
                            yield pa.RecordBatch.from_pylist(got, schema)
                            got = []
                    yield pa.RecordBatch.from_pylist(got, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)
    n = max(1, min(10_000, manifest.count()))
    return manifest.repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def store_and_read(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    return read_tokens(write_tokens(docs, tokenizer, new_dir(docs.sparkSession, "tokens"), **kw))
