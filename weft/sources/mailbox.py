"""Mail as a data source of Spark: format("weft_mail"), for batches and for streams.

A folder holds messages, one a file, or many in a file whose name ends in .mbox or .txt and whose messages each begin with
a line "From ". Partitions are files packed to BYTES, and stretches of BYTES of larger ones: a stretch has the messages that
begin in it. Filters on file that Spark hands down (equality, lists, prefixes) leave files out before any is opened. A scan
neither sorts nor counts. As a stream the source goes by time of change and name; files are written once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith

from ..functions import text as T

FORMAT = "weft_mail"
SCHEMA = "file string, id string, sender string, subject string, in_reply_to string, references string, date string, body string"
#: Bytes of a partition, and of a read.
BYTES, AT_ONCE = 16 << 20, 1 << 20
MANY = (".mbox", ".txt")
#: Rows of a batch.
ROWS = 1000


class Stretch(InputPartition):
    """Files with the stretch of each that is read: name, start, end (of None: to the end, one message)."""

    def __init__(self, files: list[tuple]):
        self.files = files


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _listed(path: str) -> list[tuple[str, int, int]]:
    """name, size, time of change (ns) of the files of a folder; hidden ones and marks of writers are none."""
    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    names = [(i.path[len(root.rstrip("/")) + 1 :], i.size, i.mtime_ns or 0) for i in found if i.is_file]
    return sorted(n for n in names if not n[0].rpartition("/")[2].startswith(("_", ".")))


def planned(files: list[tuple], size: int) -> list[Stretch]:
    """Partitions of some size: large files in stretches, small ones together."""
    out, held, room = [], [], size
    for name, length, _ in files:
        if name.endswith(MANY):
            pieces = [(name, a, min(length, a + size)) for a in range(0, length, size)]
        else:
            pieces = [(name, 0, None)]
        for piece in pieces:
            cost = (length if piece[2] is None else piece[2] - piece[1]) + 1024  # opening a file costs, too
            if held and cost > room:
                out.append(Stretch(held))
                held, room = [], size
            held.append(piece)
            room -= cost
    return [*out, Stretch(held)] if held else out


def messages(f, start: int, end: int):
    """Raw messages of an open file of many whose "From " line begins in [start, end). What follows a message's last line is not read."""
    at = max(0, start - 1)
    f.seek(at)
    rest, lines, skip = b"", None, start > 0
    while True:
        block = f.read(AT_ONCE)
        data = rest + block
        cut = len(data) if not block else data.rfind(b"\n") + 1
        rest = data[cut:]
        for line in data[:cut].splitlines(keepends=True) if b"\r" not in data[:cut] else _lines(data[:cut]):
            here, at = at, at + len(line)
            if skip:  # the end of a line that begins before the stretch
                skip = False
                continue
            if line.startswith(b"From "):
                if lines is not None:
                    yield b"".join(lines)
                if here >= end:
                    return
                lines = []
            elif lines is not None:
                lines.append(line[1:] if line.lstrip(b">").startswith(b"From ") else line)
        if not block:
            break
    if lines is not None:
        yield b"".join(lines)


def _lines(data: bytes) -> list[bytes]:
    """Lines that end with a line feed only."""
    return [x + b"\n" for x in data.split(b"\n")[:-1]] + ([data.split(b"\n")[-1]] if not data.endswith(b"\n") else [])


def _fields(name: str, raw: bytes) -> tuple:
    import email
    from email import policy

    from .readers import _mail_fields

    stem = name.rpartition("/")[2].rpartition(".")[0] or name
    if name.endswith(MANY):
        stem = str(email.message_from_bytes(raw, policy=policy.compat32).get("Message-ID", "")).strip().strip("<>")
    return (name, stem, *_mail_fields(raw))


def read_stretch(path: str, stretch: Stretch):
    """Arrow batches of a partition's messages."""
    import pyarrow as pa

    system, root = _system(path)
    kind = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])
    rows: list = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=kind)

    for name, start, end in stretch.files:
        with system.open_input_file(f"{root.rstrip('/')}/{name}") as f:
            for raw in [f.read()] if end is None else messages(f, start, end):
                rows.append(_fields(name, raw))
                if len(rows) >= ROWS:
                    yield batch()
                    rows.clear()
    if rows:
        yield batch()


class MailReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.tests = path, size, []

    def pushFilters(self, filters):  # noqa: N802
        """Takes filters on file; the others stay Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) == ("file",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        return all(name == v if kind == "EqualTo" else name in v if kind == "In" else name.startswith(v) for kind, v in self.tests)

    def partitions(self):
        return planned([f for f in _listed(self.path) if self._wanted(f[0])], self.size) or [Stretch([])]

    def read(self, partition):
        yield from read_stretch(self.path, partition)


class MailStream(DataSourceStreamReader):
    """Offsets are the time of change and the name of the last file of a batch."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self):  # noqa: N802
        return {"time": -1, "name": ""}

    def latestOffset(self):  # noqa: N802
        return max(({"time": t, "name": n} for n, _, t in _listed(self.path)), key=_place, default=self.initialOffset())

    def partitions(self, start, end):
        return planned([f for f in _listed(self.path) if _place(start) < (f[2], f[0]) <= _place(end)], self.size)

    def read(self, partition):
        yield from read_stretch(self.path, partition)

    def commit(self, end):
        pass


def _place(offset: dict) -> tuple:
    return offset["time"], offset["name"]


class MailSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def _at(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("partitionbytes", BYTES))

    def reader(self, schema):
        return MailReader(*self._at())

    def streamReader(self, schema):  # noqa: N802
        return MailStream(*self._at())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailSource)


def mails(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, id, sender, subject, thread, body, date of the messages of a folder."""
    register(spark)
    return threaded(spark.read.format(FORMAT).options(**options).load(path))


def mail_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return threaded(spark.readStream.format(FORMAT).options(**options).load(path))


def threaded(raw: DataFrame) -> DataFrame:
    return raw.select("file", "id", "sender", "subject", T.thread_key(F.col("in_reply_to"), F.col("references"), F.col("subject")).alias("thread"), "body", "date")


def write_mbox(messages: DataFrame, path: str) -> None:
    """Writes messages (headers: map of name to text, body) as files of many; lines of a body that begin as a message would are marked."""
    head = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"(?m)^(>*From )", ">$1")
    fixed = 'MIME-Version: 1.0\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit'
    messages.select(F.concat(F.lit("From -\n"), head, F.lit(f"\n{fixed}\n\n"), body, F.lit("\n")).alias("value")).write.text(path)
