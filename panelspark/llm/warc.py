"""WARC archives as a Spark data source, with identical-payload revisits.

Writing: every record is a gzip member of its own whose header carries, in the ``sl`` extra field,
the member's compressed length, so that a reader can step over a record it doesn't want.  Tasks
write files under fresh names; a commit publishes them in a manifest, so that files of failed or
repeated attempts are never read.

Reading: files are planned into partitions by size.  A gzip file larger than a partition is cut into
byte ranges: own files at member starts that the manifest lists, files of other writers where a
task finds the first member of its range (see ``member_start``).  Only the head of a member is
inflated at first; predicates on the record type and on other headers are tested on it, and the
payload of a record that fails them, or that nobody asked for (option ``payload`` = false), is
neither inflated nor decoded.  Plain files and gzip files of other writers, with a member for each
record or several records in one, can be read as well; plain files are not cut.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .ranges import BROADCAST_ROWS
from .storage import stored

# Names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, http_length bigint, content_length bigint, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
MANIFEST = "_manifest-"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _value(text: str) -> str:
    """Header values stay on one line: control characters and blanks become percent escapes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(row: dict) -> bytes:
    """One record.  A revisit keeps the HTTP header, with the length of the full payload, only."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['http_length']}\r\n\r\n".encode()
    head = [VERSION] + [f"{name}: {_value(row[c])}" for c, name in HEADERS.items() if row[c] is not None]
    head += [f"WARC-Profile: {PROFILE}"] * revisit
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else len(payload))}"]
    return b"".join(["\r\n".join(head).encode(), b"\r\n\r\n", http, b"" if revisit else payload, b"\r\n\r\n"])


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with its own length in the extra field ``sl``."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = squeeze.compress(data) + squeeze.flush()
    return struct.pack("<4BI2BH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, 24 + len(body) + 8, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    """Name and size of each file, and where some of its members start."""

    files: list[tuple[str, int, list[int]]]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, cut_bytes: int = 16 << 20):
        self.path, self.file_bytes, self.cut_bytes = path, file_bytes, cut_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = _open(self.path)
        where.create_dir(folder, recursive=True)
        out, name, size, cuts, files = None, "", 0, [], []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, size, cuts = f"{uuid.uuid4().hex}.warc.gz", 0, []
                        out = where.open_output_stream(f"{folder}/{name}", compression=None)
                    data = member(record(row))
                    if size - (cuts[-1] if cuts else 0) >= self.cut_bytes:
                        cuts.append(size)
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        files.append((name, size, cuts))
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files + [(name, size, cuts)] * (out is not None))

    def commit(self, messages: list) -> None:
        where, folder = _open(self.path)
        where.create_dir(folder, recursive=True)
        lines = [f"{name}\t{size}\t{','.join(map(str, cuts))}\n" for m in messages if m for name, size, cuts in m.files]
        with where.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}") as out:
            out.write("".join(lines).encode())

    def abort(self, messages: list) -> None:
        where, folder = _open(self.path)
        for name in [name for m in messages if m for name, *_ in m.files]:
            where.delete_file(f"{folder}/{name}")


class Files(InputPartition):
    """``(path, begin, end)``: the members that start in this range of the file are read."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class Reader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, payload: bool):
        self.path, self.partition_bytes, self.payload = path, partition_bytes, payload
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for x in filters:
            if len(x.attribute) == 1 and x.attribute[0] in HEADERS and isinstance(x, (EqualTo, In, IsNotNull, StringStartsWith)):
                self.tests.append(x)
            else:
                yield x

    def partitions(self) -> Sequence[InputPartition]:
        where, folder = _open(self.path)
        found = where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        manifests = [x for x in found if x.base_name.startswith(MANIFEST)]
        files: list[tuple[str, int, list[int]]] = []  # name, size, where it can be cut
        for x in manifests:
            with where.open_input_stream(x.path) as lines:
                for name, size, cuts in (y.split("\t") for y in lines.read().decode().splitlines()):
                    files.append((f"{folder}/{name}", int(size), [int(c) for c in cuts.split(",") if c]))
        if not manifests:
            for x in found:
                if x.is_file and x.base_name.endswith((".warc", ".warc.gz")):
                    cuts = range(self.partition_bytes, x.size, self.partition_bytes) if x.base_name.endswith(".gz") else ()
                    files.append((x.path, x.size, list(cuts)))
        ranges = []
        for path, size, cuts in files:
            begin = 0
            for cut, ahead in zip(cuts, [*cuts[1:], size] if cuts else [], strict=True):
                if ahead - begin > self.partition_bytes:
                    ranges.append((path, begin, cut))
                    begin = cut
            ranges.append((path, begin, size))
        groups: list[list[tuple[str, int, int]]] = []
        room = 0
        for path, begin, end in sorted(ranges, key=lambda x: (x[1] - x[2], x)):
            if not groups or room < end - begin:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append((path, begin, end))
            room -= end - begin
        return [Files(g) for g in groups] or [Files([])]

    def wanted(self, head: dict[str, str]) -> bool:
        for x in self.tests:
            value = head.get(HEADERS[x.attribute[0]].lower())
            if value is None:
                return False
            if isinstance(x, EqualTo) and value != x.value or isinstance(x, In) and value not in x.value or isinstance(x, StringStartsWith) and not value.startswith(x.value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = _open(self.path)
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("http_length", pa.int64()), ("content_length", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for path, begin, end in partition.ranges:
            with where.open_input_file(path) as file:
                for head, block in records(file, self.wanted, self.payload, begin, end):
                    row = {c: head.get(name.lower()) for c, name in HEADERS.items()}
                    http, payload = split_http(block)
                    row |= {"http_length": http, "content_length": int(head["content-length"]), "payload": payload if self.payload else None}
                    rows.append(row)
                    size += len(block)
                    if size >= 1 << 21 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows or not partition.ranges:
            yield pa.RecordBatch.from_pylist(rows, schema)


def parse_head(data: bytes) -> dict[str, str]:
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines) if name}


def split_http(block: bytes) -> tuple[int | None, bytes]:
    """Content-Length of the HTTP header, if there is one, and what follows the header."""
    if not block.startswith(b"HTTP/"):
        return None, block
    head, _, payload = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), payload
    return None, payload


def records(file: pa.NativeFile, wanted, payload: bool, begin: int = 0, end: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of every wanted record; without ``payload`` the block's HTTP header only.

    Of a gzip file, the records of members that start at ``begin`` or later but before ``end``.
    """
    total = file.size()
    end, at = total if end is None else end, begin
    gzipped = bytes(file.read_at(2, 0)) == b"\x1f\x8b" if total else False
    if gzipped and begin:
        at = member_start(file, begin, end, total)
    while at < end:
        source: Inflated | Plain = Inflated(file, at, total) if gzipped else Plain(file, at, total)
        while True:
            head = parse_head(source.until(b"\r\n\r\n"))
            length = int(head["content-length"])
            asked = wanted(head)
            block = b"" if not asked else source.peek(length) if payload else http_head(source, length)
            if asked:
                yield head, block
            if not source.more(length + 4):
                break
        at = source.end()


def http_head(source: Inflated | Plain, length: int) -> bytes:
    """The block's HTTP header with its blank line, however long; nothing of other blocks."""
    if source.peek(min(5, length)) != b"HTTP/":
        return b""
    size = 1024
    while True:
        data = source.peek(min(size, length))
        if (k := data.find(b"\r\n\r\n")) >= 0:
            return data[: k + 4]
        if size >= length:
            return data
        size *= 4


def member_start(file: pa.NativeFile, begin: int, end: int, total: int) -> int:
    """The first member that starts in the range, or ``end``.

    A start is a gzip header whose content begins with a WARC version, and whose member is followed
    by another such one or the end of the file.  Only an archive of archives that is stored without
    compression could hold the like within a payload.
    """
    window = 1 << 16
    for base in range(begin, end, window):
        data = bytes(file.read_at(min(window + 2, total - base), base))
        k = data.find(b"\x1f\x8b\x08")
        while 0 <= k < window and base + k < end:
            if (after := _member_end(file, base + k, total)) and (after >= total or _member_end(file, after, total)):
                return base + k
            k = data.find(b"\x1f\x8b\x08", k + 1)
    return end


def _member_end(file: pa.NativeFile, at: int, total: int) -> int:
    """Where the member at ``at`` ends; 0 if there is none with a WARC record."""
    try:
        source = Inflated(file, at, total)
        if not source.peek(5) == b"WARC/":
            return 0
        return source.end()
    except (zlib.error, ValueError):
        return 0


class Plain:
    """A record of a file that isn't compressed; ``end`` is known after ``more``."""

    def __init__(self, file: pa.NativeFile, at: int, total: int):
        self.file, self.at, self.total = file, at, total

    def until(self, mark: bytes) -> bytes:
        size = 2048
        while True:
            data = bytes(self.file.read_at(min(size, self.total - self.at), self.at))
            if (k := data.find(mark)) >= 0:
                self.at += k + len(mark)
                return data[:k]
            if self.at + size >= self.total:
                raise ValueError("the file ends within a record")
            size *= 4

    def peek(self, n: int) -> bytes:
        return bytes(self.file.read_at(n, self.at))

    def more(self, n: int) -> bool:
        self.at += n
        return False

    def end(self) -> int:
        return self.at


class Inflated:
    """A gzip member, inflated as far as asked for; what is passed is forgotten."""

    def __init__(self, file: pa.NativeFile, at: int, total: int):
        self.file, self.total, self.begin = file, total, at
        head = bytes(file.read_at(24, at))
        self.length = struct.unpack("<I", head[16:20])[0] if len(head) == 24 and head[3] == 4 and head[12:14] == b"sl" else 0
        self.read_to, self.data, self.used = at, bytearray(), 0
        self.inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)

    def _more(self, need: int) -> None:
        """At least ``need`` bytes behind the used ones, if the member has as many."""
        need += self.used
        while len(self.data) < need and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                stop = self.begin + self.length if self.length else self.total
                raw = bytes(self.file.read_at(min(1 << 18, stop - self.read_to), self.read_to))
                self.read_to += len(raw)
                if not raw:
                    raise ValueError("the file ends within a record")
            self.data += self.inflate.decompress(raw, max(1024, need - len(self.data)))

    def until(self, mark: bytes) -> bytes:
        need = 1024
        self._more(need)
        while (k := self.data.find(mark, self.used)) < 0:
            if self.inflate.eof:
                raise ValueError("the file ends within a record")
            need *= 2
            self._more(need)
        found = bytes(self.data[self.used : k])
        self.used = k + len(mark)
        return found

    def peek(self, n: int) -> bytes:
        self._more(n)
        return bytes(self.data[self.used : self.used + n])

    def _skip(self, n: int) -> None:
        """Pass ``n`` bytes without keeping them."""
        while n > 0:
            self._more(min(n, 1 << 20))
            step = min(n, len(self.data) - self.used)
            if not step:
                return
            self.used, n = self.used + step, n - step
            del self.data[: self.used]
            self.used = 0

    def more(self, n: int) -> bool:
        """Whether the member goes on behind the next ``n`` bytes, with another record."""
        if self.length:  # own members hold one record each
            return False
        self._skip(n)
        return len(self.peek(1)) > 0

    def end(self) -> int:
        if self.length:
            return self.begin + self.length
        while not self.inflate.eof:
            self._skip(len(self.data) - self.used)
            self._more(1)
        return self.read_to - len(self.inflate.unused_data)


class WarcSource(DataSource):
    """Options: path; payload (true); partition_bytes (64 MB); file_bytes (64 MB) and cut_bytes
    (16 MB, how far apart the listed member starts are) for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("partition_bytes", 64 << 20)), self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("file_bytes", 64 << 20)), int(self.options.get("cut_bytes", 16 << 20)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 64 << 20) -> DataFrame:
    """Records of all archives under ``path``; see ``SCHEMA``."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partition_bytes", partition_bytes).load(path)


def with_revisits(df: DataFrame, payload: Column, id_col: str, min_bytes: int = 100, salts: int = 16) -> DataFrame:
    """``df`` with payload, payload_bytes, payload_digest and refers_to.

    Of rows with equal payloads of ``min_bytes`` or more, ``refers_to`` names the smallest id in all
    rows but those of that id.  A null payload is empty.  Rows with a null id refer to the smallest
    id like any other; if an equal payload has no id at all, none is named.  Columns of ``df`` that
    have these names are replaced.

    Groups are found on digests and ids alone.  The table of digests that occur more than once is
    broadcast if its counted rows are few, so that no payload is shuffled; beyond that, a payload
    that many rows share is spread over ``salts`` partitions in the join.
    """
    own = ["payload", "payload_bytes", "payload_digest", "refers_to"]
    full = df.select(*[c for c in df.columns if c not in own], F.coalesce(payload, F.lit(b"")).alias("payload"))
    full = full.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    groups = full.where(F.col("payload_bytes") >= min_bytes).groupBy(F.unhex("payload_digest").alias("__digest")).agg(F.min(id_col).alias("__first"), F.count("*").alias("__n")).where("__n > 1").select("__digest", "__first")
    groups = stored(groups, "warc-groups")
    same = F.unhex("payload_digest") == F.col("__digest")
    if groups.count() <= BROADCAST_ROWS:
        joined = full.join(F.broadcast(groups), same, "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(id_col), F.lit("salt")), F.lit(salts))
        salted = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
        joined = full.join(salted, same & (salt == F.col("__salt")), "left").drop("__salt")
    refers = F.when(~F.col("__first").eqNullSafe(F.col(id_col)), F.col("__first"))
    return joined.withColumn("refers_to", refers).drop("__digest", "__first")


def write(df: DataFrame, path: str, id_col: str, uri_col: str, date: str | None = None, file_bytes: int = 64 << 20) -> None:
    """Write ``with_revisits``'s rows as archives under ``path``; record ids are ``urn:id:<id>``."""
    register(df.sparkSession)
    when = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    urn = lambda c: F.concat(F.lit("urn:id:"), F.coalesce(c.cast("string"), F.lit("")))
    revisit = F.col("refers_to").isNotNull()
    df.select(
        urn(F.col(id_col)).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col(uri_col).cast("string").alias("target_uri"),
        F.lit(when).alias("date"),
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        F.when(revisit, urn(F.col("refers_to"))).alias("refers_to"),
        F.col("payload_bytes").alias("http_length"),
        F.lit(None).cast("long").alias("content_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").option("file_bytes", file_bytes).mode("append").save(path)


def resolved(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` of records read back.

    Responses are measured on the payload; a revisit states its payload's digest and length, so
    that its record may have been read without payload.
    """
    number = lambda c: F.expr(f"try_cast(nullif(substring({c}, 8), '') as {id_type})")
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring("payload_digest", 8, 64)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
