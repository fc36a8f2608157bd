"""WARC archives as a Python data source: spark.read.format("warc") and df.write.format("warc").

Files hold one gzip member per record (.warc.gz) or plain records (.warc). A writing task writes a file of its own under a
new name; each commit lists its files and where reading may begin in them in a manifest of its own, so what failed or
repeated tasks left behind is not read, and concurrent appends do not meet. A written member states its length in an extra
field of its gzip header, which other readers ignore. The reader plans a partition for each part of a file, parses a
record's headers first, tests record type and header predicates on them, and passes over the payload unless the row is
wanted and the query reads its payload: by seeking, or by inflating where a gzip member does not state its length.

An archive that is damaged or cut off is an error that names the file and the place; with the option damaged "skip" what
follows in that part of the file is left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from stayflow.sources.store import qualified, shared_dir, written

MANIFEST = "_warc_manifest"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns of a record; header columns can be pushed down, payload is what is decoded last.
SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: A new part begins in a file after so many bytes.
PART = 8 << 20


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, opened on the driver and on executors alike."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith(("/", "file:")) else posixpath.abspath(path))


class Damaged(ValueError):
    """An archive that does not hold whole records."""


def member(data: bytes, level: int = 1) -> bytes:
    """data as a gzip member whose extra field SL states the member's length in bytes."""
    machine = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = machine.compress(data) + machine.flush()
    length = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHQ", 12, b"SL", 8, length)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """The length that a member's first bytes state, or None."""
    if len(head) < 24 or head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != struct.pack("<H2sH", 12, b"SL", 8):
        return None
    return struct.unpack("<Q", head[16:24])[0]


def uri_safe(url: str) -> str:
    """One line: what would end or break a header is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, kind: str, url: str | None, date: str, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    """A response or revisit record. Its block is an HTTP answer, whose Content-Length is the full payload's also where a revisit leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {uri_safe(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    parts: list[int]
    size: int


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_id, record_type, target_uri, date, payload_digest, refers_to, payload_bytes, payload) to files."""

    def __init__(self, path: str, schema: T.StructType, packed: bool, overwrite: bool):
        self.path, self.names, self.packed, self.overwrite = path, schema.names, packed, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = store(self.path)
        fs.create_dir(root, recursive=True)
        name, out, parts, at = f"{uuid.uuid4().hex}.warc{'.gz' * self.packed}", None, [0], 0
        for whole in iterator:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                columns = {n: batch.column(i).to_pylist() for i, n in enumerate(self.names)}
                for row in zip(*[columns[n] for n in SCHEMA.names], strict=True):
                    record_id, kind, url, date, digest, refers, length, payload = row
                    data = record(record_id, kind, url, date, digest, length, payload or b"", refers)
                    if self.packed:
                        data = member(data)
                    if at - parts[-1] >= PART:
                        parts.append(at)
                    if out is None:
                        out = fs.open_output_stream(posixpath.join(root, name), compression=None)
                    out.write(data)
                    at += len(data)
        if out is None:
            return Written(None, [], 0)
        out.close()
        return Written(name, parts, at)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store(self.path)
        fs.create_dir(root, recursive=True)
        old = manifests(fs, root) if self.overwrite else []
        files = [{"name": m.name, "parts": m.parts, "size": m.size} for m in messages if m and m.name]
        at = posixpath.join(root, f"{MANIFEST}-{uuid.uuid4().hex}.json")
        with fs.open_output_stream(f"{at}.new") as f:
            f.write(json.dumps(files).encode())
        fs.move(f"{at}.new", at)
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = store(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(posixpath.join(root, m.name))


def manifests(fs: pyarrow.fs.FileSystem, root: str) -> list[str]:
    if fs.get_file_info(root).type != pyarrow.fs.FileType.Directory:
        return []
    return sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(root)) if re.fullmatch(rf"{MANIFEST}-\w+\.json", x.base_name))


@dataclass
class Part(InputPartition):
    name: str
    start: int
    end: int

    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, tests: list[tuple[str, set | None]], damaged: str = "error"):
        if damaged not in ("error", "skip"):
            raise ValueError(f"damaged must be error or skip: {damaged!r}")
        self.path, self.names, self.tests, self.damaged = path, schema.names, tests, damaged

    def partitions(self) -> list[Part]:
        fs, root = store(self.path)
        files = []
        listed = manifests(fs, root)
        for at in listed:
            with fs.open_input_stream(at) as f:
                files += json.loads(f.read())
        if not listed:  # archives of others: each file is one part
            found = fs.get_file_info(pyarrow.fs.FileSelector(root)) if fs.get_file_info(root).type == pyarrow.fs.FileType.Directory else [fs.get_file_info(root)]
            files = [{"name": x.path, "parts": [0], "size": x.size} for x in found if re.search(r"\.warc(\.gz)?$", x.path)]
        parts = [Part(posixpath.join(root, f["name"]), a, b) for f in files for a, b in zip(f["parts"], [*f["parts"][1:], f["size"]], strict=True) if b > a]
        return parts or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        fs, _ = store(self.path)
        rows: list[tuple] = []
        held = 0
        types = {"payload_bytes": pa.int64(), "payload": pa.binary()}

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for c, n in zip(columns, self.names, strict=True)], names=self.names)

        with fs.open_input_file(part.name) as f:
            source = Packed(f, part.start, part.end) if part.name.endswith(".gz") else Plain(f, part.start, part.end)
            while (row := self._next(source, part)) is not False:
                if row:
                    rows.append(row)
                    held += len(row[self.names.index("payload")] or b"") if "payload" in self.names else 0
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    def _next(self, source, part: Part) -> tuple | None | bool:
        at = source.place()
        try:
            return self._record(source)
        except (Damaged, zlib.error) as e:
            if self.damaged == "skip":
                return False
            raise Damaged(f"{part.name} at byte {at}: {e}") from e

    def _record(self, source) -> tuple | None | bool:
        """The next record's row; None if it is not wanted; False at the end."""
        head = source.headers()
        if head is None:
            return False
        value = {c: head.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            value[c] = value[c].strip("<>") if value[c] else None
        if value["payload_digest"]:
            value["payload_digest"] = value["payload_digest"].removeprefix("sha1:")
        stated = head.get("content-length", "")
        if not (stated.isascii() and stated.isdigit()):
            raise Damaged(f"a record without a length: {stated!r}")
        length = int(stated)
        if any(value[c] is None or wanted is not None and value[c] not in wanted for c, wanted in self.tests):
            source.skip(length)
            return None
        value |= {"payload_bytes": None, "payload": None}
        if "http" in head.get("content-type", ""):
            http, used = source.block_headers(length)
            if http.get("content-length", "").isdigit():
                value["payload_bytes"] = int(http["content-length"])
            rest = length - used
            if rest < 0:
                raise Damaged("the headers of a block go beyond its length")
            if value["record_type"] == "revisit" or "payload" not in self.names:
                source.skip(rest)
            else:
                value["payload"] = source.read(rest)
                source.skip(0)
        elif "payload" in self.names:
            value["payload"] = source.read(length)
            value["payload_bytes"] = length
            source.skip(0)
        else:
            value["payload_bytes"] = length
            source.skip(length)
        return tuple(value[n] for n in self.names)


class PushingReader(WarcReader):
    """Takes filters that Spark pushes down: equality, membership and presence of header columns are tested on the headers;
    the rest goes back to Spark.

    Spark 4.1 keeps what one query pushes with the loaded table, so that another query on the same DataFrame would lose
    rows. So this reader is used only if the option pushdown says that a load serves one query only; Spark then wants
    spark.sql.python.filterPushdown.enabled.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.tests.append((column, {f.value}))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, {v for v in f.value if v is not None}))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f


def parse_headers(data: bytes) -> dict[str, str]:
    """Header lines to a dictionary by lower-case name; lines that begin with white space go on."""
    found: dict[str, str] = {}
    name = ""
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class Plain:
    """Records one after the other; payloads that are not wanted are passed over by seeking."""

    def __init__(self, f, start: int, end: int):
        self.f, self.at, self.end, self.buffer = f, start, end, bytearray()

    def place(self) -> int:
        return self.at

    def _fill(self, n: int) -> bool:
        self.f.seek(self.at + len(self.buffer))
        more = self.f.read(max(n, 1 << 14))
        self.buffer += more
        return bool(more)

    def _until_blank(self) -> bytes | None:
        """What comes before the next empty line, with it; None if nothing but line ends is left."""
        seen = 0
        while (end := self.buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self.buffer) - 3)
            if not self._fill(1 << 14):
                if self.buffer.strip(b"\r\n"):
                    raise Damaged("headers that do not end")
                return None
        return self._take(end + 4)

    def _take(self, n: int) -> bytes:
        data = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.at += n
        return data

    def headers(self) -> dict[str, str] | None:
        if self.at >= self.end:
            return None
        head = self._until_blank()
        while head is not None and not head.strip(b"\r\n"):
            head = self._until_blank()
        if head is None:
            return None
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise Damaged(f"no record begins with {head[:20]!r}")
        return parse_headers(head)

    def block_headers(self, length: int) -> tuple[dict[str, str], int]:
        head = self._until_blank() or b""
        return parse_headers(head), len(head)

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n and self._fill(n - len(self.buffer)):
            pass
        if len(self.buffer) < n:
            raise Damaged(f"{n - len(self.buffer)} bytes of a block are missing")
        return self._take(n)

    def skip(self, n: int) -> None:
        """Over n bytes and the end of the record."""
        n += 4
        if len(self.buffer) < n and self.at + n > self.f.size():
            raise Damaged(f"{self.at + n - self.f.size()} bytes of a block or its end are missing")
        del self.buffer[:n]
        self.at += n


class Packed(Plain):
    """A gzip member per record: its first bytes are inflated for the headers, the rest only as far as it is read."""

    def __init__(self, f, start: int, end: int):
        super().__init__(f, start, end)
        f.seek(start)
        self.packed, self.machine, self.next = b"", None, None

    def place(self) -> int:
        return self.f.tell() - len(self.packed)

    def _fill(self, n: int) -> bool:
        while not self.machine.eof:
            if not self.packed:
                self.packed = self.f.read(1 << 16)
                if not self.packed:
                    raise Damaged("a gzip member is cut off")
            more = self.machine.decompress(self.packed, max(n, 1 << 12))
            self.packed = self.machine.unconsumed_tail or self.machine.unused_data
            if more:
                self.buffer += more
                return True
        return False

    def headers(self) -> dict[str, str] | None:
        at = self.place()
        if at >= self.end:
            return None
        while len(self.packed) < 24 and (more := self.f.read(1 << 16)):
            self.packed += more
        if not self.packed:
            raise Damaged("the file is shorter than its manifest says")
        length = member_length(self.packed)
        self.next = at + length if length else None
        self.machine, self.buffer = zlib.decompressobj(31), bytearray()
        head = self._until_blank()
        if head is None or not head.startswith(b"WARC/"):
            raise Damaged("a gzip member without a record")
        return parse_headers(head)

    def skip(self, n: int) -> None:
        """To the next member: at once if this one states its length; else inflating is the only way there, but nothing is kept."""
        self.buffer = bytearray()
        if self.next is None or self.machine.eof:
            while self._fill(1 << 18):
                self.buffer = bytearray()
            return
        if self.next > self.f.size():
            raise Damaged("a gzip member is cut off")
        ahead = self.next - self.place()
        if ahead <= len(self.packed):
            self.packed = self.packed[ahead:]
        else:
            self.packed = b""
            self.f.seek(self.next)


class WarcDataSource(DataSource):
    """Options: path; compression "gzip" (the default when writing) or "none"; predicates, a JSON list of [header column,
    list of values or null for any]; damaged "error" (the default) or "skip"; pushdown "true" to take Spark's filters as
    well. Schema: any columns of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        tests = [(c, set(v) if v is not None else None) for c, v in json.loads(self.options.get("predicates", "[]"))]
        if unknown := {c for c, _ in tests} - set(HEADERS):
            raise ValueError(f"no header columns: {sorted(unknown)}")
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else WarcReader
        return kind(self.options["path"], schema, tests, self.options.get("damaged", "error"))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        if missing := set(SCHEMA.names) - set(schema.names):
            raise ValueError(f"columns that a record needs: {sorted(missing)}")
        return WarcWriter(self.options["path"], schema, self.options.get("compression", "gzip") != "none", overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, where: dict[str, list[str] | None] | None = None, damaged: str = "error") -> DataFrame:
    """Records of archives. A path without a scheme lies in Spark's default file system. With `columns` only those are made, and payloads are not decoded unless asked for; `where`
    gives header columns the values that they may have (None: any value), tested before a payload is touched."""
    register(spark)
    schema = T.StructType([f for f in SCHEMA.fields if columns is None or f.name in columns])
    predicates = json.dumps([[c, v] for c, v in (where or {}).items()])
    return spark.read.format("warc").schema(schema).option("predicates", predicates).option("damaged", damaged).load(qualified(spark, path))


def read_filtered(spark: SparkSession, path: str, condition: Column, columns: list[str] | None = None, damaged: str = "error") -> DataFrame:
    """Records that meet a condition, which Spark pushes into the source: header predicates are tested before a payload is
    touched. The load serves this one condition, as Spark 4.1 keeps pushed filters with a loaded table; what is filtered
    further on is filtered by Spark above it. Sets spark.sql.python.filterPushdown.enabled for the session."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = T.StructType([f for f in SCHEMA.fields if columns is None or f.name in columns])
    loaded = spark.read.format("warc").schema(schema).option("pushdown", "true").option("damaged", damaged).load(qualified(spark, path))
    # generated, so that no later filter is moved below and pushed as well
    return loaded.where(condition).select(F.explode(F.array(F.struct(*schema.names))).alias("r")).select("r.*")


def write(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> str:
    """Write a record per row and return the folder.

    Of rows with equal payloads of at least least_revisit bytes, those with the largest id are responses and the others
    revisit it; smaller payloads are all responses. A null payload is empty; a null url leaves the header out; rows that
    repeat the largest id are all responses; a null id is smaller than any other, and where a payload has null ids
    alone, all its rows are responses. Record ids are urn:page:<id> (urn:page: for null). No rows: no records.
    """
    spark = pages.sparkSession
    register(spark)
    path = qualified(spark, path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "length": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("length") >= least_revisit).groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null")
    shared = written(shared.select(F.col("digest").alias("of"), "largest"), "payloads")
    rows = rows.join(shared, (rows.digest == shared.of) & (F.col("length") >= least_revisit), "left")
    again = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    records = rows.select(
        urn(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        base32(F.col("digest")).alias("payload_digest"),
        F.when(again, urn(F.col("largest"))).alias("refers_to"),
        F.col("length").alias("payload_bytes"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").option("compression", compression).mode("append").save(path)
    return path


def base32(digest):
    """Base32 of 20 bytes, as a column: eight letters for every five bytes."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.hex(digest)
    parts = []
    for at in range(0, 20, 5):
        number = F.conv(F.substring(hexed, 2 * at + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(letters), F.shiftright(number, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*parts)


#: The query of the catalogue in DuckDB SQL.
SQL = """
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as hex from pages
), w as (select hex, max(page_id) as largest from p group by hex
), b as (
  select p.*, largest, list_transform([1, 11, 21, 31], lambda k: ('0x' || substr(p.hex, k, 10))::bigint) as parts from p join w on p.hex = w.hex
)
select page_id, strlen(t)::bigint as payload_bytes,
       array_to_string(list_transform(parts, lambda v: array_to_string(list_transform(range(8), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (35 - 5 * k)::int) & 31)::int + 1, 1)), '')), '') as payload_digest,
       case when page_id = largest then 'response' else 'revisit' end as record_type,
       case when page_id <> largest then largest end as refers_to
from b
"""
