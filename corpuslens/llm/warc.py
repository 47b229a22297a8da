"""WARC archives as a Python data source, with duplicates written as revisit records."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import cut, own_path

SCHEMA = "id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, record_id string, refers_to_id string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]
PREFIX, ROW, MANIFEST = "urn:corpuslens:page:", "urn:corpuslens:row:", "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a task goes on with another file; rows, and bytes of payloads, after which the reader gives a batch.
FILE_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 500, 8 << 20
#: Bytes of a read, and of the window that is held before and after a position, about.
READ_BYTES = 1 << 18
#: Payloads shorter than this are always written whole.
LEAST_BYTES = 1000


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _line(value: str) -> str:
    """A header value on one line: control characters, white space and per cent are percent-encoded."""
    return "".join(c if c.isprintable() and c not in " %" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def _unline(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value, errors="surrogatepass")


def record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record. The HTTP block of a response holds the payload with Content-Encoding deflate; a revisit's has
    its headers only. Both name digest and length of the full payload."""
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else zlib.compress(row["payload"] or b"", 1)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: deflate\r\nContent-Length: {len(body)}\r\nX-Payload-Length: {row['payload_bytes']}\r\n\r\n".encode()
    name = f"{PREFIX}{row['id']}" if row["id"] is not None else f"{ROW}{uuid.uuid5(uuid.NAMESPACE_URL, f'{row["uri"]} {row["payload_digest"]}')}"
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if row["uri"] is not None:
        head.append(f"WARC-Target-URI: {_line(row['uri'])}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode())
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PREFIX}{row['refers_to']}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    """Each task writes files of its own name; the driver lists those of the tasks that count in a manifest, so that
    what a lost executor or a second attempt has left is never read."""

    def __init__(self, options: dict) -> None:
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _fs(self.path)
        fs.create_dir(path, recursive=True)
        files: list[str] = []
        out, held = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or held >= FILE_BYTES:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc")
                    out, held = fs.open_output_stream(f"{path}/{files[-1]}"), 0
                data = record(row, self.date)
                out.write(data)
                held += len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, path = _fs(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list) -> None:
        fs, path = _fs(self.path)
        for m in messages:
            for x in m.files if m else []:
                fs.delete_file(f"{path}/{x}")


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]) -> None:
        self.names = names


class Stream:
    """Bytes of an uncompressed file or of one of gzip members, read forwards by position. A window of the file is held."""

    def __init__(self, raw, zipped: bool) -> None:
        self.raw, self.zipped = raw, zipped
        self.buffer, self.base, self.ended = b"", 0, False
        self.inflate = zlib.decompressobj(31)

    def _more(self, least: int) -> None:
        if not self.zipped:
            data = self.raw.read(max(least, READ_BYTES))
            self.ended = not data
        else:
            packed, data = self.inflate.unused_data or self.raw.read(READ_BYTES), b""
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            if packed.strip(b"\0"):
                data = self.inflate.decompress(packed)
            elif not packed:
                self.ended = True
        self.buffer = self.buffer + data if self.buffer else data

    def forget(self, at: int) -> None:
        """Nothing before the position is asked for again; in an uncompressed file what is not read yet is passed by a seek."""
        if at <= self.base + len(self.buffer):
            if at - self.base > READ_BYTES:
                self.buffer, self.base = self.buffer[at - self.base :], at
        elif not self.zipped:
            self.raw.seek(at)
            self.buffer, self.base = b"", at
        else:
            while not self.ended and at > self.base + len(self.buffer):
                self.base += len(self.buffer)
                self.buffer = b""
                self._more(0)
            self.buffer = self.buffer[max(0, at - self.base) :]
            self.base = at

    def take(self, at: int, n: int) -> bytes:
        while not self.ended and len(self.buffer) < at - self.base + n:
            self._more(at - self.base + n - len(self.buffer))
        return self.buffer[at - self.base : at - self.base + n]

    def header(self, at: int) -> tuple[int, bytes] | None:
        """Where the next header begins and what stands there up to the next empty line, or None at the end of the file.
        Empty lines in front are passed."""
        while (some := self.take(at, 4)) and some[:1] in b"\r\n":
            at += 1
        if not some:
            return None
        while (end := self.buffer.find(b"\r\n\r\n", at - self.base)) < 0:
            if self.ended:
                raise ValueError("a WARC record is cut off")
            self._more(len(self.buffer) - (at - self.base))
        return at, self.buffer[at - self.base : end]


def headers(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += f" {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _digest(value: str | None) -> str | None:
    """sha1 in lower-case hex of a digest header in base32 or hex; other digests as they stand."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return value
    if len(text) == 40:
        return text.lower()
    try:
        return base64.b32decode(text.upper()).hex()
    except ValueError:
        return value


def _number(name: str) -> int | None:
    tail = name.removeprefix(PREFIX)
    return int(tail) if tail != name and tail.lstrip("-").isdigit() else None


def entity(head: dict[str, str], body: bytes) -> bytes:
    """An HTTP body without its transfer and content codings; an unknown coding is left as it stands."""
    if "chunked" in head.get("transfer-encoding", "").lower():
        out, at = [], 0
        while (line := body.find(b"\r\n", at)) >= 0:
            size = body[at:line].split(b";")[0].strip()
            n = int(size, 16) if size else 0
            if not n:
                break
            out.append(body[line + 2 : line + 2 + n])
            at = line + 4 + n
        body = b"".join(out)
    coding = head.get("content-encoding", "").lower()
    if body and coding in ("gzip", "x-gzip"):
        return zlib.decompress(body, 47)
    if body and coding == "deflate":
        try:
            return zlib.decompress(body)
        except zlib.error:
            return zlib.decompress(body, -15)
    return body


class Reader(DataSourceReader):
    """A partition a file: of an archive that this source has written those of its manifest, else the .warc and .warc.gz
    files of the folder, or the one file that the path names.

    Of each record the headers are parsed first; where the pushed predicates on record_type, id, uri, refers_to or
    payload_digest fail, its block is passed over and not decoded, in an uncompressed file by a seek. Option payload:
    full (default), verify (decoded and checked, not returned) or none (never decoded). Payloads of foreign responses
    are the HTTP bodies without their codings, those of other foreign records their blocks; their sizes are known
    without a payload only where nothing has to be decoded, else null. Only own payloads are checked: others' digests
    may be of the coded body.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"].rstrip("/"), options.get("payload", "full")
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if isinstance(f, (EqualTo, EqualNullSafe)) and name in NAMES[:5] and f.value is not None:
                self.wanted.append((name, (f.value,)))
            elif isinstance(f, In) and name in NAMES[:5]:
                self.wanted.append((name, tuple(f.value)))
            elif isinstance(f, IsNotNull) and name == "record_type":
                pass
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, path = _fs(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [Files([path])]
        if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
                names = [f"{path}/{x}" for x in json.loads(f.read())]
        else:
            names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith((".warc", ".warc.gz")))
        return [Files([n]) for n in names] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.path)
        rows: list[tuple] = []
        held = 0
        for name in partition.names:
            with fs.open_input_file(name) as raw:
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                for row in self.records(Stream(raw, zipped)):
                    rows.append(row)
                    held += len(row[6] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    def records(self, f: Stream) -> Iterator[tuple]:
        at = 0
        while (found := f.header(at)) is not None:
            at, block = found
            head = headers(block)
            start, length = at + len(block) + 4, int(head["content-length"])
            row, names = self.head_row(head)
            if all(dict(zip(NAMES, row, strict=False))[k] in v for k, v in self.wanted):
                yield (*self.full_row(row, head, f.take(start, length)), *names)
            at = start + length
            f.forget(at)

    @staticmethod
    def head_row(head: dict) -> tuple[tuple, tuple]:
        name, refers, uri = head.get("warc-record-id", "").strip("<>"), head.get("warc-refers-to", "").strip("<>"), head.get("warc-target-uri")
        own = name.startswith((PREFIX, ROW))
        uri = _unline(uri) if own and uri is not None else uri
        return (_number(name), uri, head.get("warc-type"), _number(refers), _digest(head.get("warc-payload-digest"))), (name or None, refers or None)

    def full_row(self, row: tuple, head: dict, block: bytes) -> tuple:
        http, body = {}, block
        if head.get("content-type", "").lower().startswith("application/http"):
            end = block.find(b"\r\n\r\n")
            http, body = headers(block[: end if end >= 0 else len(block)]), block[end + 4 :] if end >= 0 else b""
        own = "x-payload-length" in http
        if row[2] == "revisit" or self.payload == "none":
            coded = "content-encoding" in http or "transfer-encoding" in http
            return (*row, int(http["x-payload-length"]) if own else None if coded or row[2] == "revisit" else len(body), None)
        payload = entity(http, body)
        if own and (len(payload) != int(http["x-payload-length"]) or hashlib.sha1(payload).hexdigest() != row[4]):
            raise ValueError(f"the payload of record {row[0]} differs from its headers")
        return (*row, len(payload), payload if self.payload == "full" else None)


class WarcSource(DataSource):
    """spark.read.format("warc").load(path), df.write.format("warc").mode("append").save(path); rows as in SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write one record per row and return the path, by default a new one in the shared folder.

    Of rows with equal payloads (html in UTF-8, null as empty) of LEAST_BYTES or more, those with the largest id are
    responses, the others revisit it; shorter ones are all responses. A null id is never the largest, and a group
    without ids is all responses. The largest id of a payload is aggregated before the shuffle; of payloads that stand
    in several rows it is cut and joined back, so that the join reads two plain exchanges and Spark can split the rows
    of a payload that very many pages share. Other payloads are joined by keys of their own. An empty table gives an
    archive without records; repeated rows are records each; other columns are ignored.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or own_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("uri"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = F.col("payload_bytes") >= LEAST_BYTES
    last = rows.where(large).groupBy("payload_digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("last is not null and n > 1")
    last = cut(last.select(F.col("payload_digest").alias("key"), "last"))
    rows = rows.withColumn("key", F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("id", "uri").cast("string"))))
    rows = rows.join(last, "key", "left")
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    rows = rows.select("id", "uri", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))
    rows.write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    """The records of an archive, own or foreign, as in SCHEMA; predicates on header columns are pushed into the source."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)
