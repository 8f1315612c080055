"""WARC archives as a Spark data source: records are written with streamed payloads and read back as a table of chunks."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import scratch, table

CHUNKS = "record_id string, chunk_no long, data binary, bytes_so_far long, digest_so_far string, is_last boolean, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long"
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in CHUNKS.split(", "))])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: No header is longer than this in what the reader accepts.
HEADER = 1 << 20


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """Archives are opened by pyarrow, so schemes that only Hadoop knows aren't."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def header(kind: str, record_id: str, uri: str | None, digest: str, length: int, refers_to: str | None, date: str) -> tuple[bytes, bytes]:
    """The record's header and the HTTP header that begins its block. digest is in hex; the file has it in base 32, as usual."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = len(http) + (length if kind == "response" else 0)
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date,
        "WARC-Target-URI": None if uri is None else quote(uri, safe="%/:?#[]@!$&'()*+,;=~-._"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Profile": PROFILE if kind == "revisit" else None, "WARC-Refers-To": refers_to and f"<{refers_to}>",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(block),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n").encode(), http


MANIFEST = "_MANIFEST-"


def _manifests(store: fs.FileSystem, path: str) -> list[str]:
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.startswith(MANIFEST) and i.base_name.endswith(".json"))


class _Message(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own, a gzip member for each record; a record's payload goes through the compressor in slices of Arrow's buffer. A manifest, written when all tasks are done, names the files of a write that count: what failed or doubled attempts left doesn't. A folder has one for each write; an overwriting one removes those before it."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.overwrite = overwrite
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.chunk, self.roll = int(options.get("chunkbytes", 1 << 18)), int(options.get("filebytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Message:
        store, path = _at(self.path)
        store.create_dir(path, recursive=True)
        files, out = [], None
        for b in iterator:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                if out is None or out.tell() >= self.roll:
                    if out is not None:
                        out.close()
                    files.append(f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(f"{path}/{files[-1]}", compression=None)
                kind, record_id, uri, digest, refers = (cols[c][i].as_py() for c in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to"))
                payload = memoryview(cols["payload"][i].as_buffer() or b"")
                head, http = header(kind, record_id, uri, digest, len(payload), refers, self.date)
                z = zlib.compressobj(1, wbits=31)
                out.write(z.compress(head + http))
                for at in range(0, len(payload) if kind == "response" else 0, self.chunk):
                    out.write(z.compress(payload[at : at + self.chunk]))
                out.write(z.compress(b"\r\n\r\n") + z.flush())
        if out is not None:
            out.close()
        return _Message(files)

    def commit(self, messages: list[_Message | None]) -> None:
        store, path = _at(self.path)
        store.create_dir(path, recursive=True)
        before = _manifests(store, path)
        name = f"{path}/{MANIFEST}{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())
        store.move(f"{name}.part", name)
        for x in before if self.overwrite else ():
            store.delete_file(x)

    def abort(self, messages: list[_Message | None]) -> None:
        store, path = _at(self.path)
        for m in messages:
            for x in m.files if m else ():
                store.delete_file(f"{path}/{x}")


class _Inflated:
    """Reads a file of gzip members (or plain bytes) forward; holds little more than what was asked for."""

    def __init__(self, raw, step: int = 1 << 16):
        self.raw, self.step, self.held, self.rest = raw, step, bytearray(), b""
        self.rest = raw.read(step)
        self.plain = self.rest[:2] != b"\x1f\x8b"
        self.z = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.z.eof:
            self.rest, self.z = self.z.unused_data or self.rest, zlib.decompressobj(31)
        if not self.rest:
            self.rest = self.raw.read(self.step)
            if not self.rest:
                return False
        if self.plain:
            self.held += self.rest
            self.rest = b""
        else:
            self.held += self.z.decompress(self.rest, self.step)
            self.rest = b"" if self.z.eof else self.z.unconsumed_tail
            if self.z.eof and not self.z.unused_data:
                self.rest, self.z = b"", zlib.decompressobj(31)
        return True

    def until(self, end: bytes) -> bytes:
        """What comes before end, which is read too; empty at the end of the file."""
        seen = 0
        while (k := self.held.find(end, max(0, seen - len(end)))) < 0:
            seen = len(self.held)
            if seen > HEADER:
                raise ValueError("a WARC header is too long")
            if not self._more():
                if self.held.strip():
                    raise ValueError("the WARC file ends in a header")
                return b""
        out = bytes(self.held[:k])
        del self.held[: k + len(end)]
        return out

    def peek(self, n: int) -> bytes:
        """The next n bytes, fewer where the file ends; they stay."""
        while len(self.held) < n and self._more():
            pass
        return bytes(self.held[:n])

    def within(self, n: int) -> bytes:
        """The HTTP header that begins the next n bytes, with the empty line after it; all of them, if they are few and have no such line; none of many."""
        size = 4096
        while True:
            seen = self.peek(min(size, n))
            m = re.search(rb"\r?\n\r?\n", seen)
            if m or size >= n or size > HEADER:
                return self.take(m.end() if m else n if n <= HEADER and seen.startswith((b"HTTP/", b"GET ", b"POST ", b"HEAD ")) else 0)
            size *= 4

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the WARC file ends in a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = re.split(r"\r?\n", head.decode("utf-8", "replace"))
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _declared(value: str) -> str | None:
    """A declared SHA-1 in hex: files have it in base 32, or in hex; other digests aren't checked."""
    name, _, text = value.partition(":")
    if name.lower() != "sha1":
        return None
    return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower() if len(text) == 40 else None


class _Payload:
    """The payload of a record's block, forward: what is left of it, without the chunks of its transfer where it has such."""

    def __init__(self, src: _Inflated, left: int, chunked: bool):
        self.src, self.left, self.raw = src, left, hashlib.sha1()
        self.chunked = chunked and re.match(rb"[0-9a-fA-F]+[ \t]*(;[^\r\n]*)?\r\n", src.peek(min(left, 1000))) is not None
        self.within = 0

    def _take(self, n: int) -> bytes:
        data = self.src.take(min(n, self.left))
        self.left -= len(data)
        self.raw.update(data)
        return data

    def take(self, n: int) -> bytes:
        """n bytes of it, fewer at its end."""
        if not self.chunked:
            return self._take(n)
        out = b""
        while len(out) < n and self.left:
            if not self.within:
                line = b""
                while not line.endswith(b"\n") and self.left and len(line) < 1000:
                    line += self._take(1)
                size = line.split(b";")[0].strip()
                if size and not re.fullmatch(rb"[0-9a-fA-F]+", size):
                    raise ValueError("a chunk of a transfer has no size")
                self.within = int(size or b"0", 16)
                if size and not self.within:  # the last; what follows are trailers
                    while self.left:
                        self._take(self.left if self.left < 1 << 16 else 1 << 16)
                continue
            data = self._take(min(n - len(out), self.within))
            self.within -= len(data)
            out += data
        return out


def chunks(raw, chunk: int) -> Iterator[tuple]:
    """Rows of CHUNKS for the records of an open file, of any kind and in order: a payload of n bytes has max(1, ceil(n / chunk)) of them.

    The payload is the block, without the HTTP header of such records and the chunks of its transfer. payload_bytes is what the block has, for a revisit what its HTTP header says; null where neither tells.
    A payload that isn't what a declared SHA-1 says is an error, unless the record says that it was cut short. Files by others that digest a chunked transfer as it is are right, too.
    """
    src = _Inflated(raw)
    while True:
        head = src.until(b"\r\n\r\n")
        if not head.strip():
            return
        f = _fields(head.lstrip(b"\r\n"))
        for name in ("warc-type", "content-length"):
            if name not in f:
                raise ValueError(f"a WARC record without {name}")
        left, kind = int(f["content-length"]), f["warc-type"]
        http = src.within(left) if "application/http" in f.get("content-type", "") else None
        fields = _fields(http) if http is not None else {}
        left -= len(http) if http is not None else 0
        declared = _declared(f.get("warc-payload-digest", "")) if "warc-truncated" not in f else None
        body = _Payload(src, left, "chunked" in fields.get("transfer-encoding", "").lower())
        told = fields.get("content-length", "")
        total = (int(told) if told.isdigit() else None) if kind == "revisit" else None if body.chunked else left
        hexed = _declared(f.get("warc-payload-digest", ""))
        same = f.get("warc-record-id", "").strip("<>"), kind, f.get("warc-target-uri"), f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None, hexed, total
        sha, done, k, data = hashlib.sha1(), 0, 0, body.take(chunk)
        while True:
            following = body.take(chunk) if len(data) == chunk else b""
            last = not following
            done += len(data)
            sha.update(data)
            if last and kind != "revisit" and declared and declared not in (sha.hexdigest(), body.raw.hexdigest()):
                raise ValueError(f"the payload of {same[0]} isn't what its record says")
            yield same[0], k, data, done, sha.hexdigest(), last, *same[1:]
            if last:
                break
            k, data = k + 1, following
        if src.take(4) != b"\r\n\r\n":
            raise ValueError(f"no end after {same[0]}")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunkbytes", 1 << 18))
        self.all = options.get("allfiles", "false").lower() == "true"

    def partitions(self) -> list[_File]:
        """The files that the manifests of writes name; where there is none, or allFiles is set, all archives of the folder. None at all is an error, but of a write without records."""
        store, path = _at(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return [_File(path)]
        manifests = [] if self.all else _manifests(store, path)
        files = []
        for x in manifests:
            with store.open_input_stream(x) as f:
                files += [f"{path}/{n}" for n in json.loads(f.read())]
        if not manifests:
            files = [i.path for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.base_name.endswith((".warc", ".warc.gz"))]
            if not files:
                raise ValueError(f"there is no archive in {self.path}")
        return [_File(x) for x in sorted(files)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _at(self.path)[0].open_input_stream(partition.path, compression=None) as raw:
            rows, size = [], 0
            for row in chunks(raw, self.chunk):
                rows.append(row)
                size += len(row[2]) + 300
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA, strict=True)], schema=_SCHEMA)


class WarcDataSource(DataSource):
    """format("wayfold_warc"): reads a folder of archives, or one, as CHUNKS; writes record_id, record_type, target_uri, refers_to, payload_digest and payload."""

    @classmethod
    def name(cls) -> str:
        return "wayfold_warc"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """What to write for each row of pages: record_id, record_type, target_uri, refers_to, payload_digest, payload.

    Of rows with equal payloads of min_bytes or more, those with the largest id are responses and the others revisit them (a null id is
    the smallest; rows that share the largest id are all responses). Null payloads are empty; a null url has no target; an empty table
    gives no records; other columns are not read. Payloads are equal if SHA-256 and length are; SHA-1 is the digest that is written.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"payload_digest": F.sha1("payload"), "same": F.sha2("payload", 256), "n": F.octet_length("payload")})
    last = p.where(F.col("n") >= min_bytes).groupBy("same", "n").agg(F.max("id").alias("last"), F.count("*").alias("c")).where("c > 1")
    last = last.select(F.concat("same", F.lit("")).alias("d"), F.col("n").alias("of"), "last")
    j = p.join(last, (F.col("same") == F.col("d")) & (F.col("n") == F.col("of")), "left")
    again = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return j.select(urn("id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(again, urn("last")).alias("refers_to"), "payload_digest", "payload")


def write_archives(recs: DataFrame, path: str, **options: object) -> None:
    """Adds the records to the folder's."""
    recs.sparkSession.dataSource.register(WarcDataSource)
    recs.write.format("wayfold_warc").options(**options).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, chunk_bytes: int = 1 << 18) -> DataFrame:
    """The table of chunks of a folder of archives, ours or others'. A payload is never held whole: each row has chunk_bytes of it at most, with the digest of all bytes so far."""
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("wayfold_warc").option("chunkBytes", chunk_bytes).load(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(records(table(spark, sf_dir, "pages")), path)
    ends = read_archives(spark, path).where("is_last")
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    full = F.col("record_type") == "response"
    return ends.select(
        page("record_id").alias("page_id"),
        F.when(full, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


QUERIES = {"op2_warc": op2_warc}
ORACLES = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN g USING (html)""",
}
