"""WARC archives as a data source of chunk rows, and one record for each distinct payload.

A payload travels as rows (record, chunk_no, data) of at most ``CHUNK`` bytes, in order; no task holds a payload in one
piece besides the row that it came from. SHA-1 and SHA-256 are taken as the chunks pass: first to find equal payloads,
again when an archive is written, where a record that does not have the announced digest is an error, and again when it
is read, where each chunk row carries the digest up to its end.

``spark.read.format("warc").load(folder)`` gives the chunk rows of a folder of archives, one task for each few of them;
``rows.write.format("warc").save(folder)`` writes chunk rows, in archives of about ``ARCHIVE`` bytes, each record
compressed by itself. Tasks write to a folder of the attempt; only what the tasks that count have written is moved in
place, when all are done, so a lost executor leaves nothing behind. The folder must be one that ``pyarrow.fs`` reaches
from the driver and all executors.

Defined cases: a null payload is empty; an empty one is a record of no bytes; a null address is left out of the record.
Rows that repeat in id and payload are the same record, written as often as they are there. A row without an id is a
revisit of a row with an equal payload that has one, if there is any, and else a response. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillmark.llm.runtime import met_by_groups, stored

#: Bytes of a payload that travel in one row.
CHUNK = 1 << 18
#: Bytes after which a task begins a new archive, and of archives that one task reads.
ARCHIVE, READ_AT_ONCE = 64 << 20, 8 << 20
#: Bytes of a record's or response's head.
MOST_HEAD = 1 << 20
#: Decisions on records that are broadcast at most: about 30 MB.
MOST_DECISIONS = 100_000

# Names and lines of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"

WRITTEN = ["record_id", "row_id", "target", "kind", "refers_to", "digest", "n_bytes", "chunk_no", "data"]
READ = (
    "record_id string, row_id string, target string, kind string, refers_to string, declared_digest string, declared_bytes bigint, "
    "chunk_no int, is_last boolean, n_bytes bigint, digest string, data binary"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# --- chunk rows


def chunks(rows: DataFrame, payload: str = "payload", size: int = CHUNK) -> DataFrame:
    """``rows`` with the payload as rows: ``chunk_no`` from 0, ``n_chunks`` and ``data``; one row without bytes if there are none."""
    data = F.col(payload).cast("binary")
    number = F.coalesce((F.greatest(F.octet_length(data), F.lit(1)) - 1).cast("int"), F.lit(0))
    rows = rows.withColumn("n_chunks", F.floor(number / size).cast("int") + 1)
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    return rows.withColumn("data", F.substring(data, F.col("chunk_no") * size + 1, F.lit(size))).drop(payload)


def heads(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, finger, n_bytes, digest, sha256) of each row (id, payload): digests of the whole payload, taken chunk by chunk.

    ``finger`` tells apart rows of the same id.
    """
    rows = rows.select("id", F.xxhash64(F.coalesce(F.col("payload").cast("binary"), F.lit(b""))).alias("finger"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = two = None
        total = 0
        for batch in batches:
            done, out = [], []
            for i, (no, of, data) in enumerate(zip(*(batch.column(c) for c in ("chunk_no", "n_chunks", "data")), strict=True)):
                if no.as_py() == 0:
                    one, two, total = hashlib.sha1(), hashlib.sha256(), 0
                if data.is_valid:
                    part = data.as_buffer()
                    one.update(part)
                    two.update(part)
                    total += len(part)
                if no.as_py() + 1 == of.as_py():
                    done.append(i)
                    out.append((total, base32(one.digest()), two.digest()))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))]
            at = pa.array(done, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("finger").take(at), *columns], names=["id", "finger", "n_bytes", "digest", "sha256"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return chunks(rows, size=size).mapInArrow(run, f"id {kind}, finger bigint, n_bytes bigint, digest string, sha256 binary")


def decided(found: DataFrame, least: int = 0) -> DataFrame:
    """``found`` (as ``heads`` gives it) once for each id and payload, with record_id, kind and refers_to.

    Of equal payloads of at least ``least`` bytes that of the largest id is the response, which the others refer to.
    """
    found = found.distinct()
    large = found.where(F.col("n_bytes") >= least)
    groups = stored(large.groupBy("sha256").agg(F.max("id").alias("chosen"), F.count("*").alias("size")))
    rows = met_by_groups(large, groups, "sha256", "size").drop("size")
    rows = rows.unionByName(found.where(F.col("n_bytes") < least).withColumn("chosen", F.col("id")))

    def urn(of: str):
        m = F.md5(F.concat_ws(":", F.coalesce(F.col(of).cast("string"), F.lit("")), F.hex("sha256")).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(m, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))

    again = F.col("chosen").isNotNull() & ~F.col("id").eqNullSafe(F.col("chosen"))
    rows = rows.withColumns({"record_id": urn("id"), "kind": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, urn("chosen"))})
    return rows.drop("chosen", "sha256")


def write(rows: DataFrame, path: str, id_col: str, target_col: str, payload_col: str, least: int = 0, size: int = CHUNK) -> None:
    """Archives of the rows in the folder ``path``: a response or revisit record for each."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(target_col).cast("string").alias("target"), F.col(payload_col).alias("payload"))
    decisions = stored(decided(stored(heads(rows, size)), least))
    if decisions.count() <= MOST_DECISIONS:
        decisions = F.broadcast(decisions)
    rows = rows.withColumn("finger", F.xxhash64(F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))).alias("r")
    same = F.col("r.id").eqNullSafe(F.col("d.id")) & (F.col("r.finger") == F.col("d.finger"))
    rows = rows.join(decisions.alias("d"), same).select(
        "record_id", F.col("r.id").cast("string").alias("row_id"), "target", "kind", "refers_to", "digest", "n_bytes",
        F.when(F.col("kind") == "response", F.col("payload")).alias("payload"),
    )
    rows.sparkSession.dataSource.register(WarcSource)
    chunks(rows, size=size).select(*WRITTEN).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, data: bool = True, size: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives in ``path``; without ``data``, payloads are read and digested, but not handed on."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("data", str(data).lower()).option("chunk", size).load(path)


def records(read_rows: DataFrame) -> DataFrame:
    """(record_id, row_id, target, kind, refers_to, n_bytes, digest, intact) of each record; ``refers_to`` is the response's row_id.

    A response has the bytes and digest that were read, a revisit those of the response that it refers to. ``intact``
    tells that they are what the record announces, and null that the response of a revisit is not there.
    """
    rows = stored(read_rows.where("is_last").drop("data", "chunk_no", "is_last"))
    wanted = rows.where("kind = 'revisit'").groupBy(F.col("refers_to").alias("of")).agg(F.count("*").alias("size"))
    there = rows.where("kind = 'response'").groupBy(F.col("record_id").alias("of")).agg(*(F.min(c).alias(f"its_{c}") for c in ("row_id", "n_bytes", "digest")))
    groups = stored(wanted.join(there, "of", "left"))
    revisits = rows.where("kind = 'revisit'").withColumn("of", F.col("refers_to")).drop("n_bytes", "digest")
    revisits = met_by_groups(revisits, groups, "of", "size")
    renamed = {"n_bytes": F.col("its_n_bytes"), "digest": F.col("its_digest"), "refers_to": F.col("its_row_id")}
    out = rows.where("kind <> 'revisit'").unionByName(revisits.withColumns(renamed).select(*rows.columns))
    intact = (F.col("digest") == F.col("declared_digest")) & (F.col("n_bytes") == F.col("declared_bytes"))
    return out.withColumn("intact", intact).select("record_id", "row_id", "target", "kind", "refers_to", "n_bytes", "digest", "intact")


# --- the data source


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WarcSource(DataSource):
    """Options: ``path``, ``data`` (true: payloads are handed on), ``chunk`` (bytes of a payload in a row)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ if self.options.get("data", "true") == "true" else READ.removesuffix(", data binary")

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("data", "true") == "true", int(self.options.get("chunk", CHUNK)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if schema.fieldNames() != WRITTEN:
            raise ValueError(f"chunk rows have the columns {', '.join(WRITTEN)}")
        return WarcWriter(self.options["path"].rstrip("/"), overwrite)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.pending = f"{path}/_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, place = store(self.pending)
        files.create_dir(place, recursive=True)
        out, done = None, Written()
        record = None
        for batch in iterator:
            columns = [batch.column(c) for c in WRITTEN]
            for i in range(batch.num_rows):
                *values, no, data = (c[i] for c in columns)
                if no.as_py() == 0:
                    if record is not None:
                        raise ValueError(f"{record.row} ends before its last byte")
                    if out is None or out.tell() >= ARCHIVE:
                        if out is not None:
                            out.close()
                        done.files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = files.open_output_stream(f"{place}/{done.files[-1]}", compression=None)
                    record = _Record(out, *(v.as_py() for v in values))
                if record is None:
                    raise ValueError("a record's chunks must follow each other")
                if record.add(data.as_buffer() if data.is_valid else b""):
                    record = None
        if record is not None:
            raise ValueError(f"{record.row} ends before its last byte")
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, place = store(self.path)
        pending = store(self.pending)[1]
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                if old.path.endswith(".warc.gz"):
                    files.delete_file(old.path)
        files.create_dir(place, recursive=True)
        for name in (n for m in messages if m is not None for n in m.files):
            files.move(f"{pending}/{name}", f"{place}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        files, pending = store(self.pending)
        if files.get_file_info(pending).type == fs.FileType.Directory:
            files.delete_dir(pending)


class _Record:
    """A record that is being written: its head at once, the payload as it comes, one compressed member in all."""

    def __init__(self, out, record_id, row_id, target, kind, refers_to, digest, n_bytes):
        self.out, self.row, self.digest, self.left = out, row_id, digest, n_bytes if kind == "response" else 0
        self.sha1 = hashlib.sha1() if kind == "response" else None
        self.packer = zlib.compressobj(4, wbits=31)
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
        named = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", None if target is None else quote(target, safe="!#$%&'()*+,/:;=?@[]~")),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Refers-To", refers_to),
            ("WARC-Profile", PROFILE if kind == "revisit" else None),
            ("Row-ID", row_id),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", len(http) + self.left),
        ]
        head = "".join(f"{n}: {v}\r\n" for n, v in named if v is not None)
        self._put(f"{VERSION}\r\n{head}\r\n".encode() + http)

    def _put(self, data) -> None:
        packed = self.packer.compress(data)
        if packed:
            self.out.write(packed)

    def add(self, data) -> bool:
        """Write a chunk; whether it was the last one."""
        if self.sha1 is not None:
            self.sha1.update(data)
        self.left -= len(data)
        self._put(data)
        if self.left > 0:
            return False
        if self.left < 0 or (self.sha1 is not None and base32(self.sha1.digest()) != self.digest):
            raise ValueError(f"the payload of {self.row} is not the one that was announced")
        self._put(CRLF + CRLF)
        self.out.write(self.packer.flush())
        return True


class Archives(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, data: bool, size: int):
        self.path, self.data, self.size = path, data, size

    def partitions(self) -> list[Archives]:
        files, place = store(self.path)
        found = sorted((f.path, f.size) for f in files.get_file_info(fs.FileSelector(place)) if f.path.endswith((".warc.gz", ".warc")))
        out, total = [], READ_AT_ONCE
        for name, size in found:
            if total + size > READ_AT_ONCE:
                out.append([])
                total = 0
            out[-1].append(name)
            total += size
        return [Archives(x) for x in out] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        schema = WarcSource({"data": str(self.data).lower()}).schema()
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
        held, total = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(fields)], schema=fields)

        for name in partition.value:
            for row, data in self._rows(name):
                held.append((*row, data) if self.data else row)
                total += len(data) + 400
                if total >= 4 << 20:
                    yield batch()
                    held, total = [], 0
        yield batch()

    def _rows(self, name: str) -> Iterator[tuple[tuple, bytes]]:
        with store(self.path)[0].open_input_stream(name, compression=None) as raw:
            stream = _Stream(raw, name.endswith(".gz"))
            while (head := stream.head()) is not None:
                length = int(head["content-length"])
                kind, http, payload = head.get("warc-type"), {}, length
                if "application/http" in head.get("content-type", ""):
                    before = stream.taken
                    http = stream.head() or {}
                    payload = length - (stream.taken - before)
                if payload < 0:
                    raise ValueError(f"{name}: the head of {head.get('warc-record-id')} is longer than the record")
                declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                size = int(http["content-length"]) if "content-length" in http else None if kind == "revisit" else payload
                known = (head.get("warc-record-id"), head.get("row-id"), head.get("warc-target-uri"), kind, head.get("warc-refers-to"), declared, size)
                sha1, n, no = hashlib.sha1(), 0, 0
                while True:
                    data = stream.take(min(self.size, payload - n))
                    sha1.update(data)
                    n += len(data)
                    yield (*known, no, n == payload, n, base32(sha1.digest())), data
                    no += 1
                    if n == payload:
                        break
                if stream.take(4) != CRLF + CRLF:
                    raise ValueError(f"{name}: {head.get('warc-record-id')} does not end where it should")


class _Stream:
    """Bytes of an archive, unpacked as they are asked for; members of a packed one follow each other."""

    def __init__(self, raw, packed: bool):
        self.raw, self.packed, self.taken = raw, packed, 0
        self.held, self.rest, self.unpacker = bytearray(), b"", None

    def _more(self) -> bool:
        """Hold some more bytes; False at the end."""
        while True:
            if not self.rest:
                self.rest = self.raw.read(1 << 18)
                if not self.rest:
                    if self.unpacker is not None:
                        raise ValueError("the archive ends within a record")
                    return False
            if not self.packed:
                self.held += self.rest
                self.rest = b""
                return True
            self.unpacker = self.unpacker or zlib.decompressobj(wbits=31)
            data = self.unpacker.decompress(self.rest, 1 << 18)
            self.rest = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.rest, self.unpacker = self.unpacker.unused_data, None
            if data:
                self.held += data
                return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.taken += n
        return out

    def head(self) -> dict[str, str] | None:
        """Named fields up to an empty line, names in lower case; None at the end of the archive."""
        seen = 0
        while (end := self.held.find(CRLF + CRLF, max(0, seen - 3))) < 0:
            seen = len(self.held)
            if seen > MOST_HEAD:
                raise ValueError("no end of a head where one should be")
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends within a head")
                return None
        lines = self.take(end + 4).decode("utf-8", "replace").split("\r\n")
        return {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:] if x)}
