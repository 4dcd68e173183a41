"""WARC archives: deduplicating writer, and a parallel reader by boundary-chain verification.

Writer: one record a row.  Among rows of equal payload the one with the least id is a ``response``; the others are ``revisit`` records,
which hold the HTTP header alone and refer to the response.  Files are gzip members of 1 MiB of the raw stream each, with a side
file of member offsets, so that any raw block can be read alone; plain files are read too.

Reader: tasks scan raw blocks for the magic and emit, for each candidate, the offset of its successor (where its length says the next
record starts), followed within the block up to the first offset outside it.  Pointer jumping from offset 0 of each file, by joins
that double the length of jumps each round, finds which candidate each block is entered at; magic inside payloads is never reached.
A last pass reads the records from those entries.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"WARC/1.1\r\n"
MEMBER = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    """A URN that holds the id: variant and version bits as RFC 4122 asks for, the 64 bits of the id around them."""
    v = 0 if page_id is None else page_id & (2**64 - 1)
    h = f"{v:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8{int(page_id is None)}0{h[15]}-000000000000>"


def id_of(urn: str) -> int | None:
    a = urn.strip("<>").rpartition(":")[2].split("-")
    if a[3][1] == "1":
        return None
    v = int(a[0] + a[1] + a[2][1:] + a[3][3], 16)
    return v - 2**64 if v >= 2**63 else v


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class ArchiveWriter:
    def __init__(self, uri: str):
        self.fs, self.path = C.filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.tmp = f"{self.path}.{os.getpid()}.{os.urandom(4).hex()}"
        self.out, self.held, self.raw, self.places = self.fs.open_output_stream(self.tmp, compression=None), bytearray(), 0, []

    def add(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= MEMBER:
            self._member(bytes(self.held[:MEMBER]))
            del self.held[:MEMBER]

    def _member(self, data: bytes) -> None:
        self.places.append(self.out.tell())
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.out.write(z.compress(data) + z.flush())
        self.raw += len(data)

    def close(self) -> int:
        if self.held:
            self._member(bytes(self.held))
        self.places.append(self.out.tell())
        self.out.close()
        with self.fs.open_output_stream(self.tmp + ".idx", compression=None) as idx:
            idx.write(struct.pack("<qq", self.raw, MEMBER) + np.array(self.places, "<i8").tobytes())
        self.fs.move(self.tmp + ".idx", self.path + ".idx")
        self.fs.move(self.tmp, self.path)  # a task that runs again puts the same bytes in the same place
        return self.raw


class Archive:
    """Random reads of the raw stream of a plain or a member-indexed archive."""

    def __init__(self, uri: str):
        fs, path = C.filesystem(uri)
        self.f = fs.open_input_file(path)
        self.places = None
        if path.endswith(".gz"):
            with fs.open_input_stream(path + ".idx", compression=None) as f:
                idx = f.read()
            self.size, self.member = struct.unpack_from("<qq", idx)
            self.places = np.frombuffer(idx, "<i8", offset=16)
            self.kept: dict[int, bytes] = {}
        else:
            self.size = self.f.size()

    def _part(self, m: int) -> bytes:
        if m not in self.kept:
            if len(self.kept) > 3:
                self.kept.pop(next(iter(self.kept)))
            at, end = int(self.places[m]), int(self.places[m + 1])
            self.kept[m] = zlib.decompress(self.f.read_at(end - at, at), 31)
        return self.kept[m]

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if self.places is None:
            return self.f.read_at(n, at)
        out = []
        for m in range(at // self.member, (at + n - 1) // self.member + 1 if n else 0):
            out.append(self._part(m)[max(0, at - m * self.member) : at + n - m * self.member])
        return b"".join(out)

    def header(self, at: int) -> tuple[dict[str, str], int] | None:
        """Fields of the record header at an offset and the offset of its block; None if there is no whole header.

        A header may be of any length: reading goes on as long as its whole lines are fields.
        """
        n = 1 << 12
        while True:
            data = self.read(at, n)
            end = data.find(b"\r\n\r\n")
            if end >= 0:
                break
            if len(data) < n or any(b":" not in line for line in data.split(b"\r\n")[1:-1]):
                return None
            n *= 4
        if not data.startswith(MAGIC):
            return None
        fields = {}
        for line in data[len(MAGIC) : end].decode("utf-8", "replace").split("\r\n"):
            name, sep, value = line.partition(":")
            if not sep:
                return None
            fields[name.lower()] = value.strip()
        if not fields.get("content-length", "").isdigit():
            return None
        return fields, at + end + 4

    def successor(self, at: int) -> int:
        """Where the next record starts, or -1 if no record of sound length starts here."""
        got = self.header(at)
        if got is None:
            return -1
        end = got[1] + int(got[0]["content-length"])
        return end + 4 if end + 4 <= self.size and self.read(end, 4) == b"\r\n\r\n" else -1

    def close(self) -> None:
        self.f.close()


def with_types(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Rows (id, url, payload, first): first is the least id among rows of equal payload, where there are others, else null."""
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    keyed = slim.withColumn("sha", F.sha1(F.encode("payload", "utf-8")))
    large = F.octet_length("payload") >= min_bytes
    # a payload that very many rows share is dealt to as many tasks as it has salts
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    parts = keyed.filter(large).groupBy("sha", "salt").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = parts.groupBy("sha").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1")
    first = shared.select("sha", "first", F.explode("salts").alias("salt"))
    return keyed.join(first, ["sha", "salt"], "left").select("id", "url", "payload", F.when(large, F.col("first")).alias("first"))


def write_archives(pages: DataFrame, out: str, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> list[tuple[str, int]]:
    """Writes one archive a partition; returns (path, raw bytes) of each: one small row a partition.

    Null payloads are empty ones.  Payloads of fewer than min_bytes are all responses.  Rows that repeat the least id of their payload
    are responses too; a null id is larger than any other, and a response if all of its payload are null.  Other columns are not read.
    """

    @C.tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = f"{out}/part-{TaskContext.get().partitionId():06d}.warc.gz", None
        for batch in batches:
            raw, offs = C.text_buffer(batch.column(2))
            for i, (page, url, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                file = file or ArchiveWriter(path)
                payload = raw[offs[i] : offs[i + 1]].tobytes()
                file.add(record(page, url, payload, base32_sha1(payload), first, first is not None and first != page))
        if file is not None:
            yield pa.RecordBatch.from_pydict({"path": [path], "raw": [file.close()]})

    C.gentle(pages.sparkSession)
    rows = with_types(pages, min_bytes, id_col, url_col, payload_col)
    return sorted(tuple(r) for r in rows.mapInArrow(write, "path string, raw long").collect())


def read_archives(spark: SparkSession, files: list[tuple[str, int]], *, block: int = 4 * MEMBER, payloads: bool = False) -> DataFrame:
    """One row a record reachable from the start of its file.

    page_id, payload_bytes, payload_digest, record_type, refers_to (and path, offset, url, payload, if payloads is set; the payload of
    a revisit is null).  Digest and length are taken from the bytes of a response and compared with its header; a revisit states those of
    the payload that it refers to.  A file that ends inside a record, or a response that does not match its digest, raises an error.
    """
    if not files:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", path string, offset long, url string, payload binary" if payloads else ""))
    names = spark.createDataFrame(files, "path string, size long")
    tasks = max(C.parts(spark), len(files))
    starts = names.withColumn("block", F.explode(F.expr(f"sequence(0L, greatest(0L, size - 1) div {block}L)"))).repartition(tasks, "path", "block")

    @C.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, at = Archive(path), b * block
                stop = min(size, at + block)
                data = a.read(at, block + len(MAGIC) - 1)
                found, i = [], data.find(MAGIC)
                while i >= 0:
                    found.append(at + i)
                    i = data.find(MAGIC, i + 1)
                jump = {x: a.successor(x) for x in found}
                for x in reversed(found):  # successors in the block are followed to the first outside it
                    jump[x] = jump.get(jump[x], -1 if jump[x] < stop else jump[x])
                a.close()
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(found), pa.string()), "at": pa.array(found, pa.int64()), "to": pa.array([jump[x] for x in found], pa.int64()), "size": pa.array([size] * len(found), pa.int64())})

    jumps, trash = C.store(starts.mapInArrow(scan, "path string, at long, to long, size long"), "jumps")
    dead = jumps.filter("at = 0 and to = -1").limit(1).collect()
    if dead:
        raise ValueError(f"{dead[0].path}: the chain of records breaks off in its first block")
    reached = names.select("path", F.lit(0).cast("long").alias("at"), "size")
    rounds, longest = 0, max(size for _, size in files)
    while (1 << rounds) * block < longest:  # after round k, chains of 2**k jumps from the start are known
        more = reached.join(jumps.select("path", "at", "to"), ["path", "at"]).filter("to < size")
        if not more.filter("to = -1").isEmpty():
            raise ValueError("a chain of records breaks off")
        reached, _ = C.store(reached.union(more.select("path", F.col("to").alias("at"), "size")).distinct(), "reached")
        then = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("then"))
        jumps, _ = C.store(jumps.join(then, ["path", "to"], "left").select("path", "at", F.coalesce("then", "to").alias("to"), "size"), "jumps")
        rounds += 1

    @C.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, stop, rows, held = Archive(path), min(size, (at // block + 1) * block), [], 0
                while at < stop:
                    got = a.header(at)
                    if got is None:
                        raise ValueError(f"{path}: no record at {at}")
                    fields, start = got
                    length = int(fields["content-length"])
                    body = a.read(start, length)
                    http, _, payload = body.partition(b"\r\n\r\n")
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response":
                        n = len(payload)
                        if base32_sha1(payload) != digest:
                            raise ValueError(f"{path}: record at {at} does not match its digest")
                    else:
                        n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        payload = None
                    refers = fields.get("warc-refers-to")
                    rows.append((id_of(fields["warc-record-id"]), n, digest, kind, refers and id_of(refers), path, at, fields.get("warc-target-uri"), payload))
                    at, held = start + length + 4, held + length
                    if payloads and held > 1 << 24:
                        yield table(rows)
                        rows, held = [], 0
                a.close()
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        cols = list(zip(*rows, strict=True))[: 9 if payloads else 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset", "url", "payload"][: len(cols)])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return reached.repartition(tasks, "path", "at").mapInArrow(emit, schema + (", path string, offset long, url string, payload binary" if payloads else ""))
