"""Web archives in ZIP packages: written by tasks, and read in place by ranges, without unpacking.

A package is a ZIP file with stored (not compressed) members: archives (WARC, each record a gzip member of its own or plain), indexes of their records
(lines of key, time and JSON with file name, offset and length), and a description. ``write`` makes packages from rows; of equal payloads only the one with the least id is
stored, others are revisit records that refer to it. Each attempt of a task writes files under names of its own, and those that count are named in a table, which
Spark commits whole; so a lost or repeated task leaves stray files at most.

``read`` takes a table of paths. A task finds a package's directory from its end (ZIP64 too) and each member's place from its local header; indexes are cut into ranges of
bytes, so that a large one is shared by tasks; the records they name are dealt out by stretches of their archive, and each stretch is read by one range request.
What is shuffled is narrow: places of records, and digests to find equal payloads. No payload goes through a shuffle unless the digests of repeated payloads are too many to broadcast.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Rounds, join_checked
from lodestar.operators.store import shared_folder

#: Payloads of fewer bytes are stored each time.
LEAST_BYTES = 100
#: Bytes of archive after which a task begins another package; bytes of an index that one row reads; bytes of archive that are dealt out and read together.
PACKAGE_BYTES, INDEX_BYTES, STRETCH_BYTES = 256 << 20, 4 << 20, 4 << 20
#: Bytes of packages that one task reads, about, if there are more than the session has cores.
TASK_BYTES = 64 << 20
#: Payload bytes that a batch of records holds, about.
BATCH_BYTES = 8 << 20
# Signatures, names and places of the ZIP, WARC and package formats.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
STORED, DEFLATED = 0, 8
ARCHIVE, INDEX, DESCRIPTION = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

Read = Callable[[int, int], bytes]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, as Spark names them too (``file:/x``), and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path)


# --- directories of ZIP files


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    header: int
    packed: int
    size: int


def _directory(read: Read, size: int) -> tuple[int, int, int]:
    """(place, bytes, entries) of the central directory; the place is right with anything written before the file, too."""
    tail = read(max(0, size - 22 - MAX16), min(size, 22 + MAX16))
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the signature may stand in the comment
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    entries, length, _ = struct.unpack_from("<HLL", tail, at + 10)
    place = size - len(tail) + at
    locator = read(place - 20, 20) if place >= 20 else b""
    if locator[:4] == LOCATOR64:
        stated = struct.unpack_from("<Q", locator, 8)[0]
        for begin in {stated, place - 20 - 56}:  # what was written before the file moves it
            end = read(begin, 56) if 0 <= begin <= size - 56 else b""
            if end[:4] == END64:
                entries, length = struct.unpack_from("<Q", end, 32)[0], struct.unpack_from("<Q", end, 40)[0]
                place = begin
                break
    return place - length, length, entries


def members(read: Read, size: int) -> list[Member]:
    """All members of a ZIP file of ``size`` bytes, by its central directory."""
    begin, length, entries = _directory(read, size)
    data, at, found = read(begin, length), 0, []
    for _ in range(entries):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<LLHHH", data, at + 20)
        header = struct.unpack_from("<L", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # 64-bit values of those fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                whole, packed, header = (next(wide, v) if v == MAX32 else v for v in (whole, packed, header))
            e += 4 + n
        found.append(Member(name, method, header, packed, whole))
        at += 46 + n_name + n_extra + n_comment
    return found if (shift := _shift(read, found, begin)) == 0 else [replace(m, header=m.header + shift) for m in found]


def _shift(read: Read, found: list[Member], begin: int) -> int:
    """By how many bytes members stand later than stated, because something was written before the file."""
    if not found or read(found[0].header, 4) == LOCAL:
        return 0
    first = min(m.header for m in found)
    for at in range(0, begin, 1 << 20):
        hit = read(at, min((1 << 20) + 3, begin - at)).find(LOCAL)
        if hit >= 0:
            return at + hit - first
    raise ValueError("no header of a member")


def data_start(read: Read, member: Member) -> int:
    head = read(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


# --- records


def _escaped(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _urn(key: str | None) -> str:
    return "<urn:row>" if key is None else f"<urn:row:{quote(key, safe='')}>"


def record(key: str | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers: str | None) -> bytes:
    """One WARC record, not compressed; a revisit (no payload) has the head of the answer only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {DATE}"]
    lines += [] if url is None else [f"WARC-Target-URI: {_escaped(url)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [] if payload is not None else [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(refers)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The fields of a record of bytes, which may be one gzip member."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    payload, stated = block, None
    if head.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        stated = int(told[1]) if told else None
    kind = head.get("warc-type")
    return {
        "record_id": head.get("warc-record-id"), "record_type": kind, "url": head.get("warc-target-uri"), "stated_digest": (head.get("warc-payload-digest") or "").rpartition(":")[2] or None,
        "refers_to": head.get("warc-refers-to"), "payload": None if kind == "revisit" else payload, "payload_bytes": stated if kind == "revisit" else len(payload),
        "payload_digest": None if kind == "revisit" else hashlib.sha256(payload).hexdigest(),
    }


# --- writing


class _Stream(io.RawIOBase):
    """A stream for zipfile, which only writes forward."""

    def __init__(self, to: pa.NativeFile) -> None:
        self.to = to

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.to.write(bytes(data))
        return len(data)


class _Package:
    """One package: records are appended to its archive; the index follows when it is closed."""

    def __init__(self, files: pafs.FileSystem, path: str) -> None:
        self.path, self.out = path, files.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Stream(self.out), "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines: list[bytes] = []
        self.at = 0
        self.sha = hashlib.sha256()
        self._put(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info>\r\nWARC-Date: " + DATE.encode() + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n")

    def _put(self, data: bytes) -> tuple[int, int]:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = squeeze.compress(data) + squeeze.flush()
        self.archive.write(packed)
        self.sha.update(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def add(self, key: str | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers: str | None) -> None:
        offset, length = self._put(record(key, url, payload, n_bytes, digest, refers))
        host, _, rest = re.sub(r"^[^/]*://", "", url or "").partition("/")
        place = _escaped(",".join(reversed(host.lower().split("."))) + ")/" + rest) or "-"
        told = {"url": url, "digest": f"sha256:{digest}", "length": str(length), "offset": str(offset), "filename": ARCHIVE.rpartition("/")[2], "status": "200"}
        self.lines.append(f"{place} {re.sub('[^0-9]', '', DATE)} {json.dumps(told)}\n".encode("utf-8", "replace"))

    def close(self) -> dict:
        n = self.at
        self.archive.close()
        index = b"".join(sorted(self.lines))
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        parts = [{"name": name.rpartition("/")[2], "path": name, "hash": f"sha256:{sha}", "bytes": size} for name, sha, size in ((ARCHIVE, self.sha.hexdigest(), n), (INDEX, hashlib.sha256(index).hexdigest(), len(index)))]
        self.zip.writestr(zipfile.ZipInfo(DESCRIPTION), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": parts}))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return {"path": self.path, "length": size, "records": len(self.lines)}


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes ``pages`` as packages to ``folder`` (new, and shared by all executors) and returns a table of (path, length, records), which is stored there as well.

    A null payload is empty. Of equal payloads of ``LEAST_BYTES`` or more, the rows with the least id are stored, others refer to it; a null id is above all others, and
    if all are null, all are stored; a row repeated in whole is as its twin. A null url is left out; spaces and control characters of urls are escaped. Very long payloads are
    records like others. Further columns are not written. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload"))
    equal = own.where(F.col("n_bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    equal = Rounds(spark).written(equal.select(F.col("digest").alias("of"), "first"), "equal")
    told = join_checked(own, equal, F.when(F.col("n_bytes") >= LEAST_BYTES, F.col("digest")), "of")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    told = told.select(F.col("id").cast("string").alias("id"), "url", F.when(~again, F.col("payload")).alias("payload"), F.col("n_bytes").cast("long").alias("n_bytes"), "digest", F.when(again, F.col("first")).cast("string").alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(f"{folder}/data")
        context, made, package = TaskContext.get(), [], None
        name = f"{context.partitionId() if context else 0:06d}-{uuid.uuid4()}"
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "n_bytes", "digest", "refers")]
            for k in range(batch.num_rows):
                if package is None:
                    files.create_dir(base, recursive=True)
                    package = _Package(files, f"{base}/{name}-{len(made):04d}.wacz")
                package.add(*[c[k].as_py() for c in columns])
                if package.at >= PACKAGE_BYTES:
                    made.append(package.close())
                    package = None
        if package is not None:
            made.append(package.close())
        rows = [{"path": f"{folder}/data/{m['path'].rpartition('/')[2]}", "length": m["length"], "records": m["records"]} for m in made]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())]))

    told.mapInArrow(run, "path string, length long, records long").write.mode("errorifexists").parquet(f"{folder}/written")
    return spark.read.parquet(f"{folder}/written")


# --- reading

_RECORD = "path string, offset long, record_id string, record_type string, url string, stated_digest string, refers_to string, payload binary, payload_bytes long, payload_digest string"


def _reader(path: str) -> tuple[pa.NativeFile, Read, int]:
    files, inner = opened(path)
    file = files.open_input_file(inner)

    def read(offset: int, length: int) -> bytes:
        return bytes(file.read_at(length, offset))

    return file, read, file.size()


def directories(packages: DataFrame) -> DataFrame:
    """(path, name, method, start, packed, size): the members of all ``packages`` (path), with the place of their first byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("method", pa.int32()), ("start", pa.int64()), ("packed", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file, read, size = _reader(path)
                with file:
                    rows = [{"path": path, "name": m.name, "method": m.method, "start": data_start(read, m), "packed": m.packed, "size": m.size} for m in members(read, size)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return packages.select("path").mapInArrow(run, "path string, name string, method int, start long, packed long, size long")


def _lines(read: Read, start: int, size: int, begin: int, end: int) -> Iterator[bytes]:
    """The lines of a member that begin in [begin, end)."""
    at = begin - 1 if begin else 0
    rest = b""
    skip = bool(begin)
    while at < size:
        chunk = read(start + at, min(1 << 20, size - at))
        at += len(chunk)
        rest += chunk
        *whole, rest = rest.split(b"\n")
        first = at - len(rest) - sum(len(x) + 1 for x in whole)
        for line in whole:
            if skip:
                skip = False
            elif first < end:
                yield line
            first += len(line) + 1
        if not skip and first >= end:
            return
    if rest and not skip and size - len(rest) < end:
        yield rest


def _inflated(read: Read, member: dict) -> bytes:
    data = read(member["start"], member["packed"])
    data = zlib.decompress(data, -15) if member["method"] == DEFLATED else data
    if data[:2] != b"\x1f\x8b":
        return data
    out = b""
    while data:  # a member a block
        one = zlib.decompressobj(31)
        out += one.decompress(data)
        data = one.unused_data
    return out


def entries(packages: DataFrame) -> DataFrame:
    """(path, offset, length): the places of all records that the packages' indexes name, in their files.

    Plain indexes are read by ranges that share lines out; a compressed one is read by one task. A record that several lines name is there once. An archive member that isn't
    stored, or that an index names and the package lacks, is an error.
    """
    found = directories(packages)
    archives = found.where("name like 'archive/%' and name not like '%/'").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("method", "start", "size")))).alias("archives"))
    plain = (F.col("method") == STORED) & ~F.lower("name").endswith(".gz")
    indexes = found.where("lower(name) rlike '^indexes/.*[.](cdx|cdxj)([.]gz)?$'").withColumn("step", F.when(plain, F.lit(INDEX_BYTES)).otherwise(F.greatest(F.col("size"), F.lit(1))).cast("long"))
    parts = indexes.join(archives, "path", "left").where("size > 0").withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("step"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for part in batch.to_pylist():
                file, read, _ = _reader(part["path"])
                places, rows = dict(part["archives"] or []), []
                with file:
                    whole = part["method"] != STORED or part["name"].lower().endswith(".gz")
                    lines = _inflated(read, part).split(b"\n") if whole else _lines(read, part["start"], part["size"], part["begin"], part["begin"] + part["step"])
                    for line in lines:
                        told = line.partition(b"{")
                        if not told[1] or line.startswith(b"!"):
                            continue
                        entry = json.loads(told[1] + told[2])
                        place = places.get(f"archive/{entry['filename']}") or places.get(entry["filename"])
                        if place is None or place["method"] != STORED:
                            raise ValueError(f"{part['path']} has no stored archive {entry['filename']}")
                        rows.append({"path": part["path"], "offset": place["start"] + int(entry["offset"]), "length": int(entry["length"])})
                yield pa.RecordBatch.from_pylist(rows, schema)

    dealt = parts.select("path", "name", "method", "start", "packed", "size", "begin", "step", "archives").repartition("path", "begin")
    return dealt.mapInArrow(run, "path string, offset long, length long").groupBy("path", "offset").agg(F.max("length").alias("length"))


def read(packages: DataFrame) -> DataFrame:
    """The records of all ``packages`` (path, length), each read by ranges from its place.

    (path, offset, record_id, record_type, url, stated_digest, refers_to, payload, payload_bytes, payload_digest): a revisit has no payload and no digest of its own, and the bytes it states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _RECORD.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.int64(), pa.string()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        file, name, rows, held = None, None, [], 0
        for batch in batches:
            places = batch.to_pylist()
            k = 0
            while k < len(places):
                path, begin = places[k]["path"], places[k]["offset"]
                end, last = begin + places[k]["length"], k + 1
                while last < len(places) and places[last]["path"] == path and max(end, places[last]["offset"] + places[last]["length"]) - begin <= STRETCH_BYTES:
                    end = max(end, places[last]["offset"] + places[last]["length"])
                    last += 1
                if path != name:
                    if file is not None:
                        file.close()
                    (file, fetch, _), name = _reader(path), path
                stretch = fetch(begin, end - begin)
                for place in places[k:last]:
                    at = place["offset"] - begin
                    rows.append({"path": path, "offset": place["offset"]} | parsed(stretch[at : at + place["length"]]))
                    held += len(rows[-1]["payload"] or b"") + 500
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                k = last
        if file is not None:
            file.close()
        yield pa.RecordBatch.from_pylist(rows, schema)

    length = packages.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(packages.sparkSession.sparkContext.defaultParallelism, -(-length // TASK_BYTES))  # places are narrow, so their bytes don't tell how many tasks reading takes
    dealt = entries(packages).repartition(tasks, "path", F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, _RECORD)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length): the packages below a folder, listed by Spark, which doesn't read them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wacz").load(folder).select("path", "length")


def resolved(records: DataFrame) -> DataFrame:
    """(record_id, url, record_type, refers_to, payload_bytes, payload_digest): revisits have the bytes and digest of the response they refer to, null if there is none.

    ``records`` are narrow columns of ``read``, stored. A response that many revisits refer to is joined by broadcast.
    """
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'")
    asked = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    held = responses.join(asked, "record_id", "left_semi").groupBy("record_id").agg(F.min(F.struct("payload_bytes", "payload_digest")).alias("held"))
    held = Rounds(records.sparkSession).written(held.select(F.col("record_id").alias("of"), "held"), "held")
    joined = join_checked(revisits.drop("payload_bytes", "payload_digest"), held, F.col("refers_to"), "of")
    columns = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    return responses.select(*columns).unionByName(joined.select("record_id", "url", "record_type", "refers_to", "held.payload_bytes", "held.payload_digest"))


def archive_digest(pages: DataFrame) -> DataFrame:
    """Packages written from ``pages`` and read again: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The packages are deleted once the narrow table of what was read from them is stored.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/packages-{uuid.uuid4()}"
    records = read(write(pages, folder)).select("record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
    records = Rounds(spark).written(records, "records")
    files, inner = opened(folder)
    files.delete_dir(inner)
    key = lambda c: F.url_decode(F.regexp_extract(F.col(c), "^<urn:row:(.*)>$", 1))
    page = lambda c: F.when(F.col(c).startswith("<urn:row:"), key(c).try_cast("long"))
    return resolved(records).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
