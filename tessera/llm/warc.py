"""WARC archives with a two-level capture index.

``write`` stores each page as a gzip member of a WARC 1.1 file: the page with the largest
id among those of equal payload as a response, the others as revisits that refer to it.
``index`` sorts the captures by reversed-host URL key over range partitions; each
partition becomes one file of compressed blocks with a sparse directory (the first key,
offset and length of each block) at its end, and the first keys of the files, one row
each, are the upper level. ``lookup`` sends keys to their file by binary search in the
upper level, finds the block by binary search in the file's directory, and reads only
that byte range; ``read`` then reads the captures themselves by byte range.

Tasks write under a name of their own and rename the finished file, so a repeated task
replaces equal content. Files are reached through pyarrow's file systems, in the shared
folder of spark.checkpoint.dir.

Cases: null html is the empty payload; control characters of a URL are percent-encoded; a null url gets the page's URN as URL; pages with
equal id and payload are all responses; a null id never names a response unless all
pages of that payload have none. Empty tables give an empty index. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, scratch

DATE = "2026-01-01T00:00:00Z"
#: Captures in an index block, bytes after which a task begins a new archive, and bytes of archives that a reading task gets.
BLOCK, ROLL, READ = 512, 1 << 30, 64 << 20
#: Rows found that a task hands on at once, however many captures a key has.
FOUND = 10_000
#: Least payload bytes for which equal payloads become revisits.
LEAST = 0
_CONTROL = [*range(32), 127]


def url_key(url: Column) -> Column:
    """The URL with its scheme, port and user dropped and its host reversed: com,example)/path.
    Control characters are percent-encoded."""
    plain = F.coalesce(url, F.lit(""))
    coded = plain
    for c in _CONTROL:
        coded = F.replace(coded, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    low = F.lower(F.when(plain.rlike(r"[\x00-\x1F\x7F]"), coded).otherwise(plain))
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#]*)", 1), r":\d+$", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _File:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, path = _open(folder)
        self.fs.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.name, self.temporary, self.final, self.at = name, f"{path}/.{name}.{attempt}", f"{path}/{name}", 0
        self.out = self.fs.open_output_stream(self.temporary)

    def add(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)


def _member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC 1.1 record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit")
    return fields, rest[:n]


def _uri(url: str) -> str:
    """A URL that fits in a header line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    x = urn[len("<urn:page:") : -1]
    return None if x == "none" else int(x)


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Archives in ``folder``; (key, page_id, file, offset, length) of every capture, as a table."""
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    equal = sized.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1")
    equal = cut(equal.select("digest", "kept_id"), "payloads")
    refers = F.when(F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id")), F.col("kept_id"))
    todo = sized.join(equal, "digest", "left").select("page_id", "url", url_key(F.col("url")).alias("key"), "html", "digest", refers.alias("refers_to"))

    def run(batches):
        part = TaskContext.get().partitionId()
        out, number = None, 0
        for batch in batches:
            got = []
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    out = _File(folder, f"pages-{part:06}-{number:04}.warc.gz")
                    out.add(_member(record("warcinfo", {"WARC-Record-ID": f"<urn:archive:{out.name}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                payload = html.encode()
                sha = base64.b32encode(bytes.fromhex(digest)).decode()
                fields = {"WARC-Record-ID": _urn(page_id), "WARC-Date": DATE, "WARC-Target-URI": _uri(url) if url is not None else _urn(page_id)[1:-1]}
                fields |= {"WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http;msgtype=response"}
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                if refers_to is None:
                    data = record("response", fields, http + payload)
                else:
                    fields |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    data = record("revisit", fields, http)
                packed = _member(data)
                got.append((out.name, out.add(packed), len(packed)))
                if out.at > ROLL:
                    out.close()
                    out, number = None, number + 1
            files, offsets, lengths = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("page_id"), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "page_id", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    kind = pages.schema["page_id"].dataType.simpleString()
    return cut(todo.mapInArrow(run, f"key string, page_id {kind}, file string, offset long, length long"), "captures")


def index(captures: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Index files in ``folder``; the upper level: (first key, file), in order."""
    # the place in the archives breaks ties, so that one very frequent key spreads over files
    ordered = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches):
        out, directory, lines, first = None, [], [], None

        def block():
            data = _member("".join(f"{k}\t{json.dumps(v)}\n" for k, *v in lines).encode())
            directory.append((lines[0][0], out.add(data), len(data)))
            lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))):
                if out is None:
                    out, first = _File(folder, f"index-{TaskContext.get().partitionId():06}.gz"), row[0]
                lines.append(row)
                if len(lines) == BLOCK:
                    block()
        if out is not None:
            if lines:
                block()
            tail = _member(json.dumps(directory).encode())
            out.add(tail)
            out.add(struct.pack("<q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.string()), "file": pa.array([out.name], pa.string())})

    made = ordered.select("key", "file", "offset", "length").mapInArrow(run, "first string, file string")
    return [(r["first"], r["file"]) for r in sorted(made.collect(), key=lambda r: r["file"])]


class IndexFile:
    """One index file, opened by its directory."""

    def __init__(self, folder: str, name: str) -> None:
        files, path = _open(folder)
        self.file = files.open_input_file(f"{path}/{name}")
        size = self.file.size()
        (n,) = struct.unpack("<q", self._range(size - 8, 8))
        self.directory = json.loads(zlib.decompress(self._range(size - 8 - n, n), 31))
        self.firsts = [x[0] for x in self.directory]
        self.last: tuple[int, list[str]] = (-1, [])

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> list[str]:
        if self.last[0] != i:
            _, at, n = self.directory[i]
            self.last = (i, zlib.decompress(self._range(at, n), 31).decode().split("\n")[:-1])
        return self.last[1]

    def find(self, key: str):
        """[file, offset, length] of every capture of ``key``."""
        i = max(bisect_left(self.firsts, key) - 1, 0)
        while i < len(self.firsts) and self.firsts[i] <= key:
            lines = self.block(i)
            for x in lines[bisect_left(lines, f"{key}\t") :]:
                k, _, rest = x.partition("\t")
                if k != key:
                    return
                yield json.loads(rest)
            i += 1


def lookup(keys: DataFrame, top: list[tuple[str, str]], folder: str) -> DataFrame:
    """(file, offset, length) of all captures of the distinct keys (key). ``top`` has a row for
    each index file, which is one for each of the range partitions that wrote them."""
    firsts, names = [x[0] for x in top], [x[1] for x in top]

    def route(batches):
        for batch in batches:
            ks, ns = [], []
            for key in batch.column("key").to_pylist():
                # a key may run on from the file before the first that begins with it
                for i in range(max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key)):
                    ks.append(key)
                    ns.append(names[i])
            yield pa.RecordBatch.from_pydict({"key": pa.array(ks, pa.string()), "name": pa.array(ns, pa.string())})

    def search(batches):
        name, opened, found = None, None, []

        def out():
            files, offsets, lengths = zip(*found)
            found.clear()
            return pa.RecordBatch.from_pydict({"file": pa.array(files, pa.string()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())})

        for batch in batches:
            for key, n in zip(batch.column("key").to_pylist(), batch.column("name").to_pylist()):
                if n != name:
                    name, opened = n, IndexFile(folder, n)
                for place in opened.find(key):
                    found.append(place)
                    if len(found) == FOUND:
                        yield out()
        if found:
            yield out()

    routed = keys.select("key").distinct().mapInArrow(route, "key string, name string")
    return routed.repartition("name").sortWithinPartitions("name", "key").mapInArrow(search, "file string, offset long, length long")


def read(places: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The captures at ``places`` (file, offset, length), each read by its byte range and checked
    against its digest: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.
    Without ``with_payload`` the payload is checked but not handed on."""

    def run(batches):
        files, path = _open(folder)
        name, opened = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    name, opened = file, files.open_input_file(f"{path}/{file}")
                opened.seek(offset)
                fields, block = parse(zlib.decompress(opened.read(length), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{file} at {offset}: the payload doesn't fit its digest")
                size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                refers = fields.get("WARC-Refers-To")
                rows.append((_page_id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload.decode() if kind == "response" and with_payload else None, size, digest, kind, _page_id(refers) if refers else None))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=list(names))

    out = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return places.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch(spark, "warc")
    captures = write(pages, folder)
    top = index(captures, folder)
    found = lookup(pages.select(url_key(F.col("url")).alias("key")), top, folder)
    size, n = captures.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    # near in an archive, near in a task: ranges of places, so many that none reads more than about READ bytes
    parts = max(spark.sparkContext.defaultParallelism, -(-size // READ))
    out = cut(read(found.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset"), folder, with_payload=False).drop("url", "payload"), "read")
    if (back := out.count()) != n:
        raise RuntimeError(f"{n} captures were written and {back} were read back")
    return out


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS kept_id FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: CAST(('0x' || substr(h, CAST(1 + 5 * i AS INT), 5)) AS INT)) AS v FROM k)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN kept_id IS NOT NULL AND page_id IS DISTINCT FROM kept_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM kept_id THEN kept_id END AS refers_to
FROM v
"""
