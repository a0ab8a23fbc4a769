"""WARC archives of pages, and a two-level capture index over them.

Every page becomes a record in a gzip member of its own: a response with its payload, or, where a page of
a larger id has the same payload, a revisit that names that page. Members are gathered in segments of
about a megabyte; a segment is a row of a table (its bytes are a valid .warc.gz file), so archives are
written and committed by Spark on any file system, and a member is read by its offset and length.

The index is sorted by key (reversed host, path, query) and cut into compressed blocks. A sparse directory has the first
and last key of each block; it is cut into sheets, and only the first and last key of each sheet go to every task. A search
finds the sheets of a key by binary search, in these its blocks and in these its lines, each time by binary search, and the
lines' places are then read as ranges of their archives.

Null html is an empty payload, a null URL an empty one. Of equal payloads all rows of the largest page id are
responses; a null id is less than any, and if no page has an id all are responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._store import written

SEGMENT = 1 << 20
BLOCK_LINES = 2000
#: Blocks of a sheet of the directory; a task gets a row for each 2 million captures at most.
SHEET = 1000
#: Bytes of repeated payloads' digests, or of places to read, that may be broadcast.
BROADCAST_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The host reversed and separated by commas, then ")", path and query: example.com/a is com,example)/a."""
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return f"){url.strip()}"
    name = ",".join(reversed(host.split("."))) if host else ""
    port = f":{port}" if port and port not in (80, 443) else ""
    return f"{name}{port}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(url: str, page_id: int | None, payload: bytes, code: str, refers_to: int | None, kind: str) -> bytes:
    """One WARC/1.0 record as a gzip member."""
    block = _HTTP.format(len(payload)).encode() + (payload if kind == "response" else b"")
    name = uuid.UUID(bytes=hashlib.md5(f"{page_id} {url} {code}".encode("utf-8", "replace")).digest())
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{code}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", len(payload)),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if kind == "revisit":
        head += [("WARC-Profile", _PROFILE), ("X-Refers-To-Page", refers_to)]
    head.append(("Content-Length", len(block)))
    raw = b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (without HTTP headers) of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _roles(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, html, keep): keep is the page that others with the payload revisit, null for payloads that occur once."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    many = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 AND keep IS NOT NULL").select("sha", "keep")
    many = written(many, "payloads")
    # 40 characters and a number with their overheads; beyond the bound the join shuffles, split where a payload is very common.
    small = many.count() * 128 <= BROADCAST_BYTES
    return rows.join(F.broadcast(many) if small else many.hint("merge"), "sha", "left").select("page_id", "url", "html", "keep")


_SEGMENTS = "archive string, body binary, captures array<struct<key: string, page_id: long, offset: long, length: long>>"


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Segments (archive, body, captures) of the records of pages (page_id, url, html), written in the shared folder.

    Payloads of fewer than least bytes are never revisited. Extra columns are ignored.
    """

    def run(batches):
        part, i, body, captures = TaskContext.get().partitionId(), 0, [], []

        def flush():
            name = f"pages-{part:06d}-{i:06d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(body)], pa.binary()), pa.array([captures], kind)], names=["archive", "body", "captures"])

        kind = pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
        at = 0
        for b in batches:
            for page_id, url, html, keep in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "keep")]):
                payload = html.encode("utf-8", "replace")
                again = keep is not None and page_id != keep
                member = record(url, page_id, payload, digest(payload), keep if again else None, "revisit" if again else "response")
                captures.append({"key": url_key(url), "page_id": page_id, "offset": at, "length": len(member)})
                body.append(member)
                at += len(member)
                if at >= SEGMENT:
                    yield flush()
                    i, body, captures, at = i + 1, [], [], 0
        if body:
            yield flush()

    return written(_roles(pages, least).mapInArrow(run, _SEGMENTS), "warc")


def build_index(segments: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """Blocks (block, first, last, n, data) of the captures in the order of key and place, written in the shared folder.

    Ties of a key are cut by page and place, so one very common host or URL takes several ranges.
    """
    captures = segments.select("archive", F.explode("captures").alias("c")).select("c.key", "c.page_id", "archive", "c.offset", "c.length")
    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.repartitionByRange(parts, "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")

    def run(batches):
        part, i, held = TaskContext.get().partitionId(), 0, []

        def block(rows):
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (f"{part:06d}-{i:08d}", rows[0][0], rows[-1][0], len(rows), _packed(rows))], names=["block", "first", "last", "n", "data"])

        for b in batches:
            held += zip(*[b.column(c).to_pylist() for c in range(5)])
            while len(held) >= lines:
                yield block(held[:lines])
                i, held = i + 1, held[lines:]
        if held:
            yield block(held)

    return written(ordered.mapInArrow(run, "block string, first string, last string, n long, data binary"), "index")


_CAPTURES = "key string, page_id long, archive string, offset long, length long"


def captures(blocks: DataFrame) -> DataFrame:
    """(key, page_id, archive, offset, length) of all lines of blocks (data)."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_unpacked(data)), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "archive", "offset", "length"])

    return blocks.select("data").mapInArrow(run, _CAPTURES)


def build_directory(index: DataFrame, blocks: int = SHEET) -> DataFrame:
    """Sheets (name, first, last, data) of the first and last keys of the index's blocks, in their order, written in the shared folder."""
    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["first", "last", "block"]
    ordered = index.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        part, i, held = TaskContext.get().partitionId(), 0, []

        def sheet(rows):
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (f"{part:06d}-{i:08d}", rows[0][0], rows[-1][1], _packed(rows))], names=["name", "first", "last", "data"])

        for b in batches:
            held += zip(*[b.column(c).to_pylist() for c in range(3)])
            while len(held) >= blocks:
                yield sheet(held[:blocks])
                i, held = i + 1, held[blocks:]
        if held:
            yield sheet(held)

    return written(ordered.mapInArrow(run, "name string, first string, last string, data binary"), "directory")


def _packed(rows: list[tuple]) -> bytes:
    return zlib.compress("\n".join(json.dumps(r) for r in rows).encode(), 6)


def _unpacked(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]


def _spanning(first: list[str], last: list[str], key: str) -> range:
    """Which of sorted ranges may hold key; neighbours meet at most in equal keys, so these are in a row."""
    return range(bisect_left(last, key), bisect_right(first, key))


def _met(level: DataFrame, wanted: DataFrame, look, schema: str) -> DataFrame:
    """Rows of look(lines, keys), for batches of the wanted keys (name, key), where lines are those of the level's row (name, data).

    Each row of the level is sent once and read once, then its keys run past it.
    """
    rows = level.select("name", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("key"), "data")
    rows = rows.join(wanted.select("name").distinct(), "name", "left_semi").unionByName(wanted.select("name", F.lit(1).alias("turn"), "key", F.lit(None).cast("binary").alias("data")))

    def run(batches):
        lines, looked = [], None
        for b in batches:
            out, keys = [], []
            for turn, key, data in zip(*[b.column(c).to_pylist() for c in ("turn", "key", "data")]):
                if turn == 0:
                    out += looked(keys) if keys else []
                    lines, keys = _unpacked(data), []
                    looked = look(lines)
                else:
                    keys.append(key)
            out += looked(keys) if keys else []
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    kinds = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in schema.split(", ")]
    return rows.repartition("name").sortWithinPartitions("name", "turn").mapInArrow(run, schema)


def _blocks_of(lines: list[list]):
    first, last = [x[0] for x in lines], [x[1] for x in lines]
    return lambda keys: [(lines[i][2], key) for key in keys for i in _spanning(first, last, key)]


def _captures_of(lines: list[list]):
    own = [x[0] for x in lines]
    return lambda keys: [tuple(lines[i]) for key in keys for i in range(bisect_left(own, key), bisect_right(own, key))]


def search(index: DataFrame, urls: DataFrame, url: str = "url", directory: DataFrame | None = None) -> DataFrame:
    """(key, page_id, archive, offset, length) of all captures of the URLs of a table."""
    sheets = build_directory(index) if directory is None else directory
    top = sorted(((r.first, r.last, r.name) for r in sheets.select("first", "last", "name").collect()))  # a row for each SHEET blocks
    shared = index.sparkSession.sparkContext.broadcast(tuple(map(list, zip(*top))) or ([], [], []))

    def run(batches):
        first, last, names = shared.value
        for b in batches:
            found = [(names[i], key) for key in b.column(0).to_pylist() for i in _spanning(first, last, key)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*found)) or [(), ()]], names=["name", "key"])

    in_sheets = written(_keys(urls, url).mapInArrow(run, "name string, key string"), "sheets")
    in_blocks = written(_met(sheets, in_sheets, _blocks_of, "name string, key string"), "blocks")
    return _met(index.withColumnRenamed("block", "name"), in_blocks, _captures_of, _CAPTURES)


def _keys(urls: DataFrame, url: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    return urls.select(F.coalesce(F.col(url), F.lit("")).alias("url")).mapInArrow(run, "key string").distinct()


_READ = "archive string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html binary"


def _read(archive: str, offset: int, member: bytes, payload_too: bool) -> tuple:
    head, payload = parse(member)
    code = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (digest(payload) != code or len(payload) != int(head["X-Payload-Length"])):
        raise ValueError(f"the record at {offset} of {archive} is damaged")
    number = lambda k: int(head[k]) if k in head else None
    return (archive, offset, number("X-Page-Id"), head["WARC-Target-URI"], head["WARC-Type"], number("X-Payload-Length"), code, number("X-Refers-To-Page"), payload if payload_too and head["WARC-Type"] == "response" else None)


_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=[x.split()[0] for x in _READ.split(", ")])


def read_places(segments: DataFrame, places: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at places (archive, offset, length), by range reads from their segments; with payloads, those of responses in html.

    An archive's places are some thousands at most, as its size is bounded.
    """
    wanted = written(places.groupBy("archive").agg(F.sort_array(F.collect_set(F.struct("offset", "length"))).alias("places")), "places")
    size = wanted.agg(F.sum(F.size("places") * 16 + 64)).first()[0] or 0
    wanted = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted.hint("merge")

    def run(batches):
        for b in batches:
            for archive, body, at in zip(*[b.column(c).to_pylist() for c in ("archive", "body", "places")]):
                yield _batch([_read(archive, p["offset"], body[p["offset"] : p["offset"] + p["length"]], payloads) for p in at])

    return segments.select("archive", "body").join(wanted, "archive").mapInArrow(run, _READ)


def read_all(segments: DataFrame) -> DataFrame:
    """All records of segments, without their payloads, read member by member without the index; to compare with."""
    places = segments.select("archive", F.explode("captures").alias("c")).select("archive", "c.offset", "c.length")
    return read_places(segments, places, payloads=False).drop("html")
