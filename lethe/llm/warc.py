"""WARC archives with a two-level capture index.

Pages are dealt out by range of their reversed-host URL keys and written, in that order, as one
gzip member for each record.  Beside each archive lie its index, key-sorted lines in
compressed blocks, and the sparse directory of those blocks; the keys that an archive spans
are in the manifest.  A lookup searches manifest, directory and block by bisection and then reads
one range of the archive; reading back walks all blocks, each task those of some archives.

Files are written by tasks under a name of their own and moved into place when complete, so a task
that is run again replaces its file by an equal one.

Defined cases: null html is an empty payload; a null URL has an empty key and no target
URI; of rows that repeat the id of a response all are responses; null ids come after others
when the first of equal payloads is chosen; without pages there are no archives and reading gives no rows; other columns
are not archived.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import _store

#: Payloads below this are never revisits.
LEAST = 100
#: Payload bytes of an archive, and captures of an index block.
ARCHIVE_BYTES = 32 << 20
BLOCK_LINES = 512
#: Repeated digests (about 50 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 400_000
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = "name string, first_key string, last_key string, records long"
_CAPTURE = "url_key string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: http://www.a.org/x?y has org,a)/x?y."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), r":\d*$", ""), r"^www\d*\.", "")
    tail = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail == "", F.lit("/")).otherwise(tail))
    return F.when(url.isNull(), F.lit("")).otherwise(F.regexp_replace(key, r"[\t\r\n]", " "))


def key_of(url: str) -> str:
    """url_key for one URL, without Spark."""
    import re

    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?", "", url)
    host = re.match(r"[^/?#]*", rest)[0]
    tail = re.sub(r"#.*$", "", rest[len(host) :], flags=re.S)
    host = re.sub(r"^www\d*\.", "", re.sub(r":\d*$", "", host.lower()))
    return re.sub(r"[\t\r\n]", " ", ",".join(reversed(host.split("."))) + ")" + (tail or "/"))


@dataclass
class Archive:
    """Where archives lie, and one manifest row for each."""

    path: str
    manifest: DataFrame


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def _name(page: str | None, digest: str, url: str | None) -> str:
    """The id of a capture's record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{digest}|{url}')}>"


def _info(name: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: lethe\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}.warc.gz", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record(kind: str, page: str | None, url: str | None, payload: bytes, digest: str, size: int, refers: str | None, refers_url: str | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page, digest, url)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers, digest, refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers}"]
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + " ".join(refers_url.split()))
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a compressed record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _write(path: str, lines: int):
    def run(batches):
        fs, root = _open(path)
        name, own = f"{TaskContext.get().partitionId():06d}", uuid.uuid4().hex
        streams: dict = {}
        at = index_at = records = 0
        block, directory, keys = [], [], []

        def flush():
            nonlocal index_at
            if block:
                data = _gzip("".join(block).encode())
                directory.append(f"{keys[-1][0]}\t{index_at}\t{len(data)}\t{len(block)}\n")
                streams["cdx"].write(data)
                index_at += len(data)
                block.clear()

        for batch in batches:
            for k, page, url, html, digest, size, kind, refers, refers_url in zip(*(batch.column(c).to_pylist() for c in ("k", "page", "url", "html", "digest", "size", "kind", "refers", "refers_url")), strict=True):
                if not streams:
                    streams = {x: fs.open_output_stream(f"{root}/.{name}.{own}.{x}", compression=None) for x in ("warc", "cdx")}
                    first = k
                    info = _gzip(_info(name))
                    streams["warc"].write(info)
                    at += len(info)
                member = _gzip(_record(kind, page, url, html or b"", digest, size, refers, refers_url))
                streams["warc"].write(member)
                if not block:
                    keys.append((k,))
                block.append(f"{k}\t{page or ''}\t{kind}\t{digest}\t{at}\t{len(member)}\n")
                at += len(member)
                records += 1
                last = k
                if len(block) == lines:
                    flush()
        if streams:
            flush()
            for s in streams.values():
                s.close()
            with fs.open_output_stream(f"{root}/.{name}.{own}.idx", compression=None) as s:
                s.write("".join(directory).encode())
            for x, to in (("warc", "warc.gz"), ("cdx", "cdx.gz"), ("idx", "idx")):
                fs.move(f"{root}/.{name}.{own}.{x}", f"{root}/{name}.{to}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([last]), pa.array([records], pa.int64())], names=["name", "first_key", "last_key", "records"])

    return run


def write(pages: DataFrame, path: str | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES) -> Archive:
    """Archive pages below path (by default a new folder in the shared one)."""
    spark = pages.sparkSession
    _store.ship(spark)
    path = path or _store.scratch(spark, "warc")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    body = F.coalesce(F.encode(_store.column(pages, html, "string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").alias("page"), _store.column(pages, url, "string").alias("url"), body.alias("html")).withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long"), "k": url_key(F.col("url"))})
    total = rows.select(F.sum("size")).first()[0] or 0
    equal = rows.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.min(F.when(F.col("page").isNotNull(), F.struct("page", "url"))).alias("m"), F.count("*").alias("c")).filter("c > 1").select("digest", F.col("m.page").alias("first"), F.col("m.url").alias("first_url"))
    # The pages need not be shuffled to be joined while the digests that repeat fit a broadcast of known size.
    equal = _store.cut(equal.withColumn("digest", F.unhex("digest")).withColumnRenamed("digest", "d"))
    few = F.broadcast(equal) if equal.count() <= BROADCAST_DIGESTS else equal
    named = rows.join(few, F.unhex("digest") == F.col("d"), "left").withColumn("kind", F.when(F.col("first").isNull() | F.col("page").eqNullSafe(F.col("first")), "response").otherwise("revisit"))
    # A revisit's payload is not written, so it need not travel.
    named = named.select("k", F.col("page").cast("string").alias("page"), "url", F.when(F.col("kind") == "response", F.col("html")).alias("html"), "digest", "size", "kind", F.when(F.col("kind") == "revisit", F.col("first").cast("string")).alias("refers"), F.when(F.col("kind") == "revisit", F.col("first_url")).alias("refers_url"))
    parts = max(8, -(-total // archive_bytes))
    dealt = named.repartitionByRange(parts, "k", "page", "digest").sortWithinPartitions("k", "page", "digest")
    return Archive(path, _store.stored(dealt.mapInArrow(_write(path, block_lines), _MANIFEST), "manifest"))


def _directory(fs, root: str, name: str) -> list[tuple[str, int, int]]:
    with fs.open_input_file(f"{root}/{name}.idx") as f:
        rows = [x.split("\t") for x in f.read().decode().split("\n")[:-1]]
    return [(k, int(a), int(n)) for k, a, n, _ in rows]


def _block(index, at: int, n: int) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(index.read_at(n, at), 31).decode().split("\n")[:-1]]


def _row(key: str, member: bytes, with_payload: bool) -> dict:
    fields, http, payload = parse(member)
    size = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of {key}")
    return {"url_key": key, "page_id": fields.get("X-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": fields.get("X-Refers-To-Page-ID"), "payload": payload if with_payload and kind == "response" else None}


def _read(path: str, with_payload: bool):
    schema = pa.schema([("url_key", pa.string()), ("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def run(batches):
        fs, root = _open(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_file(f"{root}/{name}.cdx.gz") as index, fs.open_input_file(f"{root}/{name}.warc.gz") as warc:
                    for _, at, n in _directory(fs, root, name):
                        entries, rows = _block(index, at, n), []
                        for key, _, _, _, offset, length in entries:
                            rows.append(_row(key, warc.read_at(int(length), int(offset)), with_payload))
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read(archive: Archive, *, payloads: bool = True) -> DataFrame:
    """Every capture, found through the index; the payload of a revisit is null."""
    names = archive.manifest.select("name")
    spark = names.sparkSession
    _store.ship(spark)
    n = max(1, archive.manifest.count())
    return names.repartition(n, "name").mapInArrow(_read(archive.path, payloads), _CAPTURE)


def lookup(archive: Archive, urls: list[str]) -> list[dict]:
    """Captures of each URL: manifest, directory and block are searched by bisection, records read by range."""
    files = sorted((r["first_key"], r["last_key"], r["name"]) for r in archive.manifest.toLocalIterator())
    fs, root = _open(archive.path)
    found = []
    for url in dict.fromkeys(urls):
        key = key_of(url)
        # Captures of one key may go on from one archive or block to the next.
        k = max(0, bisect.bisect_left([f[0] for f in files], key) - 1)
        for _, _, name in [f for f in files[k:] if f[0] <= key <= f[1]]:
            blocks = _directory(fs, root, name)
            b = max(0, bisect.bisect_left([x[0] for x in blocks], key) - 1)
            with fs.open_input_file(f"{root}/{name}.cdx.gz") as index, fs.open_input_file(f"{root}/{name}.warc.gz") as warc:
                while b < len(blocks) and blocks[b][0] <= key:
                    lines = _block(index, *blocks[b][1:])
                    at = bisect.bisect_left(lines, key, key=lambda x: x[0])
                    while at < len(lines) and lines[at][0] == key:
                        found.append(_row(key, warc.read_at(int(lines[at][5]), int(lines[at][4])), True) | {"url": url})
                        at += 1
                    b += 1
    return found


def open_archive(spark: SparkSession, path: str, manifest_path: str) -> Archive:
    return Archive(path, spark.read.parquet(manifest_path))
