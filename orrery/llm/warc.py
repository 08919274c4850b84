"""WARC archives with a two-level capture index.

Writing: each task streams its pages into one WARC/1.1 file, a gzip member per record. Of pages with an
equal payload of some size, the first by id is a response and the others are revisits to it.
Index: captures are sorted by a reversed-host URL key and cut in blocks of ``BLOCK`` lines, each compressed;
a sparse directory holds the first key and place of each block. A lookup searches the directory by
bisection, unpacks one block (or a few, for a prefix), and reads just the byte ranges of its captures. ``Index``
looks up single URLs, ``find`` a table of them: keys are routed to index files by bisection of the files' key
ranges, and to blocks by bisection of each file's part of the directory.

Plan at scale: pages meet the first id of their payload by one join on the digest; the index is one sort
by ranges. Files go to a folder that driver and executors share. Each attempt of a task writes a file of
its own name, and what the committed attempt returns names that file with its offsets; a file that no
committed row names is never read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 256
_CAPTURE = "page_id long, url_key string, url string, file string, at long, size long, record_type string, payload_digest string, payload_bytes long, refers_to long"
_FIELDS = [x.split()[0] for x in _CAPTURE.split(", ")]
#: Record time: archives of one table are the same whenever they are written.
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then ``)`` and path with query, in lower case.

    Scheme, a leading ``www.``, default ports, user info and fragment are left out; white space is one space. Null: empty.
    """
    text = " ".join((url or "").split())
    try:
        u = urlsplit(text if "//" in text else f"//{text}")
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return text.lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) if host else ""
    if port and port not in (80, 443):
        key += f":{port}"
    return f"{key}){u.path or '/'}{'?' + u.query if u.query else ''}".lower()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC record as a gzip member."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{refers_to}')}>", f"WARC-Refers-To-Target-URI: {' '.join((refers_url or '').split())}", f"X-Refers-To-Page: {refers_to}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + payload
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.split(b"\r\n\r\n", 1)[1]


def _put(where: str, name: str, write) -> None:
    fs, base = pafs.FileSystem.from_uri(where)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        write(out)


def _writer(where: str):
    from pyspark import TaskContext

    def run(batches):
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        rows: list[tuple] = []

        def body(out):
            at = 0

            def every():
                yield first
                yield from batches

            for b in every():
                for i, url, html, digest, ref, ref_url in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                    data = (html or "").encode("utf-8", "surrogatepass")
                    kind = "revisit" if ref is not None else "response"
                    rec = record(i, url, data, digest, kind, ref, ref_url)
                    out.write(rec)
                    rows.append((i, url_key(url), url, name, at, len(rec), kind, digest, len(data), ref))
                    at += len(rec)

        _put(where, name, body)
        types = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for c in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[c : c + 5000], strict=True), types, strict=True)], names=_FIELDS)

    return run


def _index_writer(where: str):
    """A sorted partition of captures to one file of compressed blocks; gives the directory rows."""
    from pyspark import TaskContext

    def run(batches):
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.gz"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        rows: list[tuple] = []

        def body(out):
            at, lines, key, total = 0, [], None, 0

            def flush():
                nonlocal at, lines, total
                if lines:
                    data = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
                    out.write(data)
                    rows.append((key, lines[-1].split("\t", 1)[0], name, at, len(data), len(lines), total))
                    at, lines, total = at + len(data), [], 0

            def every():
                yield first
                yield from batches

            for b in every():
                for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    if not lines:
                        key = _clean(r[0])
                    total += r[4]
                    lines.append("\t".join(["" if x is None else _clean(str(x)) for x in r]))
                    if len(lines) == BLOCK:
                        flush()
            flush()

        _put(where, name, body)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["first_key", "last_key", "file", "at", "size", "lines", "bytes"])

    return run


def _clean(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def write(pages: DataFrame, path: str, least: int = 100, index_rows: int = 100_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write archives, index and directory of ``pages`` below ``path`` (a URI that all executors reach).

    Payload: the html in UTF-8 (null: empty). Of equal payloads of at least ``least`` bytes, that of the
    smallest id is a response and the rest revisit it; shorter ones are all responses. Rows with a null id
    are responses and never referred to. Rows that repeat the smallest id are responses too. Other
    columns are ignored. Empty table: no archive, an empty index.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    # the response that revisits refer to, with its URL (the least one, should rows repeat the id)
    many = src.where((F.col("n") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.min(F.struct("id", "url")).alias("m"), F.count(F.lit(1)).alias("k"))
    many = many.where("k > 1").select("digest", F.col("m.id").alias("first"), F.col("m.url").alias("first_url"))
    ref = F.when(F.col("id") > F.col("first"), F.col("first"))
    jobs = src.join(many, "digest", "left").select("id", "url", "html", "digest", ref.alias("ref"), F.when(ref.isNotNull(), F.col("first_url")).alias("ref_url"))
    captures = jobs.mapInArrow(_writer(f"{path}/archive"), _CAPTURE)
    captures.write.option("compression", "zstd").parquet(f"{path}/captures")
    kept = spark.read.parquet(f"{path}/captures")
    parts = max(1, -(-kept.count() // index_rows))
    lines = kept.select("url_key", "page_id", "file", "at", "size").repartitionByRange(parts, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    directory = lines.mapInArrow(_index_writer(f"{path}/index"), "first_key string, last_key string, file string, at long, size long, lines int, bytes long")
    directory.write.parquet(f"{path}/directory")


def _read_range(fs, file: str, at: int, size: int) -> bytes:
    with fs.open_input_file(file) as f:
        return f.read_at(size, at)


def _reader(where: str):
    """Captures (file, at, size), ordered, to what their records say."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(where)
        held: tuple[str, object] | None = None
        for b in batches:
            rows = []
            for file, at, size in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if held is None or held[0] != file:
                    held = (file, fs.open_input_file(f"{base}/{file}"))
                fields, payload = parse(held[1].read_at(size, at))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{file} at {at}: the payload does not have its digest")
                pid, ref = fields["X-Page-Id"] if "X-Page-Id" in fields else "", fields.get("X-Refers-To-Page")
                rows.append((int(pid) if pid.strip() else None, int(fields["X-Payload-Length"]), digest, kind, int(ref) if ref else None, payload if kind == "response" else None, fields.get("WARC-Refers-To-Target-URI")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "refers_url"])

    return run


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, refers_url string"


def _unpack_blocks(where: str):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(where)
        for b in batches:
            for file, at, size in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows = [x.split("\t") for x in gzip.decompress(_read_range(fs, f"{base}/{file}", at, size)).decode().split("\n")]
                yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([int(r[3]) for r in rows], pa.int64()), pa.array([int(r[4]) for r in rows], pa.int64())], names=["file", "at", "size"])

    return run


def _in_file_order(found: DataFrame, total: int) -> DataFrame:
    """Captures (file, at, size) in stretches of files, in order: 64 MB of archive to a task, less where tasks are few."""
    tasks = max(-(-total // (64 << 20)), min(-(-total // (1 << 20)), 4 * found.sparkSession.sparkContext.defaultParallelism), 1)
    stretch = F.floor(F.col("at") / max(1 << 18, min(32 << 20, total // (2 * tasks) + 1)))
    return found.repartition(int(tasks), "file", stretch).sortWithinPartitions("file", "at")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives, reached through the index's blocks by byte ranges.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload, refers_url``; digests of
    responses are recomputed and must match. A revisit's payload is null.
    """
    blocks = spark.read.parquet(f"{path}/directory")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    found = blocks.select("file", "at", "size").mapInArrow(_unpack_blocks(f"{path}/index"), "file string, at long, size long")
    return _in_file_order(found, total).mapInArrow(_reader(f"{path}/archive"), _RECORD)


def _route(files):
    """(key, page_id) rows to the index files whose key range holds the key."""

    def run(batches):
        name, first, last = files.value
        for b in batches:
            out = []
            for key, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                i = bisect.bisect_left(last, key)
                while i < len(name) and first[i] <= key:
                    out.append((name[i], key, page))
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], names=["index", "key", "page_id"])

    return run


def _search(where: str):
    """Rows (index file, key, page, first_key, at, size) of which a file's directory rows come first, by key: places of captures."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(where)
        held, keys, places, block, rows = None, [], [], None, []
        for b in batches:
            out = []
            for file, key, page, first, at, size in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if file != held:
                    held, keys, places, block = file, [], [], None
                if first is not None:
                    keys.append(first)
                    places.append((at, size))
                    continue
                # the last block that begins before the key, and those that begin with it
                i = max(0, bisect.bisect_left(keys, key) - 1)
                while i < len(keys) and keys[i] <= key:
                    if block != i:
                        lines = gzip.decompress(_read_range(fs, f"{base}/{file}", *places[i])).decode().split("\n")
                        block, rows = i, [x.split("\t") for x in lines]
                    j = bisect.bisect_left(rows, key, key=lambda r: r[0])
                    while j < len(rows) and rows[j][0] == key:
                        if rows[j][1] == str(page):
                            out.append((rows[j][2], int(rows[j][3]), int(rows[j][4])))
                        j += 1
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], names=["file", "at", "size"])

    return run


def find(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records of the captures that ``wanted`` (url, page_id) names, as ``read`` returns them; others have no row.

    The key ranges of index files (one row per ``index_rows`` captures) come to the driver and are broadcast.
    """
    directory = spark.read.parquet(f"{path}/directory")
    ranges = directory.groupBy("file").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).orderBy("lo", "hi").collect()
    files = spark.sparkContext.broadcast(([r["file"] for r in ranges], [r["lo"] for r in ranges], [r["hi"] for r in ranges]))
    keyed = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(_to_keys, "key string, page_id long").distinct()
    routed = keyed.mapInArrow(_route(files), "index string, key string, page_id long")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("first_key", "string"), ("at", "long"), ("size", "long"))]
    entries = directory.select(F.col("file").alias("index"), F.col("first_key").alias("key"), F.lit(None).cast("long").alias("page_id"), "first_key", "at", "size")
    rows = entries.union(routed.select("index", "key", "page_id", *nothing)).repartition("index").sortWithinPartitions("index", F.col("first_key").isNull(), "key", "at")
    found = rows.mapInArrow(_search(f"{path}/index"), "file string, at long, size long")
    total = directory.agg(F.sum("bytes")).first()[0] or 0
    return _in_file_order(found, total).mapInArrow(_reader(f"{path}/archive"), _RECORD)


def _to_keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_clean(url_key(u)) for u in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["key", "page_id"])


def resolve(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """Records (without payload) whose revisits take size and digest from the response they refer to.

    The responses are found through the index. A revisit whose response is not there has nulls.
    """
    revisit = F.col("record_type") == "revisit"
    asked = records.where(revisit).select(F.col("refers_url").alias("url"), F.col("refers_to").alias("page_id")).distinct()
    heads = find(spark, path, asked).where("record_type = 'response'").select(F.col("page_id").alias("head"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")).distinct()
    out = records.join(heads, (F.col("refers_to") == F.col("head")) & (F.col("payload_digest") == F.col("d")), "left")
    size, digest = (F.when(revisit, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("n", "payload_bytes"), ("d", "payload_digest")))
    return out.select("page_id", size, digest, "record_type", "refers_to")


class Index:
    """Lookups from one process: the sparse directory in memory (a row per 256 captures), blocks and records by range reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        rows = spark.read.parquet(f"{path}/directory").orderBy("first_key", "file", "at").collect()
        self.rows = [tuple(r) for r in rows]
        self.last = [r[1] for r in self.rows]
        self.fs, self.base = pafs.FileSystem.from_uri(path)

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Records captured from a URL, by page id."""
        key = _clean(url_key(url))
        out = []
        i = bisect.bisect_left(self.last, key)
        while i < len(self.rows) and self.rows[i][0] <= key:
            file, at, size = self.rows[i][2:5]
            for line in gzip.decompress(_read_range(self.fs, f"{self.base}/index/{file}", at, size)).decode().split("\n"):
                k, _, archive, a, n = line.split("\t")
                if k == key:
                    out.append(parse(_read_range(self.fs, f"{self.base}/archive/{archive}", int(a), int(n))))
            i += 1
        return out
