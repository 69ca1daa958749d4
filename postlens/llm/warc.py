"""WARC archives: write, read back, and merge their capture indexes.

Pages become gzip-member records in archives of bounded size.  Of equal payloads the page with the
largest id is stored, the others are revisit records without payload.  Reading an archive gives a
locally sorted run of captures; the runs are range-partitioned by URL key, time and id, and each range
merges its runs by a loser tree, so the whole is globally ordered.  A hot URL spans several ranges,
because the order goes on with time and id.

Archives are written under names of their attempt, and only archives named by the written manifest are
read: a retried or lost task leaves unread files, never wrong ones.

A null html is an empty payload and empty payloads are equal; a null or odd URL has no target header
and sorts first; a null id counts as smaller than any id, and equal payloads of null ids only are all
stored.  Rows that repeat as a whole are stored each.  An empty table gives an empty result, extra
columns are ignored.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from postlens.llm.common import small_batches, work_path, written

ARCHIVE_BYTES = 32 << 20       # a new archive begins beyond this size
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def open_folder(path: str):
    files, inner = pyarrow.fs.FileSystem.from_uri(path)
    return files, inner


# --- records ------------------------------------------------------------------------------------

def url_key(url: str | None) -> str:
    """Sortable key: host labels reversed, then port and path; case of scheme and host is ignored."""
    m = re.match(r"(?s)[^:/?#]+://([^/?#]*)(.*)", url or "")
    if not m:
        return ""
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")


def capture_time(page_id: int | None) -> str:
    """The given pages carry no time: their id counts seconds."""
    seconds = (page_id or 0) % (40 * 365 * 86400)
    return (EPOCH + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One gzip member: a response with its payload, or a revisit of ``refers_to`` without."""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": capture_time(page_id),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "WARC-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    if page_id is not None:
        head["WARC-Page"] = str(page_id)
    if url is not None and url.isprintable():
        head["WARC-Target-URI"] = url
    if refers_to is not None:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Page": str(refers_to),
        }
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block += f"Content-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 5, mtime=0)


def members(stream):
    """The uncompressed records of an archive, one by one."""
    rest = b""
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                return
        engine, out = zlib.decompressobj(31), []
        while not engine.eof:
            out.append(engine.decompress(rest))
            rest = engine.unused_data if engine.eof else stream.read(1 << 20)
            if not engine.eof and not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Header fields and, for a response, the payload; a wrong digest or length is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("WARC-Page"), "url": fields.get("WARC-Target-URI"), "time": fields["WARC-Date"],
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To-Page"), "payload": payload,
    }


# --- archives -----------------------------------------------------------------------------------

def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, records): archives in the shared folder, made once."""
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = small_batches(pages).select("page_id", "url", "html", digest.alias("digest"))
    stored = rows.groupBy("digest").agg(F.max("page_id").alias("stored"))
    rows = rows.join(stored, "digest").select("page_id", "url", "html", "stored")
    folder = work_path(pages.sparkSession, "warc")

    def run(batches):
        files, inner = open_folder(folder)
        files.create_dir(inner, recursive=True)
        out, name, size, count = None, "", 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{inner}/{name}", compression=None)
                again = r["stored"] if r["stored"] is not None and r["stored"] != r["page_id"] else None
                data = record(r["page_id"], r["url"], (r["html"] or "").encode(), again)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield _manifest(folder, name, count)
                    out = None
        if out is not None:
            out.close()
            yield _manifest(folder, name, count)

    return written(rows.mapInArrow(run, "archive string, records long"), "warc-manifest")


def _manifest(folder, name, count):
    return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [count]})


CAPTURES = (
    "run string, url_key string, time string, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One locally sorted run of captures per archive."""
    names = [x.split(" ")[0] for x in CAPTURES.split(", ")]
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names])

    def run(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                files, inner = open_folder(archive)
                rows = []
                with files.open_input_stream(inner, compression=None) as stream:
                    for data in members(io.BufferedReader(stream, 1 << 20)):
                        r = parse(data)
                        rows.append({n: r.get(n) for n in names} | {"run": archive, "url_key": url_key(r["url"])})
                rows.sort(key=_order)
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 10_000], schema=schema)

    n = manifest.count()
    return manifest.select("archive").repartition(max(1, n), "archive").mapInArrow(run, CAPTURES)


def _order(r):
    return r["url_key"], r["time"], r["page_id"] is not None, r["page_id"] or 0, r["run"]


# --- merging ------------------------------------------------------------------------------------

class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its last match, so the next winner
    costs one comparison per level."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.rank = [self._rank(i) for i in range(self.k)]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _rank(self, i):
        return (1,) if self.head[i] is None else (0, self.key(self.head[i]), i)

    def _play(self, i):
        node = (i + self.k) // 2
        while node:
            other = self.loser[node]
            if other == -1:
                self.loser[node] = i
                return
            if self.rank[other] < self.rank[i]:
                self.loser[node], i = i, other
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.k:
            i = self.loser[0]
            row = self.head[i]
            if row is None:
                return
            yield row
            self.head[i] = next(self.runs[i], None)
            self.rank[i] = self._rank(i)
            self._play(i)


def merge_runs(captures: DataFrame) -> DataFrame:
    """Globally ordered capture histories: ranges by key, a loser tree over the runs in each."""
    names = captures.columns
    ranged = captures.repartitionByRange("url_key", "time", "page_id").sortWithinPartitions(
        "run", "url_key", "time", F.asc_nulls_first("page_id")
    )

    def run(batches):
        rows, schema = [], None
        for batch in batches:
            schema = batch.schema
            rows += batch.to_pylist()
        runs: dict[str, list] = {}
        for r in rows:
            runs.setdefault(r["run"], []).append(r)
        block = []
        for r in LoserTree(runs.values(), _order):
            block.append(r)
            if len(block) == 10_000:
                yield pa.RecordBatch.from_pylist(block, schema=schema)
                block = []
        if block:
            yield pa.RecordBatch.from_pylist(block, schema=schema)

    return ranged.mapInArrow(run, CAPTURES).select(*names)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives, merge their runs: one capture per page, in global order."""
    captures = written(read_archives(write_archives(pages)), "captures")
    return merge_runs(captures)
