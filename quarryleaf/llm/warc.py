"""WARC archives of pages, and their index by an external merge.

Writing: each task writes gzip archives (one member for each record) of at
most ``ROLL`` bytes of payload to a new folder on the shared file system; a
retried task writes under new names, and only files named by the attempt that
counted are read. A record whose payload equals that of a record with a larger
page_id is a revisit of it and holds no payload.

Reading: each archive gives one locally sorted capture run (URL key, timestamp,
page_id). Runs are dealt by ranges of that whole key, so one URL with a third of
all captures is no single task, and each range is merged k ways by a loser tree:
the rows come out in global order, a URL's captures as a history.

A null html counts as an empty payload. A null url has the key "" and no target.
Rows with equal page_id and payload are treated alike. A null page_id is kept
and sorts first; it is never referred to. An empty table gives no rows; columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm.common import cut, shared_dir, shuffle_partitions

ROLL = 16 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_SALTS = 32


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path and query, lower-cased: captures of
    a site lie together in the index."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(parts.path or '/')}{query}".lower()


def timestamp(page_id: int | None) -> str:
    """pages has no capture time: a second for each page_id stands for it."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One WARC record, not compressed."""
    target = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if refers_to is None else http
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {timestamp(page_id)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {target}")
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; a response's payload is digested anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(h["Content-Length"])]
    if len(block) != int(h["Content-Length"]):
        raise ValueError("a record is cut short")
    page = lambda k: int(x) if k in h and (x := h[k][len("<urn:page:") : -1]) else None
    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["Payload-Length"])
    if h["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if payload_digest(payload) != digest or len(payload) != size:
            raise ValueError("a payload differs from its digest")
    url = h.get("WARC-Target-URI")
    return {"url_key": url_key(url), "timestamp": h["WARC-Date"], "page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": page("WARC-Refers-To")}


def records(stream):
    """(offset, length, record) of each gzip member of an open archive, with a
    bounded part of the file in memory."""
    at, start, buffer = 0, 0, b""
    while True:
        if not buffer:
            buffer = stream.read(1 << 20)
            if not buffer:
                return
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not buffer:
                buffer = stream.read(1 << 20)
                if not buffer:
                    raise ValueError("an archive is cut short")
            at += len(buffer)
            out.append(z.decompress(buffer))
            buffer = z.unused_data
            at -= len(buffer)
        yield start, at - start, b"".join(out)
        start = at


def write(pages: DataFrame, folder: str, revisit_from: int = 0) -> DataFrame:
    """Write an archive record for each row of pages (page_id, url, html) under
    folder; (path, n_records) of the archives.

    Payloads of at least ``revisit_from`` bytes that equal a later page's are
    written as revisits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    latest = rows.where(F.octet_length("html") >= revisit_from).groupBy("sha").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1")
    # A payload may have a third of all rows; what is known of it goes to each salt.
    latest = latest.select("sha", "latest", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    decided = salted.join(latest, ["sha", "salt"], "left").select("page_id", "url", "html", F.when(F.coalesce(F.col("page_id") != F.col("latest"), F.col("latest").isNotNull()), F.col("latest")).alias("refers_to"))

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, size, n, path, done = None, 0, 0, None, []
        for b in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                payload = html.encode()
                out.write(gzip.compress(record(page_id, url, payload, refers_to), 3, mtime=0))
                size, n = size + len(payload), n + 1
                if size >= ROLL:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "n_records"])

    return cut(decided.mapInArrow(run, "path string, n_records long"))


_FIELDS = ["url_key", "timestamp", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_SCHEMA = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def _order(entry) -> tuple:
    return entry["url_key"], entry["timestamp"], -1 if entry["page_id"] is None else entry["page_id"]


def capture_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Index entries of the archives; those of one archive are a sorted run, and
    ``place`` is an entry's place in it."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as stream:
                    found = [parse(raw) | {"offset": offset, "length": length} for offset, length, raw in records(stream)]
                found.sort(key=_order)
                columns = [pa.array([x[f] for x in found], t) for f, t in zip(_FIELDS, _TYPES)]
                columns += [pa.array([path.rpartition("/")[2]] * len(found)), *(pa.array([x[f] for x in found], pa.int64()) for f in ("offset", "length")), pa.array(range(len(found)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*_FIELDS, "archive", "offset", "length", "place"])

    paths = archives.select("path").repartition(4 * shuffle_partitions(archives.sparkSession), "path")
    return paths.mapInArrow(run, _SCHEMA + ", place long")


class LoserTree:
    """Merges sorted iterators. Each inner node keeps the loser of its match,
    so that a new leaf plays one match a level. Equal keys come by the
    iterators' order."""

    _END = object()

    def __init__(self, iterators, key):
        self.its, self.key, self.k = [iter(x) for x in iterators], key, len(iterators)
        self.heads = [next(x, self._END) for x in self.its]
        self.keys = [key(x) if x is not self._END else None for x in self.heads]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._play(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is self._END or self.heads[b] is self._END:
            return self.heads[b] is self._END and (self.heads[a] is not self._END or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.k and self.heads[w := self.winner] is not self._END:
            yield self.heads[w]
            self.heads[w] = head = next(self.its[w], self._END)
            self.keys[w] = self.key(head) if head is not self._END else None
            node = (w + self.k) >> 1
            while node:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node >>= 1
            self.winner = w


def merged_index(runs: DataFrame, rows_each: int = 100_000) -> DataFrame:
    """The runs' entries in global order of (url_key, timestamp, page_id)."""
    spark = runs.sparkSession
    runs = cut(runs)
    n = max(shuffle_partitions(spark), -(-runs.count() // rows_each))
    ranges = runs.repartitionByRange(n, "url_key", "timestamp", F.col("page_id").asc_nulls_first()).sortWithinPartitions("archive", "place")

    def run(batches):
        part = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if part is None:
            return
        part = part.combine_chunks()
        names = part.column("archive").to_pylist()
        starts = [i for i, x in enumerate(names) if not i or names[i - 1] != x]
        keys = part.column("url_key"), part.column("timestamp"), part.column("page_id")

        def key(i):
            return keys[0][i].as_py(), keys[1][i].as_py(), -1 if (p := keys[2][i].as_py()) is None else p

        order = list(LoserTree([range(a, b) for a, b in zip(starts, [*starts[1:], len(names)])], key))
        for b in part.drop_columns(["place"]).take(pa.array(order)).to_batches(max_chunksize=10_000):
            yield b

    return ranges.mapInArrow(run, _SCHEMA)


def archive_and_index(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, and
    return the merged index."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return merged_index(capture_runs(write(pages, folder, revisit_from), folder))


def digest(pages: DataFrame) -> DataFrame:
    return archive_and_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "archive", "offset", "length")
