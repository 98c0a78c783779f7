"""WARC archives, written and read back through a merged capture index.

A page is one record; a payload that an earlier page has already stored
becomes a revisit without a body. Each archive comes with a run of index
entries sorted by URL key and time. Runs are cut at common splitters, and each
task merges its slices of all runs with a loser tree, so the merged index is
in global order and captures of a URL stand together.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import keep, shared_folder

MIN_REVISIT = 100
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
ARCHIVES = 16
_EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Sortable key of a URL: host labels in reverse, then port, path and query; scheme, fragment and case of the host are left out."""
    head, mark, rest = (url or "").partition("://")
    rest = (rest if mark else head).split("#", 1)[0]
    at = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, _, port = rest[:at].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (":" + port if port else "") + ")" + (rest[at:] or "/")


def capture_time(page_id: int | None) -> str:
    """The pages have no time of their own: a second for each page number."""
    return (_EPOCH + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record as its own gzip member."""
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {digest}')}>"),
        ("WARC-Date", capture_time(page_id)),
        ("WARC-Target-URI", json.dumps(url, ensure_ascii=True)[1:-1] if url is not None else ""),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    body = b"" if revisit else payload
    kind = "application/octet-stream" if revisit else "text/html; charset=utf-8"
    fields += [("Content-Type", kind), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of a record; ValueError if it isn't whole."""
    raw = gzip.decompress(member)
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return fields, rest[:size]


class LoserTree:
    """Merges sorted runs: a replay from one leaf to the root costs one comparison a level."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _replay(self, leaf: int) -> None:
        at, winner = (leaf + self.k) // 2, leaf
        while at > 0:
            if self.tree[at] < 0:  # while the tree fills, a first comer waits
                self.tree[at] = winner
                return
            if self._before(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (item := self.head[self.tree[0]]) is not None:
            yield item
            leaf = self.tree[0]
            self.head[leaf] = next(self.runs[leaf], None)
            self._replay(leaf)


_ENTRY = "url_key string, ts string, page_id bigint, file string, at bigint, size bigint, row bigint"
_NAMES = [f.split()[0] for f in _ENTRY.split(", ")]
#: Index entries of a range that one task merges.
ENTRIES = 200_000


def decided(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their payload's ``digest`` and size ``n``, the ``first`` page of each digest that several pages of enough bytes share)."""
    raw = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", "html", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("n")).withColumn("row", F.monotonically_increasing_id())
    seen = pages.select("page_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("n")).where(F.col("n") >= MIN_REVISIT)
    again = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 AND first IS NOT NULL").select("digest", "first")
    return rows, keep(again)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as archives under ``folder`` and return the index entries of the written records.

    A task writes archives of its own under names that no other attempt uses,
    and only entries of finished attempts are in the index.
    """
    rows, again = decided(pages)
    small = again.count() <= 200_000  # entries of bounded size: under 20 MB
    joined = rows.join(F.broadcast(again) if small else again, "digest", "left")
    refers = F.when((F.col("n") >= MIN_REVISIT) & (F.col("first") != F.col("page_id")), F.col("first"))
    records = joined.select("row", "page_id", "url", "html", "digest", refers.alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = out = None
        at, entries = 0, []

        def finish() -> pa.RecordBatch:
            # The run of this archive, in order of key, time and page.
            entries.sort(key=lambda e: (e[0], e[1], -1 if e[2] is None else e[2]))
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], _NAMES)
            entries.clear()
            return done

        for batch in batches:
            for row, page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("row", "page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = record(page, url, (html or "").encode(), refers, digest)
                out.write(member)
                entries.append((url_key(url), capture_time(page), page, name, at, len(member), row))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield finish()
        if out is not None:
            out.close()
            yield finish()

    return keep(records.mapInArrow(run, _ENTRY))


def _slices(batches: Iterable[pa.RecordBatch]) -> dict[str, list[pa.RecordBatch]]:
    """The batches of a range by run; they come run by run, each in order."""
    runs: dict[str, list[pa.RecordBatch]] = {}
    for batch in batches:
        names = batch.column("file").to_pylist()
        at = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(at[:-1], at[1:]):
            if b > a:
                runs.setdefault(names[a], []).append(batch.slice(a, b - a))
    return runs


def _entries(slices: list[pa.RecordBatch], block: int = 1024) -> Iterator[tuple]:
    """A run's entries with their place in the order before them; a block of it is unpacked at a time."""
    for batch in slices:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            for e in zip(*(part.column(c).to_pylist() for c in _NAMES)):
                yield e[0], e[1], -1 if e[2] is None else e[2], e[6], e


def merge_index(runs: DataFrame, entries_per_part: int = ENTRIES) -> DataFrame:
    """All index runs as one index in global order of URL key, time and page, with ``part`` and ``position`` in it.

    Ranges are cut by size at sampled whole entries, so a task holds about
    ``entries_per_part`` of them (packed, some 150 bytes each) however many
    there are; ties of key and time are cut by page and row, so one URL may
    span ranges. A task's rows arrive run by run, each in order, and leave
    merged by a loser tree that unpacks one block of each run at a time.
    """
    n = max(1, -(-runs.count() // entries_per_part))
    order = ["url_key", "ts", "page_id", "row"]
    sliced = runs.repartitionByRange(n, *order).sortWithinPartitions("file", *order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), []
        for position, (*_, e) in enumerate(LoserTree([_entries(r) for _, r in sorted(_slices(batches).items())])):
            out.append((*e, part, position))
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        kinds_ = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds_)], [*_NAMES, "part", "position"])

    return sliced.mapInArrow(run, f"{_ENTRY}, part bigint, position bigint")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every indexed record, read from its archive and checked: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, ts``.

    Entries are grouped by archive and offset, so a task reads forward. A
    record whose payload doesn't have its digest raises.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        name = source = None
        for batch in batches:
            out = []
            for key, ts, file, at, size in zip(*(batch.column(c).to_pylist() for c in ("url_key", "ts", "file", "at", "size"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                source.seek(at)
                fields, body = parse(source.read(size))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                length = int(fields["X-Payload-Length"])
                if kind == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"{file} at {at}: the payload is not what was stored")
                page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
                out.append((int(page) if page else None, length, digest, kind, int(refers) if refers else None, key, ts))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts"],
                )

    n = max(ARCHIVES, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Slices of 64 MB of an archive, so that a large one is read by several tasks.
    placed = index.repartition(n, "file", F.floor(F.col("at") / (64 << 20))).sortWithinPartitions("file", "at")
    return placed.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, ts string")


def history(index: DataFrame) -> DataFrame:
    """The merged index with the number of each entry among its URL's captures, from 1 on in order of time.

    A URL's captures stand together in a part, so a number is the place there
    and the captures in earlier parts; no task takes all captures of a URL.
    """
    here = index.groupBy("url_key", "part").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("url_key").orderBy("part")) - F.col("n")
    joined = index.join(here.select("url_key", "part", "first", before.alias("before")), ["url_key", "part"])
    return joined.withColumn("capture", F.col("before") + F.col("position") - F.col("first") + 1).select(*index.columns, "capture")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives, merge their index and read every record back through it.

    Null html is an empty payload, null urls and ids stay null in the result;
    repeated rows are records of their own. Rows of one payload and one id are
    all responses. Payloads and urls of any length are whole. An empty table
    writes no archive.
    """
    where = folder or shared_folder(pages.sparkSession) + "-warc"
    index = keep(merge_index(write_archives(pages, where)))
    return read_archives(index, where).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
