"""WARC archives with a two-level capture index.

Writing: every partition writes one archive of record-wise gzip members, so a record can be read by its byte range.  A
payload of at least ``REVISIT_BYTES`` that equals an earlier page's is written as a ``revisit`` record without a body.

Index, level one: lines of (reversed-host key, archive, offset, length), range-partitioned and sorted by key, packed into
zlib blocks of a part file.  Level two: a sparse directory with the first key of each block and the block's place.  A
lookup binary-searches the directory, reads and inflates one block by its range, binary-searches the block and then reads
the record's range.  Bulk lookups come sorted, so each block is read about once, and records are then read archive by
archive in the order of their offsets.

Every attempt of a task writes files of its own name, and its rows say which: only the rows of the attempt that Spark
commits are read, so a second attempt, with the same rows in another order, can't move offsets under the index.  All files
are in the shared folder.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.llm.shared import SharedFile, filesystem, fresh_path, parallelism, written

REVISIT_BYTES = 100
BLOCK_LINES = 3000
#: The directory never has more entries than this plus one a part; blocks grow instead.
MAX_DIRECTORY = 200_000
#: One record range read joins the next if the gap is below this many bytes.
GAP = 1 << 16
_DATE = "1970-01-01T00:00:00Z"
_CRLF = b"\r\n"


def surt(url: str | None) -> str:
    """Reversed-host key: ``https://www.a.example:80/B?c`` -> ``example,a,www)/B?c``; scheme, port, user, fragment go.

    A url that has no host, or can't be split, is its own key; null is the empty key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Key of one capture; white space, which divides an index line, is escaped."""
    key = "".join(f"%{ord(c):02X}" if c <= " " else c for c in surt(url))
    return f"{key} {'-' if page_id is None else page_id}"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has no block but names its original and the full payload."""
    name = lambda i: f"<urn:capture:{'none' if i is None else i}>"
    clean = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "urn:none")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {clean}",
        f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    block = b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2, 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != _CRLF * 2:
        raise ValueError("a record's length and its block differ")
    return fields, rest[:n]


def _id_of(name: str | None) -> int | None:
    return None if name is None or name.endswith(":none>") else int(name[len("<urn:capture:") : -1])


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, body, digest, refers_to): refers_to is null for a response, else the response's page_id.

    Only digests that occur more than once are joined back, so pages without a twin are not moved where that table is small.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body")
    ).withColumn("digest", F.sha2("body", 256))
    twins = written(
        rows.filter(F.octet_length("body") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "twins",
    )
    joined = rows.join(twins, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "body", "digest", refers.alias("refers_to"))


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write the records; returns the written table of index lines (key, archive, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, out = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or SharedFile(folder, name)
            keys, offsets, lengths = [], [], []
            for i, url, body, digest, ref in zip(*(batch.column(k).to_pylist() for k in range(5))):
                at, n = out.write(record(i, url, body.encode(), digest, ref, ref is not None))
                keys.append(capture_key(url, i))
                offsets.append(at)
                lengths.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "archive", "offset", "length"],
            )
        if out:
            out.close()

    return written(decided.mapInArrow(run, "key string, archive string, offset long, length long"), "captures")


class CaptureIndex:
    """The two-level index over ``folder``; ``directory`` is [(first key, part, offset, length)] in key order."""

    def __init__(self, folder: str, directory: list[tuple[str, str, int, int]]):
        self.folder, self.directory = folder, directory
        self.firsts = [d[0] for d in directory]
        self._open: dict = {}
        self._block: dict[int, tuple[list[str], list[str]]] = {}

    def __getstate__(self):
        return {"folder": self.folder, "directory": self.directory, "firsts": self.firsts, "_open": {}, "_block": {}}

    @classmethod
    def build(cls, captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        total = captures.count()
        lines_in_block = max(block_lines, -(-total // MAX_DIRECTORY))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            name, out, lines, places = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx", None, [], []

            def flush():
                nonlocal out
                out = out or SharedFile(f"{folder}/index", name)
                places.append((lines[0].rsplit(" ", 3)[0], name, *out.write(zlib.compress("\n".join(lines).encode(), 6))))
                lines.clear()

            for batch in batches:
                for k, a, o, n in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    lines.append(f"{k} {a} {o} {n}")
                    if len(lines) == lines_in_block:
                        flush()
            if lines:
                flush()
            if out:
                out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in places], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))],
                names=["first", "part", "offset", "length"],
            )

        ordered = captures.repartitionByRange(parallelism(captures), "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
        parts = written(ordered.mapInArrow(run, "first string, part string, offset long, length long"), "directory")
        return cls(folder, sorted((r["first"], r["part"], r["offset"], r["length"]) for r in parts.collect()))

    def _file(self, name: str):
        if name not in self._open:
            at, root = filesystem(self.folder)
            if len(self._open) > 64:
                self._open.clear()
            self._open[name] = at.open_input_file(f"{root}/{name}")
        return self._open[name]

    def block(self, i: int) -> tuple[list[str], list[str]]:
        """Keys and lines of block ``i``; the last two used are kept."""
        if i not in self._block:
            if len(self._block) >= 2:
                self._block.pop(next(iter(self._block)))
            _, part, offset, length = self.directory[i]
            lines = zlib.decompress(self._file(f"index/{part}").read_at(length, offset)).decode().split("\n")
            self._block[i] = [x.rsplit(" ", 3)[0] for x in lines], lines
        return self._block[i]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of each capture of ``key``."""
        out, i = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.directory) and self.firsts[i] <= key:
            keys, lines = self.block(i)
            at = bisect.bisect_left(keys, key)
            while at < len(keys) and keys[at] == key:
                archive, offset, length = lines[at].rsplit(" ", 3)[1:]
                out.append((archive, int(offset), int(length)))
                at += 1
            i += 1
        return out

    def read(self, archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self._file(archive).read_at(length, offset))


def look_up(index: CaptureIndex, wanted: DataFrame) -> DataFrame:
    """(page_id, url) rows, repeats counting once -> the places of their captures."""

    shared = wanted.sparkSession.sparkContext.broadcast(index)  # its directory has at most MAX_DIRECTORY entries and one a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keys = sorted({capture_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())})
            found = [x for k in keys for x in index.find(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "offset", "length"]
            )

    @F.pandas_udf("string")
    def key_of(ids, urls):
        return ids.combine(urls, lambda i, u: capture_key(u, None if i != i or i is None else int(i)))

    rows = wanted.select(F.col("page_id").cast("long"), F.col("url").cast("string")).distinct()
    keyed = rows.withColumn("key", key_of(F.col("page_id").cast("string"), "url"))
    n = parallelism(wanted)
    ordered = keyed.repartitionByRange(n, "key").sortWithinPartitions("key").select("page_id", "url")
    return ordered.mapInArrow(run, "archive string, offset long, length long")


def read_records(index: CaptureIndex, places: DataFrame) -> DataFrame:
    """Range reads, archive by archive in the order of offsets -> one row a capture.

    A response's digest is recomputed from the bytes read and must equal its header; a revisit carries its original's.
    """

    def rows_of(archive: str, spans: list[tuple[int, int]]) -> Iterator[tuple]:
        at = 0
        while at < len(spans):
            to, end = at, sum(spans[at])
            while to + 1 < len(spans) and spans[to + 1][0] - end < GAP and spans[to + 1][0] + spans[to + 1][1] - spans[at][0] < 1 << 23:
                to += 1
                end = max(end, sum(spans[to]))
            data = index._file(archive).read_at(end - spans[at][0], spans[at][0])
            for offset, length in spans[at : to + 1]:
                fields, block = parse_record(data[offset - spans[at][0] : offset - spans[at][0] + length])
                kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                if kind == "response" and (hashlib.sha256(block).hexdigest(), len(block)) != (digest, size):
                    raise ValueError(f"{archive}@{offset}: payload and digest differ")
                ref = _id_of(fields.get("WARC-Refers-To"))
                yield _id_of(fields["WARC-Record-ID"]), size, digest, kind, ref
            at = to + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[tuple[int, int]]] = {}
            for a, o, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                by.setdefault(a, []).append((o, n))
            rows = [r for a, spans in by.items() for r in rows_of(a, spans)]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )

    n = parallelism(places)
    dealt = places.repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[str, CaptureIndex]:
    """Write ``pages`` (page_id, url, html) as archives and index them: the folder's URI and the index."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return folder, CaptureIndex.build(write_archives(decide(pages), folder), folder)


def write_and_read_back(pages: DataFrame) -> DataFrame:
    """One row per page, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Defined cases: a null html is an empty payload, a null url the empty key.  Rows that share the smallest page_id of
    their payload are all responses (a revisit could not name one of them).  A null page_id is never an original unless
    all of its payload's are null, then each is a response.  An empty table gives no archives and no rows.  Other columns
    are ignored.
    """
    folder, index = archive_pages(pages)
    return read_records(index, written(look_up(index, pages), "places"))
