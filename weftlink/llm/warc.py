"""WARC archives: a writer that refers copies to one response, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
_IDS = 0x6E1F5B2A9C3D4E708A1B << 48
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_urn(page_id: int) -> str:
    """A URN whose last 64 bits are the page_id, so it can be read back."""
    return f"<urn:uuid:{uuid.UUID(int=(_IDS >> 64 << 64) | (page_id & (2**64 - 1)))}>"


def page_of(urn: str | None) -> int | None:
    """The page of a record of this module's; None for any other name."""
    try:
        low = uuid.UUID((urn or "").strip("<>").removeprefix("urn:uuid:")).int & (2**64 - 1)
    except ValueError:
        return None
    page = low - 2**64 if low >> 63 else low
    return page if record_urn(page) == urn else None


def hex_digest(value: str | None) -> str | None:
    """The lower-case hex form of a digest header, which may be in base 32 and name its algorithm."""
    digest = (value or "").rpartition(":")[2].strip()
    if re.fullmatch(r"[A-Za-z2-7]{32}", digest):  # base 32 of 20 bytes; hex of SHA-1 has 40 digits
        return base64.b32decode(digest.upper()).hex()
    return digest.lower() or None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One gzip member with a response, or a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    clean = "".join(c for c in (url or "") if c >= " " and c != "\x7f")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {clean}", f"WARC-Date: {DATE}"]
    head.append("WARC-Record-ID: " + (record_urn(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest + clean)}>"))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head.append(f"WARC-Profile: {_PROFILE}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: {record_urn(refers_to)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    packer, out = zlib.compressobj(6, zlib.DEFLATED, 31), []
    first, *rest = ("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n").split(MAGIC)
    out.append(packer.compress(first))
    for part in rest:  # a block ends inside each magic of the content, so not even a stored block shows a reader one
        out += [packer.compress(MAGIC[:1]), packer.flush(zlib.Z_SYNC_FLUSH), packer.compress(MAGIC[1:] + part)]
    return b"".join(out) + packer.flush()


def headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def plan(pages: DataFrame, least_bytes: int = 1000, broadcast_groups: int = 200_000) -> DataFrame:
    """page_id, url, payload, digest, revisit, refers_to for each row of pages (page_id, url, html).

    Of rows with equal payloads of ``least_bytes`` or more, those with the largest page_id are responses (rows that
    repeat it all are); the others are revisits of it. Digests are grouped with only their ids. Up to
    ``broadcast_groups`` groups of several rows, a count that is taken first, are broadcast (about 16 MB), so payloads
    stay where they are; beyond, rows are joined by digest, AQE splits a hot payload's partition, and small payloads
    carry a key of their own, which deals them out evenly.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least_bytes
    groups = rows.where(large).groupBy(F.col("digest").alias("key")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = common.settle(groups, "warc-groups")
    small = groups.count() <= broadcast_groups
    alone = F.lit(None).cast("string") if small else F.concat(F.lit("#"), F.xxhash64("page_id", "payload").cast("string"))
    out = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(alone)).join(F.broadcast(groups) if small else groups, "key", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return out.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, least_bytes: int = 1000, archive_bytes: int = 1 << 30, broadcast_groups: int = 200_000) -> DataFrame:
    """Archives in the shared folder, a gzip member for each row; returns the manifest (uri, bytes, records).

    A task streams its records to one archive and begins another at ``archive_bytes``. The manifest goes through Spark's
    committer, so files of lost attempts are in no manifest. Null html: an empty payload. Null urls: an empty target.
    Control characters in a url are left out of the header. Null page_ids are written without one, repeated rows each.
    A very long payload is compressed in one piece. Other columns are ignored, whatever their names. Empty tables give an
    empty manifest.
    """
    home = common.fresh(pages.sparkSession, "warc")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fs, path = common.filesystem(home)
        fs.create_dir(path, recursive=True)
        part, done, out, size, n, name = TaskContext.get().partitionId(), [], None, 0, 0, ""
        for b in batches:
            for row in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "revisit", "refers_to")), strict=True):
                if out is None:
                    name = f"{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = fs.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                member = record(*(x.as_py() for x in row))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{home}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{home}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["uri", "bytes", "records"])

    return common.settle(plan(pages, least_bytes, broadcast_groups).mapInArrow(run, "uri string, bytes long, records long"), "warc-manifest")


class Members:
    """Gzip members of a file that start in [start, end), found without an index.

    The range is scanned for gzip magic; a candidate counts if the headers of a record are decoded from it: a version
    line, a type, a record id and a length. From there on members follow one another, and after damage the scan resumes.
    A member may end beyond the range; its bytes are read on. The writer shows no magic inside of a member; in archives of
    other writers, records of an archive that is stored uncompressed inside a record can't be told from the outer ones.
    """

    def __init__(self, file, start: int, end: int, chunk: int = 1 << 20):
        self.file, self.start, self.end, self.chunk = file, start, end, chunk

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _valid(self, at: int) -> bool:
        """Whether the candidate inflates to the whole header block of a record, whatever the length of either header."""
        unpack, head, pos = zlib.decompressobj(31), b"", at
        try:
            while (end := head.find(b"\r\n\r\n")) < 0:
                data = unpack.unconsumed_tail or self._read(pos, 4096)
                if not unpack.unconsumed_tail:
                    pos += len(data)
                if not data or unpack.eof or not b"WARC/".startswith(head[:5]):
                    return False
                head += unpack.decompress(data, 4096)
        except zlib.error:
            return False
        fields = headers(head[:end])
        return head.startswith(b"WARC/") and bool(fields.get("warc-type")) and bool(fields.get("warc-record-id")) and fields.get("content-length", "").isdigit()

    def _inflate(self, at: int) -> tuple[bytes, int] | None:
        """(content, position after the member), or None if it is damaged or cut off."""
        unpack, out, pos = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                data = self._read(pos, self.chunk)
                if not data:
                    return None
                pos += len(data)
                out.append(unpack.decompress(data))
        except zlib.error:
            return None
        return b"".join(out), pos - len(unpack.unused_data)

    def _next(self, at: int) -> int | None:
        """The next position from ``at`` in the range where a member can start."""
        while at < self.end:
            data = self._read(at, min(self.chunk, self.end - at) + len(MAGIC) - 1)
            found = data.find(MAGIC)
            while found >= 0:
                if self._valid(at + found):
                    return at + found
                found = data.find(MAGIC, found + 1)
            at += self.chunk
        return None

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at = self._next(self.start)
        while at is not None:
            member = self._inflate(at)
            if member is None:
                at = self._next(at + 1)
                continue
            yield at, member[0]
            at = member[1]
            if at >= self.end:
                return
            if self._read(at, 3) != MAGIC or not self._valid(at):
                at = self._next(at)


def parse(content: bytes) -> tuple | None:
    """(page_id, url, payload or None, payload_bytes, payload_digest, record_type, refers_to) of the first record; None for other types.

    What another writer's revisit doesn't say, as its payload's length or a page, is null.
    """
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = headers(head)
    kind, page = fields.get("warc-type", "").lower(), fields.get("page-id", "")
    page_id = int(page) if re.fullmatch(r"-?[0-9]{1,19}", page) else None
    if kind == "revisit":
        size = fields.get("payload-length", "")
        return page_id, fields.get("warc-target-uri"), None, int(size) if size.isdigit() else None, hex_digest(fields.get("warc-payload-digest")), kind, page_of(fields.get("warc-refers-to"))
    if kind != "response":
        return None
    body = rest[: int(fields.get("content-length", 0))]
    payload = body.partition(b"\r\n\r\n")[2]
    return page_id, fields.get("warc-target-uri"), payload, len(payload), hashlib.sha1(payload).hexdigest(), kind, None


def records(content: bytes) -> Iterator[tuple]:
    """``parse`` of every record of a member: most writers make a member for each, but one may hold several."""
    at = 0
    while content.startswith(b"WARC/", at):
        head = content.find(b"\r\n\r\n", at)
        size = headers(content[at:head]).get("content-length", "") if head >= 0 else ""
        if not size.isdigit():
            return
        end = head + 4 + int(size)
        if row := parse(content[at:end]):
            yield row
        at = end
        while content.startswith(b"\r\n", at):
            at += 2


def read(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Records of the archives: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    Every range of ``split_bytes`` is a row of its own that any task can take, so one huge archive is read by many
    tasks; a range owns the records that start inside it. Digests of responses are computed from the payload read.
    Works on any manifest with uri and bytes, also of other writers' archives: several records in a member are read each,
    digests in base 32 come as hex, and what their revisits don't say is null.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for uri, start, end in zip(*(b.column(c).to_pylist() for c in ("uri", "start", "end")), strict=True):
                fs, path = common.filesystem(uri)
                rows, size = [], 0
                with fs.open_input_file(path) as file:
                    for _, content in Members(file, start, end):
                        rows += records(content)
                        size += len(content)
                        if size >= 8 << 20 and rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    step = F.lit(split_bytes)
    ranges = manifest.where("bytes > 0").select("uri", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step.cast("long"))).alias("start"))
    ranges = ranges.select("uri", "start", F.least(F.col("start") + step, F.col("bytes")).alias("end"))
    tasks = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return ranges.repartition(tasks, F.xxhash64("uri", "start")).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
