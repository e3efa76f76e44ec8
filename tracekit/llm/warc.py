"""WARC archives: a writer with payload de-duplication and a splittable reader.

Writer: every record is a gzip member of its own. Tasks write files under names of
their own and return a manifest row per file; the manifest is written by Spark's
committer, so only files of finished tasks count and a lost or repeated attempt
leaves at most an unlisted file.

Reader: a task gets a byte range, looks for the gzip magic in it, accepts a
candidate when the decoded bytes begin with a WARC header, and owns each record whose
first byte lies in the range, reading past the range's end where it must. HTML
payloads are UTF-8, in which the magic's second byte never follows the first, so a
payload stored without compression can't hold a nested member.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm.common import partitions, written
from tracekit.session import scratch_path

# Fixed values of the WARC 1.1 format.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ID_PREFIX = "urn:page:"

MIN_REVISIT = 100
RANGE_BYTES = 8 << 20
BLOCK = 1 << 18
FILE_BYTES = 512 << 20
SALTS = 16


def _open(path: str):
    """(file system, path in it) for a folder or file of any store that pyarrow reaches."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: refers_to is null for response records.

    Of equal payloads of at least ``min_revisit`` bytes the smallest id is the response
    (rows that repeat that id are responses too) and all others refer to it. A null id
    is never the smallest unless all are null; then every row is a response. Null payloads are empty.
    Only digests that occur twice enter the join. It is salted by id, so a group of copies
    that holds a third of all rows is spread over SALTS tasks.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = (p.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(F.col("digest").alias("f_digest"), "first_id",
                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt")))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    joined = p.withColumn("salt", salt).join(
        first, (F.col("digest") == F.col("f_digest")) & (F.col("salt") == F.col("f_salt")), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"))


def _urn(value) -> str:
    return f"<{ID_PREFIX}{urllib.parse.quote(str(value), safe='')}>"


def _page_of(urn: str | None) -> str | None:
    if not urn or not urn.startswith(f"<{ID_PREFIX}"):
        return None
    return urllib.parse.unquote(urn[len(ID_PREFIX) + 1:-1])


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: WARC headers, the HTTP header and, for responses, the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode("ascii")
    block = http if refers_to is not None else http + payload
    own = _urn(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}",
            f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def write_archives(spark: SparkSession, records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``plan_records`` rows as ``*.warc.gz`` and return the manifest (path, bytes, records).

    Files go to ``folder``, by default a fresh one in the shared scratch space. An empty table writes no file.
    """
    folder = folder or scratch_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int, int]] = []
        out = name = None
        size = count = 0
        store, base = _open(folder)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = record_bytes(*row)
                out.write(member)
                size += len(member)
                count += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in
                                          enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["path", "bytes", "records"])

    cols = records.select("page_id", "url", "payload", "digest", "refers_to")
    return written(spark, cols.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


class Window:
    """Forward reads of one archive from an offset on, BLOCK bytes at a time."""

    def __init__(self, file, start: int):
        self.file, self.at, self.buffer = file, start, b""
        file.seek(start)

    def more(self) -> bool:
        block = self.file.read(BLOCK)
        self.buffer += block
        return bool(block)

    def drop(self, n: int) -> None:
        self.buffer = self.buffer[n:]
        self.at += n


def _member(w: Window) -> tuple[bytes, int] | None:
    """Decode the member at the window's start: (content, compressed length); None if it isn't a WARC record."""
    unpack = zlib.decompressobj(31)
    parts, fed, seen = [], 0, b""
    while True:
        if fed == len(w.buffer) and not w.more():
            return None
        piece = w.buffer[fed:]
        fed = len(w.buffer)
        try:
            out = unpack.decompress(piece)
        except zlib.error:
            return None
        parts.append(out)
        if len(seen) < 5:
            seen += out[:5]
            if not b"WARC/".startswith(seen[:5]):
                return None  # its header isn't one of ours
        if unpack.eof:
            return b"".join(parts), fed - len(unpack.unused_data)


def read_range(file, start: int, end: int) -> Iterator[bytes]:
    """The decoded records whose first byte lies in ``[start, end)``."""
    w = Window(file, start)
    while w.at < end:
        k = w.buffer.find(MAGIC)
        if k < 0:
            w.drop(max(0, len(w.buffer) - len(MAGIC) + 1))
            if not w.more():
                return
            continue
        w.drop(k)
        if w.at >= end:
            return
        found = _member(w)
        if found is None:
            w.drop(1)
            continue
        yield found[0]
        w.drop(found[1])


def parse_record(raw: bytes) -> tuple[str | None, int, str, str, str | None]:
    """(page, payload bytes, payload digest, record type, page referred to)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, claimed = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if digest != claimed:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        size = len(payload)
    else:
        digest = claimed
        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    return _page_of(fields["WARC-Record-ID"]), size, digest, kind, _page_of(fields.get("WARC-Refers-To"))


def read_archives(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint",
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Read archives (rows ``path, bytes``) by byte ranges: a row per record.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A response whose
    payload doesn't match its digest raises.
    """
    ranges = manifest.select("path", "bytes", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    spread = ranges.repartition(max(partitions(spark), 1), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = _open(path)
                rows = []
                with store.open_input_file(inner) as file:
                    for raw in read_range(file, start, end):
                        rows.append(parse_record(raw))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t)
                                                              for k, t in enumerate(types)], names=names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                                                 names=names)

    out = spread.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, "
                                 "refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
