"""WARC archives: write pages as records, read archives back, reassemble segments.

Writing. Pages with equal payloads (SHA-1 and length) become one ``response`` record, that of the largest page_id,
and ``revisit`` records without a payload that refer to it. Only ids and digests are grouped; payloads
move once, dealt by page_id. A response's block is an HTTP message in chunked transfer framing. A block
over ``segment_bytes`` is divided: the first record has segment number 1, ``continuation`` records follow with
the first record's id as origin, the last one with the block's total length. Each record is a gzip
member of its own. A task streams its records to a file under a name of its own in the shared folder; only
files named by successful tasks are read.

Reading. Each task reads whole archives as a stream. Whole records are decoded on the spot; segments travel and
are grouped by their origin's id, ordered by number, checked to be complete and as long as the total length says, and then
decoded. Payload digests and lengths are those of the decoded bytes, for revisits those of the record they refer to, which must have
the digest that the revisit states.

Edge cases: null html is an empty payload; a null url is written without a target address; a null page_id is smaller
than all others; repeated rows (same id and same payload) are one record and give one row; rows of one id with different payloads
are separate records; a record that can't be put together is returned with ``error`` set and without digest; other
columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.llm import files

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"

SEGMENT_BYTES, CHUNK, FILE_BYTES, READ = 32 << 10, 8 << 10, 64 << 20, 1 << 18


def record_id(page_id: int | None, digest: str) -> str:
    """A stable identifier: the same page and payload have the same one in every attempt."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}/{digest}'.encode()).digest()[:16])}>"


def base32_of(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Inverse of ``chunked``; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as its size says")
        parts.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message block."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n"))
    return unchunked(body) if framed else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None),
                     b"Content-Length: %d\r\n\r\n" % len(block)])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def records(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    own = record_id(page_id, digest)
    url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")  # a header is one line
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("X-Page-ID", page_id)]
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                       ("X-Refers-To-Page-ID", refers_to), kind], HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common, kind], block)
        return
    yield _record([("WARC-Type", "response"), *common, kind, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    n = -(-len(block) // segment_bytes)
    for k in range(1, n):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, own + str(k))}>"),
                       ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k + 1),
                       ("WARC-Segment-Total-Length", len(block) if k + 1 == n else None)], block[k * segment_bytes:(k + 1) * segment_bytes])


def _write(folder: str, segment_bytes: int):
    def run(batches):
        system = out = path = None
        n = size = 0
        for batch in batches:
            for page_id, url, html, sha1, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None:
                    path = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
                    system, where = files._open(path)
                    system.create_dir(where.rpartition("/")[0], recursive=True)
                    out, n, size = system.open_output_stream(where, compression=None), 0, 0
                for data in records(page_id, url, (html or "").encode(), base32_of(sha1), refers_to, revisit, segment_bytes):
                    out.write(data)
                    n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})
    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; returns the files: path, records, bytes.

    Payloads under ``min_bytes`` are never revisited.
    """
    spark = pages.sparkSession
    folder = folder or files.scratch(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"),
                        F.octet_length(html).alias("size"))
    keys = rows.select("page_id", "sha1", "size")
    several = (keys.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
               .where("n > 1").select("sha1", "size", "refers_to"))
    revisits = (keys.where(F.col("size") >= min_bytes).join(several, ["sha1", "size"]).where("refers_to is not null and (page_id is null or page_id < refers_to)")
                .select("page_id", "sha1", "refers_to").distinct().withColumn("revisit", F.lit(True)))
    id_of = F.coalesce("page_id", F.lit(-(1 << 63)))  # null ids must meet
    joined = (rows.withColumn("k", id_of).join(revisits.withColumn("k", id_of).drop("page_id").hint("shuffle_hash"), ["k", "sha1"], "left")
              .select("page_id", "url", "html", "sha1", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit")))
    unique = joined.dropDuplicates(["page_id", "sha1"]) if _may_repeat(keys) else joined
    made = unique.mapInArrow(_write(folder, segment_bytes), "path string, records long, bytes long").checkpoint()
    return made


def _may_repeat(keys: DataFrame) -> bool:
    """Whether any (page_id, payload) occurs twice; payloads are shuffled for that only if so."""
    return not keys.groupBy("page_id", "sha1").count().where("count > 1").isEmpty()


_READ = ("record_id string, kind string, page_id long, refers_id string, refers_to long, stated string, segment int, total long, block binary, "
         "payload_bytes long, payload_digest string, error string")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a gzip archive, read as a stream of members."""
    z, plain, rest, done = zlib.decompressobj(31), bytearray(), b"", False
    while True:
        if not rest and not done:
            rest = stream.read(READ)
            done = not rest
        if rest:
            plain += z.decompress(rest)
            rest = b""
            if z.eof:
                rest, z = z.unused_data, zlib.decompressobj(31)
        head = plain.find(b"\r\n\r\n")
        while head >= 0:
            lines = bytes(plain[:head]).decode("utf-8", "replace").split("\r\n")
            if lines[0] != VERSION.decode():
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
            end = head + 4 + int(fields["content-length"])
            if len(plain) < end + 4:
                break
            yield fields, bytes(plain[head + 4:end])
            del plain[:end + 4]
            head = plain.find(b"\r\n\r\n")
        if done and not rest:
            if plain:
                raise ValueError("the archive ends within a record")
            return


def _decoded(block: bytes) -> tuple[int | None, str | None, str | None]:
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, None, f"framing: {e}"
    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None


def _whole(value: str | None) -> int | None:
    return None if value is None else int(value)


def _read(batches):
    names = [c.split()[0] for c in _READ.split(", ")]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, where = files._open(path)
            rows: list = []
            held = 0
            with system.open_input_stream(where, compression=None) as stream:
                for f, block in parse(stream):
                    kind, segment = f["warc-type"], _whole(f.get("warc-segment-number"))
                    stated = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    size = digest = error = None
                    if kind == "response" and segment is None:
                        size, digest, error = _decoded(block)
                    keep = block if segment is not None else None
                    rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), kind, _whole(f.get("x-page-id")), f.get("warc-refers-to"),
                                 _whole(f.get("x-refers-to-page-id")), stated, segment, _whole(f.get("warc-segment-total-length")), keep, size, digest, error))
                    held += len(keep or b"")
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield _batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names)


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows, names) -> pa.RecordBatch:
    kinds = [c.split()[1] for c in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(zip(*rows), kinds)], names=names)


def _reassemble(batches):
    for batch in batches:
        segments = batch.column(batch.schema.get_field_index("segments")).to_pylist()
        sizes, digests, errors = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("payload_bytes", "payload_digest", "error"))
        for i, parts in enumerate(segments):
            if not parts:
                continue
            by = {p["segment"]: p for p in parts}
            total = by[max(by)]["total"]
            if sorted(by) != list(range(1, len(by) + 1)) or total is None:
                errors[i] = "segments are missing"
            elif sum(len(p["block"]) for p in by.values()) != total:
                errors[i] = "the segments are not as long as the total length says"
            else:
                sizes[i], digests[i], errors[i] = _decoded(b"".join(by[k]["block"] for k in sorted(by)))
        keep = ["record_id", "kind", "page_id", "refers_id", "refers_to", "stated"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(sizes, pa.int64()),
                                          pa.array(digests, pa.string()), pa.array(errors, pa.string())],
                                         names=[*keep, "payload_bytes", "payload_digest", "error"])


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and error of each page in the archives (path)."""
    n = archives.count()
    rows = archives.select("path").repartition(max(n, 1), "path").mapInArrow(_read, _READ)
    first = lambda c: F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c)
    whole = (rows.groupBy("record_id")
             .agg(F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"), *map(first, ("page_id", "refers_id", "refers_to", "stated", "payload_bytes", "payload_digest", "error")),
                  F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "total", "block"))).alias("segments"))
             .mapInArrow(_reassemble, "record_id string, kind string, page_id long, refers_id string, refers_to long, stated string, payload_bytes long, "
                                      "payload_digest string, error string")).checkpoint()
    wrong = F.when(F.col("payload_digest") != F.col("stated"), F.lit("the payload has another digest than stated"))
    responses = whole.where("kind = 'response'")
    target = responses.select(F.col("record_id").alias("refers_id"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    revisits = (whole.where("kind = 'revisit'").join(target, "refers_id", "left")
                .select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.lit("revisit").alias("record_type"),
                        "refers_to", F.when(F.col("d").isNull(), F.lit("the record it refers to is missing"))
                        .when(F.col("d") != F.col("stated"), F.lit("the record it refers to has another digest")).alias("error")))
    return (responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
                             F.coalesce("error", wrong).alias("error")).union(revisits))
