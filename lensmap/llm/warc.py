"""WARC archives: a writer with revisit records and a salvaging reader.

Writer.  Each page becomes one gzip member holding one WARC/1.1 record whose
block is an HTTP response.  Of the pages with equal payloads of at least
``min_revisit`` bytes the one with the smallest page_id is a response, the
others are revisits that refer to it and carry no payload.  Files are written
by Spark's own text sink, so that its commit protocol decides which attempt of
a task counts: a member's last byte is the top byte of its length, 0 below
16 MB, and stands as the sink's one-byte line separator (a longer record is
followed by an empty member, which ends in 0 too).  The files are plain
multi-member gzip; ``per_file`` bounds their size.

Reader.  ``salvage`` goes through a file member by member, or version line by
version line where it is not compressed.  Every record must inflate with a
right checksum, have a version line, headers, a length that fits, the closing
blank lines and matching digests.  After a failed check it searches for the
next valid member or version line and goes on there; the bytes between are
logged as a gap with the reason.  Of a damaged member the records that inflate
before the damage are read - before a cut all, else those with a block digest.  One file is one row of ``binaryFile``, so a
file has to fit a task (Spark's limit is 2 GB; ours are far smaller).

Defined cases: a null payload is empty; a null url is left out; a null page_id
is written as 'null' and comes back null (it is never the smallest unless all
are null); several rows with the smallest page_id and the same payload are all
responses; repeated rows come back repeated; empty tables give no files and no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmap.session import ensure_checkpoint_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("kind string, file string, start long, end long, reason string, record_type string, record_id string, "
          "uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


EMPTY_MEMBER = member(b"")


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, n_bytes: int) -> bytes:
    """One record, uncompressed; ``refers_to`` set: a revisit without payload."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n").encode()
    block += payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~-._"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, size = [], 0
        for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "n_bytes"))):
            raw = record_bytes(*r)
            m = member(raw)
            m = m if m[-1] == 0 else m + EMPTY_MEMBER
            out.append(m[:-1])
            size += len(m)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def with_revisits(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, refers_to (null: a response)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    ids = p.filter(F.col("n_bytes") >= min_revisit).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # only ids and digests meet a hot payload; pages are joined on (digest, id), which spreads it
    later = (ids.join(first, "digest").filter(~F.coalesce(F.col("page_id") == F.col("first"), F.col("first").isNull()))
             .groupBy("digest", "page_id").agg(F.first("first").alias("refers_to"))
             .withColumnsRenamed({"digest": "d", "page_id": "i"}))
    return p.join(later, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("i")), "left").drop("d", "i")


def write_warc(pages: DataFrame, path: str, min_revisit: int = 100, per_file: int = 20_000) -> None:
    """Write (page_id, url, html) rows as gzip WARC files under ``path``."""
    (with_revisits(pages, min_revisit).select("page_id", "url", "payload", "digest", "refers_to", "n_bytes")
     .mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path))


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The valid record at ``at`` of uncompressed bytes, and its end; ValueError says what failed."""
    v = _VERSION.match(data, at)
    if not v:
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("headers do not end")
    head = {}
    for line in data[v.end():stop].split(b"\r\n"):
        k, colon, x = line.partition(b":")
        if not colon:
            raise ValueError("bad header")
        head[k.strip().lower().decode("latin-1")] = x.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    lo, hi = stop + 4, stop + 4 + int(head["content-length"])
    if data[hi:hi + 4] != b"\r\n\r\n":
        raise ValueError("length does not fit")
    block = data[lo:hi]
    want = head.get("warc-block-digest", "")
    if want.startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
        raise ValueError("block digest differs")
    payload, n = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise ValueError("no HTTP headers")
        m = re.search(rb"(?im)^content-length: *(\d+)", http)
        n = int(m[1]) if m else len(payload)
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind != "revisit":
        n, real = len(payload), hashlib.sha256(payload).hexdigest()
        if head.get("warc-payload-digest", "").startswith("sha256:") and digest != real:
            raise ValueError("payload digest differs")
        digest = real
    return {"record_type": kind, "record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"),
            "refers_to": head.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": n,
            "payload": payload}, hi + 4


CHUNK = 1 << 14      # bytes inflated at once


def _inflated(data: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """(end, bytes) for each byte of the damaged member at ``at``, up to the damage."""
    z = zlib.decompressobj(31)
    for i in range(at, len(data)):
        try:
            yield i + 1, z.decompress(data[i:i + 1])
        except zlib.error:
            return


def _before_damage(data: bytes, at: int, digests: bool) -> tuple[list[dict], list[tuple[int, int, str]], int]:
    """(records, gaps, end) of what inflates before the damage of the member at ``at``.

    No checksum covers these records: with ``digests``, those without a block digest are gaps."""
    body = b"".join(x for _, x in _inflated(data, at))
    found, lost, reach, n_lost = [], [], 0, 0
    for kind, lo, hi, x in salvage(body):
        head = body[lo:body.find(b"\r\n\r\n", lo)]
        if kind == "record" and (not digests or re.search(rb"(?im)^warc-block-digest[ \t]*:[ \t]*sha256:", head)):
            found.append(x)
            reach, n_lost = hi, len(lost)
        else:
            lost.append((lo, hi, "no block digest in a damaged member" if kind == "record" else x))
    end = size = 0
    for end, x in _inflated(data, at):
        size += len(x)
        if size >= reach:
            break
    return found, [(at, end, f"in the member, bytes {lo}-{hi}: {x}") for lo, hi, x in lost[:n_lost]], end


def _unit(data: bytes, at: int) -> tuple[list[dict], list[tuple[int, int, str]], int, str | None]:
    """(records, gaps, end, damage) of the member or plain record at ``at``; ValueError if nothing is valid.

    ``damage`` is the reason why a member holds no more after ``end``."""
    if data[at:at + 3] != b"\x1f\x8b\x08":
        r, end = _parse(data, at)
        return [r], [], end, None
    z, damage, cut, parts, end = zlib.decompressobj(31), None, False, [], at
    try:
        while not z.eof and end < len(data):        # zlib copies what it does not use: never hand it the rest of the file
            parts.append(z.decompress(memoryview(data)[end:end + CHUNK]))
            end = min(end + CHUNK, len(data))
        if not z.eof:
            damage, cut = "member is cut off", True
    except zlib.error as e:
        damage = f"member: {e}"
    if damage:
        found, lost, end = _before_damage(data, at, not cut)
        if not found:
            raise ValueError(damage)
        return found, lost, end, damage
    body, end = b"".join(parts), end - len(z.unused_data)
    found, lost = [], []
    for kind, lo, hi, x in salvage(body):
        if kind == "record":
            found.append(x)
        else:
            lost.append((at, end, f"in the member, bytes {lo}-{hi}: {x}"))
    if body and not found:
        raise ValueError(lost[0][2] if lost else "no record")
    return found, lost, end, None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """('record', start, end, fields) and ('gap', start, end, reason) in file order."""
    at, damage = 0, None
    while at < len(data):
        try:
            if damage:
                raise ValueError(damage)
            found, lost, end, damage = _unit(data, at)
        except ValueError as e:
            reason, begin, seek = str(e), at, at if damage else at + 1
            while True:  # the next place where a record is valid
                m = _NEXT.search(data, seek)
                if not m:
                    yield "gap", begin, len(data), reason
                    return
                at = m.start()
                seek = at + 1
                try:
                    found, lost, end, damage = _unit(data, at)
                    break
                except ValueError:
                    continue
            yield "gap", begin, at, reason
        for lo, hi, why in lost:
            yield "gap", lo, hi, why
        for r in found:
            yield "record", at, end, r
        at = end


def _reader(payload: bool):
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = {"start": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows, size = [], 0
                for kind, lo, hi, x in salvage(content.as_py()):
                    row = {"kind": kind, "file": file, "start": lo, "end": hi}
                    row |= x if kind == "record" else {"reason": x}
                    size += len(row.get("payload", b"")) + 200
                    if not payload:
                        row.pop("payload", None)
                    rows.append(row)
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

    return read


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records and gaps (``kind``) of all files under ``path``; columns as in RECORD."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(payload), RECORD)


def page_of(urn):
    """page id of a <urn:page:N>; null for 'null' and for other names."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op1(spark, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/lensmap-warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    r = read_warc(spark, path, payload=False).filter("kind = 'record'")
    return r.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    page_of(F.col("refers_to")).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n < 100 OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 100 OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""
