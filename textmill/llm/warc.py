"""WARC archives: a writer with revisit records and a salvage reader.

:func:`write` makes one record per page, as a gzip member of its own.  Spark's
text writer puts the members into files, so commits and retries are Spark's;
its line separator is an empty gzip member, which unpacks to nothing.  Pages of
equal payload share one response, that of the largest id; the others are
revisit records that refer to it.

:func:`read` takes archives of gzip members or of plain records.  Of every
record the framing (version line, headers, length, end) and the digests are
checked.  After a failed check it looks for the next member or version line,
whichever is nearer and however the file began, that starts a valid record,
goes on from there, and reports the bytes between as a quarantined gap with the
reason of the first failure.  A record with a wrong digest whose framing leads
to the next one is passed over as a whole.

A member may hold many records.  The valid ones are taken from what can be
unpacked of it, also behind a bad one; a gap with the span of these records says
that the member lost others.  Of a member that does not unpack to its end only
records with a block digest and the version line of the next one behind them
count, and what follows the failure in its compressed stream is lost.

Defined results: a null html is an empty payload; a null id is written as
``none`` and read back as null; rows that repeat the largest id of a payload are
all responses; control characters in addresses are percent-encoded, a null
address is left out; an empty table writes no record; other columns are
ignored; damaged bytes never fail the job.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import text_bytes, trimmed

#: Payloads from this size on become revisits.
MIN_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member: ten bytes of head, an empty block, no checksum, no length.
EMPTY_MEMBER = b"\x1f\x8b\x08\0\0\0\0\0\0\xff\x03\0" + b"\0" * 8
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Where a member or a plain record may start.
MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: Head lines that a record may have more than once.
REPEATED = {"warc-concurrent-to"}
#: Bytes unpacked at once.
STEP = 1 << 14
#: Records in one archive file.
RECORDS_PER_FILE = 20_000


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archives of the pages below ``path``."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    p = pages.select("page_id", "url", "html", F.sha1(body).alias("sha"), F.octet_length(body).alias("bytes"))
    keep = p.where(F.col("bytes") >= min_bytes).groupBy(F.col("sha").alias("sha1")).agg(F.max("page_id").alias("keeper"))
    # only payloads that several pages have change a record
    same = (F.col("sha") == F.col("sha1")) & (F.col("bytes") >= min_bytes)
    j = p.join(keep, same, "left").select(
        "page_id", "url", "html", "keeper",
        (F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "keeper", "revisit")]
            out = (gzip.compress(record(i, url, raw, to, again), 6, mtime=0)
                   for i, url, to, again, raw in zip(*cols, text_bytes(batch.column("html"))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    (j.mapInArrow(trimmed(run), "value binary").select(F.col("value").cast("string"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


class Broken(Exception):
    """A failed check; its text is the reason.  ``end`` is the end of a record
    whose framing holds up to the next one.  Version lines before ``dead``
    share the lines that failed, so none of them starts a record."""

    def __init__(self, reason: str, end=None, dead: int = 0):
        super().__init__(reason)
        self.end, self.dead = end, dead


def unpack(view: memoryview, start: int) -> tuple:
    """Content of the gzip member at ``start``, its end and None; of a broken
    member what comes before the failure, None and the reason."""
    d, out, at = zlib.decompressobj(31), [], start
    try:
        while not d.eof:
            if at >= len(view):
                return b"".join(out), None, "truncated member"
            out.append(d.decompress(view[at:at + STEP]))
            at += STEP
    except zlib.error:
        # a failed call gives nothing: once more up to it, then byte by byte
        d = zlib.decompressobj(31)
        for k in range(start, at, STEP):
            d.decompress(view[k:k + STEP])
        try:
            for k in range(at, min(at + STEP, len(view))):
                out.append(d.decompress(view[k:k + 1]))
        except zlib.error:
            pass
        return b"".join(out), None, "damaged member"
    return b"".join(out), min(at, len(view)) - len(d.unused_data), None


def reached(view: memoryview, at: int, size: int) -> int:
    """Where the first ``size`` bytes of the member at ``at`` are unpacked."""
    d = zlib.decompressobj(31)
    while size:
        size -= len(d.decompress(view[at:at + STEP], size))
        at += len(view[at:at + STEP]) - len(d.unconsumed_tail)
    return at


def parse(data: bytes, at: int = 0, strict: bool = False) -> tuple:
    """The record at ``at`` as a dict, and its end; ``strict`` ones need a block digest."""
    if not VERSION.match(data, at):
        raise Broken("no version line")
    head, line, inner = {}, data.find(b"\r\n", at) + 2, 0
    while (top := data.find(b"\r\n", line)) != line:
        if top < 0:
            raise Broken("unfinished head", dead=len(data))
        name, colon, value = data[line:top].partition(b":")
        if not colon:
            raise Broken("damaged head", dead=line)
        name = name.strip().lower().decode("latin-1")
        # a head that was cut within a line goes on as the next record's
        inner = m.start() if (m := VERSION.search(data, line, top + 2)) else inner
        if name in head and name not in REPEATED:
            raise Broken("merged heads", dead=inner or line)
        head[name] = value.strip().decode("utf-8", "replace")
        line = top + 2
    if inner and starts_record(data, inner):
        raise Broken("merged heads", dead=inner)
    size = head.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", size):
        raise Broken("no length", dead=top)
    begin, end = top + 2, top + 2 + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Broken("wrong length", dead=top)
    after = end + 4 if end + 4 == len(data) or MARK.match(data, end + 4) else None
    block, kind = data[begin:end], head.get("warc-type", "")
    sha = head.get("warc-block-digest", "")
    if strict and not sha.startswith("sha1:"):
        raise Broken("no block digest", after)
    if sha.startswith("sha1:") and sha[5:] != digest(block):
        raise Broken("wrong block digest", after)
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    sha = head.get("warc-payload-digest", "")
    if kind == "response" and sha.startswith("sha1:") and sha[5:] != digest(payload):
        raise Broken("wrong payload digest", after)
    return {"record_id": head.get("warc-record-id"), "record_type": kind, "refers_to": head.get("warc-refers-to"),
            "target_uri": head.get("warc-target-uri"), "payload_digest": sha[5:] or None, "payload": payload}, end + 4


def starts_record(data: bytes, at: int) -> bool:
    try:
        r, _ = parse(data, at)
    except Broken:
        return False
    return bool(r["record_id"] and r["record_type"])


def inside(content: bytes, whole: bool) -> tuple:
    """The valid records in the content of a member, the end of the last one,
    and the reason of the first failure or None."""
    records, last, why, k, sure = [], 0, None, 0, True
    while k < len(content):
        try:
            r, end = parse(content, k, not whole)
            if not whole and not VERSION.match(content, end):
                raise Broken("broken behind")
            # after a failure, not one that stands inside a payload
            if sure or content[k - 4:k] == b"\r\n\r\n" or VERSION.match(content, end) or whole and end == len(content):
                records.append(r)
                k = last = end
                sure = True
                continue
            after, dead = None, 0
        except Broken as e:
            why, after, dead = why or str(e), e.end, e.dead
        sure = after is not None
        if after is None:
            m = VERSION.search(content, max(dead, k + 1))
            after = m.start() if m else len(content)
        k = after
    return records, last, why


def salvage(data: bytes):
    """``("record", offset, length, record)`` and ``("gap", offset, length, reason)`` of an archive, in order."""
    view, at, gap, why, held, dead = memoryview(data), 0, None, "", [], 0

    def look(pos: int):
        """Records at ``pos``, their end (None: to be searched), from where to search, the reason of a failure."""
        nonlocal dead
        if data[pos:pos + 3] != MAGIC:
            try:
                r, end = parse(data, pos)
            except Broken as e:
                dead = max(dead, e.dead)
                return [], e.end, pos + 1, str(e)
            return [r], end, end, None
        content, end, broken = unpack(view, pos)
        records, last, fault = inside(content, broken is None)
        return records, end, max(pos + 1, reached(view, pos, last)) if broken else end, broken or fault

    def close(end: int):
        for r in held:
            yield "record", gap, end - gap, r
        yield "gap", gap, end - gap, why

    while at < len(data):
        records, end, search, fault = look(at)
        if gap is not None and records:  # an empty member proves nothing
            yield from close(at)
            gap = None
        if fault is None:
            for r in records:
                yield "record", at, end - at, r
        elif gap is None:
            gap, why, held = at, fault, records
            if end is not None and records:
                yield from close(end)
                gap = None
        if end is None:
            m = MARK.search(data, search)
            while m and m.start() < dead and m[0] != MAGIC:
                m = MARK.search(data, m.end())
            end = m.start() if m else len(data)
        at = end
    if gap is not None:
        yield from close(len(data))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``.

    ``kind`` is ``record`` or ``gap``; both have ``path, offset, length`` in
    bytes of the file (of the member for packed ones), gaps ``reason``, records
    the other columns.  A file is read as a whole by one task.
    """
    schema = ("kind string, path string, offset long, length long, reason string, record_id string, record_type string, "
              "refers_to string, target_uri string, payload_digest string, payload_bytes long") + ", payload binary" * payload

    def run(batches):
        import pyarrow as pa

        names = ["kind", "path", "offset", "length", "reason", "record_id", "record_type", "refers_to", "target_uri",
                 "payload_digest", "payload_bytes"] + ["payload"] * payload
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                file, rows, size = batch.column("path")[k].as_py(), [], 0
                for kind, offset, length, what in salvage(batch.column("content")[k].as_py()):
                    if kind == "gap":
                        row = (kind, file, offset, length, what, *[None] * 6, None)
                    else:
                        body = what["payload"]
                        row = (kind, file, offset, length, None, what["record_id"], what["record_type"], what["refers_to"],
                               what["target_uri"], what["payload_digest"], len(body), body)
                        size += len(body) * payload
                    rows.append(row[:len(names)])
                    if len(rows) == 10_000 or size > 1 << 24:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(trimmed(run), schema)


def page_records(archive: DataFrame) -> DataFrame:
    """Per record ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``; a revisit has the size of the response it refers to."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    key = lambda c: F.when(number(c) != "", number(c).cast("long"))
    r = archive.where("kind = 'record'").select(
        key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"))
    own = (r.where("record_type = 'response'").groupBy(F.col("page_id").alias("to"), F.col("payload_digest").alias("sha"))
           .agg(F.max("payload_bytes").alias("whole")))
    j = r.join(own, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("sha")), "left")
    return j.select("page_id", F.when(F.col("record_type") == "revisit", F.col("whole")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                    "payload_digest", "record_type", "refers_to")
