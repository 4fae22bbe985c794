"""WARC archives with revisit resolution.

``resolve`` takes headers only: for each payload digest (and length) that more than one record has, the least
record id is the original.  These originals come from one aggregation over headers; at most ``BROADCAST_ROWS``
of them (they are counted) are broadcast to the records, so that payloads are never shuffled; more are joined
by digest.  ``write_archive`` writes WARC/1.1 records with fresh headers (the date is that of the writing),
payloads for originals only, as gzip files through Spark's own writer, so that any file system Spark can reach
will do.  ``read_archive`` parses such files, and foreign ones, by their lengths, with streaming decompression.

A record is one row of the text writer with ``\\r\\n\\r\\n`` for its line end, which is how a WARC record ends;
payloads are UTF-8 text.  A file has ``FILE_RECORDS`` records at most, and about ``FILE_BYTES``.

Foreign archives: files ``*.gz`` or ``*.warc``; gzip members may hold one record each (as is usual) or many;
field names in any case and folded lines are understood; records of any type are returned.  A payload is what
follows the HTTP header in a block of HTTP (chunked transfer is undone), else the whole block; a revisit has
none.  Where a record names no digest or length, those of its payload are returned.  A SHA-1 digest that does
not match its payload, a truncated file and bytes that are no record raise ValueError; digests of other
algorithms are returned as they are.  A file is read by one task, as a whole, and must be below 2 GB.

Defined results: a null payload is an empty one.  Records whose payload has fewer than ``least_bytes`` bytes
are all responses.  Rows that share the least id of their payload are all responses; a null id counts as
least only if the payload has no other.  Ids may be of any type that can be cast to text; they are
percent-encoded in headers.  A null url leaves out WARC-Target-URI; control characters and spaces in a url are
percent-encoded.  Other columns of the input are ignored.  An empty table gives an archive without a record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shielded, by_value, scratch_path, settle

FILE_BYTES, FILE_RECORDS = 32 << 20, 2000
END = "\r\n"
#: Digits of Spark's conv() in base 32, and those of RFC 4648.
CONV32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
READ_SCHEMA = "record_id string, record_type string, url string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"
#: Originals (about 60 bytes each) that are broadcast.
BROADCAST_ROWS = 200_000


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a payload: 10 hexadecimal digits are 8 of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def resolve(records: DataFrame, *, record_id: str, digest: str, length: str, least_bytes: int = 0) -> DataFrame:
    """``records`` with ``record_type`` and ``refers_to``; only these three columns are shuffled, unless very many payloads repeat."""
    headers = records.select(F.col(record_id).alias("id"), F.col(digest).alias("_digest"), F.col(length).alias("_length"))
    groups = headers.where(F.col("_length") >= least_bytes).groupBy("_digest", "_length").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("_original"))
    originals = settle(groups.where("n > 1").select("_digest", "_length", "_original"), "originals")
    few = originals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    match = (F.col(digest) == F.col("_digest")) & (F.col(length) == F.col("_length"))
    joined = records.join(F.broadcast(originals) if few else originals, match, "left")
    again = F.col("_original").isNotNull() & ~F.col(record_id).eqNullSafe(F.col("_original"))
    return joined.withColumns(
        {"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_original"))}
    ).drop("_digest", "_length", "_original")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END))


def record_text(*, record_id: Column, url: Column, payload: Column, digest: Column, length: Column, record_type: Column, refers_to: Column, date: str) -> Column:
    """A WARC record without the two line ends that close it."""
    response = record_type == "response"
    empty = F.lit("")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.when(response, length).otherwise(F.lit(0)).cast("string"), F.lit(END + END)
    )
    body = F.when(response, payload).otherwise(empty)
    target = F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", record_type),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(record_id.cast("string")), empty), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", target), empty),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _line("WARC-Payload-Length", length),
        F.coalesce(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.url_encode(refers_to.cast("string")), F.lit(">"))), empty),
        F.when(response, empty).otherwise(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(http) + F.octet_length(body)),
        F.lit(END), http, body,
    )


def write_archive(
    pages: DataFrame, path: str | None = None, *, record_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str | None = None
) -> str:
    """Writes the deduplicated archive; returns its folder.  ``date`` is that of the records, the time of writing unless given."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    held = Shielded(pages)
    body = F.coalesce(F.col(held.of(payload)).cast("string"), F.lit(""))
    rows = held.rows.select(F.col(held.of(record_id)).alias("id"), F.col(held.of(url)).cast("string").alias("url"), body.alias("payload"))
    sized = rows.withColumns({"digest": payload_digest(F.col("payload")), "length": F.octet_length("payload").cast("long")})
    mean = sized.agg(F.avg("length")).first()[0] or 0.0
    per_file = max(1, min(FILE_RECORDS, int(FILE_BYTES / (mean + 600))))
    typed = resolve(sized, record_id="id", digest="digest", length="length", least_bytes=least_bytes)
    text = record_text(
        record_id=F.col("id"), url=F.col("url"), payload=F.col("payload"), digest=F.col("digest"), length=F.col("length"),
        record_type=F.col("record_type"), refers_to=F.col("refers_to"), date=date,
    )
    records = typed.select(text.alias("value"))
    records.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


class Parser:
    """Records of a stream of bytes, by Content-Length."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.held += data
        at = 0
        while True:
            while self.held[at : at + 2] == b"\r\n":  # some writers close a record with more line ends than two
                at += 2
            stop = self.held.find(b"\r\n\r\n", at)
            if stop < 0:
                break
            version, fields = header_fields(bytes(self.held[at:stop]))
            if not version.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            if not fields.get("content-length", "").isdigit():
                raise ValueError("a record without a length")
            size = int(fields["content-length"])
            if len(self.held) < stop + 4 + size + 4:
                break
            block = bytes(self.held[stop + 4 : stop + 4 + size])
            if self.held[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            at = stop + 8 + size
            yield self.record(fields, block)
        del self.held[:at]

    @staticmethod
    def record(fields: dict[str, str], block: bytes) -> tuple:
        kind, claimed = fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
        payload = None if kind == "revisit" else payload_of(fields, block)
        length = int(fields["warc-payload-length"]) if fields.get("warc-payload-length", "").isdigit() else None
        digest = claimed[5:] if claimed.lower().startswith("sha1:") else claimed
        if payload is not None:
            true = hashlib.sha1(payload)
            forms = {true.hexdigest(), base64.b32encode(true.digest()).decode()}
            if claimed.lower().startswith("sha1:") and not {digest, digest.lower(), digest.upper()} & forms or length not in (None, len(payload)):
                raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
            digest, length = digest or base64.b32encode(true.digest()).decode(), len(payload)
        return bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), digest or None, length, bare(fields.get("warc-refers-to")), payload


def header_fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields, names in lower case; a line that begins with white space goes on with the one before."""
    first, *lines = head.decode("utf-8", "replace").split(END)
    fields: dict[str, str] = {}
    last = None
    for x in lines:
        if x[:1] in (" ", "\t") and last:
            fields[last] = f"{fields[last]} {x.strip()}".strip()
        else:
            name, _, value = x.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return first, fields


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    _, http = header_fields(head)
    return unchunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked transfer; a body that is not chunked, whatever its header says, is taken as it is."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        size = body[at:stop].split(b";")[0].strip() if stop >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return body
        if n == 0:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + n])
        at = stop + 2 + n + 2


def bare(reference: str | None) -> str | None:
    """Our own ids without their frame; others without brackets."""
    if reference is None:
        return None
    reference = reference.removeprefix("<").removesuffix(">")
    if reference.startswith("urn:page:"):
        return unquote_plus(reference.removeprefix("urn:page:")) or None
    return reference or None


def unzipped(content: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """Bytes of a file in pieces: all members of a gzip file, one after the other, or the file itself."""
    try:
        yield from members(content, step)
    except zlib.error as e:
        raise ValueError(f"an archive is damaged: {e}") from None


def members(content: memoryview, step: int) -> Iterator[bytes]:
    if bytes(content[:2]) != b"\x1f\x8b":
        for i in range(0, len(content), step):
            yield bytes(content[i : i + step])
        return
    unzip, at = zlib.decompressobj(wbits=31), 0
    while at < len(content):
        piece = content[at : at + step]
        at += len(piece)
        yield unzip.decompress(piece)
        while unzip.eof:
            at -= len(unzip.unused_data)
            if not any(content[at : at + 64]):  # padding, or the end
                if any(content[at:]):
                    raise ValueError("an archive goes on with bytes that are not gzip")
                return
            rest = content[at : at + step]
            at += len(rest)
            unzip = zlib.decompressobj(wbits=31)
            yield unzip.decompress(rest)
    if not unzip.eof:
        raise ValueError("an archive ends inside a gzip member")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files in ``path`` (``READ_SCHEMA``); the payload of a revisit is null."""
    by_value()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    names = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                parser, rows, size = Parser(), [], 0
                for piece in unzipped(memoryview(content.as_buffer())):
                    for r in parser.feed(piece):
                        rows.append(r)
                        size += 200 + len(r[-1] or b"")
                        if size > 4 << 20:
                            yield flush(rows)
                            rows, size = [], 0
                if parser.held.strip(b"\r\n"):
                    raise ValueError("an archive ends inside a record")
                if rows:
                    yield flush(rows)

    return files.mapInArrow(work, READ_SCHEMA)


def restore(records: DataFrame) -> DataFrame:
    """``records`` with the payload of each revisit taken from the response it refers to, matched by digest."""
    originals = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("_digest"), F.col("record_id").alias("_id")).agg(F.first("payload").alias("_payload"))
    match = (F.col("payload_digest") == F.col("_digest")) & (F.col("refers_to") == F.col("_id"))
    return records.join(originals, match, "left").withColumn("payload", F.coalesce("payload", "_payload")).drop("_digest", "_id", "_payload")
