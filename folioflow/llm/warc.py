"""WARC archives: writing, reading, and revisit resolution."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import discard, materialize, scratch_path, table

RECORD = "path string, ordinal long, page_id long, record_id string, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: (folder, payload bytes below this, records a file): a file of any folder unpacks to 128 MB at most, or to one record.
SIZES = (("small", 8 << 10, 16_384), ("middle", 128 << 10, 1024), ("large", 4 << 20, 32), ("single", None, 1))


def record_text(record_id: Column, page_id: Column, url: Column, html: Column, date: str) -> Column:
    """A WARC 1.1 response without its two closing line ends; header fields that are null are left out.

    A header field is one line, so line ends in a URL become blanks there and the exact URL follows in hex.
    """
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    fields = [
        field("WARC-Type", F.lit("response")), field("WARC-Record-ID", record_id), field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.regexp_replace(url, "[\r\n]", " ")), field("X-Target-URI-Hex", F.when(url.rlike("[\r\n]"), F.hex(F.encode(url, "UTF-8")))),
        field("X-Page-ID", page_id), field("Content-Type", F.lit("text/html; charset=utf-8")), field("Content-Length", F.octet_length(html)),
    ]
    return F.concat(F.lit("WARC/1.1\r\n"), *fields, F.lit("\r\n"), html)


def write_archive(records: DataFrame, path: str, files_of: int, level: str = "BEST_SPEED") -> str:
    """Write the `record` column as gzip archives of files_of records through Spark's own writer, which any store takes.

    level is a name of zlib's; the fastest one takes half the time of the default for a tenth more bytes.
    """
    records.select("record").write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", level).option("maxRecordsPerFile", files_of).text(path)
    return path


def write_pages(pages: DataFrame, path: str, date: str) -> list[tuple[str, int]]:
    """Write (page_id, url, html) as archives below path, a folder for each class of SIZES that occurs: [(folder, records a file)].

    Sizes bound what a file holds, without a shuffle: each folder is a pass over the pages of its class.
    """
    html, length = F.coalesce("html", F.lit("")), F.octet_length(F.coalesce("html", F.lit("")))
    least, below = [], 0
    for _, limit, _ in SIZES:
        inside = (length >= below) & (F.lit(True) if limit is None else length < limit)
        least.append(inside)
        below = limit
    counts = pages.agg(*[F.count(F.when(x, 1)) for x in least]).first()
    record = record_text(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")), F.col("page_id"), F.col("url"), html, date)
    return [(write_archive(pages.where(x).select(record.alias("record")), f"{path}/{name}", n), n) for (name, _, n), x, count in zip(SIZES, least, counts, strict=True) if count]


# ---- reading -------------------------------------------------------------


def unpacked(raw: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file, of one member or many, in pieces of at most `step` bytes."""
    while len(raw):
        stream = zlib.decompressobj(31)
        rest: bytes | memoryview = raw
        while not stream.eof:
            piece = stream.decompress(rest[:step], step)
            used = len(stream.unconsumed_tail) + len(stream.unused_data)
            rest = rest[min(len(rest), step) - used :]
            if piece:
                yield piece
            elif not len(rest) and not stream.eof:
                raise ValueError("a gzip file ends within a member")
        raw = rest


def split_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, walking by Content-Length: blocks may hold anything. Holds one record and two pieces."""
    held, at, source = bytearray(), 0, iter(pieces)

    def more() -> bool:
        nonlocal at
        piece = next(source, None)
        if piece is None:
            return False
        if at:
            del held[:at]
            at = 0
        held.extend(piece)
        return True

    while True:
        while (head := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if len(held) > at:
                    raise ValueError("an archive ends within a header")
                return
        lines = held[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        at, length = head + 4, int(fields["Content-Length"])
        while len(held) - at < length + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        yield fields, bytes(held[at : at + length])
        at += length + 4


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_of(fields: dict[str, str]) -> str | None:
    return bytes.fromhex(fields["X-Target-URI-Hex"]).decode() if "X-Target-URI-Hex" in fields else fields.get("WARC-Target-URI")


def number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_archive(spark: SparkSession, paths: str | list[str], payloads: bool = True) -> DataFrame:
    """Rows of RECORD from the archives in folders, a file at a time, unpacked record by record.

    Digest and length come from the block itself; a revisit has an empty block, and gives those of
    the payload it stands for from its header.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                held = 0
                for k, (fields, block) in enumerate(split_records(unpacked(memoryview(content.as_buffer())))):
                    revisit = fields["WARC-Type"] == "revisit"
                    length, digest = (int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")) if revisit else (len(block), digest_of(block))
                    payload = block if payloads and not revisit else None
                    rows.append((path, k, number(fields.get("X-Page-ID")), fields["WARC-Record-ID"], url_of(fields), fields["WARC-Type"], number(fields.get("X-Refers-To-Page")), payload, length, digest))
                    held += len(payload or b"")
                    if held > 8 << 20 or len(rows) >= 4000:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return archive_files(spark, paths).mapInArrow(parse, RECORD)


def archive_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))  # a file or a few small ones
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(paths).select("path", "content")


# ---- revisits ------------------------------------------------------------


def resolve_revisits(headers: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """Header rows (page_id, record_id, payload_bytes, payload_digest, ..) with record_type, refers_to and refers_id.

    Headers alone are shuffled, by digest: of equal payloads of at least
    min_payload_bytes the largest page_id is the response, the others revisit
    it. The largest ids come from a partial aggregate, and both sides of the
    join are scans, so that Spark splits a hot digest's rows at run time.
    Records with a null page_id stay responses, and so do all that repeat the
    largest page_id.
    """
    known = headers.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_payload_bytes))
    firsts = known.groupBy("payload_digest").agg(F.max(F.struct("page_id", "record_id")).alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "original")
    firsts = materialize(firsts, "warc-originals")
    out = headers.drop("record_type", "refers_to").join(firsts.hint("merge"), "payload_digest", "left")
    again = (F.col("payload_bytes") >= min_payload_bytes) & (F.col("original.page_id") > F.col("page_id"))
    return out.select(
        *[c for c in headers.columns if c not in ("record_type", "refers_to", "refers_id")],
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("original.page_id")).alias("refers_to"), F.when(again, F.col("original.record_id")).alias("refers_id"),
    )


def fresh_id(old: str) -> str:
    """A new record id that the old one decides, so that a revisit can name its response's before that is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'deduplicated:' + old)}>"


def deduplicate_archive(spark: SparkSession, folders: list[tuple[str, int]], target: str, date: str, min_payload_bytes: int = 0) -> list[tuple[str, int]]:
    """Read the archives in folders, resolve revisits, write archives with fresh headers below target: [(folder, records a file)].

    Only headers and compressed files are shuffled. What a file's revisits refer
    to joins the file by its name (a file has a bounded number of records), and
    each file is written anew record by record: a response keeps its payload, a
    revisit loses it and names the new record that has it. Records are told
    apart by file and place, so equal records with equal ids are each written.
    """
    headers = materialize(read_archive(spark, [f for f, _ in folders], payloads=False).drop("payload", "url"), "warc-headers")
    again = resolve_revisits(headers, min_payload_bytes).where("record_type = 'revisit'")
    again = materialize(again.groupBy(F.col("path").alias("at")).agg(F.collect_list(F.struct("ordinal", "refers_to", "refers_id", "payload_bytes", "payload_digest")).alias("revisits")), "warc-revisits")
    discard(headers)

    def anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], names=["record"])

        for batch in batches:
            for content, revisits in zip(batch.column("content"), batch.column("revisits").to_pylist(), strict=True):
                refers = {x["ordinal"]: x for x in revisits or ()}
                rows: list[bytes] = []
                held = 0
                for k, (fields, block) in enumerate(split_records(unpacked(memoryview(content.as_buffer())))):
                    to, keep = refers.get(k), {n: fields.get(n) for n in ("WARC-Target-URI", "X-Target-URI-Hex", "X-Page-ID", "Content-Type")}
                    head = {"WARC-Type": "revisit" if to else "response", "WARC-Record-ID": fresh_id(fields["WARC-Record-ID"]), "WARC-Date": date, **keep}
                    if to:
                        head |= {"WARC-Payload-Digest": f"sha1:{to['payload_digest']}", "X-Payload-Length": to["payload_bytes"], "WARC-Profile": PROFILE, "WARC-Refers-To": fresh_id(to["refers_id"]), "X-Refers-To-Page": to["refers_to"]}
                        block = b""
                    else:
                        head["WARC-Payload-Digest"] = f"sha1:{digest_of(block)}"
                    lines = ["WARC/1.1", *(f"{n}: {v}" for n, v in head.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
                    rows.append("\r\n".join(lines).encode() + block)
                    held += len(rows[-1])
                    if held > 8 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    out = []
    for folder, n in folders:
        files = archive_files(spark, folder).join(again, F.col("path") == F.col("at"), "left").select("content", "revisits")
        out.append((write_archive(files.mapInArrow(anew, "record string"), f"{target}/{folder.rsplit('/', 1)[1]}", n), n))
    discard(again)
    return out


def archive_pages(spark: SparkSession, pages: DataFrame, min_payload_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages to archives, to deduplicated archives, read back: rows of RECORD without payload.

    Null html is an empty payload, null url and null page_id leave their fields out, repeated rows
    are a record each, a payload may be of any length; other columns of pages are not read. An
    empty table gives no rows. `date` is that of the records' headers.
    """
    base = scratch_path(spark, "warc")
    folders = write_pages(pages.select("page_id", "url", "html"), f"{base}/first", date)
    if not folders:
        return spark.createDataFrame([], RECORD).drop("payload")
    folders = deduplicate_archive(spark, folders, f"{base}/deduplicated", date, min_payload_bytes)
    return read_archive(spark, [f for f, _ in folders], payloads=False).drop("payload")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_pages(spark, table(spark, sf_dir, "pages"), date=datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as hex from p),
b as (select *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(hex, (i // 8) * 10 + 1, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31)::int + 1, 1)), 'string_agg', '') as payload_digest from h),
r as (select *, max(page_id) over (partition by payload_digest) as original from b)
select page_id, payload_bytes, payload_digest, case when original > page_id then 'revisit' else 'response' end as record_type,
  case when original > page_id then original end as refers_to from r
"""
