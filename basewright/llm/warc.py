"""WARC archives written by Spark and read back by a salvaging reader.

Writing: one record per page as text rows; Spark's text writer ends each record
with the blank lines the format asks for, so archives land on any file system
that Spark knows, under its commit protocol. Equal payloads are stored once;
the other records are revisits.

Reading: a parser walks each archive. Every record must start with a version
line, have a sane header and length, end in CRLF CRLF and match its digest.
After a failed check it looks for the next version line or gzip member that
inflates, whichever comes first and whatever the file began with, goes on
there, and logs the skipped bytes as a quarantined gap.

Edge cases: null html is an empty payload; a null url leaves out the target
header; line breaks in a url are percent-encoded; null page ids are allowed,
have a record id made of their payload's digest, and never refer to others; rows that repeat the largest page id of a payload
are all responses; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import shared_dir, small, small_batches, stored, table

VERSION = b"WARC/1.1\r\n"
#: Any version line may open a record.
_START = re.compile(rb"WARC/[01]\.\d+\r\n")
_MEMBER = b"\x1f\x8b\x08"
#: Rows of one archive file, and bytes of payload in it: what a reading task holds (a binary file must stay below 2 GB).
FILE_RECORDS, FILE_BYTES = 5_000, 1 << 28
RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"
_DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the format for revisits of equal payloads.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, dedup_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of ``dedup_bytes`` or more the one with the largest page
    id is the response. Only digests are shuffled to find it, aggregated before
    the exchange. Payloads that occur once, mostly all, stay out of the join;
    its other side is broadcast if small, else a hot digest's join is split.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), base32_sha1(body.cast("binary")).alias("payload_digest"))
    first = rows.where(F.col("payload_bytes") >= dedup_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n"))
    heads = stored(first.where("_n > 1").drop("_n"), "warc-heads").withColumnRenamed("payload_digest", "_digest")
    later = (F.col("payload_digest") == F.col("_digest")) & F.coalesce(F.col("page_id") < F.col("refers_to"), F.col("page_id").isNull() & F.col("refers_to").isNotNull())
    return rows.join(small(heads), later, "left").drop("_digest").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record_text() -> Column:
    """The record of a planned row, without the CRLF CRLF that ends it."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit(VERSION.decode()),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.col("payload_digest"), F.lit(">")))),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}\r\n")).otherwise(F.lit("")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.coalesce(line("WARC-Refers-To", urn(F.col("refers_to"))), F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return F.when(revisit, head).otherwise(F.concat(head, F.col("html")))


def write_archives(planned: DataFrame, path: str, compression: str = "none") -> None:
    """Write planned records as archive files under ``path``, of so many records that the largest payloads fit."""
    largest = planned.agg(F.max("payload_bytes")).first()[0] or 0
    records = max(1, min(FILE_RECORDS, FILE_BYTES // (largest + 1)))
    planned.select(record_text().alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).option("compression", compression).text(path)


def pack_members(records: list[bytes]) -> bytes:
    """One gzip member per record, as compressed archives have it."""
    out = b""
    for record in records:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.compress(record) + z.flush()
    return out


def _one(data: bytes, at: int) -> tuple[dict, int] | None:
    """The valid record that starts at ``at`` and where it ends, or None."""
    m = _START.match(data, at)
    if not m:
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    head = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower()] = value.strip()
    try:
        size, full = int(head[b"content-length"]), int(head.get(b"warc-payload-length", head[b"content-length"]))
    except (KeyError, ValueError):
        return None
    start = end + 4
    stop = start + size
    if size < 0 or data[stop : stop + 4] != b"\r\n\r\n":
        return None
    payload, kind = data[start:stop], head.get(b"warc-type", b"").decode("ascii", "replace")
    digest = head.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
    if kind != "revisit" and (full != size or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
        return None
    page = lambda name: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", head.get(name, b""))) else None
    url = head[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in head else None
    return {"page_id": page(b"warc-record-id"), "record_type": kind, "refers_to": page(b"warc-refers-to"), "payload_bytes": full, "payload_digest": digest, "url": url, "payload": payload}, stop + 4


def _plain(data: bytes) -> Iterator[tuple[str, object]]:
    at, bad = 0, None
    while at < len(data):
        if found := _one(data, at):
            if bad is not None:
                yield "gap", (bad, at)
                bad = None
            yield "record", found[0]
            at = found[1]
        else:
            bad = at if bad is None else bad
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
    if bad is not None:
        yield "gap", (bad, len(data))


def _inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The gzip member that starts at ``at`` and where it ends, or None."""
    z, parts = zlib.decompressobj(31), []
    try:
        while not z.eof and at < len(data):
            parts.append(z.decompress(data[at : at + 65_536]))
            at = min(at + 65_536, len(data))
    except zlib.error:
        return None
    return (b"".join(parts), at - len(z.unused_data)) if z.eof else None


def salvage(data: bytes) -> Iterator[tuple[str, object]]:
    """("record", dict) and ("gap", (start, end)) for the bytes of one archive.

    Wherever a check fails, what comes next of a version line and a gzip member that inflates is tried.
    """
    at, bad, version, member = 0, None, -1, -1
    while at < len(data):
        found, stop = [], at
        if data.startswith(_MEMBER, at):
            if inflated := _inflate(data, at):
                found, stop = list(_plain(inflated[0])), inflated[1]
        elif one := _one(data, at):
            found, stop = [("record", one[0])], one[1]
        records = [x for x in found if x[0] == "record"]
        if records:
            if bad is not None:
                yield "gap", (bad, at)
                bad = None
            yield from records
            if len(records) < len(found):  # damage inside: the whole member is suspect
                yield "gap", (at, stop)
            at = stop
            continue
        bad = at if bad is None else bad
        if version <= at:
            m = _START.search(data, at + 1)
            version = m.start() if m else len(data)
        if member <= at:
            member = data.find(_MEMBER, at + 1)
            member = member if member >= 0 else len(data)
        at = min(version, member)
    if bad is not None:
        yield "gap", (bad, len(data))


LOG = f"{RECORDS}, path string, gap_start long, gap_end long"


def read_logged(spark: SparkSession, path: str) -> DataFrame:
    """All archive files under ``path`` in one read: a row per valid record, and one per gap, with null record_type.

    path, gap_start and gap_end say which bytes of a file no valid record covers; null for records.
    """
    names = [c.split()[0] for c in LOG.split(", ")]

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for kind, x in salvage(content):
                    if kind == "record":
                        rows.append(x)
                        held += len(x["payload"])
                    else:
                        rows.append({"path": name, "gap_start": x[0], "gap_end": x[1]})
                    if held > 8 << 20:
                        yield _frame(rows, names)
                        rows, held = [], 0
                yield _frame(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return small_batches(files).mapInPandas(parse, LOG)


def records_of(log: DataFrame) -> DataFrame:
    return log.where("gap_start is null").drop("path", "gap_start", "gap_end")


def gaps_of(log: DataFrame) -> DataFrame:
    return log.where("gap_start is not null").select("path", "gap_start", "gap_end")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The valid records of all archive files under ``path``."""
    return records_of(read_logged(spark, path))


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """path, gap_start, gap_end of the bytes that no valid record covers."""
    return gaps_of(read_logged(spark, path))


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to", "payload_bytes", "gap_start", "gap_end"):
        out[c] = out[c].astype("Int64")
    for c in ("record_type", "payload_digest", "url", "payload", "path"):
        out[c] = out[c].astype(object).where(out[c].notna(), None)
    return out


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/basewright/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(table(spark, sf_dir, "pages")), path)
    log = stored(read_logged(spark, path).drop("payload"), "warc-log")  # the gaps stay there beside the records
    return records_of(log).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
