"""Web archives in which each payload is stored once.

Headers, without payloads, are grouped by digest; every record whose payload an earlier
one has becomes a revisit that refers to it. A WARC record is text with a fixed end, so
Spark's own text source writes and reads archives, in any file system it knows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, let, shared_dir, size_checked, stored

#: What ends a header block and a record, the profile of a revisit, base 32.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Payloads of fewer bytes are stored again each time.
LEAST_BYTES = 0


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base 32: each five hexadecimal digits are four characters."""

    def joined(digest: Column) -> Column:
        parts = [let(F.conv(F.substring(digest, F.lit(i * 5 + 1), F.lit(5)), 16, 10).cast("int"), _characters) for i in range(8)]
        return F.concat(*parts)

    return let(F.sha1(payload), joined)


def _characters(bits: Column) -> Column:
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])


def headers(pages: DataFrame, *, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, exact) of each page; ``exact`` tells payloads apart where SHA-1 does not."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    binary = F.col("payload").cast("binary")
    return rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(binary).alias("payload_digest"), F.unhex(F.sha2(binary, 256)).alias("exact"))


def originals(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(exact, refers_to, refers_url) of payloads that several records have: the record with the smallest id.

    Only headers are shuffled, and each task gives a digest once, so a payload that a third
    of all pages have is no hot key.
    """
    met = heads.filter(F.col("payload_bytes") >= least_bytes).groupBy("exact")
    met = met.agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
    return met.filter("n > 1 and first is not null").select("exact", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))


def resolved(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``heads`` with ``record_type`` and, for revisits, ``refers_to`` and ``refers_url``."""
    known = stored(originals(heads.select("page_id", "url", "payload_bytes", "exact"), least_bytes), "warc-originals")
    joined = heads.join(size_checked(known, 72, ["refers_url"]), "exact", "left")
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    kept = {c: F.when(again, F.col(c)) for c in ("refers_to", "refers_url")}
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumns(kept)


def _name(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def _address(url: Column) -> Column:
    """A url as a header's value: nothing in it can end the line."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "")


def write_archives(records: DataFrame, path: str, *, at: datetime | None = None) -> None:
    """Write resolved records as gzipped WARC 1.1 files in the folder ``path``, one for each task.

    A response's block has its HTTP header and its payload, a revisit's the header alone.
    Nothing is shuffled, and a task holds one record at a time.
    """
    date = (at or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    again = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("payload_bytes"))
    refers = F.concat(
        F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "),
        _name(F.col("refers_to"), F.col("payload_digest")),
        F.lit("\r\nWARC-Refers-To-Target-URI: "),
        _address(F.col("refers_url")),
    )
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "),
        _name(F.col("page_id"), F.col("payload_digest")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        _address(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(again, refers).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit(END),
    ]
    body = F.when(again, "").otherwise(F.col("payload").cast("string"))
    records.select(F.concat(*head, http, body).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, from the pieces between the ends of blocks, in order.

    Gzipped files are not split, so a task meets all pieces of a file one after the other.
    A block may hold any number of ends itself; its length tells where it is over. Only
    the pieces of one record are held.
    """
    end, file, head, pieces, have = END.encode(), None, None, [], 0
    for batch in batches:
        for at, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if at != file:
                if head is not None:
                    raise ValueError(f"{file} ends within a record")
                file = at
            if head is None:
                if piece.strip():
                    head, pieces, have = _fields(piece), [], 0
                continue
            pieces.append(piece)
            have += len(piece) + (4 if len(pieces) > 1 else 0)
            need = int(head["content-length"])
            if have >= need:
                whole = end.join(pieces)
                yield head, whole[:need]
                # A block that ends in half of an end takes the record's own for its second half: the next header is in this piece.
                rest = whole[need:].removeprefix(end)
                head, pieces, have = (_fields(rest), [], 0) if rest.strip() else (None, [], 0)
    if head is not None:
        raise ValueError(f"{file} ends within a record")


def _fields(piece: bytes) -> dict[str, str]:
    version, *lines = piece.decode("utf-8").strip().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").split(":")[0]
    return int(number) if number else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of the records under ``path``.

    A response's bytes and digest are those of the payload itself, and an archive whose
    header has another digest raises an error; a revisit's are those of its header.
    """
    pieces = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for head, block in _blocks(batches):
            http, _, body = block.partition(END.encode())
            kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
            size = len(body)
            if kind == "response":
                found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                if found != digest:
                    raise ValueError(f"{head['warc-record-id']} has the payload of another digest, {found}")
            else:
                size = int(next(line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
            refers = _page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
            rows.append((_page_of(head["warc-record-id"]), head["warc-target-uri"], kind, size, digest, refers, body if payloads and kind == "response" else None))
            held += len(body)
            if held > 1 << 20 or len(rows) > 5000:
                yield batch_of(rows)
                rows, held = [], 0
        yield batch_of(rows)

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return arrow_map(pieces, parse, schema)


def deduplicated(pages: DataFrame, path: str | None = None, *, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` as archives in which each payload of at least ``least_bytes`` stands once, and read them back.

    Of equal payloads the page with the smallest id is the response, all others revisit
    it; null and empty payloads are equal to each other. Rows that agree in id and payload
    are one page to this rule: where their id is the smallest, each is a response. A null
    id is larger than any other, and where a payload has no other id, all are responses.
    Urls may be null and of any form; what could end a header's line is taken out of the
    header. Other columns are not read. Tables may be empty. ``path`` is a new folder; by
    default it is in the shared one. Ids are whole numbers.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/threadloom-warc-{uuid.uuid4().hex}"
    write_archives(resolved(headers(pages, id=id, url=url, payload=payload), least_bytes), path)
    return read_archives(spark, path)


def rewritten(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archives under ``source`` again under ``target``, with fresh headers, each payload once; reads the new ones.

    A revisit that is there already has no payload: it is joined by digest and length to
    the response that now has it, and keeps its old reference where there is none.
    """
    old = read_archives(spark, source)
    again = old.filter("record_type = 'revisit'").drop("payload", "record_type")
    full = headers(old.filter("record_type = 'response'"), payload="payload")
    known = resolved(full, least_bytes)
    by_digest = full.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct("page_id", "url")).alias("first"))
    by_digest = stored(by_digest.join(again.select("payload_digest", "payload_bytes").distinct(), ["payload_digest", "payload_bytes"], "left_semi").select("payload_digest", "payload_bytes", "first.*"), "warc-responses")
    by_digest = by_digest.select("payload_digest", "payload_bytes", F.col("page_id").alias("now"), F.col("url").alias("refers_url"))
    met = again.join(size_checked(by_digest, 72, ["refers_url"]), ["payload_digest", "payload_bytes"], "left")
    met = met.withColumn("refers_to", F.coalesce("now", "refers_to")).withColumn("record_type", F.lit("revisit")).drop("now")
    write_archives(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [known.drop("exact"), met]), target)
    return read_archives(spark, target)


def archives_digest(pages: DataFrame) -> DataFrame:
    """The contract's columns for the registered query."""
    path = f"{shared_dir(pages.sparkSession)}/threadloom-warc-{uuid.uuid4().hex}"
    write_archives(resolved(headers(pages)), path)
    return read_archives(pages.sparkSession, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
