"""Legacy archive converter: ARC records of either version become WARC records with revisits, in archives that are read back."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import cut, slices, table, utf8

#: Payload bytes from which on equal ones are revisits.
REVISIT_BYTES = 1000
#: Payload bytes of one archive, unless a single record has more.
ARCHIVE_BYTES = 4 << 20
#: Repeated digests that are broadcast at most (about 200 bytes each); more are joined by a shuffle.
REPEATED = 50_000
#: Bytes of an archive that are decompressed at once.
CHUNK = 1 << 16
#: The fields of a record's header line by version of the archive.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # that of URLs in RFC 4122
UNSAFE = re.compile(r"[^\x21-\x7e]")


@dataclass
class Arc:
    """One record of an ARC archive: the fields of its header line by name, and its block."""

    version: int
    fields: dict[str, str]
    block: bytes


def safe_url(url: str | None) -> str:
    """The URL without blanks, controls and non-ASCII signs, which are percent-encoded; ``about:blank`` if there is none."""
    return UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url) if url else "about:blank"


def write_arc(version: int, name: str, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC archive of (url, date, content type, block) records, each with its declared length in the header line."""
    columns = "URL IP-address Archive-date Content-type " + ("Archive-length" if version == 1 else "Result-code Checksum Location Offset Filename Archive-length")
    about = f"{version} 0 archive\n{columns}\n\n".encode()
    out, at = [], 0
    for url, date, kind, block in [(f"filedesc://{name}", "19960101000000", "text/plain", about), *records]:
        middle = "" if version == 1 else f"200 - - {at} {name} "
        line = f"{url} 0.0.0.0 {date} {kind} {middle}{len(block)}\n".encode()
        out += [line, block, b"\n"]
        at += len(line) + len(block) + 1
    return b"".join(out)


def read_arc(archive: bytes) -> Iterator[Arc]:
    """The records after the version block, which says how many fields a header line has.

    Raises ValueError for an unknown version, a line with other fields, or a block that ends before its declared length.
    """
    end = archive.find(b"\n")
    first = archive[:end].decode("ascii", "replace").split(" ")
    if end < 0 or not first[0].startswith("filedesc://") or not first[-1].isdigit():
        raise ValueError("no version block")
    about = archive[end + 1 : end + 1 + int(first[-1])]
    version = int(about.split(b" ", 1)[0]) if about[:1].isdigit() else 0
    if version not in FIELDS or len(first) != len(FIELDS[version]):
        raise ValueError(f"version {version} isn't known")
    at = end + 1 + int(first[-1])
    while at < len(archive):
        if archive[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = archive.find(b"\n", at)
        fields = archive[at:end].decode("ascii", "replace").split(" ") if end >= 0 else []
        if len(fields) != len(FIELDS[version]) or not fields[-1].isdigit():
            raise ValueError(f"a header line doesn't have the {len(FIELDS[version])} fields of version {version}")
        named = dict(zip(FIELDS[version], fields, strict=True))
        at = end + 1 + int(named["length"])
        if at > len(archive):
            raise ValueError("a block is shorter than declared")
        yield Arc(version, named, archive[end + 1 : at])


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, payload) of an HTTP response; all is payload if it has no head."""
    at = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (b"", block)


def http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def timestamp(date: str) -> str:
    """The 14 digits of an ARC date as ISO 8601; shorter ones are filled up with the earliest time, and none is 1970."""
    digits = (re.sub(r"\D", "", date) + "19700101000000"[min(14, len(re.sub(r"\D", "", date))) :])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, payload: str) -> str:
    """The same for the same record, whenever it's converted."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{date} {url} {payload}')}>"


def to_warc(arc: Arc, refers_to: tuple[str, str, str] | None = None) -> bytes:
    """A WARC/1.0 record: an HTTP response, a resource without a head, or, with what it refers to (page, url, date), a revisit without payload."""
    head, payload = split_http(arc.block)
    date, digest = timestamp(arc.fields["date"]), sha1(payload)
    kind = "revisit" if refers_to else "response" if head else "resource"
    block = head if refers_to else arc.block
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(arc.fields["url"], date, f"{kind} {digest} {http_fields(head).get('x-page-id', '')}")), ("WARC-Date", date), ("WARC-Target-URI", arc.fields["url"]), ("WARC-IP-Address", arc.fields["ip"]), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1(block))]
    if refers_to:
        page, url, day = refers_to
        # The response's record has the same payload, so its identifier follows from its page, URL and date.
        known = record_id(url, timestamp(day), f"response {digest} {page}")
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", known), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", timestamp(day)), ("X-Refers-To-Page", page)]
    fields += [("Content-Type", "application/http; msgtype=response" if head else arc.fields["type"]), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def members(archive: bytes) -> Iterator[bytes]:
    """What each gzip member of an archive holds; every byte is handed to the decompressor once, but for the last CHUNK of a member."""
    view, at = memoryview(archive), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            parts.append(member.decompress(view[at : at + CHUNK]))
            at += min(CHUNK, len(view) - at)
        at -= len(member.unused_data)
        yield b"".join(parts)


def read_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive that holds a gzip member for each."""
    for record in members(archive):
        end = record.find(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in record[:end].decode().split("\r\n")[1:])}
        block = record[end + 4 : end + 4 + int(fields["content-length"])]
        if not record.startswith(b"WARC/") or len(block) != int(fields["content-length"]):
            raise ValueError("a record is shorter than declared")
        yield fields, block


def warcinfo(name: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: strandloom\r\nformat: WARC File Format 1.0\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"), ("WARC-Date", "1996-01-01T00:00:00Z"), ("WARC-Filename", name), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def fetched(page: int | None) -> str:
    """The ARC date of a page: pages have none of their own, so it counts seconds by its key."""
    return (datetime(1996, 1, 1, tzinfo=UTC) + timedelta(seconds=abs(page or 0) % 10**9)).strftime("%Y%m%d%H%M%S")


def archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, records, warc): archives of a gzip member for each page, converted from ARC records of it.

    Of pages with equal payloads of at least REVISIT_BYTES, that with the largest key is a response and the others
    revisit it. Null payloads are empty, null URLs ``about:blank``; pages without a key refer to the largest key of
    theirs, if there is one. Repeated rows make repeated records. The largest key is found by digest with a partial
    aggregation, so that a payload of many copies is no group in one task.
    """
    source = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).alias("_url"), utf8(html).alias("_payload"))
    long = F.length("_payload") >= REVISIT_BYTES
    keyed = source.select("*", F.when(long, F.sha1("_payload")).alias("_digest"))
    repeated = keyed.where("_digest is not null").groupBy("_digest").agg(F.max("_key").alias("_largest"), F.count("*").alias("_n"), F.max_by("_url", "_key").alias("_source")).where("_n > 1 and _largest is not null").drop("_n")
    repeated = cut(repeated)
    # A digest of each row's own where it has none, so that short payloads aren't one key; few repeated digests are broadcast.
    keyed = keyed.withColumn("_digest", F.coalesce("_digest", F.concat(F.lit("-"), F.xxhash64("_key", "_url").cast("string"))))
    rows = keyed.join(F.broadcast(repeated) if repeated.count() <= REPEATED else repeated, "_digest", "left").select("_key", "_url", "_payload", F.when(~F.col("_key").eqNullSafe(F.col("_largest")), F.col("_largest")).alias("_refers"), "_source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(slices(batches, "_payload", ARCHIVE_BYTES)):
            version, records, refers = 1 + n % 2, [], []
            for k, u, payload, r, s in zip(*(batch.column(c).to_pylist() for c in ("_key", "_url", "_payload", "_refers", "_source")), strict=True):
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + (f"X-Page-Id: {k}\r\n" if k is not None else "") + "\r\n"
                records.append((safe_url(u), fetched(k), "text/html", head.encode() + payload))
                refers.append((str(r), safe_url(s), fetched(r)) if r is not None else None)
            name = f"pages-{TaskContext.get().partitionId():06}-{n:05}"
            converted = [gzip_member(to_warc(arc, to)) for arc, to in zip(read_arc(write_arc(version, f"{name}.arc", records)), refers, strict=True)]
            about = gzip_member(warcinfo(f"{name}.warc.gz"))
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([len(converted)], pa.int64()), pa.array([b"".join([about, *converted])], pa.binary())], ["archive", "records", "warc"])

    return rows.mapInArrow(run, "archive string, records long, warc binary")


def read_back(stored: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, warc_date and target_uri of each record of the archives.

    What a response says about its payload is recomputed from it; a difference raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for warc in batch.column("warc").to_pylist():
                rows = []
                for fields, block in read_warc(warc):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    http = http_fields(head)
                    revisit = fields["warc-type"] == "revisit"
                    digest = fields["warc-payload-digest"]
                    if not revisit and sha1(payload) != digest:
                        raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
                    rows.append((int(http["x-page-id"]) if "x-page-id" in http else None, int(http["content-length"]) if revisit else len(payload), base64.b32decode(digest[5:]).hex(), fields["warc-type"], int(fields["x-refers-to-page"]) if revisit else None, fields["warc-record-id"], fields["warc-date"], fields["warc-target-uri"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "target_uri"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return stored.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string")


def save(stored: DataFrame, folder: str) -> None:
    """Writes each archive as the file that it names, a .warc.gz, into a folder of any store that Spark reaches; executors write them.

    A file is written under a name of the attempt's own and then renamed, so that a task that is run again leaves whole files.
    """
    if "://" in folder and not folder.startswith("file://"):
        # Python has no client for every store: an archive is a row of its own there.
        stored.select("archive", "warc").write.mode("overwrite").parquet(folder)
        return
    local = folder.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(local, exist_ok=True)
        for batch in batches:
            for name, warc in zip(batch.column("archive").to_pylist(), batch.column("warc").to_pylist(), strict=True):
                own = os.path.join(local, f".{name}.{TaskContext.get().taskAttemptId()}")
                with open(own, "wb") as f:
                    f.write(warc)
                os.replace(own, os.path.join(local, name))
            yield batch.select(["archive"])

    stored.select("archive", "warc").mapInArrow(run, "archive string").count()


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as its WARC record, written into archives and read back, has it.

    Null payloads are empty, null URLs ``about:blank``; repeated rows have a record each; no pages give no rows.
    """
    return read_back(cut(archives(table(spark, sf_dir, "pages")))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date")
