"""Alignment records: BAM files by the public specification, SAM text, and the columns that operators need of them."""

from __future__ import annotations

import io
import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ord long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags array<string>"
ARROW = pa.schema([("ord", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int32()), ("tlen", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.list_(pa.string()))])
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SIZES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK, BATCH = 60_000, 5_000


def inflated(stream) -> Iterator[bytes]:
    """The contents of BGZF blocks; a cut-off file raises."""
    while head := stream.read(12):
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("no BGZF block")
        extra = stream.read(struct.unpack("<H", head[10:12])[0])
        size, at = None, 0
        while at + 4 <= len(extra):
            n = struct.unpack("<H", extra[at + 2 : at + 4])[0]
            if extra[at : at + 2] == b"BC":
                size = struct.unpack("<H", extra[at + 4 : at + 6])[0] + 1
            at += 4 + n
        rest = stream.read((size or 0) - 12 - len(extra))
        if size is None or len(rest) < size - 12 - len(extra):
            raise ValueError("a BGZF block is cut off")
        data = zlib.decompress(rest[:-8], -15)
        if zlib.crc32(data) != struct.unpack("<I", rest[-8:-4])[0]:
            raise ValueError("a BGZF block's checksum is wrong")
        yield data


def deflated(data: bytes) -> bytes:
    """BGZF blocks of data."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


class Bytes:
    """Exact reads over blocks."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held, self.at = blocks, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = next(self.blocks, None)
            if more is None:
                if self.at == len(self.held):
                    return b""
                raise ValueError("a record is cut off")
            self.held, self.at = self.held[self.at :] + more, 0
        self.at += n
        return self.held[self.at - n : self.at]


def read_header(data: Bytes) -> tuple[str, list]:
    """The text, and (name, length) of each reference."""
    if data.take(4) != b"BAM\1":
        raise ValueError("no BAM file")
    text = data.take(struct.unpack("<i", data.take(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", data.take(4))[0]):
        name = data.take(struct.unpack("<i", data.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", data.take(4))[0]))
    return text, refs


def decode_tags(data: bytes) -> list[str]:
    """Optional fields as SAM text."""
    out, at = [], 0
    while at < len(data):
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out.append(f"{key}:{kind}:{data[at:end].decode()}")
            at = end + 1
        elif kind == "A":
            out.append(f"{key}:A:{chr(data[at])}")
            at += 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack("<i", data[at + 1 : at + 5])[0]
            size = struct.calcsize(SIZES[sub])
            values = struct.unpack(f"<{n}{SIZES[sub]}", data[at + 5 : at + 5 + n * size])
            out.append(f"{key}:B:" + ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)]))
            at += 5 + n * size
        else:
            size = struct.calcsize(SIZES[kind])
            v = struct.unpack("<" + SIZES[kind], data[at : at + size])[0]
            out.append(f"{key}:f:{v:g}" if kind == "f" else f"{key}:i:{v}")
            at += size
    return out


def encode_tags(tags: list[str]) -> bytes:
    out = []
    for tag in tags:
        key, kind, value = tag.split(":", 2)
        head = key.encode()
        if kind == "i":
            v = int(value)
            out.append(head + (b"i" + struct.pack("<i", v) if -(2**31) <= v < 2**31 else b"I" + struct.pack("<I", v)))
        elif kind == "f":
            out.append(head + b"f" + struct.pack("<f", float(value)))
        elif kind == "A":
            out.append(head + b"A" + value.encode())
        elif kind == "B":
            sub, *values = value.split(",")
            out.append(head + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{SIZES[sub]}", len(values), *(float(v) if sub == "f" else int(v) for v in values)))
        else:
            out.append(head + kind.encode() + value.encode() + b"\0")
    return b"".join(out)


def decode(body: bytes, refs: list[str]) -> tuple:
    """A record's fields after ord; places are 0-based, -1 for none."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", body[:32])
    at = 32 + n_name
    name = body[32 : at - 1].decode()
    cigar = "".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack(f"<{n_cigar}I", body[at : at + 4 * n_cigar])) or "*"
    at += 4 * n_cigar
    packed = body[at : at + (n_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq] or "*"
    at += len(packed)
    qual = body[at : at + n_seq]
    text = "*" if not n_seq or qual[:1] == b"\xff" else bytes(q + 33 for q in qual).decode("latin-1")
    name_of = lambda i: refs[i] if i >= 0 else "*"
    return name, flag, name_of(ref), pos, mapq, cigar, name_of(mate), mate_pos, tlen, seq, text, decode_tags(body[at + n_seq :])


def bin_of(start: int, end: int) -> int:
    """The index bin of an interval, by the specification's five levels."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def encode(row: dict, refs: dict[str, int]) -> bytes:
    """A record's bytes with their length before them."""
    ops = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "*")]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    span = sum(n for n, o in ops if OPS[o] in "MDN=X") or 1
    codes = [max(0, BASES.find(c)) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(ord(c) - 33 for c in row["qual"])
    name = row["qname"].encode() + b"\0"
    pos = -1 if row["pos"] is None else row["pos"]
    mate = -1 if row["pnext"] is None else row["pnext"]
    number = lambda r: refs.get(r, -1)
    body = struct.pack("<iiBBHHHiiii", number(row["rname"]), pos, len(name), row["mapq"] or 0, bin_of(max(pos, 0), max(pos, 0) + span) if pos >= 0 else 4680, len(ops), row["flag"], len(seq), number(row["rnext"]), mate, row["tlen"] or 0)
    body += name + struct.pack(f"<{len(ops)}I", *(n << 4 | o for n, o in ops)) + packed + qual + encode_tags(row["tags"] or [])
    return struct.pack("<i", len(body)) + body


class BamReader(DataSourceReader):
    """One partition a file."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        missing = [p for p in self.paths if not os.path.exists(p)]
        if missing:
            raise FileNotFoundError(missing[0])
        return [InputPartition((k, p)) for k, p in enumerate(self.paths)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        k, path = partition.value
        with open(path, "rb") as f:
            yield from batches_of(inflated(f), k << 40)


class BamSource(DataSource):
    """``spark.read.format("bam")``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader([p.removeprefix("file://") for p in self.options["path"].split(",")])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").load(path)


def batches_of(blocks: Iterator[bytes], first: int) -> Iterator[pa.RecordBatch]:
    """The records of a file's blocks, numbered from ``first``."""
    data = Bytes(blocks)
    names = [n for n, _ in read_header(data)[1]]
    rows: list[tuple] = []
    n = first
    while size := data.take(4):
        rows.append((n, *decode(data.take(struct.unpack("<i", size)[0]), names)))
        n += 1
        if len(rows) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def read_bam_store(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from any store that Spark reads; a file comes to one task as a whole, so it's for files of up to 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in zip(batch.column("k").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from batches_of(inflated(io.BytesIO(content)), k << 30)

    files = spark.read.format("binaryFile").load(path).select(F.monotonically_increasing_id().alias("k"), "content")
    return files.mapInArrow(run, SCHEMA)


def bam_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    with open(path, "rb") as f:
        return read_header(Bytes(inflated(f)))


def index_of(path: str) -> str:
    """The path of a file's index, which must be there; plans here don't need it."""
    if not os.path.exists(found := f"{path}.bai"):
        raise FileNotFoundError(found)
    return found


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text as the same rows."""
    from strandloom.sources.tables import numbered_lines

    p = F.split("value", "\t")
    field = lambda i: F.get("p", F.lit(i))
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select("ord", p.alias("p"))
    mate = F.when(field(6) == "=", field(2)).otherwise(field(6))
    return rows.select("ord", field(0).alias("qname"), field(1).cast("int").alias("flag"), field(2).alias("rname"), (field(3).cast("int") - 1).alias("pos"), field(4).cast("int").alias("mapq"), field(5).alias("cigar"), mate.alias("rnext"), (field(7).cast("int") - 1).alias("pnext"), field(8).cast("int").alias("tlen"), field(9).alias("seq"), field(10).alias("qual"), F.slice("p", 12, F.greatest(F.size("p") - 11, F.lit(0))).alias("tags"))


def write_bam(records: DataFrame, path: str, header: tuple[str, list[tuple[str, int]]], order: list | None = None) -> None:
    """One BAM file in an order (coordinates if none is given). Executors compress; the driver appends one task's blocks after another."""
    text, refs = header
    index = {name: i for i, (name, _) in enumerate(refs)}
    rank = F.coalesce(F.create_map(*(F.lit(x) for n, i in index.items() for x in (n, i)))[F.col("rname")], F.lit(1 << 30)) if index else F.lit(0)
    ordered = records.orderBy(*(order or [rank, "pos", "ord"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([deflated(b"".join(encode(r, index) for r in batch.to_pylist()))], pa.binary())], ["blocks"])

    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs))
    for name, size in refs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    with open(path, "wb") as f:
        f.write(deflated(head))
        for row in ordered.mapInArrow(run, "blocks binary").toLocalIterator():
            f.write(row.blocks)
        f.write(EOF)


def tag(name: str, tags: str = "tags") -> Column:
    """The value of an optional field as text, null if it's absent."""
    found = F.get(F.filter(tags, lambda t: t.startswith(f"{name}:")), F.lit(0))
    return F.substr(found, F.lit(len(name) + 4))


def with_tag(name: str, kind: str, value: Column, tags: str = "tags") -> Column:
    """The optional fields with one replaced or added, or without it where the value is null."""
    others = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~t.startswith(f"{name}:"))
    return F.when(value.isNull(), others).otherwise(F.array_append(others, F.concat(F.lit(f"{name}:{kind}:"), value.cast("string"))))


def viewed(records: DataFrame, cb: str = "CB") -> DataFrame:
    """Records with mate, category, paired, unmapped, mate_unmapped, is_reverse, ref_start, ref_len, cb and as_tag."""
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    spans = F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return records.withColumns(
        {
            "mate": F.when(bit(0x80), 2).otherwise(1),
            "category": F.when(bit(0x100), "secondary").when(bit(0x800), "supplementary").otherwise("primary"),
            "paired": bit(0x1),
            "unmapped": bit(0x4),
            "mate_unmapped": bit(0x1) & bit(0x8),
            "is_reverse": bit(0x10),
            "ref_start": F.col("pos"),
            "ref_len": F.aggregate(spans, F.lit(0), lambda a, n: a + n.cast("int")),
            "cb": tag(cb),
            "as_tag": tag("AS").try_cast("double"),
        }
    )
