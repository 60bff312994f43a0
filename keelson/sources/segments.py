"""Binary segment files: a 64-byte header, packed records, and a footer of their offsets.

Files are read through Spark's binaryFile source and parsed in Arrow batches, a file per row, so a store
may live wherever Spark can read. A file that doesn't end in a valid footer is scanned up to its first
bad record; nothing behind it is used.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.errors import ChecksumMismatch, CorruptFooter, CorruptRecord, InvalidSegmentHeader
from keelson.functions import codec
from keelson.functions.scalars import segment_file_name, segment_id_of
from keelson.schemas import RECORD_OVERHEAD, RECORD_HEADER, SEGMENT_HEADER

_HEAD = struct.Struct("<QQQII")  # key (low and high 8 bytes), version, flags, payload length
#: A footer is looked for in this tail of a file; a longer one is ignored and the records are scanned.
TAIL = 256 * 1024
MOST_KEY = (1 << 63) - 1


@dataclass(frozen=True)
class SegmentFormat:
    """What marks a segment file and its footer (8 bytes each). Set both to open files of another writer."""

    magic: bytes = b"KEELSEG1"
    footer_magic: bytes = b"KEELFTR1"
    version: int = 1


def encode_record(key: int, version: int, flags: int, payload: bytes) -> bytes:
    body = _HEAD.pack(key & ((1 << 64) - 1), key >> 64, version, flags, len(payload)) + payload
    return body + struct.pack("<I", zlib.crc32(body))


def decode_record(data: bytes, at: int = 0, base: int = 0) -> tuple[int, int, int, bytes, int]:
    """(key, version, flags, payload, checksum) of the record at a place in data."""
    if len(data) - at < RECORD_OVERHEAD:
        raise CorruptRecord(base + at, "short header")
    low, high, version, flags, length = _HEAD.unpack_from(data, at)
    if len(data) - at < RECORD_OVERHEAD + length:
        raise CorruptRecord(base + at, "short body")
    body = data[at : at + RECORD_HEADER + length]
    stored = struct.unpack_from("<I", data, at + len(body))[0]
    if stored != zlib.crc32(body):
        raise ChecksumMismatch(base + at, zlib.crc32(body), stored)
    return low | high << 64, version, flags, body[RECORD_HEADER:], stored


def segment_name(segment_id: int) -> str:
    return f"{segment_id:020d}.seg"


def encode_header(segment_id: int, fmt: SegmentFormat = SegmentFormat()) -> bytes:
    return (fmt.magic + struct.pack("<IQ", fmt.version, segment_id)).ljust(SEGMENT_HEADER, b"\0")


def decode_header(data: bytes, fmt: SegmentFormat = SegmentFormat()) -> tuple[int, int] | None:
    """(format version, segment id), or None if the file isn't a segment."""
    return struct.unpack_from("<IQ", data, 8) if data[:8] == fmt.magic and len(data) >= SEGMENT_HEADER else None


def encode_footer(offsets: list[int], fmt: SegmentFormat = SegmentFormat()) -> bytes:
    body = fmt.footer_magic + struct.pack(f"<Q{len(offsets)}Q", len(offsets), *offsets)
    return body + struct.pack("<I", zlib.crc32(body))


def decode_footer(data: bytes, fmt: SegmentFormat = SegmentFormat()) -> list[int] | None:
    if len(data) < 20 or data[:8] != fmt.footer_magic:
        return None
    count = struct.unpack_from("<Q", data, 8)[0]
    if len(data) != 20 + 8 * count or struct.unpack_from("<I", data, len(data) - 4)[0] != zlib.crc32(data[:-4]):
        return None
    return list(struct.unpack_from(f"<{count}Q", data, 16))


def find_footer(data: bytes, fmt: SegmentFormat = SegmentFormat()) -> tuple[list[int], int] | None:
    """(offsets, where the footer starts) from the end of a file, the shortest valid footer first."""
    at = len(data)
    while (at := data.rfind(fmt.footer_magic, max(0, len(data) - TAIL), at)) >= 0:
        if (offsets := decode_footer(data[at:], fmt)) is not None:
            return offsets, at
    return None


def scan(data: bytes, start: int = SEGMENT_HEADER) -> tuple[list[int], int]:
    """Offsets of records from `start` up to the first bad one, and where the last good one ends."""
    offsets = []
    while start < len(data):
        try:
            payload = decode_record(data, start)[3]
        except (CorruptRecord, ChecksumMismatch):
            break
        offsets.append(start)
        start += RECORD_OVERHEAD + len(payload)
    return offsets, start


def recover(data: bytes, fmt: SegmentFormat = SegmentFormat()) -> tuple[list[int], int, bool]:
    """(offsets, end of the records, healed): by the footer if it fits the records, else by a scan."""
    if len(data) < SEGMENT_HEADER:
        raise CorruptFooter("a segment shorter than its header")
    if found := find_footer(data, fmt):
        if found[1] < SEGMENT_HEADER:
            raise CorruptFooter("a footer inside the header")
        offsets, end = scan(data[: found[1]])
        if (offsets, end) == found:
            return offsets, end, False
    if decode_header(data, fmt) is None:
        raise InvalidSegmentHeader("no segment header")
    return *scan(data), True


def heal(path: str, fmt: SegmentFormat = SegmentFormat()) -> list[int]:
    """Recover a local file, cutting what is behind its last good record and writing a footer; its offsets."""
    with open(path, "rb") as f:
        data = f.read()
    offsets, end, healed = recover(data, fmt)
    if healed:
        with open(path, "r+b") as f:
            f.truncate(end)
            f.seek(end)
            f.write(encode_footer(offsets, fmt))
            f.flush()
            os.fsync(f.fileno())
    return offsets


RECORD_SCHEMA = "path string, segment_id bigint, file_bytes bigint, healed boolean, error string, key bigint, version bigint, flags int, payload binary, checksum bigint, offset bigint, size bigint"


def segment_images(log: DataFrame, fmt: SegmentFormat = SegmentFormat()) -> DataFrame:
    """path, length and content of the sealed segment file of each segment of a packed log, by built-in functions. A segment is bounded by its rotation."""
    value = lambda x, size: F.hex(codec.little_endian(x, size))
    record = F.hex(codec.encode(F.col("key"), F.col("version"), F.col("flags"), F.col("payload")))
    own = log.select("segment_id", F.struct("offset", record.alias("digits")).alias("r")).groupBy("segment_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    header = F.rpad(F.concat(F.lit(fmt.magic.hex().upper()), value(F.lit(fmt.version), 4), value(F.col("segment_id"), 8)), 2 * SEGMENT_HEADER, "0")
    offsets = F.array_join(F.transform("rs", lambda x: value(x["offset"], 8)), "")
    footer = F.concat(F.lit(fmt.footer_magic.hex().upper()), value(F.size("rs"), 8), offsets)
    whole = F.concat(header, F.array_join(F.transform("rs", lambda x: x["digits"]), ""), footer, value(F.crc32(F.unhex(footer)), 4))
    made = own.select(segment_file_name("segment_id").alias("path"), F.unhex(whole).alias("content"))
    return made.select("path", F.length("content").cast("bigint").alias("length"), "content")


def read_segments(spark: SparkSession, folder: str, fmt: SegmentFormat = SegmentFormat(), pattern: str = "*.seg") -> DataFrame:
    """parse_segments() of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")
    return parse_segments(files, fmt)


def parse_segments(files: DataFrame, fmt: SegmentFormat = SegmentFormat()) -> DataFrame:
    """Every recoverable record of every segment file (path, length, content), with path, segment_id, offset and size.

    A file that can't be used gives one row with its error and no record; an empty segment gives one row
    without either. Keys beyond 63 bits are errors of their file.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows, error, healed = [], None, False
                try:
                    offsets, _, healed = recover(data, fmt)
                    for at in offsets:
                        key, version, flags, payload, crc = decode_record(data, at)
                        if key > MOST_KEY or version > MOST_KEY:
                            raise CorruptRecord(at, "a key or version beyond 63 bits")
                        rows.append((key, version, flags, payload, crc, at, RECORD_OVERHEAD + len(payload)))
                except (CorruptFooter, InvalidSegmentHeader, CorruptRecord) as e:
                    rows, error = [], type(e).__name__
                rows = rows or [(None,) * 7]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array([path] * len(rows)), pa.array([size] * len(rows), pa.int64()), pa.array([healed] * len(rows)), pa.array([error] * len(rows), pa.string())]
                columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "file_bytes", "healed", "error", "key", "version", "flags", "payload", "checksum", "offset", "size"])

    parsed = files.select("path", "length", "content").mapInArrow(parse, RECORD_SCHEMA.replace("segment_id bigint, ", ""))
    return parsed.withColumn("segment_id", segment_id_of("path")).select(*[x.split()[0] for x in RECORD_SCHEMA.split(", ")])


def records_of(read: DataFrame) -> DataFrame:
    """The log rows of read_segments()."""
    return read.where("key IS NOT NULL").select("key", "version", "flags", "payload", "segment_id", "offset", "size")


def write_segments(log: DataFrame, folder: str, fmt: SegmentFormat = SegmentFormat()) -> DataFrame:
    """Write log rows as sealed segment files to a folder that executors share, one file a segment; returns path, records, bytes.

    Records go in the order of their offsets and must be packed from the header on.
    """

    def write(frame):
        import pandas as pd

        segment = int(frame["segment_id"].iloc[0])
        data, offsets = [encode_header(segment, fmt)], []
        at = SEGMENT_HEADER
        for r in frame.sort_values("offset").itertuples():
            if r.offset != at:
                raise CorruptRecord(int(r.offset), f"expected at {at}")
            data.append(encode_record(int(r.key), int(r.version), int(r.flags), bytes(r.payload)))
            offsets.append(at)
            at += len(data[-1])
        data.append(encode_footer(offsets, fmt))
        path = os.path.join(folder, segment_name(segment))
        with open(f"{path}.tmp", "wb") as f:
            f.write(b"".join(data))
        os.replace(f"{path}.tmp", path)
        return pd.DataFrame([(path, len(offsets), sum(map(len, data)))], columns=["path", "records", "bytes"])

    return log.select("key", "version", "flags", "payload", "segment_id", "offset").groupBy("segment_id").applyInPandas(write, "path string, records bigint, bytes bigint")


def replay_summary(read: DataFrame) -> DataFrame:
    """segments, records verified, healed and unusable files of read_segments()."""
    files = read.groupBy("path").agg(F.max(F.col("healed").cast("int")).alias("healed"), F.max("error").alias("error"), F.count("key").alias("records"))
    return files.agg(F.count(F.lit(1)).alias("segments_replayed"), F.coalesce(F.sum("records"), F.lit(0)).alias("checksum_records_verified"), F.coalesce(F.sum("healed"), F.lit(0)).alias("segments_healed"), F.count("error").alias("segments_unusable"))
