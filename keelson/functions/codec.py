"""The record format as column expressions.

A record is, little-endian: key (16 bytes), version (8), flags (4), payload length (4), payload,
CRC-32 of all that (4). Keys here are non-negative bigints.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.schemas import RECORD_HEADER, RECORD_OVERHEAD


def little_endian(value: Column, size: int) -> Column:
    """The lowest `size` bytes (up to 16) of a non-negative integer."""
    full = F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))
    # reverse() works on strings and arrays; bytes are turned two hexadecimal digits at a time
    turned = F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.substring(F.hex(full), 2 * k + 1, F.lit(2)))), "")
    return F.unhex(turned)


def from_little_endian(data: Column) -> Column:
    """A bigint of up to 8 little-endian bytes; null from 2**63 on."""
    digits = F.hex(data)
    turned = F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.length(data) - 1), lambda k: F.substring(digits, 2 * k + 1, F.lit(2)))), "")
    return F.conv(turned, 16, 10).try_cast("bigint")


def header(key: Column, version: Column, flags: Column, payload_len: Column) -> Column:
    return F.concat(little_endian(key, 16), little_endian(version, 8), little_endian(flags, 4), little_endian(payload_len, 4))


def checksum(key: Column, version: Column, flags: Column, payload: Column) -> Column:
    return F.crc32(F.concat(header(key, version, flags, F.length(payload)), payload))


def encode(key: Column, version: Column, flags: Column, payload: Column) -> Column:
    """A record as bytes."""
    body = F.concat(header(key, version, flags, F.length(payload)), payload)
    return F.concat(body, little_endian(F.crc32(body), 4))


def decode(data: Column) -> Column:
    """A record at the start of bytes: struct(key, version, flags, payload_len, payload, checksum, size, status).

    status is 'ok', 'short_header', 'short_body' or 'checksum'; other fields are null unless the
    header is there.
    """
    whole = F.length(data) >= RECORD_OVERHEAD
    part = lambda at, size: F.substring(data, at + 1, size)
    length = F.when(whole, from_little_endian(part(28, 4)))
    full = F.length(data) >= length + RECORD_OVERHEAD
    body = F.substring(data, F.lit(1), (length + RECORD_HEADER).cast("int"))
    stored = from_little_endian(F.substring(data, (length + RECORD_HEADER + 1).cast("int"), F.lit(4)))
    status = F.when(~whole, "short_header").when(~full, "short_body").when(F.crc32(body) != stored, "checksum").otherwise("ok")
    return F.struct(
        F.when(whole, from_little_endian(part(0, 8))).alias("key"),
        F.when(whole, from_little_endian(part(16, 8))).alias("version"),
        F.when(whole, from_little_endian(part(24, 4)).cast("int")).alias("flags"),
        length.cast("int").alias("payload_len"),
        F.when(whole & full, F.substring(data, F.lit(RECORD_HEADER + 1), length.cast("int"))).alias("payload"),
        F.when(whole & full, stored).alias("checksum"),
        (length + RECORD_OVERHEAD).cast("bigint").alias("size"),
        status.alias("status"),
    )


def rewrite_status(payload: Column, payload_len: Column, stored: Column, computed: Column) -> Column:
    """Whether a record may be rewritten: 'ok', 'length' or 'checksum' (a stored checksum of 0 is not checked)."""
    return F.when(F.length(payload) != payload_len, "length").when((stored != 0) & (stored != computed), "checksum").otherwise("ok")
