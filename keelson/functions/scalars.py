"""Scalar expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.schemas import BLOCK, RECORD_OVERHEAD, TOMBSTONE


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def low(a: Column | str, b: Column | str) -> Column:
    """The lesser end of an undirected pair."""
    return F.least(_col(a), _col(b))


def high(a: Column | str, b: Column | str) -> Column:
    return F.greatest(_col(a), _col(b))


def record_size(payload_len: Column | str) -> Column:
    """Bytes of a record on disk."""
    return (_col(payload_len) + RECORD_OVERHEAD).cast("bigint")


def is_tombstone(flags: Column | str = "flags") -> Column:
    return _col(flags).bitwiseAND(F.lit(TOMBSTONE)) != 0


def signed_gain(before: Column | str, after: Column | str) -> Column:
    """Part of `before` that was saved; 0 where there was nothing."""
    before, after = _col(before), _col(after)
    return F.when(before > 0, (before - after) / before).otherwise(F.lit(0.0))


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """A quotient that is 0 where the bottom is."""
    top, bottom = _col(top), _col(bottom)
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def segment_file_name(segment_id: Column | str) -> Column:
    return F.concat(F.lpad(_col(segment_id).cast("string"), 20, "0"), F.lit(".seg"))


def segment_id_of(path: Column | str) -> Column:
    """Segment id of a file name or path; null where it is none."""
    digits = F.regexp_extract(_col(path), r"(?:^|/)([0-9]+)\.seg$", 1)
    return F.nullif(digits, F.lit("")).cast("bigint")


def block_index(offset: Column | str, block: int = BLOCK) -> Column:
    return F.floor(_col(offset) / block).cast("bigint")


def block_within(offset: Column | str, block: int = BLOCK) -> Column:
    return _col(offset) % block


def blocks_touched(offset: Column | str, size: Column | str, block: int = BLOCK) -> Column:
    """Blocks that a span of bytes reaches into; 0 for an empty one."""
    offset, size = _col(offset), _col(size)
    spanned = F.floor((offset + size - 1) / block) - F.floor(offset / block) + 1
    return F.when(size == 0, F.lit(0)).otherwise(spanned).cast("bigint")


def block_checksums(content: Column | str, offset: Column | str, size: Column | str, block: int = BLOCK) -> Column:
    """CRC-32 of each whole block (clipped at the end of the content) that a span touches: array of (block, crc)."""
    content, offset, size = _col(content), _col(offset), _col(size)
    first = F.floor(offset / block).cast("int")
    last = F.floor((offset + size - 1) / block).cast("int")
    one = lambda k: F.struct(k.alias("block"), F.crc32(F.substring(content, k * block + 1, F.lit(block))).alias("crc"))
    return F.when(size > 0, F.transform(F.sequence(first, last), one)).otherwise(F.array().cast("array<struct<block:int,crc:bigint>>"))


def load_payload(key: Column | str, length: int = 24) -> Column:
    """Payload of a loaded key: its low byte, repeated."""
    return F.unhex(F.repeat(F.lpad(F.hex(_col(key).bitwiseAND(F.lit(255))), 2, "0"), length))


def csv_field(value: Column | str) -> Column:
    """A CSV field, quoted where it needs to be."""
    value = _col(value)
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\\n\\r]'), quoted).otherwise(value)


def duration_text(ns: Column | str) -> Column:
    """Nanoseconds as text with a fitting unit."""
    ns = _col(ns).cast("double")
    return (
        F.when(ns >= 1e9, F.format_string("%.3f s", ns / 1e9))
        .when(ns >= 1e6, F.format_string("%.3f ms", ns / 1e6))
        .when(ns >= 1e3, F.format_string("%.1f µs", ns / 1e3))
        .otherwise(F.format_string("%.0f ns", ns))
    )


def parse_unsigned(text: Column | str) -> Column:
    """A decimal or 0x-prefixed number up to 2**64 - 1 as decimal(20,0); null where it is none."""
    text = _col(text)
    digits = F.when(text.rlike("^0[xX][0-9A-Fa-f]{1,16}$"), F.conv(F.substring(text, 3, 16), 16, 10))
    return digits.otherwise(F.when(text.rlike("^\\+?[0-9]{1,19}$"), text)).try_cast("decimal(20,0)")
