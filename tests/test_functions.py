import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import codec, scalars
from keelson.functions import statistics as stats
from keelson.functions.prng import Stream, derive_seed, draws, zipf_cdf
from keelson.sources.segments import encode_record


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def test_two_kinds_of_percentiles(spark):
    df = values(spark, [10, 20, 30, 40])
    assert tuple(df.agg(stats.nearest_rank("x", 0.5), stats.nearest_rank("x", 0.95), stats.median("x")).first()) == (30.0, 40.0, 25.0)
    assert values(spark, [1, 2, 3, 4]).agg(stats.median("x")).first()[0] == 2.5
    assert values(spark, range(1, 10)).agg(stats.iqr("x")).first()[0] == 4.0
    assert values(spark, [1, math.nan, 3]).agg(stats.median("x")).first()[0] == 2.0
    assert tuple(values(spark, []).agg(stats.median("x"), stats.nearest_rank("x", 0.5), stats.least("x"), stats.greatest("x")).first()) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(values(spark, [math.nan, 2, 5]).agg(stats.least("x"), stats.greatest("x")).first()) == (2.0, 5.0)
    assert values(spark, [math.inf, 1]).agg(stats.greatest("x")).first()[0] == 0.0
    assert tuple(values(spark, [900, 500, 700, 300, 1100]).agg(stats.median("x"), stats.iqr("x")).first()) == (700.0, 400.0)


@pytest.mark.parametrize(
    "gains, signs, flips",
    [([0.2, -0.3, 0.0, 0.005, -0.4, 0.6], (2, 2, 2), 2), ([0.5, 0.4, 0.0, -0.5, -0.2], (3 - 1, 2, 1), 0), ([0.5, -0.5, 0.5, -0.5], (2, 2, 0), 3), ([], (0, 0, 0), 0)],
)
def test_signs_and_flips(spark, gains, signs, flips):
    df = spark.createDataFrame([("s", k, g) for k, g in enumerate(gains)], "scenario string, run_id int, gain double")
    assert tuple(df.agg(stats.positive_runs("gain"), stats.negative_runs("gain"), stats.zeroish_runs("gain")).first()) == signs
    assert (df.withColumn("f", stats.flips("gain", ["scenario"], "run_id")).agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]) == flips


def test_splitmix():
    assert [f"{x:016X}" for x in draws(0, 1, 3).tolist()] == ["E220A8397B1DCDAF", "6E789E6AA1B965F4", "06C45D188009454F"]
    assert [derive_seed(0xBEEFC0DE, k) for k in range(3)] == [0xBEEFC0DE, 0x9E3779BA3E3A3CF3, 0x3C6EF373BD84B908]
    s, t = Stream(7, block=4), draws(7, 1, 20).tolist()
    assert [s.bits() for _ in range(5)] == t[:5]
    assert s.below(1) == 0 and s.below(0) == 0
    assert s.below(1000) == ((t[5] << 64) | t[6]) % 1000
    assert s.unit() == t[7] / 2**64


def test_zipf():
    cdf = zipf_cdf(100, 1.2)
    assert np.all(np.diff(cdf) > 0) and abs(cdf[-1] - 1) < 1e-12


def test_records_as_columns(spark):
    rows = [(42, 9, 1, bytearray(b"hello")), (0, 0, 0, bytearray(b"")), ((1 << 62) + 5, 1 << 40, 0, bytearray(range(256)))]
    df = spark.createDataFrame(rows, "key bigint, version bigint, flags int, payload binary")
    made = df.select("key", codec.encode(F.col("key"), F.col("version"), F.col("flags"), F.col("payload")).alias("data"))
    found = {r["key"]: bytes(r["data"]) for r in made.collect()}
    assert found == {k: encode_record(k, v, f, bytes(p)) for k, v, f, p in rows}
    back = made.select(codec.decode(F.col("data")).alias("d")).select("d.*").collect()
    assert {(r["key"], r["version"], r["flags"], bytes(r["payload"]), r["status"]) for r in back} == {(k, v, f, bytes(p), "ok") for k, v, f, p in rows}
    hello = next(r for r in back if r["key"] == 42)
    assert (hello["checksum"], hello["size"]) == (998573222, 41)


def test_bad_records(spark):
    good = encode_record(1, 1, 0, b"xyz")
    rows = [(0, good), (1, good[:-1] + bytes([good[-1] ^ 255])), (2, good[:-2]), (3, good[:20]), (4, good + b"tail")]
    df = spark.createDataFrame([(k, bytearray(d)) for k, d in rows], "k int, data binary")
    assert [r[1] for r in df.select("k", codec.decode(F.col("data"))["status"]).orderBy("k").collect()] == ["ok", "checksum", "short_body", "short_header", "ok"]
    checks = spark.createDataFrame([(bytearray(b"ab"), 2, 0, 7), (bytearray(b"ab"), 3, 0, 7), (bytearray(b"ab"), 2, 8, 7), (bytearray(b"ab"), 2, 7, 7)], "p binary, n int, s bigint, c bigint")
    assert [r[0] for r in checks.select(codec.rewrite_status(F.col("p"), F.col("n"), F.col("s"), F.col("c"))).collect()] == ["ok", "length", "checksum", "ok"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.segment_file_name(F.lit(7))) == "00000000000000000007.seg"
    assert one(scalars.segment_id_of(F.lit("/a/b/00000000000000000012.seg"))) == 12 and one(scalars.segment_id_of(F.lit("x.tmp"))) is None
    assert one(scalars.blocks_touched(F.lit(65535), F.lit(2))) == 2 and one(scalars.blocks_touched(F.lit(5), F.lit(0))) == 0
    assert one(scalars.signed_gain(F.lit(4.0), F.lit(3.0))) == 0.25 and one(scalars.signed_gain(F.lit(0.0), F.lit(3.0))) == 0.0
    assert bytes(one(scalars.load_payload(F.lit(258)))) == b"\x02" * 24
    assert one(scalars.csv_field(F.lit('a"b'))) == '"a""b"' and one(scalars.csv_field(F.lit("ab"))) == "ab"
    assert str(one(scalars.parse_unsigned(F.lit("0xBEEFC0DE")))) == "3203383518" and one(scalars.parse_unsigned(F.lit("x"))) is None
    assert str(one(scalars.parse_unsigned(F.lit("0xFFFFFFFFFFFFFFFF")))) == "18446744073709551615"
    assert one(scalars.duration_text(F.lit(1500))) == "1.5 µs"
    assert one(scalars.is_tombstone(F.lit(3))) is True


def test_checksums_of_whole_blocks(spark):
    import zlib

    data = bytes(range(256)) * 3
    df = spark.createDataFrame([(bytearray(data), 250, 20)], "c binary, o bigint, n bigint")
    found = df.select(scalars.block_checksums("c", "o", "n", 256)).first()[0]
    assert [(r["block"], r["crc"]) for r in found] == [(0, zlib.crc32(data[:256])), (1, zlib.crc32(data[256:512]))]


def test_nearest_ranks_of_groups_of_any_size(spark):
    rows = [("a", float(k % 5)) for k in range(101)] + [("b", None), ("c", 7.0), ("c", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    plain = df.groupBy("g").agg(stats.nearest_rank("x", 0.5).alias("p50"), stats.nearest_rank("x", 0.95).alias("p95"))
    found = stats.nearest_ranks(df, ["g"], "x", {"p50": 0.5, "p95": 0.95})
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in plain.collect()} and found.columns == plain.columns
    assert stats.nearest_ranks(df.where("false"), ["g"], "x", {"p50": 0.5}).count() == 0
