"""What the operators share: written intermediate tables, Arrow helpers, ranks within hot groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson import session

#: Rows of one Arrow batch; a batch of long documents then stays at some tens of MB.
ARROW_ROWS = 1024


def _small_batches(spark: SparkSession) -> None:
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < rows <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


class Scratch(session.Scratch):
    """Written tables of an operator, whose Arrow batches are held small."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        _small_batches(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def parts(spark: SparkSession) -> int:
    """Into how many salts a hot key is dealt: the session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""
    _small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (made := each(batch)) is not None:
                yield made

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def ranked(df: DataFrame, group: list[str], order: list[str], salts: int, rank: str = "rank", together: list[str] | None = None) -> DataFrame:
    """Number the rows of each group from 0 in a fixed order, without bringing a group into one task.

    Rows are dealt into salts by their content (or by `together`, which keeps its equal rows next to each
    other and should be the first of the order); a row's number is its place in its salt plus the rows of earlier salts. Only the counts by group and salt are summed over whole groups. df must be
    stable (a written table), for it is read twice. Equal rows get different numbers.
    """
    from pyspark.sql import Window

    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in together or order]), F.lit(salts)))
    counts = dealt.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*group, "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_salt").orderBy(*order)
    return (
        dealt.join(before, [*group, "_salt"])
        .withColumn(rank, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_salt", "_before")
    )
