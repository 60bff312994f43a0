"""Sessions and intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("keelson").config(map=settings)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); local sessions get a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="keelson-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and have a known size."""

    _roots: list[str] = []

    def __init__(self, spark: SparkSession, name: str = "tables"):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        Scratch._roots.append(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back."""
        self._made += 1
        path = f"{self.root}/{self._made}-{name}"
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        written._keelson_path = path
        return written

    def drop(self, *written: DataFrame) -> None:
        """Delete tables that no result reads any more."""
        for df in written:
            _delete(self.spark, df._keelson_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete every table that was written to the shared folder so far. Results that still read them break."""
    while Scratch._roots:
        _delete(spark, Scratch._roots.pop())


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table."""
    return Scratch(df.sparkSession, name).save(df, name)


def numbered(df: DataFrame, order: list, name: str = "seq", weight: str | None = None) -> DataFrame:
    """Adds the rank from 0 of each row in a total order, without sorting all rows in one task.

    Rows are range-partitioned and written; a row's rank is its place in its part plus the rows of
    earlier parts. `order` should be total (ties get an arbitrary order) and name columns. With `weight`, a
    row counts as often as that column says.
    """
    spark = df.sparkSession
    dealt = saved(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()), name)
    counts = dealt.groupBy("_part").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_held"))
    # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    place = F.row_number().over(inside) - 1 if weight is None else F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + place).drop("_part", "_start")
