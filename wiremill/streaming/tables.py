"""Tables of a stream: hash buckets of a key, of which a batch writes only those that it touches.

``root/<table>/batch=<n>/bucket=<b>`` holds a bucket as batch n left it. A
batch reads buckets as of the batches before it, writes whole new versions of
those that it changes, and last of all a snapshot: the version of every bucket
of every table. What has no snapshot was not committed, so a batch that stops
between two tables changes nothing for readers, and run again it reads and
writes the same. What a batch writes follows what it touches, not the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the file system that Spark finds it in; none without the folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def last_batch(spark: SparkSession, root: str) -> int:
    """The number of the last committed batch; -1 without one."""
    made = [n for n in names_in(spark, f"{root}/_snapshots") if n.startswith("batch=")]
    return max((int(n.split("=")[1]) for n in made if "_SUCCESS" in names_in(spark, f"{root}/_snapshots/{n}")), default=-1)


class Tables:
    """The tables under ``root`` before batch ``number``; ``schemas`` by name."""

    def __init__(self, spark: SparkSession, root: str, number: int, schemas: dict[str, str], buckets: int = 64) -> None:
        self.spark, self.root, self.number, self.buckets = spark, root, number, buckets
        self.schemas = {n: StructType.fromDDL(s) for n, s in schemas.items()}
        self.touched: dict[str, dict[int, int | None]] = {}
        self.versions: dict[tuple[str, int], int] = {}
        if number:
            rows = spark.read.schema("name string, bucket int, version int").parquet(f"{root}/_snapshots/batch={number - 1}").collect()  # tables x buckets
            self.versions = {(r["name"], r["bucket"]): r["version"] for r in rows}

    def bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets of the only column of ``keys``, at most as many as there are."""
        return [r["b"] for r in keys.select(self.bucket(keys.columns[0]).alias("b")).distinct().collect()]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        wanted = range(self.buckets) if buckets is None else buckets
        paths = [f"{self.root}/{name}/batch={self.versions[name, b]}/bucket={b}" for b in wanted if (name, b) in self.versions]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def write(self, name: str, rows: DataFrame, key: str | Column, buckets: list[int]) -> DataFrame:
        """Write the whole new contents of ``buckets``; the rows as written."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name]]
        path = f"{self.root}/{name}/batch={self.number}"
        dealt = rows.withColumn("bucket", self.bucket(key)).select(*columns, "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
        filled = {int(n.split("=")[1]) for n in names_in(self.spark, path) if n.startswith("bucket=")}
        self.touched[name] = {b: self.number if b in filled else None for b in buckets}
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    def append(self, name: str, rows: DataFrame) -> None:
        """Write the rows that this batch adds to a log."""
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name]]).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={self.number}")

    def log(self, name: str) -> DataFrame:
        """All rows appended by committed batches and this one, with their ``batch``."""
        schema = StructType([*self.schemas[name].fields]).add("batch", IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("batch") <= self.number)

    def commit(self) -> None:
        """Make what this batch wrote what readers see."""
        self.versions |= {(n, b): v for n, found in self.touched.items() for b, v in found.items()}
        rows = [(n, b, v) for (n, b), v in sorted(self.versions.items()) if v is not None]
        made = self.spark.createDataFrame(rows, "name string, bucket int, version int").coalesce(1)
        made.write.mode("overwrite").parquet(f"{self.root}/_snapshots/batch={self.number}")

