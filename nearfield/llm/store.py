"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.ship import ship
from nearfield.sources.snapshot import shared_folder

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Ships the package, and keeps Arrow batches of whole texts small where the session has Spark's default of 10,000 rows."""
    ship(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


#: A key with more than one in so many rows is joined by a broadcast; there are fewer than that of such keys.
HEAVY = 1000


def join_unique(rows: DataFrame, unique: DataFrame, on: list[str], times: str) -> DataFrame:
    """Inner join of ``rows`` with a table of one row a key, whose column ``times`` says how many of the rows have the key.

    Keys that more than one in ``HEAVY`` of the rows have are broadcast, and
    there are less than ``HEAVY`` of them whatever the size of the tables; so no
    key's rows all go to one task. ``times`` is dropped. Both are written tables.
    """
    total = unique.agg(F.sum(times)).first()[0] or 0
    heavy = F.col(times) * HEAVY > F.lit(total)
    few = F.broadcast(unique.where(heavy).drop(times))
    rest = rows.join(F.broadcast(unique.where(heavy).select(on)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(unique.where(~heavy).drop(times), on))


def join_salted(rows: DataFrame, table: DataFrame, on: str, scratch: Scratch, salts: int = 64) -> DataFrame:
    """Inner join on a column of which either side may have many rows a key.

    Keys that more than one in ``HEAVY`` of ``rows`` have, and there are less
    than ``HEAVY`` of those, are dealt over ``salts`` tasks each, with as many
    copies of their rows in ``table``.
    """
    counts = scratch.write(rows.groupBy(on).agg(F.count("*").alias("times")), "counts")
    total = counts.agg(F.sum("times")).first()[0] or 0
    heavy = F.broadcast(counts.where(F.col("times") * HEAVY > F.lit(total)).select(on))
    dealt = rows.join(heavy, on, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = table.join(heavy, on, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [on, "_salt"]).drop("_salt").unionByName(rows.join(heavy, on, "left_anti").join(table, on))


#: Copies of a row that one task makes at a time.
BLOCK = 256


def repeated(rows: DataFrame, times: str, number: str, dealt: bool = False) -> DataFrame:
    """Each row as often as its column ``times`` (1 or more) says, with ``number`` from 0.

    ``dealt``: blocks of ``BLOCK`` copies are dealt over all tasks before they
    are made, so that the copies of one row are not one task's work.
    """
    zero = F.lit(0).cast("long")
    if not dealt:
        return rows.withColumn(number, F.explode(F.sequence(zero, F.col(times).cast("long") - 1)))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.withColumn("_block", F.explode(F.sequence(zero, F.expr(f"({times} - 1) div {BLOCK}")))).repartition(tasks)
    begin = F.col("_block") * BLOCK
    return blocks.withColumn(number, F.explode(F.sequence(begin, F.least(begin + BLOCK, F.col(times).cast("long")) - 1))).drop("_block")


class Scratch:
    """Written tables of one operator call.

    A written table is reread, so that a lost executor costs the tasks that read
    it and not the whole plan before it. ``drop`` removes tables that the
    returned, still lazy, result no longer reads; the rest stay for the caller's
    action and go with the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        ready(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/nearfield-{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._nearfield_path = path
        return out

    def write_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Like ``write``, in buckets of ``key``, one a shuffle partition: joins of such tables on the key move nothing.

        ``df`` should come from an exchange by the key, so that each bucket is one file.
        """
        self.made += 1
        path, table = f"{self.root}/{self.made:03d}-{name}", f"nearfield_{name}_{uuid.uuid4().hex[:12]}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
        out = self.spark.table(table)
        out._nearfield_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(table._nearfield_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
