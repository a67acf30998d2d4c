"""Tables written once in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where tasks run in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-notegraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Keeper:
    """Writes tables below one folder and returns readers of them, so that later plans are short."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}"

    def __call__(self, table: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:8]}"
        table.write.parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def bucketed(self, table: DataFrame, *by: str) -> DataFrame:
        """As many buckets by ``by`` as a shuffle has partitions, sorted; one file for each."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"kept_{uuid.uuid4().hex}"
        table.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", f"{self.root}/{name}").saveAsTable(name)
        return self.spark.table(name)


def state_of(spark: SparkSession, folder: str) -> int:
    """A number that changes when a file directly below ``folder`` does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return hash(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))
