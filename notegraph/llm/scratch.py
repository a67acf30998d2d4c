"""Shared scratch tables: how iterative operators cut lineage.

Every intermediate is a Parquet table in the folder that the cluster names
in ``spark.checkpoint.dir``, so it outlives any executor.  Only where the
setting is absent and the master is local is a local folder created.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Where it is unset, a session whose tasks run in this process gets a local
    one; on a cluster other executors couldn't see that.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-notegraph-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class Scratch:
    """Names and removes the scratch tables of one operator run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/notegraph-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a reader of the written table."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                if self.root in name:
                    self._delete(name)

    def clear(self) -> None:
        """Delete every table of this run."""
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a file below the shared folder, for tasks.

    A path without a scheme is local; folders of a local file are made.
    """
    store, path = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", uri).replace("s3a://", "s3://", 1), safe=":/"))
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store, path
