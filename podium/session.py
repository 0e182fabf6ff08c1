"""Session settings and the one way this library cuts lineage: a Parquet table in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_folder: str | None = None


def build_session(app: str = "podium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with. On a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables: what the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where one machine is the whole cluster, may fall back to a temporary folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="podium-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Later plans then start from files: nothing upstream runs again for a second reader or after an executor is
    lost, values that depend on task placement are pinned, and the size the planner sees is the real one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a written table through Hadoop's file system, so that it works wherever the folder lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Stages:
    """Owner of written intermediate tables.

    ``write`` stages a table under a fresh name and returns it reread; ``drop`` removes those that later steps no
    longer read. What a returned plan still reads stays; the cluster's lifetime rule for ``spark.checkpoint.dir`` ends it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self._paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", set()

    def path(self, name: str) -> str:
        """A folder of this owner, for files that are not tables."""
        self._paths.add(name)
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names or tuple(self._paths):
            if name in self._paths:
                self._paths.discard(name)
                drop_folder(self.spark, f"{self.root}/{name}")
