"""Tables in the folder that driver and executors share, which cut lineage and survive the loss of executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext.getCheckpointDir()
        if not known:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            known = "file://" + tempfile.mkdtemp(prefix="panelforge-")
            spark.sparkContext.setCheckpointDir(known)
        where = known if known.rsplit("/", 1)[-1].startswith("panelforge-") else known.rsplit("/", 1)[0]
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below :func:`shared_dir` and read it back, which cuts its lineage.

    Unlike ``localCheckpoint`` the table survives the loss of executors.
    """
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Tables written to the shared folder, for one run of an operator; ``drop`` deletes those that are done with."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = table
        return table

    def folder(self, name: str) -> str:
        """A path of its own, to be written to; ``drop`` deletes it too."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths[path] = path
        return path

    def drop(self, *keep: DataFrame | str) -> None:
        """Delete all tables but those in ``keep``: what a result still reads when it runs."""
        for path in [p for p, t in self.paths.items() if not any(t is k for k in keep)]:
            del self.paths[path]
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
