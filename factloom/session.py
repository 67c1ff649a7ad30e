"""Session helpers: where iterative jobs cut their lineage."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame

_OWNED: set[str] = set()


def ensure_checkpoint_dir(spark) -> None:
    """Point the session at the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``; where that is unset it lies beside the tables of the session, in
    ``spark.sql.warehouse.dir``, which executors reach as well. Each application has a folder of its own
    below it and removes it when it ends.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        context.setCheckpointDir(folder)
    own = context.getCheckpointDir()
    if own not in _OWNED:
        _OWNED.add(own)
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        atexit.register(_remove, path.getFileSystem(context._jsc.hadoopConfiguration()), path)


def _remove(files, path) -> None:
    try:
        files.delete(path, True)
    except Py4JError:  # the JVM may be gone by now; the folder then stays
        pass


def exists(spark, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever store it names."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def cut_lineage(*frames: DataFrame) -> DataFrame:
    """Write the frames into one new table under the checkpoint folder and read it.

    Later rounds start from files, which survive the loss of executors, are
    computed once, and bring the sizes the optimizer needs to choose joins.
    """
    spark = frames[0].sparkSession
    path = scratch_path(spark, "round")
    for frame in frames:
        frame.write.mode("append").parquet(path)
    return spark.read.schema(frames[0].schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: both sides are shuffled and sorted, this one is never broadcast.

    Names and numbers that repeat take so little room in files that the optimizer, which goes by the size of files, would send tens of
    millions of rows through the driver to every executor.
    """
    return df.hint("merge")


class Rounds:
    """The growing result of an iterative job: each round adds a part, read as one table."""

    def __init__(self, spark):
        self.spark, self.paths, self.schema = spark, [], None

    def add(self, part: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "round")
        part.write.parquet(path)
        self.paths.append(path)
        self.schema = self.schema or part.schema
        return self.spark.read.schema(self.schema).parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def scratch_path(spark, name: str) -> str:
    """A folder of its own under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
