"""Intermediate tables that outlive the executors that wrote them.

Iterative jobs cut their lineage by writing a parquet table below the folder named by
``spark.checkpoint.dir``. Losing an executor afterwards costs a re-read, not a recomputation
of every earlier iteration.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a temporary folder for a local session without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="lexivec-")
    return _LOCAL_ROOTS[app]


class Scratch:
    """Names, writes and drops the intermediate tables of one job.

    As a context manager it drops all of them at the end::

        with Scratch(spark, "rank") as scratch:
            global_rank(table, ["key"], scratch=scratch).write.parquet(path)
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/lexivec/{job}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop("")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a frame that reads it back with a cut lineage."""
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a superseded table that no live frame reads any more."""
        self.names.discard(name)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write the result of the job and drop every other table of it."""
        out = self.write(df, name)
        for other in self.names - {name}:
            self.drop(other)
        return out
