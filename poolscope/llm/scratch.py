"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import contextlib
import posixpath
import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, as a full URI. Where the setting is absent and all tasks run on this machine, as in tests, a temporary
    folder becomes it; on a cluster that is an error, since executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: Folders made since the innermost collect() of this thread or task began, if one is open.
_made: ContextVar[list[Scratch] | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def collect():
    """Within it, folders are noted, and deleted at its end: for callers that have written what they need of the results."""
    before = _made.set([])
    try:
        yield
    finally:
        own = _made.get()
        _made.reset(before)
        for scratch in own:
            scratch.drop("")


class Scratch:
    """A folder of tables for one run of an operator.

    A table that is written and read again cuts the lineage: a lost executor costs no more than the tasks that ran on it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = posixpath.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
        if _made.get() is not None:
            _made.get().append(self)

    def path(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the written table. The shuffle files of the writing job go when it is done."""
        path, conf = self.path(name), self.spark.conf
        before = conf.get(CLEANUP, "false")
        with contextlib.suppress(Exception):
            conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            with contextlib.suppress(Exception):
                conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def again(self, name: str, schema: str) -> DataFrame:
        """A table that keep() has written."""
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables and files that no later step reads; "" stands for the whole folder."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
