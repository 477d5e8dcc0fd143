"""Tables in the folder that driver and executors share: they cut lineage and settle what a plan would compute anew."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one the session was given.

    Only a local master, whose executors are the driver, gets a temporary one; on a
    cluster a machine's own folder would be invisible to the others, so that is an error.
    """
    base = spark.conf.get(SHARED_DIR, None)
    if not base:
        context = spark.sparkContext
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            base = given.get()
        elif context.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="orbitquery-")
            context.setCheckpointDir(base)
        else:
            raise ValueError(f"set {SHARED_DIR} to a folder that all machines share")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/orbitquery-{tag}-{uuid.uuid4().hex}"


_OPEN: list[list["Table"]] = []


class Table:
    """A DataFrame written to the shared folder: lineage is cut and a lost executor costs no rerun.

    Inside scratch() it goes at the end, unless it is to be kept.
    """

    def __init__(self, df: DataFrame, tag: str, keep: bool = False):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, tag)
        self.there = True
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _OPEN and not keep:
            _OPEN[-1].append(self)

    def drop(self) -> None:
        if self.there:
            remove(self.spark, self.path)
        self.there = False


@contextmanager
def scratch() -> Iterator[None]:
    """Tables made in here are dropped at the end: what is needed longer is kept, or written outside."""
    made: list[Table] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not made]
        for table in made:
            table.drop()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name
