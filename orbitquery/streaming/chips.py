"""Chips that keep arriving in a folder.

The stream's checkpoint remembers which files were seen, so a restart goes on where
it stopped; each micro-batch is matched as a batch job and its results appended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names

LISTING = "path string, modificationTime timestamp, length long, content binary"


def incoming_chips(spark: SparkSession, folder: str, extensions: Sequence[str] = (".png",), files_per_batch: int = 1000) -> DataFrame:
    """path, name, orgname, part, res of new files."""
    files = spark.readStream.format("binaryFile").schema(LISTING).option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(names.has_extension(F.col("path"), extensions)).select(
        "path", name.alias("name"), names.original_name(name).alias("orgname"), names.part(name).alias("part"), names.resolution(name).alias("res")
    )


def match_stream(chips: DataFrame, match: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True, key: str = "orgname") -> StreamingQuery:
    """Match each micro-batch's chips, leave out those solved in earlier batches, append the results.

    A chip is solved if `output` has a row with its `key`.  A batch that is run again after a
    failure overwrites its own folder and does not count as an earlier one, so no row doubles.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        left = batch
        if number and _exists(spark, output):
            solved = spark.read.option("basePath", output).parquet(output).where(F.col("batch") < number)
            left = batch.join(solved.select(key).distinct(), key, "left_anti").select(*batch.columns)
        match(left).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = chips.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by window and kind, late ones let in up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
