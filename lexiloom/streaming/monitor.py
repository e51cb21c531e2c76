"""New checkpoint and result files as streams, scored in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def checkpoint_name(path: Column) -> Column:
    """Whether a file is a numbered checkpoint."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.rlike(r"^checkpoint_.*pt$") & ~name.isin("checkpoint_best.pt", "checkpoint_last.pt")


def result_name(path: Column) -> Column:
    return path.rlike(r"txt$")


def pair_folder(path: Column) -> Column:
    return path.rlike(r"^[a-z]{2}(_|2)[a-z]{2}$")


def encoded_name(testset: Column) -> Column:
    return F.replace(testset, F.lit("/"), F.lit("__"))


def decoded_name(name: Column) -> Column:
    return F.replace(name, F.lit("__"), F.lit("/"))


def new_files(spark: SparkSession, folder: str, pattern: str = "*", most: int = 1000) -> DataFrame:
    """(path, modificationTime, length) of files as they appear, at most ``most`` in a micro-batch; their content stays unread."""
    rows = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", most).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return rows.select("path", "modificationTime", "length")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Text lines as they appear: every Column function of the library applies to them."""
    return spark.readStream.format("text").load(folder).withColumnRenamed("value", "line")


def for_each_new(files: DataFrame, wanted: Callable[[Column], Column], act: Callable[[list[str]], None], state: str, once: bool = True) -> StreamingQuery:
    """``act`` on the paths of each micro-batch, whose number ``new_files`` bounds; the checkpoint folder ``state`` keeps what is done."""

    def batch(rows: DataFrame, _: int) -> None:
        act([r.path for r in rows.where(wanted(F.col("path"))).select("path").collect()])

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_scores(rows: DataFrame, score: Callable[[DataFrame], DataFrame], log: str, state: str, once: bool = True) -> StreamingQuery:
    """Micro-batches scored and appended to a tab-separated log (time, checkpoint, test set, score)."""

    def batch(part: DataFrame, number: int) -> None:
        found = score(part)
        line = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "ckpt", "testset", F.col("score").cast("string"))
        # a batch that is run again replaces its own part
        found.select(line.alias("value")).write.mode("overwrite").text(f"{log}/batch={number}")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()
