"""The inventory of a folder that still grows: the same parser over a stream of its files, and totals that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plyworks.functions.lines import as_bytes
from plyworks.operators.parse import parse
from plyworks.variants import Variant


def stream_lines(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """(file, line) of the folder's files as they come."""
    source = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_a_batch)
    return source.text(folder).select(F.col("_metadata.file_path").alias("file"), as_bytes(F.col("value")).alias("line"))


def counters(lines: DataFrame, v: Variant) -> DataFrame:
    """(file, lines, malformed, tbskip, nogameid) so far. Sums alone, so the state is a row for each file."""
    parsed = parse(lines, v)
    ok = F.col("accepted")
    return parsed.groupBy("file").agg(F.count_if(ok).alias("lines"), F.count_if(~ok).alias("malformed"), F.count_if("tb_skip").alias("tbskip"), F.count_if(ok & F.col("gid").isNull()).alias("nogameid"))


def follow(spark: SparkSession, folder: str, v: Variant, table: str, checkpoint: str) -> StreamingQuery:
    """Counts what has come since the last call, in memory under the table's name, and stops; the checkpoint knows what was counted."""
    out = counters(stream_lines(spark, folder), v).writeStream.outputMode("complete").format("memory").queryName(table)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
