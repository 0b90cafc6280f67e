"""Reading self-play lines in the order of files and lines, from any number of splits at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyworks.functions.lines import as_bytes
from plyworks.sources.discovery import File, files_table, unit_of
from plyworks.variants import Variant

#: Lines of this many bytes and more are errors.
TOO_LONG = 1 << 20
#: Files whose table is broadcast to the scan; more are joined by a shuffle of names.
BROADCAST_FILES = 100_000


def _plain(uri):
    """URIs differ in how many slashes follow the scheme of a local file."""
    return F.regexp_replace(uri, "^file:/+", "file:/")


def read_lines(spark: SparkSession, files: list[File], v: Variant, group_key: str = "rel") -> DataFrame:
    """(file_idx, ord, line, qual_hash): ord is a single number that grows along files and lines.

    It has the unit in which the line's split starts, counted over all files, and the line's place in its task. Splits of one
    file that share a task come in order, so nothing has to be counted beforehand.
    """
    table = files_table(spark, files, v, group_key)
    table = table.select("file_idx", _plain(F.col("uri")).alias("__uri"), "qual_hash", "first_unit")
    raw = spark.read.option("lineSep", "\n").text(sorted({f.readable for f in files}))
    raw = raw.select("value", _plain(F.col("_metadata.file_path")).alias("__uri"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__row"))
    rows = raw.join(F.broadcast(table) if len(files) <= BROADCAST_FILES else table, "__uri")
    order = F.shiftleft(F.col("first_unit") + F.floor(F.col("__start") / unit_of(spark)), 33) + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select("file_idx", order.alias("ord"), as_bytes(F.col("value")).alias("line"), "qual_hash")


def without_long(rows: DataFrame) -> DataFrame:
    """rows, failing at a line that is too long."""
    return rows.withColumn("line", F.when(F.length("line") < TOO_LONG, F.col("line")).otherwise(F.raise_error(F.lit("a line is too long"))))


def first_long(rows: DataFrame) -> DataFrame:
    """(file_idx, long_ord): where a file has its first line that is too long; only such files."""
    return rows.where(F.length("line") >= TOO_LONG).groupBy("file_idx").agg(F.min("ord").alias("long_ord"))


def until_long(rows: DataFrame) -> DataFrame:
    """rows up to each file's first line that is too long. It reads the files twice, so use it where first_long() found some."""
    return rows.join(F.broadcast(first_long(rows)), "file_idx", "left").where(F.col("long_ord").isNull() | (F.col("ord") < F.col("long_ord"))).drop("long_ord")
