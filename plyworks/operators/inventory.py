"""The inventory: files, games, lines, unique positions, malformed lines and tablebase positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyworks.functions import lines as L

_COUNTS = ("lines", "malformed", "tbskip", "nogameid")


def _tallies() -> list:
    ok = F.col("accepted")
    return [
        F.count_if(ok).alias("lines"),
        F.count_if(~ok).alias("malformed"),
        F.count_if(F.col("tb_skip")).alias("tbskip"),
        F.count_if(ok & F.col("gid").isNull()).alias("nogameid"),
    ]


def _game() -> Column:
    return F.when(F.col("accepted"), F.col("gid"))


def _position() -> Column:
    return F.when(F.col("accepted") & ~F.col("tb_skip"), F.col("key"))


def games_by_file(parsed: DataFrame) -> DataFrame:
    """(file_idx, games): game ids are unique within a file only; lines of tablebase positions count."""
    return parsed.groupBy("file_idx").agg(F.count_distinct(_game()).alias("games")).where("games > 0")


def unique_by_file(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("file_idx").agg(F.count_distinct(_position()).alias("unique")).where("unique > 0")


def unique(parsed: DataFrame) -> int:
    """The number of positions over all files."""
    return parsed.agg(F.count_distinct(_position())).first()[0]


def per_file(parsed: DataFrame, files: DataFrame | None = None, unique: bool = True) -> DataFrame:
    """(file_idx, games, lines, unique, malformed, tbskip, nogameid); files without lines have zeros. Without `unique` keys aren't even parsed, and the column is null.

    Lines are parsed once. Spark tags each line's distinct values and reduces them by (file, tag, value) first, so that no
    file's values meet in one task.
    """
    distinct = [F.count_distinct(_position()).alias("unique")] if unique else []
    out = parsed.groupBy("file_idx").agg(*_tallies(), F.count_distinct(_game()).alias("games"), *distinct)
    if files is not None:
        out = files.select("file_idx").join(out, "file_idx", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counted = zero("unique") if unique else F.lit(None).cast("bigint").alias("unique")
    return out.select("file_idx", zero("games"), zero("lines"), counted, *(zero(c) for c in _COUNTS[1:]))


def total(parsed: DataFrame, unique: bool = True) -> DataFrame:
    """One row of the same counters and files and dedup; unique counts positions once over all files. Lines are parsed once."""
    distinct = [F.count_distinct(_position()).alias("unique")] if unique else []
    # Of the pairs of file and game those without a game don't count.
    out = parsed.agg(*_tallies(), F.count_distinct("file_idx").alias("files"), F.count_distinct(F.when(_game().isNotNull(), F.col("file_idx")), _game()).alias("games"), *distinct)
    if not unique:
        out = out.withColumn("unique", F.lit(None).cast("bigint"))
    return out.select("files", "games", "lines", "unique", *_COUNTS[1:], L.dedup_ratio(F.col("lines"), F.col("unique")).alias("dedup"))


def rollup_total(rows: DataFrame) -> DataFrame:
    """The TOTAL of rows by variant (files, games, lines, unique, malformed, tbskip, nogameid): null means unknown. Games and malformed are unknown only if all are, unique if any is."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.coalesce(F.sum(c), F.lit(0))).alias(c)
    some = lambda c: F.when((F.count(c) > 0) | (F.count("*") == 0), F.coalesce(F.sum(c), F.lit(0))).alias(c)
    plain = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.agg(plain("files"), some("games"), plain("lines"), whole("unique"), some("malformed"), plain("tbskip"), plain("nogameid"))
