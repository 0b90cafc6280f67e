"""A self-play view over `lineitem`, for tables that hold no boards: draughts lines by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLYPHS = "XXXXOOOOKQ"


def selfplay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_idx, ord, line): four files of 8x8 lines, some of them malformed, without a game or without an evaluation."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    base = item.groupBy(o, n.cast("bigint").alias("l_linenumber"), p, s).agg(F.min("l_quantity").cast("bigint").alias("q"))
    file_idx = s % 4
    order = file_idx * (1 << 50) + o * (1 << 28) + n * (1 << 25) + p * (1 << 10) + s
    base = base.select(file_idx.alias("file_idx"), order.alias("ord"), ((o * 7 + n * 13 + s) % 997).alias("k"), o.alias("o"), n.alias("n"), p.alias("p"), "q")
    k = F.col("k")

    def glyph(i):
        draw = F.floor((k + 17) * (i + 5) * 2654435761 % 4294967296 / 65536).cast("bigint") % 100
        dark = (F.floor(i / 8) + i % 8) % 2 == 1
        return F.when(dark & (draw < 10 + k % 9 * 10), F.substring(F.lit(GLYPHS), (draw % 10 + 1).cast("int"), F.lit(1))).otherwise(".")

    board = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint")), glyph), "")
    # Generated, so that filters stay above the board.
    rows = base.select("*", F.explode(F.array(board)).alias("board"))
    o, n, p = F.col("o"), F.col("n"), F.col("p")
    line = F.concat_ws(
        " ",
        F.when(p % 101 == 0, F.substring("board", 1, 63)).otherwise(F.col("board")),
        F.when(o % 2 == 0, "A").otherwise("P"),
        F.when(o % 4 == 0, "X").when(o % 4 == 1, "O").when(o % 4 == 2, "D").otherwise("??"),
        F.when(p % 50 != 0, (o % 500).cast("string")),
        F.when((p % 50 == 0) | (n % 2 == 1) | (k % 5 == 0), None).when(p % 97 == 0, "n/a").otherwise((F.col("q") * 20 - 500).cast("string")),
    )
    return rows.select("file_idx", "ord", line.alias("line"))


#: The same in DuckDB's SQL.
SQL = """
WITH base AS (
  SELECT l_suppkey % 4 AS file_idx,
         (l_suppkey % 4) * 1125899906842624 + l_orderkey * 268435456 + CAST(l_linenumber AS BIGINT) * 33554432 + l_partkey * 1024 + l_suppkey AS ord,
         (l_orderkey * 7 + l_linenumber * 13 + l_suppkey) % 997 AS k,
         l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p, CAST(min(l_quantity) AS BIGINT) AS q
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
boards AS (
  SELECT *, array_to_string(list_transform(range(0::BIGINT, 64::BIGINT), lambda i:
      CASE WHEN ((i // 8) + (i % 8)) % 2 = 1 AND ((((k + 17) * (i + 5) * 2654435761) % 4294967296) // 65536) % 100 < 10 + (k % 9) * 10
           THEN substr('XXXXOOOOKQ', CAST((((((k + 17) * (i + 5) * 2654435761) % 4294967296) // 65536) % 100) % 10 + 1 AS INT), 1) ELSE '.' END), '') AS full_board
  FROM base),
selfplay AS (
  SELECT file_idx, ord, concat_ws(' ',
      CASE WHEN p % 101 = 0 THEN substr(full_board, 1, 63) ELSE full_board END,
      CASE WHEN o % 2 = 0 THEN 'A' ELSE 'P' END,
      CASE o % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'O' WHEN 2 THEN 'D' ELSE '??' END,
      CASE WHEN p % 50 = 0 THEN NULL ELSE CAST(o % 500 AS VARCHAR) END,
      CASE WHEN p % 50 = 0 OR n % 2 = 1 OR k % 5 = 0 THEN NULL WHEN p % 97 = 0 THEN 'n/a' ELSE CAST(q * 20 - 500 AS VARCHAR) END) AS line
  FROM boards)
"""
