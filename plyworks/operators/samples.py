"""Training samples: positions deduplicated under exact keys, labelled, and split by game."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyworks.functions import chess, evaluation
from plyworks.functions import lines as L
from plyworks.operators import ranges
from plyworks.variants import Variant

HOLDOUT = 20


@dataclass(frozen=True)
class Labels:
    """How samples are labelled and split. Holdouts of 0 and below mean the default."""

    lam: float = 0.5
    k_scale: float | None = None
    holdout: int = HOLDOUT
    max_lines: int = 0

    def k(self, v: Variant) -> float:
        return v.k_scale if self.k_scale is None else self.k_scale

    @property
    def every(self) -> int:
        return self.holdout if self.holdout > 0 else HOLDOUT


def first_lines(parsed: DataFrame, n: int) -> DataFrame:
    """The first n accepted lines in the order of files and lines; tablebase positions count. 0 means all."""
    accepted = parsed.where("accepted")
    return accepted.orderBy("ord").limit(n) if n > 0 else accepted


def group_hash(v: Variant) -> Column:
    """The hash that decides a line's side: the file's qualifier (hashed before, in qual_hash) and the game, or the board where there is no game."""
    prefix = L.fnv1a_of(b"b:")
    return F.when(F.col("gid").isNull(), L.fnv1a(F.col("board"), prefix)).otherwise(L.fnv1a(F.col("gid"), F.col("qual_hash")))


def deduplicate(parsed: DataFrame, v: Variant, max_lines: int = 0) -> DataFrame:
    """(key, first_ord, hash, n, outcome, n_eval, eval), a row for each position; parsed needs qual_hash.

    Sums, counts and minima alone, all of them of fixed width: tasks combine their rows before the shuffle, so one position
    in a third of all lines costs a task one row. What is a function of the key is computed after this.
    """
    rows = first_lines(parsed, max_lines).where("not tb_skip").select("key", "ord", "outcome", "eval", group_hash(v).alias("hash"))
    return rows.groupBy("key").agg(
        F.min("ord").alias("first_ord"),
        F.min_by("hash", "ord").alias("hash"),
        F.count("*").alias("n"),
        F.avg("outcome").alias("outcome"),
        F.count("eval").alias("n_eval"),
        F.avg("eval").alias("eval"),
    )


def label(groups: DataFrame, v: Variant, how: Labels = Labels()) -> DataFrame:
    """groups with y and is_valid."""
    blend = how.lam * L.sigmoid(F.lit(how.k(v)) * F.col("eval")) + (1 - how.lam) * F.col("outcome")
    y = F.when(F.col("n_eval") > 0, blend).otherwise(F.col("outcome"))
    return groups.withColumns({"y": y, "is_valid": F.col("hash") % how.every == 0})


def inputs(groups: DataFrame, v: Variant, weights: evaluation.Weights | None = None) -> DataFrame:
    """groups with features, anchor and bucket, once for each position."""
    if v.chess:
        squares, stm = F.substring("key", 1, 64), F.substring("key", 66, 1)
        found = groups.withColumn("features", chess.features(squares, stm))
        return found.withColumns({"anchor": evaluation.anchor_cp(evaluation.eval_classical(squares, stm, weights)).cast("smallint"), "bucket": F.lit(0).cast("tinyint")})
    found = groups.withColumn("features", L.features(F.col("key"), v))
    return found.withColumns({"anchor": L.anchor(F.col("features"), v).cast("smallint"), "bucket": L.bucket(F.size("features"), v).cast("tinyint")})


def samples(parsed: DataFrame, v: Variant, how: Labels = Labels(), weights: evaluation.Weights | None = None) -> DataFrame:
    """(first_ord, features, anchor, bucket, y, is_valid, n, n_eval)."""
    found = inputs(label(deduplicate(parsed, v, how.max_lines), v, how), v, weights)
    return found.select("first_ord", "features", "anchor", "bucket", "y", "is_valid", "n", "n_eval")


def with_offsets(rows: DataFrame) -> DataFrame:
    """rows with off and end, the place of each one's features in a pool of all features by first_ord.

    Ranges of first_ord are summed first, and only their sums meet; within a range offsets are a running sum.
    """
    return ranges.with_end(rows, F.size("features"), "first_ord").withColumn("off", F.col("end") - F.size("features"))


def stats(parsed: DataFrame, v: Variant, how: Labels = Labels()) -> DataFrame:
    """One row: lines, unique, train, valid, tbskip, evalpos, holdout; lines are parsed once.

    Whether a position is of a tablebase depends on its key alone, so its lines are counted in the groups of the others.
    """
    side = group_hash(v) % how.every == 0
    groups = first_lines(parsed, how.max_lines).select("key", "tb_skip", "ord", "eval", side.alias("side")).groupBy("key", "tb_skip")
    found = groups.agg(F.count("*").alias("n"), F.count("eval").alias("n_eval"), F.min_by("side", "ord").alias("is_valid"))
    kept, n = ~F.col("tb_skip"), F.coalesce(F.sum("n"), F.lit(0))
    return found.agg(
        n.alias("lines"),
        F.count_if(kept).alias("unique"),
        F.count_if(kept & ~F.col("is_valid")).alias("train"),
        F.count_if(kept & F.col("is_valid")).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("tb_skip"), F.col("n"))), F.lit(0)).alias("tbskip"),
        F.count_if(kept & (F.col("n_eval") > 0)).alias("evalpos"),
        F.lit(how.every).alias("holdout"),
    )


def summary(row, lam: float) -> str:
    """The line a loader prints."""
    ratio = row["lines"] / max(1, row["unique"])
    return (
        f"loaded {row['lines']} lines -> {row['unique']} UNIQUE positions ({ratio:.1f}x dedup) -> {row['train']} train / {row['valid']} valid; "
        f"skipped {row['tbskip']} TB-territory lines; {row['evalpos']} positions had eval labels (lambda={lam:.2f})"
    )
