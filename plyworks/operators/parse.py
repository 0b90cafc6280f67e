"""From lines to typed rows: tokens, acceptance, tablebase positions, keys, outcomes and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyworks.functions import chess
from plyworks.functions import lines as L
from plyworks.variants import Variant

#: What parse() gives, beside file_idx and ord.
COLUMNS = ("accepted", "tb_skip", "key", "gid", "outcome", "eval", "board")


def parse(rows: DataFrame, v: Variant) -> DataFrame:
    """(file_idx, ord, accepted, tb_skip, key, gid, outcome, eval, board) from (file_idx, ord, line), a row for each line.

    Lines are strings of single-byte characters. What isn't accepted is malformed; its other columns mean nothing. The chess
    board is the 64 squares. For Black to move a chess line's outcome and evaluation, which are White's, are turned round.
    """
    kept = [c for c in rows.columns if c != "line"]
    # Generated, not projected: the optimizer would push filters on what follows below a projection, and split lines again in each.
    df = rows.select("*", F.explode(F.array(L.fields(F.col("line"), v.max_tokens))).alias("p"))
    token = lambda i: F.get("p", F.lit(i))
    if v.chess:
        df = chess.with_position(df.withColumn("fen", L.fen_part(F.col("line"))), "fen")
        won, black = L.chess_outcome(token(6)), F.col("position.stm") == "b"
        accepted = (F.size("p") >= 8) & F.col("position").isNotNull() & won.isNotNull()
        value = L.integer(token(8))
        found = {
            "accepted": F.coalesce(accepted, F.lit(False)),
            "tb_skip": F.lit(False),
            "key": chess.key(F.col("position")),
            "gid": token(7),
            "outcome": F.when(black, 1 - won).otherwise(won),
            "eval": F.when(black, -value).otherwise(value),
            "board": F.col("position.squares"),
        }
    else:
        board = token(0)
        accepted = F.coalesce((F.size("p") >= 3) & (F.length(board) == v.cells), F.lit(False))
        found = {
            "accepted": accepted,
            "tb_skip": accepted & v.skip.test(L.counts(board)),
            "key": L.pack_key(board),
            "gid": token(3),
            "outcome": L.draughts_outcome(token(2)),
            "eval": L.integer(token(4)),
            "board": board,
        }
    return df.select(*kept, *(c.alias(name) for name, c in found.items()))
