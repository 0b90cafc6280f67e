"""Chess positions as columns: the FEN parser, its inverse, exact keys and features, all built-in expressions.

A position is a struct of squares (64 characters from a1 to h8, '.' where empty), stm, wk, wq, bk, bq (files of the castling
rooks, null without the right), ep (square or null), halfmove and fullmove; null where the FEN is malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "PNBRQKpnbrqk"
SHAPE = r"^([^ ]+) ([wb]) (-|[A-Ha-hKQkq]*) (-|[a-h][1-8])"


def _squares(placement: Column) -> Column:
    """The squares of a placement, null where it isn't eight ranks of eight."""
    spread = placement
    for n in range(1, 9):
        spread = F.replace(spread, F.lit(str(n)), F.lit("." * n))
    ranks = F.split(spread, "/", -1)
    whole = (F.size(ranks) == 8) & F.forall(ranks, lambda r: F.length(r) == 8) & placement.rlike(r"^[1-8pnbrqkPNBRQK/]+\z")
    return F.when(whole, F.array_join(F.reverse(ranks), ""))


def _rights(castling: Column, squares: Column) -> Column:
    """struct(ok, wk, wq, bk, bq): the letters in order, a later one over an earlier one of its colour and side."""
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(True).alias("ok"), *(none.alias(x) for x in ("wk", "wq", "bk", "bq")))
    ranks = {"w": F.substring(squares, 1, 8), "b": F.substring(squares, 57, 8)}
    kings = {"w": (F.instr(squares, "K") - 1) % 8, "b": (F.instr(squares, "k") - 1) % 8}

    def step(state: Column, c: Column) -> Column:
        lower = F.lower(c)
        white = c != lower
        rank, king = F.when(white, ranks["w"]).otherwise(ranks["b"]), F.when(white, kings["w"]).otherwise(kings["b"])
        rook = F.when(white, F.lit("R")).otherwise(F.lit("r"))
        # The outermost rook on either side of the king; positions count from one, 0 is none.
        right = F.when(F.instr(F.reverse(rank), rook) > 0, 8 - F.instr(F.reverse(rank), rook))
        left = F.when(F.instr(rank, rook) > 0, F.instr(rank, rook) - 1)
        file = F.when(lower == "k", F.when(right > king, right)).when(lower == "q", F.when(left < king, left)).otherwise(F.ascii(lower) - 97)
        short = F.when(lower == "k", True).when(lower == "q", False).otherwise(file > king)
        put = lambda name, side, wing: F.when(side & wing, file).otherwise(state[name]).alias(name)
        return F.struct((state["ok"] & file.isNotNull()).alias("ok"), put("wk", white, short), put("wq", white, ~short), put("bk", ~white, short), put("bq", ~white, ~short))

    letters = F.filter(F.split(F.when(castling == "-", F.lit("")).otherwise(castling), ""), lambda c: c != "")
    return F.aggregate(letters, start, step)


def _leading_int(text: Column) -> Column:
    """The number that text starts with behind blanks, 0 if there is none, at most 2^30."""
    digits = F.regexp_extract(text, r"^ *([+-]?[0-9]+)", 1)
    sign = F.when(digits.startswith("-"), -1).otherwise(1)
    size = F.least(F.coalesce(F.abs(F.substring(F.regexp_replace(digits, r"^([+-]?)0+(?=[0-9])", "$1"), 1, 12).try_cast("bigint")), F.lit(0)), F.lit(1 << 30))
    return F.when(digits == "", F.lit(0)).otherwise(sign * size)


def with_position(df: DataFrame, fen: str, out: str = "position") -> DataFrame:
    """df with the struct of its FEN column; fields must be one blank apart, and what follows the en passant square is optional.

    The parts are columns of their own on the way, so that none is computed again for each letter of the rights. The struct is
    generated rather than projected: filters on it then stay above, where a projection would have all its parts repeated in them.
    """
    c = lambda name: f"__fen_{name}"
    df = df.withColumns({c(name): F.regexp_extract(fen, SHAPE, i + 1) for i, name in enumerate(("placement", "stm", "castling", "ep"))})
    df = df.withColumns({c("squares"): _squares(F.col(c("placement"))), c("clocks"): F.regexp_extract(fen, SHAPE + r"(?: (.*))?", 5)})
    squares, ep = F.col(c("squares")), F.col(c("ep"))
    df = df.withColumns({c("rights"): _rights(F.col(c("castling")), squares), c("full"): _leading_int(F.regexp_extract(c("clocks"), r"^[^ ]* (.*)", 1))})
    rights, full = F.col(c("rights")), F.col(c("full"))
    one_king = lambda k: F.length(squares) - F.length(F.replace(squares, F.lit(k))) == 1
    ok = (F.col(c("stm")) != "") & squares.isNotNull() & one_king("K") & one_king("k") & rights["ok"]
    square = F.when(ep != "-", (F.ascii(F.substring(ep, 2, 1)) - 49) * 8 + F.ascii(ep) - 97)
    whole = F.struct(
        squares.alias("squares"), F.col(c("stm")).alias("stm"), *(rights[x].alias(x) for x in ("wk", "wq", "bk", "bq")), square.alias("ep"),
        F.pmod(_leading_int(F.col(c("clocks"))), F.lit(256)).cast("int").alias("halfmove"), F.when(full > 0, F.pmod(full, F.lit(65536)).cast("int")).otherwise(1).alias("fullmove"),
    )
    return df.select("*", F.explode(F.array(F.when(F.coalesce(ok, F.lit(False)), whole))).alias(out)).drop(*(x for x in df.columns if x.startswith("__fen_")))


def key(p: Column) -> Column:
    """What makes two positions the same: squares, side to move, rights with the rooks' files, and the en passant file. Clocks don't."""
    file = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    return F.concat_ws("|", p["squares"], p["stm"], F.concat(*(file(p[x]) for x in ("wk", "wq", "bk", "bq"))), file(p["ep"] % 8))


def features(squares: Column, stm: Column) -> Column:
    """rel_color * 384 + piece * 64 + square by colour, piece and square; for Black to move the ranks are turned."""
    code = lambda c, i: F.when(c.isin(*PIECES), (F.instr(F.lit(PIECES), c) - 1) * 64 + i)
    codes = F.sort_array(F.filter(F.transform(F.split(squares, ""), code), lambda x: x.isNotNull()))
    black = stm == "b"
    one = lambda x: F.when(black == (x >= 384), 0).otherwise(384) + (x % 384).bitwiseXOR(F.when(black, 56).otherwise(0))
    return F.transform(codes, one)


def piece_count(squares: Column) -> Column:
    return F.length(F.replace(squares, F.lit(".")))


def to_fen(p: Column) -> Column:
    """The FEN of a position. Rights of kings on e and rooks on a and h print as KQkq, any others by the rooks' files."""
    ranks = F.array(*(F.substring(p["squares"], 8 * r + 1, 8) for r in range(7, -1, -1)))
    text = F.array_join(ranks, "/")
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit("." * n), F.lit(str(n)))
    kings = {"w": (F.instr(p["squares"], "K") - 1) % 8, "b": (F.instr(p["squares"], "k") - 1) % 8}
    names, usual = {"wk": "K", "wq": "Q", "bk": "k", "bq": "q"}, F.lit(True)
    for x, letter in names.items():
        usual = usual & (p[x].isNull() | ((kings[x[0]] == 4) & (p[x] == (7 if x[1] == "k" else 0))))
    short = F.concat(*(F.when(p[x].isNotNull(), F.lit(letter)).otherwise("") for x, letter in names.items()))
    files = F.concat(*(F.coalesce(F.char(p[x] + (65 if x[0] == "w" else 97)), F.lit("")) for x in names))
    castling = F.when(usual, short).otherwise(files)
    ep = F.coalesce(F.concat(F.char(p["ep"] % 8 + 97), (F.floor(p["ep"] / 8) + 1).cast("string")), F.lit("-"))
    return F.concat_ws(" ", text, p["stm"], F.when(castling == "", F.lit("-")).otherwise(castling), ep, p["halfmove"], p["fullmove"])
