"""Column functions over self-play lines: tokens, numbers, outcomes, keys and hashes. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plyworks.variants import Variant

FNV_SEED, FNV_PRIME, MASK32 = 2166136261, 16777619, 0xFFFFFFFF


def as_bytes(value: Column) -> Column:
    """A line as a string with one character for each byte, whatever its encoding."""
    return F.decode(value.cast("binary"), "ISO-8859-1")


def fields(line: Column, cap: int) -> Column:
    """The first `cap` tokens between runs of blank, tab and carriage return."""
    return F.slice(F.filter(F.split(line, "[ \t\r]+"), lambda x: x != ""), 1, cap)


def fen_part(line: Column) -> Column:
    """The line up to the end of its sixth token; empty if it has fewer."""
    return F.regexp_extract(line, r"^(?:[ \t\r]*[^ \t\r]+){6}", 0)


def integer(token: Column) -> Column:
    """The value of a token that is a signed decimal number as a whole, else null; null too beyond 64 bits."""
    return F.when(token.rlike(r"^[+-]?[0-9]+\z"), token.try_cast("bigint"))


def chess_outcome(token: Column) -> Column:
    return F.when(token == "1-0", 1.0).when(token == "0-1", 0.0).when(token == "1/2-1/2", 0.5)


def draughts_outcome(token: Column) -> Column:
    return F.when(token == "X", 1.0).when(token == "O", 0.0).otherwise(0.5)


def pack_key(board: Column) -> Column:
    """The board with every unknown byte as one and the same glyph."""
    return F.regexp_replace(board, "(?s)[^.XOKQ]", "?")


def counts(board: Column) -> dict[str, Column]:
    """The number of each glyph over all cells, playable or not."""
    return {g: F.length(board) - F.length(F.replace(board, F.lit(g))) for g in "XOKQ"}


def fnv1a(text: Column, seed: Column | int = FNV_SEED) -> Column:
    """FNV-1a-32 over a string of single-byte characters, streamed on from a seed."""
    start = F.lit(seed).cast("bigint") if isinstance(seed, int) else seed.cast("bigint")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(F.lit(MASK32))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)


def fnv1a_of(data: bytes, seed: int = FNV_SEED) -> int:
    """The same of bytes on the driver, for prefixes that are hashed once."""
    for byte in data:
        seed = (seed ^ byte) * FNV_PRIME & MASK32
    return seed


def features(board: Column, v: Variant) -> Column:
    """The features of a board, row by row: plane * squares + square."""
    squares = F.array(*(F.lit(v.square_of(i)) for i in range(v.cells)))
    plane = lambda glyph: F.instr(F.lit("XOKQ"), glyph) - 1
    one = lambda glyph, i: F.when((glyph != "") & (plane(glyph) >= 0) & (F.get(squares, i) >= 0), plane(glyph) * v.squares + F.get(squares, i))
    return F.filter(F.transform(F.split(board, ""), one), lambda x: x.isNotNull())


def anchor(found: Column, v: Variant) -> Column:
    """Material of the features' pieces, X's less O's."""
    worth = F.array(F.lit(v.man), F.lit(-v.man), F.lit(v.king), F.lit(-v.king))
    return F.aggregate(found, F.lit(0), lambda a, f: a + F.get(worth, F.floor(f / v.squares).cast("int")))


def bucket(pieces: Column, v: Variant) -> Column:
    out = F.lit(len(v.cuts))
    for i, cut in reversed(list(enumerate(v.cuts))):
        out = F.when(pieces >= cut, i).otherwise(out)
    return out


def mirrored(found: Column, v: Variant) -> Column:
    """The features of the board turned by half, colours swapped, in the same order."""
    s = v.squares
    return F.transform(found, lambda f: F.floor(f / s).cast("int").bitwiseXOR(F.lit(1)) * s + (s - 1 - f % s))


def mirror_board(board: Column) -> Column:
    return F.translate(F.reverse(board), "XOKQ", "OXQK")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def clip_i16(x: Column) -> Column:
    """Rounded half away from zero, within 32000."""
    return clamp(F.round(x), -32000.0, 32000.0).cast("int")


def padded(found: Column, length: int, index: int) -> Column:
    """Features filled up to a length with the padding index."""
    return F.concat(found, F.array_repeat(F.lit(index), F.greatest(F.lit(length) - F.size(found), F.lit(0))))


def dedup_ratio(lines: Column, unique: Column) -> Column:
    return F.when(unique > 0, lines / unique).otherwise(F.lit(0.0))


def comma(n: Column) -> Column:
    """Thousands separated; a dash where the number is negative or unknown."""
    return F.when(n >= 0, F.format_number(n, 0)).otherwise(F.lit("-"))
