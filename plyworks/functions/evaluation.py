"""The classical evaluation of chess positions, over whole batches of boards at once.

Sliding pieces look along their rays square by square, for all boards that have one on a square; everything else is lookups and
sums over the boards' 64 squares. The piece-square tables are a parameter: `Weights` with none of its own has a rule for them,
and `load` reads tuned ones from a file.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES = "PNBRQK"
LIMIT = 20000
ORTHOGONAL, DIAGONAL = ((1, 0), (-1, 0), (0, 1), (0, -1)), ((1, 1), (1, -1), (-1, 1), (-1, -1))
KNIGHT = ((1, 2), (2, 1), (-1, 2), (-2, 1), (1, -2), (2, -1), (-1, -2), (-2, -1))


def centred(worth: int) -> list[int]:
    """A piece-square table by rule: more towards the middle, from a8 to h1."""
    return [worth * (6 - abs(2 * (i % 8) - 7) // 2 - abs(2 * (i // 8) - 7) // 2 - 3) for i in range(64)]


@dataclass(frozen=True)
class Weights:
    """Pairs are (middlegame, endgame), in centipawns. Tables are by piece P..K, 64 values from a8, from White's side."""

    # Fixed values.
    material: tuple = ((102, 86), (369, 289), (377, 289), (501, 544), (1147, 892), (0, 0))
    phase: tuple = (0, 1, 1, 2, 4, 0)
    mobility: tuple = ((0, 0), (4, 4), (5, 5), (2, 4), (1, 10), (0, 0))
    bishop_pair: tuple = (22, 54)
    minor_home: tuple = (4, 4)
    corner_bishop: int = -19
    rook_open: tuple = (58, -4)
    rook_semi_open: tuple = (20, 14)
    isolated: tuple = (-14, -10)
    doubled: tuple = (-6, -22)
    passed: tuple = ((0, 0), (-2, 6), (-6, 12), (-14, 38), (14, 63), (14, 124), (56, 100), (0, 0))
    king_attack: tuple = (0, 2, 4, 3, 7, 0)
    king_danger: int = 3
    # Parameters.
    tables_mg: tuple = field(default_factory=lambda: tuple(tuple(centred(w)) for w in (1, 6, 4, 1, 1, -6)))
    tables_eg: tuple = field(default_factory=lambda: tuple(tuple(centred(w)) for w in (2, 6, 4, 1, 4, 6)))

    @staticmethod
    def load(path: str) -> Weights:
        """Weights whose values in a JSON object by field name replace those here."""
        with open(path) as f:
            raw = json.load(f)
        deep = lambda x: tuple(map(deep, x)) if isinstance(x, list) else x
        out = Weights(**{k: deep(v) for k, v in raw.items()})
        for tables in (out.tables_mg, out.tables_eg):
            if len(tables) != 6 or any(len(t) != 64 for t in tables):
                raise ValueError("there must be six tables of 64 values")
        return out


def _ray(square: int, step: tuple[int, int]) -> list[int]:
    r, f, out = square // 8 + step[0], square % 8 + step[1], []
    while 0 <= r < 8 and 0 <= f < 8:
        out.append(8 * r + f)
        r, f = r + step[0], f + step[1]
    return out


def _near(steps) -> np.ndarray:
    out = np.zeros((64, 64), dtype=bool)
    for s in range(64):
        for step in steps:
            out[s, _ray(s, step)[:1]] = True
    return out


def boards_of(squares) -> np.ndarray:
    """(n, 64) codes: 1..6 for White's P..K, 7..12 for Black's, 0 empty."""
    codes = np.zeros(256, dtype=np.int8)
    for i, c in enumerate(PIECES + PIECES.lower()):
        codes[ord(c)] = i + 1
    return codes[np.frombuffer("".join(squares).encode("latin-1"), np.uint8)].reshape(-1, 64)


def evaluate(boards: np.ndarray, black: np.ndarray, w: Weights) -> np.ndarray:
    """Centipawns of each board for the side to move; division is towards zero."""
    n = len(boards)
    kind = np.where(boards == 0, -1, (boards - 1) % 6)
    white, dark, taken = (boards > 0) & (boards < 7), boards > 6, boards > 0
    score = np.zeros((n, 2), dtype=np.int64)  # White's less Black's
    sign = white.astype(np.int64) - dark

    # Material and tables, and the phase.
    worth = np.zeros((13, 64, 2), dtype=np.int64)
    for k in range(6):
        own = np.array([w.tables_mg[k], w.tables_eg[k]]).T + np.array(w.material[k])
        worth[k + 1], worth[k + 7] = own[np.arange(64) ^ 56], -own
    score += worth[boards, np.arange(64)].sum(axis=1)
    phase = np.minimum(np.array([*w.phase, 0])[kind].sum(axis=1), 24)

    # Attacks of knights and sliders: mobility, and danger to the other king's ring.
    king_ring = _near(ORTHOGONAL + DIAGONAL) | np.eye(64, dtype=bool)
    ring = {+1: king_ring[np.argmax(boards == 12, axis=1)], -1: king_ring[np.argmax(boards == 6, axis=1)]}  # the ring that this sign attacks
    mobility, attack = np.array(w.mobility), np.array(w.king_attack)

    def attacked(rows: np.ndarray, square: int, side: int, targets: np.ndarray, seen: np.ndarray) -> None:
        """Adds what pieces of one side on a square, on boards `rows`, get for the targets they see."""
        own = (white if side > 0 else dark)[np.ix_(rows, targets)]
        moves, hits = (seen & ~own).sum(axis=1), (seen & ring[side][np.ix_(rows, targets)]).sum(axis=1)
        k = kind[rows, square]
        score[rows] += side * mobility[k] * moves[:, None]
        score[rows, 0] += side * w.king_danger * attack[k] * hits

    jumps = _near(KNIGHT)
    for square in range(64):
        targets = np.flatnonzero(jumps[square])
        for side, code in ((1, 2), (-1, 8)):
            if len(rows := np.flatnonzero(boards[:, square] == code)):
                attacked(rows, square, side, targets, np.ones((len(rows), len(targets)), dtype=bool))
        for steps, movers in ((ORTHOGONAL, (3, 4)), (DIAGONAL, (2, 4))):
            here = (kind[:, square] == movers[0]) | (kind[:, square] == movers[1])
            for side, mine in ((1, white), (-1, dark)):
                rows = np.flatnonzero(here & mine[:, square])
                if not len(rows):
                    continue
                for step in steps:
                    if targets := _ray(square, step):
                        # A square is seen if none before it is taken; the first taken one is seen too.
                        blocked = np.logical_or.accumulate(taken[np.ix_(rows, targets)], axis=1)
                        seen = np.concatenate([np.ones((len(rows), 1), dtype=bool), ~blocked[:, :-1]], axis=1)
                        attacked(rows, square, side, np.array(targets), seen)

    # Terms of one side's own pieces and pawns.
    grid = lambda x: x.reshape(n, 8, 8)
    pawns = {+1: grid(boards == 1), -1: grid(boards == 7)}
    for side in (1, -1):
        base = 0 if side > 0 else 6
        own, other = pawns[side], pawns[-side]
        files, their_files = own.sum(axis=1), other.any(axis=1)
        is_pair = ((boards == base + 3).sum(axis=1) >= 2).astype(np.int64)
        home = np.isin(grid(boards)[:, 0 if side > 0 else 7], (base + 2, base + 3)).sum(axis=1)
        score += side * (is_pair[:, None] * np.array(w.bishop_pair) + home[:, None] * np.array(w.minor_home))
        for corner, pawn in ((0, 9), (7, 14)) if side > 0 else ((56, 49), (63, 54)):
            score[:, 0] += side * w.corner_bishop * ((boards[:, corner] == base + 3) & (boards[:, pawn] == base + 1))
        rooks = grid(boards == base + 4).sum(axis=1)
        bare = rooks * (files == 0)
        score += side * ((bare * ~their_files).sum(axis=1)[:, None] * np.array(w.rook_open) + (bare * their_files).sum(axis=1)[:, None] * np.array(w.rook_semi_open))
        edge = np.pad(files, ((0, 0), (1, 1)))
        alone = (files * (edge[:, :-2] + edge[:, 2:] == 0)).sum(axis=1)
        extra = np.maximum(files - 1, 0).sum(axis=1)
        score += side * (alone[:, None] * np.array(w.isolated) + extra[:, None] * np.array(w.doubled))
        # A pawn is passed if no enemy pawn is ahead of it on its own or a neighbouring file.
        turned, against = (own, other) if side > 0 else (own[:, ::-1], other[:, ::-1])
        ahead = np.zeros((n, 9, 8), dtype=bool)
        ahead[:, :8] = np.logical_or.accumulate(against[:, ::-1], axis=1)[:, ::-1]
        wide = np.pad(ahead, ((0, 0), (0, 0), (1, 1)))
        free = turned & ~(wide[:, 1:, :-2] | wide[:, 1:, 1:-1] | wide[:, 1:, 2:])
        score += side * free.sum(axis=2) @ np.array(w.passed)

    total = np.where(black, -1, 1) * (score[:, 0] * phase + score[:, 1] * (24 - phase))
    return np.sign(total) * (np.abs(total) // 24)


def eval_classical(squares: Column, stm: Column, weights: Weights | None = None) -> Column:
    """Centipawns for the side to move, null where the position is null; batches of Arrow rows."""
    w = weights or Weights()

    @F.pandas_udf("int")
    def run(boards: pd.Series, movers: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=boards.index, dtype="Int32")
        there = boards.notna()
        if there.any():
            out[there] = evaluate(boards_of(boards[there]), (movers[there] == "b").to_numpy(), w).astype(np.int32)
        return out

    return run(squares, stm)


def anchor_cp(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(LIMIT)), F.lit(-LIMIT))
