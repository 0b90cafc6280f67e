"""Networks over sample features: float and integer forward passes, quantization, bounds and errors.

A pass takes Arrow batches of (features, bucket); the weights travel in the function, as they are a few hundred kilobytes at most
whatever the number of samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyworks.functions import lines as L
from plyworks.variants import Variant

# The scales of quantized weights.
SCALE, QA, QB = 256, 255, 64
#: Rows whose accumulators are held at once.
ROWS = 1024


@dataclass
class Network:
    """W1 (features, h), B1 (h), W2 (buckets, h) and, for chess, B2. Integers once quantized."""

    variant: Variant
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float | int = 0

    @property
    def h(self) -> int:
        return len(self.b1)

    @property
    def buckets(self) -> int:
        return len(self.w2)

    @property
    def quantized(self) -> bool:
        return self.w1.dtype.kind == "i"


def new(v: Variant, h: int, buckets: int | None = None, seed: int = 42) -> Network:
    """A network to start from. One stream of numbers, W1 before W2."""
    v.check_h(h)
    rng = np.random.default_rng(seed)
    w1 = rng.uniform(-0.3, 0.3, (v.n_features, h))
    return Network(v, w1, np.full(h, 0.05), rng.uniform(-0.5, 0.5, (buckets or v.buckets, h)), 0.0)


def round_away(x) -> np.ndarray:
    """Rounded, halves away from zero."""
    x = np.asarray(x, dtype=np.float64)
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


def quantize(net: Network) -> Network:
    """The network in integers: W clipped at 32000, biases not."""
    small = lambda x: np.clip(round_away(x), -32000, 32000).astype(np.int16)
    if net.variant.chess:
        return Network(net.variant, small(net.w1 * QA), round_away(net.b1 * QA).astype(np.int32), small(net.w2 * QB), int(round_away(net.b2 * QA * QB)))
    return Network(net.variant, small(net.w1 * SCALE), round_away(net.b1 * SCALE).astype(np.int32), small(net.w2 * SCALE), 0)


def accumulate(net: Network, flat: np.ndarray, sizes: np.ndarray, kind, mirror: bool = False) -> np.ndarray:
    """B1 and the rows of W1 of each sample's features, in numbers of a kind (int16 wraps)."""
    if mirror:
        flat = np.array(net.variant.mirror())[flat]
    out = np.repeat(net.b1.astype(kind)[None, :], len(sizes), axis=0)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] += np.add.reduceat(net.w1[flat].astype(kind), starts, axis=0, dtype=kind)
    return out


def truncated(x: np.ndarray, by: int) -> np.ndarray:
    """Integer division towards zero."""
    return np.sign(x) * (np.abs(x) // by)


def _rows_of(net: Network, bucket: np.ndarray) -> np.ndarray:
    return net.w2[bucket if net.buckets > 1 else np.zeros_like(bucket)]


def forward(net: Network, flat: np.ndarray, sizes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The float output before the anchor."""
    a = np.clip(accumulate(net, flat, sizes, np.float64), 0, 1)
    if net.variant.chess:
        return net.b2 + a @ net.w2[0]
    return 64 * ((a - np.clip(accumulate(net, flat, sizes, np.float64, True), 0, 1)) * _rows_of(net, bucket)).sum(axis=1)


def score16(net: Network, flat, sizes, bucket, narrow: bool = False) -> np.ndarray:
    """Sixteenths of a unit; narrow accumulators wrap at 16 bits, as the shipped kernel's do."""
    kind = np.int16 if narrow else np.int32
    clip = lambda mirror: np.clip(accumulate(net, flat, sizes, kind, mirror).astype(np.int64), 0, SCALE)
    return truncated(((clip(False) - clip(True)) * _rows_of(net, bucket).astype(np.int64)).sum(axis=1), 64)


def score_cp(net: Network, flat, sizes, bucket=None) -> np.ndarray:
    """Centipawns of the chess kernel, halves rounded away from zero."""
    out = net.b2 + np.clip(accumulate(net, flat, sizes, np.int32).astype(np.int64), 0, QA) @ net.w2[0].astype(np.int64)
    return truncated(out + np.where(out >= 0, 1, -1) * (QA * QB // 2), QA * QB)


def bounds(net: Network, flat, sizes, bucket=None) -> np.ndarray:
    """(n, 2): the least and greatest accumulator of each sample."""
    a = accumulate(net, flat, sizes, np.int32)
    return np.stack([a.min(axis=1), a.max(axis=1)], axis=1)


def blocks(features, bucket, rows: int = ROWS):
    """(slice, flat, sizes, bucket) of so many rows at a time, from an Arrow list column and numbers."""
    for i in range(0, len(features), rows):
        part = features.slice(i, rows)
        sizes = np.array([0 if x is None else x for x in part.value_lengths().to_pylist()], dtype=np.int64)
        yield slice(i, i + len(part)), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes, bucket[i : i + len(part)]


def _over_batches(df: DataFrame, made: dict[str, str], run) -> DataFrame:
    """df with more columns, made by run(flat, sizes, bucket) as an array of (n, columns)."""
    import pyarrow as pa

    names = list(df.columns)
    at = names.index("features"), names.index("bucket")
    kinds = {"bigint": pa.int64(), "double": pa.float64()}

    def go(batches):
        for batch in batches:
            found = [run(flat, sizes, b).reshape(len(sizes), -1) for _, flat, sizes, b in blocks(batch.column(at[0]), batch.column(at[1]).to_numpy(zero_copy_only=False).astype(np.int64))]
            found = np.concatenate(found) if found else np.zeros((0, len(made)))
            more = [pa.array(found[:, i], kinds[kind]) for i, kind in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *made])

    types = {"bigint": T.LongType(), "double": T.DoubleType()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, types[kind]) for name, kind in made.items())])
    return df.mapInArrow(go, schema)


def with_output(df: DataFrame, net: Network, name: str = "net") -> DataFrame:
    return _over_batches(df, {name: "double"}, lambda flat, sizes, bucket: forward(net, flat, sizes, bucket))


def with_score(df: DataFrame, net: Network, name: str = "score", narrow: bool = False) -> DataFrame:
    """df with the integer score of the variant's kernel."""
    if net.variant.chess:
        if narrow:
            raise ValueError("the chess kernel has no narrow accumulator")
        return _over_batches(df, {name: "bigint"}, lambda *x: score_cp(net, *x))
    return _over_batches(df, {name: "bigint"}, lambda *x: score16(net, *x, narrow=narrow))


def error(rows: DataFrame, k: float, output: Column) -> DataFrame:
    """One row, mse: of y against the sigmoid of anchor and output over the holdout; NaN where it is empty."""
    off = F.col("y") - L.sigmoid(F.lit(k) * (F.col("anchor") + output))
    return rows.where("is_valid").agg(F.coalesce(F.avg(off * off), F.lit(float("nan"))).alias("mse"))


def anchor_mse(rows: DataFrame, k: float) -> DataFrame:
    return error(rows, k, F.lit(0.0))


def mse(rows: DataFrame, net: Network, k: float) -> DataFrame:
    """The error of a float or a quantized network."""
    held = rows.where("is_valid")
    if not net.quantized:
        return error(with_output(held, net), k, F.col("net"))
    return error(with_score(held, net), k, F.col("score") if net.variant.chess else F.col("score") / 16)


def acc_bound(rows: DataFrame, net: Network) -> DataFrame:
    """One row, lo <= 0 and hi >= 0: the bounds of all accumulators, before they are clipped."""
    each = _over_batches(rows, {"lo": "bigint", "hi": "bigint"}, lambda *x: bounds(net, *x))
    return each.agg(F.coalesce(F.least(F.min("lo"), F.lit(0)), F.lit(0)).alias("lo"), F.coalesce(F.greatest(F.max("hi"), F.lit(0)), F.lit(0)).alias("hi"))


def worst_case(net: Network, pieces: int) -> int:
    """An accumulator no sample of so many pieces can exceed: the greatest bias and the sum of a unit's greatest weights."""
    top = np.sort(net.w1.astype(np.int64), axis=0)[-pieces:] if pieces else np.zeros((0, net.h), dtype=np.int64)
    return int(net.b1.max()) + int(top.sum(axis=0).max(initial=0))
