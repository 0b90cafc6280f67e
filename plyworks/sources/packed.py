"""Packed corpora: one binary file of features and labelled samples. Little-endian, both versions of the layout.

Header: magic, version, 16 bytes of name, in version 2 the kernel, then cells, features, buckets, the counters, holdout, lambda,
in version 2 K, and the pool's length; then the pool of 16-bit features, and 19 bytes for each sample, training side first.
"""

from __future__ import annotations

import math
import os
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plyworks.operators import samples as S
from plyworks.variants import Variant, get

HEADER_MAX = 128
RECORD = np.dtype([("off", "<i4"), ("end", "<i4"), ("anchor", "<i2"), ("bucket", "u1"), ("y", "<f8")])
_LAYOUT = {1: "<4sI16sIIIQQQQQQIdQ", 2: "<4sI16sIIIIQQQQQQIddQ"}
SCHEMA = "first_ord bigint, features array<int>, anchor smallint, bucket tinyint, y double, is_valid boolean"


@dataclass(frozen=True)
class Info:
    magic: str
    version: int
    name: str
    kernel: int | None
    cells: int
    n_features: int
    buckets: int
    lines: int
    unique: int
    train: int
    valid: int
    tbskip: int
    evalpos: int
    holdout: int
    lam: float
    k_scale: float | None
    pool: int
    header: int

    @property
    def size(self) -> int:
        """The length the whole file must have."""
        return self.header + 2 * self.pool + RECORD.itemsize * (self.train + self.valid)


def parse_header(raw: bytes, path: str = "") -> Info:
    """The header of a file's first bytes; the body isn't looked at."""
    magic = raw[:4]
    version = {b"NTC1": 1, b"NTC2": 2}.get(magic)
    if version is None:
        raise ValueError(f"{path}: not a packed corpus")
    size = struct.calcsize(_LAYOUT[version])
    if len(raw) >= 8 and struct.unpack_from("<I", raw, 4)[0] != version:
        raise ValueError(f"{path}: unsupported version")
    if len(raw) < size:
        raise ValueError(f"{path}: header truncated at byte {len(raw)}")
    found = list(struct.unpack_from(_LAYOUT[version], raw))
    name = found[2].split(b"\0")[0].decode("latin-1")
    kernel = found.pop(3) if version == 2 else None
    k_scale = found.pop(14) if version == 2 else None
    cells, n_features, buckets, lines, unique, train, valid, tbskip, evalpos, holdout, lam, pool = found[3:]
    return Info(magic.decode(), version, name, kernel, cells, n_features, buckets, lines, unique, train, valid, tbskip, evalpos, holdout, lam, k_scale, pool, size)


def read_header(path: str) -> Info:
    with open(path, "rb") as f:
        return parse_header(f.read(HEADER_MAX), path)


def check(info: Info, v: Variant, size: int | None = None, path: str = "") -> None:
    """Raises unless the file is of the variant and as long as its header says."""
    if info.name != v.name:
        raise ValueError(f"{path} holds variant {info.name!r}, not {v.name!r}")
    if info.kernel is None and v.chess:
        raise ValueError(f"{path}: this version can't hold chess; pack it again")
    if info.kernel is not None and info.kernel != int(v.chess):
        raise ValueError(f"{path} is of the other kernel")
    if (info.cells, info.n_features) != (v.cells, v.n_features):
        raise ValueError(f"{path}: geometry mismatch (cells {info.cells}/{v.cells}, features {info.n_features}/{v.n_features})")
    if size is not None and size != info.size:
        raise ValueError(f"{path}: {size} bytes where the header describes {info.size} (truncated or corrupt)")


def write(path: str, v: Variant, rows: DataFrame, stats, how: S.Labels) -> Info:
    """Writes samples in the order of first_ord, training side first.

    Features and samples are streamed through the driver part by part, as the layout is one file; Parquet is the format for
    what is too large for that.
    """
    offsets = S.with_offsets(rows)
    pool = int(rows.agg(F.coalesce(F.sum(F.size("features")), F.lit(0))).first()[0])
    if pool >= 1 << 31:
        raise ValueError("the pool exceeds the layout's 32-bit offsets")
    head = struct.pack(
        _LAYOUT[2], b"NTC2", 2, v.name.encode().ljust(16, b"\0")[:16], int(v.chess), v.cells, v.n_features, v.buckets,
        stats["lines"], stats["unique"], stats["train"], stats["valid"], stats["tbskip"], stats["evalpos"], how.every, how.lam, how.k(v), pool,
    )
    with open(path, "wb") as f:
        f.write(head)
        for row in rows.orderBy("first_ord").select("features").toLocalIterator():
            f.write(np.array(row["features"], dtype="<u2").tobytes())
        for side in (False, True):
            part = offsets.where(F.col("is_valid") == side).orderBy("first_ord").select("off", "end", "anchor", "bucket", "y")
            for r in part.toLocalIterator():
                f.write(np.array([tuple(r)], dtype=RECORD).tobytes())
    return read_header(path)


class PackedPart(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


def _bad(records: np.ndarray, info: Info) -> str | None:
    if (records["off"] < 0).any() or (records["end"] < records["off"]).any() or (records["end"] > info.pool).any():
        return "a sample lies outside the pool"
    if (records["bucket"] >= info.buckets).any():
        return "a bucket is out of range"
    return None


class PackedReader(DataSourceReader):
    """Ranges of records; each task reads its own records and the stretch of the pool they use."""

    def __init__(self, path: str, variant: str | None, rows: int):
        self.path, self.rows = path, rows
        self.info = read_header(path)
        check(self.info, get(variant or self.info.name), os.path.getsize(path), path)

    def partitions(self):
        n = self.info.train + self.info.valid
        return [PackedPart(i, min(self.rows, n - i)) for i in range(0, n, self.rows)]

    def read(self, part):
        import pyarrow as pa

        info = self.info
        with open(self.path, "rb") as f:
            f.seek(info.header + 2 * info.pool + RECORD.itemsize * part.first)
            records = np.frombuffer(f.read(RECORD.itemsize * part.count), RECORD)
            if wrong := _bad(records, info):
                raise ValueError(f"{self.path}: {wrong}")
            low = int(records["off"].min(initial=info.pool))
            f.seek(info.header + 2 * low)
            pool = np.frombuffer(f.read(2 * (int(records["end"].max(initial=low)) - low)), "<u2").astype(np.int32)
        if (pool >= info.n_features).any():
            raise ValueError(f"{self.path}: a feature is out of range")
        lengths = (records["end"] - records["off"]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(records["off"].astype(np.int64) - low - offsets[:-1], lengths) + np.arange(offsets[-1])
        features = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(pool[take]))
        order = np.arange(part.first, part.first + len(records))
        columns = [pa.array(order), features, pa.array(records["anchor"].astype(np.int16)), pa.array(records["bucket"].astype(np.int8)), pa.array(records["y"].astype(np.float64)), pa.array(order >= info.train)]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


class PackedSource(DataSource):
    """spark.read.format("ntc").option("path", ...): samples of a packed corpus; first_ord is the record's number."""

    @classmethod
    def name(cls):
        return "ntc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PackedReader(self.options["path"], self.options.get("variant"), int(self.options.get("rows", 100_000)))


def read(spark: SparkSession, path: str, v: Variant | None = None, rows: int = 100_000) -> DataFrame:
    spark.dataSource.register(PackedSource)
    source = spark.read.format("ntc").option("path", path).option("rows", rows)
    return (source.option("variant", v.name) if v else source).load()


def stored_k(info: Info) -> float:
    """K of the corpus: version 1 has none and means draughts' own."""
    return info.k_scale if info.k_scale is not None and not math.isnan(info.k_scale) else 1 / 256
