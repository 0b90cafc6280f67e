"""Finding corpora: data folders, packed files and globs, through Hadoop's file systems, so any store Spark reads will do."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plyworks.functions.lines import fnv1a_of
from plyworks.variants import Variant

GROUP_KEYS = ("rel", "path", "basename")
#: Files are laid out in units of at most this many bytes for ordinals.
UNIT = 1 << 20


@dataclass(frozen=True)
class Found:
    """A packed corpus, or globs of text files, or neither; and the roots that were searched."""

    packed: str | None
    globs: tuple[str, ...]
    searched: tuple[str, ...]


@dataclass(frozen=True)
class File:
    path: str
    uri: str
    size: int
    #: What Spark is given to read it: not encoded, and nothing in it taken for a pattern.
    readable: str = ""

    @property
    def folder(self) -> str:
        return os.path.basename(os.path.dirname(self.path))

    @property
    def basename(self) -> str:
        return os.path.basename(self.path)


def roots(*places: str) -> tuple[str, ...]:
    """Absolute roots in order, each once; by default the data folder of the working directory."""
    return tuple(dict.fromkeys(p if "://" in p else os.path.abspath(p) for p in places or (os.path.join(os.getcwd(), "data"),)))


def listed(spark: SparkSession, pattern: str) -> list[File]:
    """Files that match a glob, by path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    files = [s for s in found if s.isFile()]
    out = [File(s.getPath().toUri().getPath() if s.getPath().toUri().getScheme() in (None, "file") else str(s.getPath()), str(s.getPath().toUri().toString()), s.getLen(), re.sub(r"([\[\]{}*?\\])", r"\\\1", str(s.getPath().toString()))) for s in files]
    return sorted(out, key=lambda f: f.path.encode())


def discover(spark: SparkSession, v: Variant, places: tuple[str, ...]) -> Found:
    """The first root that has anything wins, and in it a packed corpus over text. Roots are never merged."""
    for root in places:
        packed = f"{root}/{v.name}.ntc"
        if listed(spark, packed):
            return Found(packed, (), ())
        globs = tuple(g for g in (f"{root}/{folder}/*.txt" for folder in v.data_folders) if listed(spark, g))
        if globs:
            return Found(None, globs, ())
    return Found(None, (), places)


def expand(spark: SparkSession, globs) -> list[File]:
    """All matches of all globs by path; a file that two globs match is there twice."""
    out = sorted((f for g in globs for f in listed(spark, g)), key=lambda f: f.path.encode())
    if not out:
        raise FileNotFoundError(f"no files match {list(globs)}")
    hidden = [f.path for f in out if f.basename[0] in "._"]
    if hidden:
        raise ValueError(f"Spark doesn't read files whose names start with a dot or underscore: {hidden}")
    return out


def qualifier(f: File, v: Variant, group_key: str = "rel") -> str:
    """What tells a file's games from another's."""
    if group_key not in GROUP_KEYS:
        raise ValueError(f"the group key is one of {', '.join(GROUP_KEYS)}, not {group_key!r}")
    if group_key == "rel":
        return f"{f.folder if v.chess else v.name}/{f.basename}"
    return f.path if group_key == "path" else f.basename


def unit_of(spark: SparkSession) -> int:
    """The bytes of a unit, a power of two that no split is smaller than, but a file's last."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    least = min(size(spark.conf.get(f"spark.sql.files.{x}")) for x in ("maxPartitionBytes", "openCostInBytes"))
    return min(UNIT, 1 << max(0, least.bit_length() - 1))


def files_table(spark: SparkSession, files: list[File], v: Variant, group_key: str = "rel") -> DataFrame:
    """(file_idx, path, uri, qual_hash, first_unit): first_unit is where the file starts if all are laid end to end in units."""
    rows, at, unit = [], 0, unit_of(spark)
    for i, f in enumerate(files):
        rows.append((i, f.path, f.uri, fnv1a_of((qualifier(f, v, group_key) + ":").encode()), at))
        at += f.size // unit + 1
    if at >= 1 << 30:
        raise ValueError(f"the files exceed the ordinals' range of 2^30 units of {unit} bytes")
    return spark.createDataFrame(rows, "file_idx int, path string, uri string, qual_hash bigint, first_unit bigint")
