"""What the corpus operators share: table access, the shared folder, word rules and worker caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Internal columns start like this, so that no column of the caller's clashes with them.
OWN = "__pw_"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. A temporary one of our own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plyworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later steps survive lost executors and reuse it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plyworks/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows of an array that are folded by one appended list.
FOLD = 256


def running(items: Column, step, kind: str) -> Column:
    """array<kind> of what step(at, item) -> (next at, output) puts out along an array, at being 0 in the beginning; null outputs are left out.

    Appending copies a list, so outputs are appended to short lists and these to a list of lists.
    """
    empty = lambda k: F.array().cast(f"array<{k}>")

    def one(state: Column, item: Column) -> Column:
        at, out = step(state["at"], item)
        return F.struct(at.alias("at"), F.array_append(state["out"], out).alias("out"))

    def along(whole: Column) -> Column:
        def many(state: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(whole, k * FOLD + 1, F.lit(FOLD)), F.struct(state["at"].alias("at"), empty(kind).alias("out")), one)
            return let(part, lambda p: F.struct(p["at"].alias("at"), F.array_append(state["out"], F.array_compact(p["out"])).alias("out")))

        last = F.greatest(F.ceil(F.size(whole) / FOLD).cast("int") - 1, F.lit(0))
        start = F.struct(F.lit(0).alias("at"), empty(f"array<{kind}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), last), start, many, lambda s: F.flatten(s["out"]))

    return let(items, along)


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def worker_state() -> types.ModuleType:
    """A place for caches that live as long as a Python worker, whatever way its functions were shipped."""
    return sys.modules.setdefault("plyworks_worker_state", types.ModuleType("plyworks_worker_state"))


def forget() -> None:
    """Empties those caches: a worker is used again by later stages, which need the memory for their own."""
    worker_state().__dict__.get("vocabularies", {}).clear()


#: Rows of an Arrow batch of whole texts: both the JVM and the worker hold a batch, outside the heap.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Lets the session's Arrow batches have BATCH rows at most from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH:
        spark.conf.set(name, str(BATCH))
