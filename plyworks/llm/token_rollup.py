"""Token counts kept as rollups of signed changes.

A change inserts, deletes or revises a document; it adds its counts with a sign to the totals of its source, language and
tokenizer version. Each batch is aggregated and committed under its name, once: it is written aside and renamed into place, and
a name that is there already changes nothing, so batches can be sent again after a failure; with other changes it is an error.
Totals are the sum over batches, which can be compacted.

Results for odd input: null texts count nothing; a null source or language is a group of its own; a group whose counts have all
been taken back shows zeros; an empty batch is committed and adds nothing. There must be one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyworks.llm.common import OWN, WORD
from plyworks.llm.lexicon import pieces, strings

KEYS = ("source", "lang", "tokenizer")
#: Of the bounds of the tokenizers' caches, as one worker holds those of several.
WORD_SHARE, BYTE_SHARE = 0.5, 1
SCHEMA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def native_counters() -> dict[str, callable]:
    """Tokenizer versions that built-in functions count: words between blanks, and bytes."""
    none = F.lit(0).cast("long")
    return {
        "words/1": lambda text: F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), none),
        "bytes/1": lambda text: F.coalesce(F.octet_length(text).cast("long"), none),
    }


def tokenizer_counter(path: str):
    """A counter for any file of the tokenizers library: whole texts go through the whole tokenizer."""
    def count(texts: pa.Array, first: bool) -> np.ndarray:
        from tokenizers import Tokenizer

        from plyworks.llm.common import worker_state

        held = worker_state().__dict__.setdefault("counters", {})
        if path not in held:
            held[path] = Tokenizer.from_file(path)
        return np.array([len(x.ids) for x in held[path].encode_batch_fast(texts.to_pylist(), add_special_tokens=False)], dtype=np.int64)

    return _counter(count)


def _counter(count):
    """A function of a text column, with a member `together`: of several columns, to an array of their counts. count gets a column's part, and whether it is the first of its row's."""
    def counts(texts: tuple[pa.Array, ...]) -> np.ndarray:
        batch = pa.RecordBatch.from_arrays([strings(x) for x in texts], names=[str(i) for i in range(len(texts))])
        parts = [np.stack([count(x, i == 0) for i, x in enumerate(part.columns)], axis=1) for part in pieces(batch, 0)]
        return np.concatenate([np.zeros((0, len(texts)), np.int64), *parts])

    @F.arrow_udf("long")
    def one(texts: pa.Array) -> pa.Array:
        return pa.array(counts((texts,))[:, 0])

    @F.arrow_udf("array<long>")
    def many(*texts: pa.Array) -> pa.Array:
        found = counts(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(texts), pa.int32()), pa.array(found.ravel()))

    def counter(text: Column) -> Column:
        return one(text.cast("string"))

    counter.together = lambda *texts: many(*(x.cast("string") for x in texts))
    return counter


def word_counter(path: str):
    """A counter for a tokenizer file whose words never reach over a blank: each word is encoded once."""
    def count(texts: pa.Array, first: bool) -> np.ndarray:
        from plyworks.llm.repair_store import word_encoder

        return word_encoder(path, WORD_SHARE).count_column(texts, first)

    return _counter(count)


def byte_counter(path: str, pattern: str):
    """A counter for a file of byte-level ranks."""
    def count(texts: pa.Array, first: bool) -> np.ndarray:
        from plyworks.llm.prefix_bpe import vocabulary

        return vocabulary(path, pattern, BYTE_SHARE).count_column(texts, first)

    return _counter(count)


def counted_together(docs: DataFrame, texts: Mapping[str, Column], counters: Mapping[str, callable]) -> DataFrame:
    """docs with a map<tokenizer, tokens> of each name in texts; a tokenizer sees the texts of a row together, so that what they share is looked up once."""
    all_of = {k: f.together(*texts.values()) for k, f in counters.items() if hasattr(f, "together")}
    docs = docs.withColumns({f"{OWN}{i}": c for i, c in enumerate(all_of.values())})
    place = {k: f"{OWN}{i}" for i, k in enumerate(all_of)}
    said = lambda k, f, n, text: F.get(place[k], F.lit(n)) if k in place else f(text)
    docs = docs.withColumns({name: F.create_map(*(x for k, f in counters.items() for x in (F.lit(k), said(k, f, n, text)))) for n, (name, text) in enumerate(texts.items())})
    return docs.drop(*place.values())


def counted(docs: DataFrame, text: Column, counters: Mapping[str, callable], name: str) -> DataFrame:
    """docs with a map<tokenizer, tokens> of that name."""
    return docs.withColumn(name, F.create_map(*(x for k, f in counters.items() for x in (F.lit(k), f(text)))))


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, documents, tokens) additions from (op, source, lang, counts, old_source, old_lang, old_counts): old ones are those of a deleted or revised document."""
    side = lambda test, sign, prefix: F.when(F.col("op").isin(*test), F.struct(F.lit(sign).alias("sign"), F.col(prefix + "source").alias("source"), F.col(prefix + "lang").alias("lang"), F.col(prefix + "counts").alias("counts")))
    both = F.array_compact(F.array(side(("insert", "revise"), 1, ""), side(("delete", "revise"), -1, "old_")))
    rows = changes.select(F.explode(both).alias("c")).select("c.sign", "c.source", "c.lang", F.explode("c.counts").alias("tokenizer", "n"))
    return rows.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("n")).cast("long").alias("tokens"))


class OtherContent(ValueError):
    """A batch's name was sent again with other changes."""


class Rollups:
    """Committed batches in a folder.

    A batch is a table of the folder batches/<name>, with the digest of its additions in its name's file in digests/. compact()
    sums batches into one table of bases/<number>; the names it covers are listed in it, so that sent again they add nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _place(self, batch: str) -> str:
        if not batch or batch[0] == "_" or any(c in batch for c in "/\\.:"):
            raise ValueError("a batch's name is one plain folder name, and doesn't start with _")
        return f"{self.path}/batches/{batch}"

    def _base(self) -> tuple[str | None, dict[str, str]]:
        """The newest base and the batches it holds, with their digests."""
        found = self._names("bases")
        if not found:
            return None, {}
        base = f"{self.path}/bases/{max(found, key=int)}"
        return f"{base}/totals", {r["batch"]: r["digest"] for r in self.spark.read.schema("batch string, digest string").parquet(f"{base}/held").collect()}

    def _digest(self, batch: str) -> str | None:
        """The digest of a committed batch."""
        held = self._base()[1]
        if batch in held:
            return held[batch]
        place = self._place(batch)
        fs, at = self._fs(place)
        return self.spark.read.schema("digest string").parquet(f"{place}/digest").first()["digest"] if fs.exists(at) else None

    def committed(self, batch: str) -> bool:
        self._place(batch)
        return self._digest(batch) is not None

    def _rename(self, aside: str, place: str) -> bool:
        fs, source = self._fs(aside)
        to = self._fs(place)[1]
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(source, to):
            fs.delete(source, True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch was added now; False if it had been. The same name with other changes is an error.

        Additions and their digest are written aside and renamed into place together, so a crash leaves all or nothing.
        """
        place, aside = self._place(batch), f"{self.path}/aside/{uuid.uuid4().hex}"
        before = self._digest(batch)
        signed(changes).write.parquet(f"{aside}/additions")
        rows = self.spark.read.schema(SCHEMA).parquet(f"{aside}/additions")
        digest = "/".join(map(str, rows.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0))).first()))
        if before is not None:
            fs, at = self._fs(aside)
            fs.delete(at, True)
            if before != digest:
                raise OtherContent(f"batch {batch!r} was committed with other changes")
            return False
        self.spark.range(1).select(F.lit(digest).alias("digest")).write.parquet(f"{aside}/digest")
        return self._rename(aside, place)

    def compact(self) -> int:
        """Sums the newest base and all batches into a new base, and removes them; gives the number of batches summed."""
        batches = self._names("batches")
        if not batches:
            return 0
        held = self._base()[1] | {b: self._digest(b) for b in batches}
        aside, number = f"{self.path}/aside/{uuid.uuid4().hex}", max(map(int, self._names("bases")), default=0) + 1
        self.totals().write.parquet(f"{aside}/totals")
        self.spark.createDataFrame(sorted(held.items()), "batch string, digest string").write.parquet(f"{aside}/held")
        if not self._rename(aside, f"{self.path}/bases/{number}"):
            return 0
        # A crash from here on leaves batches behind that the new base holds; totals() passes over them.
        for folder in (*(f"batches/{b}" for b in batches), *(f"bases/{n}" for n in self._names("bases") if int(n) < number)):
            fs, at = self._fs(f"{self.path}/{folder}")
            fs.delete(at, True)
        return len(batches)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over the newest base and all batches that it doesn't hold."""
        base, held = self._base()
        found = [f"{self.path}/batches/{b}/additions" for b in self._names("batches") if b not in held] + ([base] if base else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
