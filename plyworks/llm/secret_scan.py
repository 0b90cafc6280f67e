"""Secret scans: spans found by patterns, then told apart by how many repositories and owners hold the same value.

Values are hashed, and each hash is counted over the whole corpus by distinct repository and owner. One that many owners hold
is a copied example; the others are live-looking credentials of their owner.

Results for odd input: a null or empty text has no spans; a null repository or owner counts as one of its own; repeated rows
are scanned one by one and add nothing to the counts; an empty table gives an empty result. Positions are in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyworks.llm.common import OWN, let, materialize, running, text_of


@dataclass(frozen=True)
class Detector:
    """Leftmost non-overlapping matches of pattern whose group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_KEYS = "(?i:password|passwd|secret|token|api_?key)"
#: In the order in which spans of one start are listed. Runs that are too short are dropped either way, so their least length is in the pattern where that can't change the other matches.
BASE = (
    Detector("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Detector("access", r"AKIA[A-Z0-9]{14,}"),
    Detector("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Detector("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Detector("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Detector("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Detector("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]{0,24}PRIVATE KEY-----"),
)
#: A value held by so many owners, or by so many repositories, is a copied example.
OWNERS, REPOSITORIES = 3, 8
#: Characters of the parts in which places of a text are found.
PART = 4096


_SPAN = "struct<start:int,no:int,kind:string,end:int,value:string>"


def spans_of(text: str, no: int, d: Detector) -> Column:
    """array<struct<start, no, kind, end, value>> of one detector, from the pieces between its matches."""
    found = F.regexp_extract_all(F.col(text), F.lit(d.pattern), F.lit(0))
    values = F.regexp_extract_all(F.col(text), F.lit(d.pattern), F.lit(d.group)) if d.group else found
    both = F.arrays_zip(F.split(F.col(text), d.pattern, -1).alias("gap"), found.alias("match"), values.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(no).alias("no"), F.lit(d.kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return end, F.when(F.length(x["value"]) >= d.least, span)

    return F.when(F.col(text).rlike(d.pattern), running(both, step, _SPAN)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find(docs: DataFrame, text: str = "text", detectors=BASE + MORE) -> DataFrame:
    """docs with OWN + spans, by start and then by the detectors' order, with the SHA-256 of each value in its place."""
    out = docs.withColumn(OWN + "text", text_of(text))
    out = out.withColumn(OWN + "spans", F.array_sort(F.concat(*(spans_of(OWN + "text", i, d) for i, d in enumerate(detectors)))))
    spans = F.transform(OWN + "spans", lambda s: F.struct(s["start"], s["no"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash")))
    return out.withColumn(OWN + "spans", spans).drop(OWN + "text")


def ownership(found: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """(hash, n_repositories, n_owners, copied) of every value, from rows with OWN + spans, repository and owner.

    Each task first reduces its rows to distinct (hash, repository, owner), so a value that is everywhere costs a task one row
    for each pair, and two counts of distinct pairs follow.
    """
    c = lambda x: OWN + x
    held = found.select(F.explode(F.transform(c("spans"), lambda s: s["hash"])).alias("hash"), c("repository"), c("owner")).distinct()
    per_owner = held.groupBy("hash", c("owner")).agg(F.count("*").alias("repositories"))
    counted = per_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    return counted.withColumn("copied", (F.col("n_owners") >= owners) | (F.col("n_repositories") >= repositories))


def scan(docs: DataFrame, repository: Column, owner: Column, text: str = "text", detectors=BASE + MORE, keep: list[str] | None = None, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """The columns in keep (default: all) with OWN + spans: array<struct<start,no,kind,end,hash,n_repositories,n_owners,copied>>.

    Patterns run once; what they find is written to the shared folder, and only rows that have spans take part in the joins.
    """
    c = lambda x: OWN + x
    kept = list(docs.columns if keep is None else keep)
    named = docs.withColumns({c("repository"): F.coalesce(repository.cast("string"), F.lit("")), c("owner"): F.coalesce(owner.cast("string"), F.lit(""))})
    found = find(named, text, detectors).withColumn(c("row"), F.monotonically_increasing_id())
    found = materialize(found.select(*kept, *(c(x) for x in ("repository", "owner", "row", "spans"))), "secret-spans")
    some = found.where(F.size(c("spans")) > 0)
    each = some.select(c("row"), F.explode(c("spans")).alias("s")).select(c("row"), "s.*")
    told = each.join(ownership(some, owners, repositories), "hash")
    again = told.groupBy(c("row")).agg(F.array_sort(F.collect_list(F.struct("start", "no", "kind", "end", "hash", "n_repositories", "n_owners", "copied"))).alias(c("told")))
    with_spans = some.join(again, c("row")).select(*kept, F.col(c("told")).alias(c("spans")))
    without = found.where(F.size(c("spans")) == 0).select(*kept, F.array().cast(again.schema[c("told")].dataType).alias(c("spans")))
    return with_spans.unionByName(without)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, repository: Column, owner: Column, text: str = "text", mark: str = "[SECRET]", **how) -> DataFrame:
    """docs with each live-looking span replaced by the mark (touching spans share one); copied examples stay."""
    out = scan(docs, repository, owner, text, **how)
    live = F.filter(OWN + "spans", lambda s: ~s["copied"])
    # A span behind all others at the end of the text closes the list.
    closed = F.array_append(F.transform(live, lambda s: F.struct(s["start"], s["end"], F.lit(mark).alias("mark"))), F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit("").alias("mark")))

    def redacted(parts: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            size = F.greatest(s["start"] - at, F.lit(0))
            first = F.floor(at / PART).cast("int")
            near = F.array_join(F.slice(parts, first + 1, F.floor((at + size) / PART).cast("int") - first + 1), "")
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.concat(F.substring(near, at - first * PART + 1, size), s["mark"]))

        return F.array_join(running(closed, step, "string"), "")

    # A place in a text is found by counting characters from its start, so it is cut into parts first.
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PART).cast("int")), lambda k: F.substring(F.col(text), k * PART + 1, F.lit(PART)))
    clean = let(cut, redacted)
    return out.withColumn(text, F.when(F.size(live) > 0, clean).otherwise(F.col(text))).drop(OWN + "spans")
