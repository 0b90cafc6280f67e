"""SimHash near-dedup by anchor points.

A 64-bit fingerprint is cut into segments so that two fingerprints within the distance agree closely in one of them. The anchors
of a segment are a covering code, a product of perfect Hamming codes of 15 bits and free bits. Each fingerprint has one home
anchor, within the covering radius, and is replicated to every anchor within the radius plus the segment's threshold; of two
fingerprints that are that close in the segment, the home of either is an anchor of the other, so comparing per anchor finds
every link. Only distinct fingerprints are replicated, and an anchor's links leave it as a spanning forest, never as all pairs.

Results for odd input: a null or empty text has fingerprint 0 and is linked like any other; repeated rows share their
fingerprint and component; null ids never name a component unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce
from itertools import combinations
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyworks.llm.common import OWN, materialize
from plyworks.llm.url_filters import _bits, _block, blocks_for, bloom_filter

DISTANCE, SHINGLE, SEED = 4, 4, 42
#: Hashes that are turned into bits at once, for very long texts.
BLOCK = 1 << 16


def fingerprint(text: bytes | str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    raw = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not raw:
        return 0
    joined, ends, at = b" ".join(raw), [], -1
    for n in map(len, raw):
        at += n + 1
        ends.append(at)
    size = min(size, len(raw))
    starts = [0, *(e + 1 for e in ends[: len(raw) - size])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])), dtype="<u8", count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and OWN + fp, a signed long."""
    import pyarrow as pa

    columns, out = list(keep), OWN + "fp"
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + f", {out} bigint"

    def run(batches):
        for batch in batches:
            texts = batch.column(len(columns))
            found = np.array([fingerprint(x.as_py()) for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))] + [pa.array(found)], names=[*columns, out])

    return docs.select(*columns, F.col(text).cast("string").cast("binary").alias(OWN + "text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Segment:
    """Bits [offset, offset + width); its first 15 * codes bits are covered by Hamming codes, one flip each; the rest is free."""

    offset: int
    width: int
    codes: int
    threshold: int

    @property
    def reach(self) -> int:
        return self.codes + self.threshold


#: Replicas of a fingerprint and rows of an anchor per fingerprint: 43.5 and N / 9,000; 324 and N / 104,000.
COARSE = (Segment(0, 21, 1, 1), Segment(21, 21, 1, 1), Segment(42, 22, 1, 1))
FINE = (Segment(0, 32, 2, 2), Segment(32, 32, 2, 2))
#: From so many distinct fingerprints on, the comparisons saved outweigh the replicas of the finer code. Both are exact.
FINE_FROM = 8_000_000


@cache
def _syndromes() -> np.ndarray:
    """Of every 15-bit word in the perfect Hamming code: the number of the bit to flip, 0 for a code word."""
    words = np.arange(1 << 15, dtype=np.uint16)
    out = np.zeros(1 << 15, dtype=np.uint8)
    for bit in range(15):
        out ^= np.where(words >> bit & 1, np.uint8(bit + 1), np.uint8(0))
    return out


def _syndrome(values: np.ndarray, codes: int) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.int64)
    for k in range(codes):
        out |= _syndromes()[(values >> np.uint64(15 * k)) & np.uint64(0x7FFF)].astype(np.int64) << 4 * k
    return out


@cache
def _flips(segment: Segment) -> tuple[list[np.ndarray], np.ndarray]:
    """For each syndrome the masks of at most `reach` flips that lead to an anchor, and the one that leads home."""
    masks = np.array([sum(1 << b for b in c) for n in range(segment.reach + 1) for c in combinations(range(segment.width), n)], dtype=np.uint64)
    which = _syndrome(masks, segment.codes)
    homes = np.array([sum(1 << (15 * k + ((s >> 4 * k & 15) - 1)) for k in range(segment.codes) if s >> 4 * k & 15) for s in range(16**segment.codes)], dtype=np.uint64)
    return [masks[which == s] for s in range(16**segment.codes)], homes


def replicate(distinct: DataFrame, design: tuple[Segment, ...]) -> DataFrame:
    """(anchor, fp, home) from (fp)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for no, segment in enumerate(design):
                values = fps >> np.uint64(segment.offset) & np.uint64((1 << segment.width) - 1)
                which = _syndrome(values, segment.codes)
                masks, homes = _flips(segment)
                order = np.argsort(which, kind="stable")
                bounds = np.searchsorted(which[order], np.arange(16**segment.codes + 1))
                for s in range(16**segment.codes):
                    rows = order[bounds[s] : bounds[s + 1]]
                    for i in range(0, len(rows), 4096):
                        part = rows[i : i + 4096]
                        anchors = values[part][:, None] ^ masks[s][None, :]
                        if not anchors.size:
                            continue
                        home = np.broadcast_to(masks[s] == homes[s], anchors.shape)
                        yield pa.RecordBatch.from_arrays([pa.array((anchors | np.uint64(no << 40)).ravel().view(np.int64)), pa.array(np.repeat(fps[part], anchors.shape[1]).view(np.int64)), pa.array(home.ravel())], names=["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor bigint, fp bigint, home boolean")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a[i], b[i]) as stars: each member but the least of its component, and the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


#: Comparisons that are made in one numpy call, and the size of an anchor from which it is walked instead.
PAIRS, WALK = 1 << 21, 4 << 20


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bits in which fingerprints differ. They are numbers, or rows of two."""
    bits = np.bitwise_count(x ^ y)
    return bits if bits.ndim == 1 else bits[:, 0] + bits[:, 1]


def _node(x: np.ndarray) -> np.ndarray:
    """What fingerprints are linked by: themselves, or the first number of each row."""
    return x if x.ndim == 1 else x[:, 0]


def _walk(fps: np.ndarray, distance: int, nodes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of a large anchor: every fingerprint is compared only with those no component has reached yet."""
    left, names, a, b = fps, _node(fps) if nodes is None else nodes, [], []
    while len(left):
        root, left, names, queue = names[0], left[1:], names[1:], [left[0]]
        while queue and len(left):
            near = _apart(left, queue.pop()) <= distance
            if near.any():
                queue.extend(left[near])
                a.append(names[near])
                b.append(np.full(len(a[-1]), root))
                left, names = left[~near], names[~near]
    none = np.zeros(0, dtype=np.uint64)
    a, b = (np.concatenate(a), np.concatenate(b)) if a else (none, none)
    return (a, b) if nodes is None or not (a != b).any() else forest(a[a != b], b[a != b])


def _compare(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, distance: int, nodes: np.ndarray | None = None):
    """Links within whole anchors; rows are sorted by anchor. Homes are compared with all rows of their anchor.

    nodes has what each row is linked by, else fingerprints are linked themselves.
    """
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(starts, len(anchor)))
    group = np.repeat(np.arange(len(starts)), sizes)
    homes = np.bincount(group[home], minlength=len(starts))
    large = homes * sizes > WALK
    for g in np.flatnonzero(large):
        part, first = np.unique(fps[starts[g] : starts[g] + sizes[g]], axis=0, return_index=True)
        yield _walk(part, distance, None if nodes is None else nodes[starts[g] + first])
    rows = np.flatnonzero(home & ~large[group] & (sizes[group] > 1))
    costs = np.cumsum(sizes[group[rows]])
    at, most = 0, PAIRS if fps.ndim == 1 else PAIRS >> 3
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(costs, (costs[at - 1] if at else 0) + most, side="right")))
        part = rows[at:to]
        n = sizes[group[part]]
        left = np.repeat(part, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[part]], n)
        x, y = fps[left], fps[right]
        near = np.flatnonzero(_apart(x, y) <= distance)
        x, y = (_node(x[near]), _node(y[near])) if nodes is None else (nodes[left[near]], nodes[right[near]])
        if (x != y).any():
            yield forest(x[x != y], y[x != y])
        at = to


def links(replicas: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): stars of linked fingerprints, from replicas; every link within an anchor lies in one star.

    Replicas may have a second word of their fingerprints, `more`; links are then those of the first words. They may have a
    `root` of earlier links: then roots are linked, so that nothing is said again of rows that have the same one.
    """
    import pyarrow as pa

    columns = ["anchor", *[c for c in ("fp", "more") if c in replicas.columns], "home", *[c for c in ("root",) if c in replicas.columns]]

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        names = ["a", "b"]

        def out(rows):
            for a, b in _compare(*rows[:3], distance, *rows[3:]):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

        def joined():
            return tuple(np.concatenate(x) for x in zip(*held))

        for batch in batches:
            if not batch.num_rows:
                continue
            found = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
            anchor, fps = found["anchor"], found["fp"] if "more" not in found else np.stack([found["fp"], found["more"]], axis=1)
            held.append((anchor, fps.view(np.uint64), found["home"], *[found[c].view(np.uint64) for c in ("root",) if c in found]))
            last = np.searchsorted(anchor, anchor[-1])
            if anchor[0] == anchor[-1] or sum(len(x[0]) for x in held) < 1 << 17:
                continue
            rest = tuple(x[last:] for x in held[-1])
            held[-1] = tuple(x[:last] for x in held[-1])
            yield from out(joined())
            held = [rest]
        if held:
            yield from out(joined())

    return replicas.select(columns).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): each node that has a link, but the roots, with the least node of its component, by alternating stars.

    Both star operations are an aggregation and a join on a node; a hub has many rows on one side only, which the planner may
    split. Every round is a written table.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    told = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    mark = told(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct(), label)
        before, mark = mark, told(now)
        if tuple(before) == tuple(mark):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE, design: tuple[Segment, ...] | None = None) -> DataFrame:
    """(doc_id, OWN + fp, component_id) of each row."""
    if distance > DISTANCE:
        raise ValueError(f"the segments' thresholds are made for a distance of {DISTANCE} at most")
    rows = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "simhash")
    distinct = materialize(rows.groupBy(F.col(OWN + "fp").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash-distinct")
    design = design or (FINE if distinct.count() >= FINE_FROM else COARSE)
    roots = components(links(replicate(distinct, design), distance), "simhash-links")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("fp").alias(OWN + "fp"), "component_id")
    return rows.join(named, OWN + "fp").select("doc_id", OWN + "fp", "component_id")


#: Rows of ids that are broadcast to the texts. Beyond it texts meet a Bloom filter of the ids, and what it lets through alone is shuffled.
FEW = 1 << 18


def possible(docs: DataFrame, key: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs that a Bloom filter of the one column of keys lets through: all whose key is there, and few others. With left_anti the rest."""
    n = blocks_for(keys.count())
    table = F.broadcast(bloom_filter(keys.toDF("key"), n))
    hit = [F.col(f"{OWN}w{i}").bitwiseAND(bit) != 0 for i, bit in enumerate(_bits(F.col(key)))]
    return docs.join(table, reduce(and_, hit, _block(F.col(key), n) == F.col(OWN + "block")), how)


def keep_first(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Of docs the rows that keep_one keeps, where found has the (doc_id, component_id) of each row."""
    found = materialize(found, "dedup-found")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(OWN + "gone")).distinct()
    again = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(OWN + "again"))
    those = F.col(doc_id) == F.col(OWN + "gone")
    if gone.count() <= FEW:
        left = docs.join(F.broadcast(gone), those, "left_anti")
    else:
        left = possible(docs, doc_id, gone, "left_anti").unionByName(possible(docs, doc_id, gone).join(gone, those, "left_anti"))
    # Without repeated ids one join moves the texts, not four.
    if again.isEmpty():
        return left
    once = left.join(again, F.col(doc_id) == F.col(OWN + "again"), "left_anti")
    return once.unionByName(left.join(again, F.col(doc_id) == F.col(OWN + "again"), "left_semi").dropDuplicates([doc_id]))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The document of the least id of each component, once if its row is repeated; rows without an id stay."""
    return keep_first(docs, dedup(docs, text, doc_id), doc_id)
