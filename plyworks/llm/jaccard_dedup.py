"""Near-dedup by the Jaccard similarity of the sets of words that follow each other, with candidates by SimHash and anchor points.

A text's set is that of its runs of five words, as 64-bit hashes, and its SimHash has WORDS times 64 bits. Two sets of similarity
0.8 have a cosine of 8 / 9 and so differ in 15.2% of these bits. Anchors are the words of a perfect Hamming code of 15 bits in
segments of the fingerprint. In each segment a fingerprint has one home, within the covering radius of 1, and is replicated to all
anchors within 2, so two that differ in one bit of the segment at most meet at the home of either; as one of these meetings is
enough, replicas go to anchors below the home only. A pair at 0.8 is that close in 31% of segments, and the number of segments
makes that fail for all of them at once in MISS of cases. In larger tables segments have free bits too, in which both have to
agree, so that anchors stay small, and there are more segments. Fingerprints that meet are linked as candidates within SLACK of
128 bits (19.4 on average at 0.8, over 36 for one pair in 30,000). The first few segments link most of a group; in the others
only what these have not linked yet is. Each group of candidates then meets with its whole sets, and the similarity itself
decides every link.

Results for odd input: null, empty and blank texts have one set, the empty one, and are linked with each other only; a text of
less than five words has one run, of all its words; repeated rows share their component; null ids never name a component unless
all its ids are null; an empty table gives an empty result. Sets of less than about 20 runs have coarser fingerprints, and pairs
of them are missed somewhat more often.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyworks.llm import simhash_dedup
from plyworks.llm.common import OWN, forget, materialize, small_batches
from plyworks.llm.lexicon import release
from plyworks.llm.simhash_dedup import SEED, Segment, _flips, _syndrome, components, keep_first, links, possible

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint, and the share of them that differ at SIMILARITY.
WORDS, DIFFER = 5, math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: Candidates differ in so many of their first 128 bits at most.
SLACK = 36
#: The code of a segment, pairs that meet nowhere, homes of an anchor, and segments that are replicated at a time, at first and later.
CODE, MISS, HOMES, FIRST, TOGETHER = Segment(0, 15, 1, 1), 1e-4, 128, 3, 11
#: Minima by which the sets of a group are told apart before they are compared; at 0.8 fewer agree for one pair in a million.
MINIMA, AGREE = 160, 102
#: Hashes that are permuted or turned into bits at once, for very long texts.
BLOCK = 1 << 13

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64)
_FACTOR = _rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64) | np.uint64(1)
_FAMILIES = _rng.integers(0, 1 << 64, WORDS, dtype=np.uint64)


def shingles(text: bytes | str | None, size: int = SHINGLE) -> np.ndarray:
    """The set of one text: hashes of its runs of words, ascending."""
    import xxhash

    raw = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    joined, ends, at = b" ".join(raw), [], -1
    for n in map(len, raw):
        at += n + 1
        ends.append(at)
    size = min(size, len(raw))
    starts = [0, *(e + 1 for e in ends[: len(raw) - size])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])), dtype="<u8", count=len(starts)))


def minima(found: np.ndarray) -> np.ndarray:
    """The least hash of a set under each permutation."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), BLOCK):
        out = np.minimum(out, ((found[i : i + BLOCK][None, :] ^ _XOR[:, None]) * _FACTOR[:, None]).min(axis=1))
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    """64 * WORDS bits of each hash."""
    x = hashes[:, None] ^ _FAMILIES[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set, as WORDS words. Bits that are set in just half of the hashes are those of the least hash."""
    if not len(found):
        return np.zeros(WORDS, dtype=np.uint64)
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for i in range(0, len(found), BLOCK):
        ones += _bits(found[i : i + BLOCK]).sum(axis=0, dtype=np.uint16)
    ones = 2 * ones + _bits(found[:1])[0] > len(found)
    return np.packbits(ones, bitorder="little").view("<u8")


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, same, fp, words) from (doc_id, text): equal sets have equal `same`, words are the bytes of the fingerprint, fp the first of them."""
    import pyarrow as pa

    def run(batches):
        import xxhash

        forget()
        for batch in batches:
            same, fp, words = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                same.append(xxhash.xxh3_128_digest(found.tobytes()))
                bits = fingerprint(found)
                fp.append(bits[0])
                words.append(bits.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(words, pa.binary())], names=["doc_id", "same", "fp", "words"])
        release()

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias(OWN + "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, same binary, fp bigint, words binary")


def segments(distinct: int) -> list[np.ndarray]:
    """The bits of each segment for so many fingerprints: 15 of the code, then the free ones."""
    free = min(max(0, math.ceil(math.log2(max(distinct, 1) / (HOMES << 11)))), 22)
    near = sum(math.comb(CODE.width, k) * DIFFER**k * (1 - DIFFER) ** (CODE.width - k) for k in range(CODE.threshold + 1))
    number = math.ceil(math.log(MISS) / math.log1p(-near * (1 - DIFFER) ** free))
    width, out, rng = CODE.width + free, [], np.random.default_rng(SEED)
    order = np.arange(64 * WORDS)
    while len(out) < number:
        out += [order[i : i + width] for i in range(0, len(order) - width + 1, width)]
        order = rng.permutation(64 * WORDS)
    return out[:number]


def replicate(distinct: DataFrame, parts: list[np.ndarray], below: bool = False, at: int = 0) -> DataFrame:
    """(anchor, fp, more, home) from (words): a row for the home and each replica in every segment. A root is passed on.

    With below only replicas at anchors below the home: of two homes that could meet the other's row, the lesser does. The parts
    are the segments from number `at` on.
    """
    import pyarrow as pa

    rooted = ["root"] if "root" in distinct.columns else []

    def run(batches):
        masks, homes = _flips(CODE)
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
            bits, words = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64), raw.view("<u8").view(np.int64)
            roots = [batch.column(1).to_numpy(zero_copy_only=False) for _ in rooted]
            for no, columns in enumerate(parts, at):
                values = bits[:, columns] @ (1 << np.arange(len(columns)))
                which = _syndrome(values.view(np.uint64), 1)
                for s in range(16):
                    rows = np.flatnonzero(which == s)
                    if not len(rows):
                        continue
                    anchors = values[rows][:, None] ^ masks[s].view(np.int64)[None, :] | no << 40
                    home = np.broadcast_to(masks[s] == homes[s], anchors.shape)
                    which_row, column = np.nonzero(anchors <= anchors[home][:, None]) if below else map(np.ravel, np.indices(anchors.shape))
                    of = rows[which_row]
                    yield pa.RecordBatch.from_arrays([pa.array(anchors[which_row, column]), pa.array(words[of, 0]), pa.array(words[of, 1]), pa.array(home[which_row, column]), *(pa.array(r[of]) for r in roots)], names=["anchor", "fp", "more", "home", *rooted])

    return distinct.select("words", *rooted).mapInArrow(run, "anchor bigint, fp bigint, more bigint, home boolean" + ", root bigint" * len(rooted))


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b): links of first words, or of roots of such, from (fp, words). Segments are dealt with some at a time, so that only their replicas are on disk."""
    parts = segments(distinct.count())

    def linked(rows: DataFrame, start: int, end: int) -> DataFrame:
        found = materialize(links(replicate(rows, parts[start:end], True, start), SLACK), "jaccard-links")
        # Spark deletes the files of a shuffle when the driver's garbage is collected.
        rows.sparkSession.sparkContext._jvm.System.gc()
        return found

    roots = components(linked(distinct, 0, FIRST), "jaccard-first")
    rooted = materialize(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("words", F.coalesce("root", "fp").alias("root")), "jaccard-rooted")
    out = roots.toDF("a", "b")
    for i in range(FIRST, len(parts), TOGETHER):
        out = out.unionByName(linked(rooted, i, i + TOGETHER))
    return out


def similar(grams: list[np.ndarray]) -> np.ndarray:
    """Of each set of a group the place of the first one in its component. A set is compared with those no component has reached."""
    root, left = np.arange(len(grams)), np.arange(len(grams))
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    least = np.array([minima(g) for g in grams]) if len(grams) > 2 else None
    while len(left):
        first, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            at = queue.pop()
            n = sizes[left]
            may = np.minimum(n, sizes[at]) >= SIMILARITY * np.maximum(n, sizes[at])
            if least is not None:
                may[may] = (least[left[may]] == least[at]).sum(axis=1) >= AGREE
            near = np.zeros(len(left), dtype=bool)
            mine = grams[at]
            for k in np.flatnonzero(may).tolist():
                other = grams[left[k]]
                place = np.minimum(np.searchsorted(mine, other), max(len(mine) - 1, 0))
                both = int((mine[place] == other).sum()) if len(mine) else 0
                # 5 * both >= 4 * all, in whole numbers.
                near[k] = 5 * both >= 4 * (len(mine) + len(other) - both)
            found = left[near]
            root[found] = first
            queue.extend(found.tolist())
            left = left[~near]
    return root


def _grouped(groups: DataFrame) -> DataFrame:
    """(same, first) of the sets in (root, same, text) that another one of their group is similar to; first is the `same` that names the component."""
    import pyarrow as pa

    def run(batches):
        import xxhash

        def out(held):
            same = list(held)
            root = similar(list(held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), pa.array([same[k] for k in root.tolist()], pa.binary())], names=["same", "first"])

        held, of = {}, None
        for batch in batches:
            for root, same, text in zip(*(batch.column(i) for i in range(3))):
                root, same = root.as_py(), same.as_py()
                if held and root != of:
                    yield from out(held)
                    held = {}
                of = root
                if same not in held:
                    found = shingles(text.as_py())
                    # A repeated id may come with another text, which isn't the one that carries the set.
                    if xxhash.xxh3_128_digest(found.tobytes()) == same:
                        held[same] = found
        if held:
            yield from out(held)
        held = {}
        release()

    return groups.select("root", "same", "text").repartition("root").sortWithinPartitions("root", "same").mapInArrow(run, "same binary, first binary")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) of each row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    rows = materialize(sketches(docs), "jaccard-sketches")
    distinct = materialize(rows.groupBy("same").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("words").alias("words")), "jaccard-distinct")
    # Equal first words are one node, whatever their sets: candidates only.
    roots = components(candidates(materialize(distinct.select("fp", "words").distinct(), "jaccard-words")), "jaccard-links")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("same", "least", F.coalesce("root", "fp").alias("root"))
    many = rooted.groupBy("root").count().where("count > 1").select("root")
    rooted = materialize(rooted.join(many, "root", "left_semi"), "jaccard-groups")
    # Of rows with equal sets the least id's carries the set; its words are read again rather than stored.
    few = rooted.count() <= simhash_dedup.FEW
    near = docs if few else possible(docs, "doc_id", rooted.select("least"))
    carried = near.join(F.broadcast(rooted) if few else rooted, near["doc_id"].eqNullSafe(rooted["least"])).select("root", "same", "text")
    found = materialize(_grouped(carried), "jaccard-found")
    named = distinct.join(found, "same", "left").select("same", "least", F.coalesce("first", "same").alias("first"))
    least = named.groupBy("first").agg(F.min("least").alias("component_id"))
    named = named.join(least, "first").select("same", "component_id")
    return rows.select("doc_id", "same").join(named, "same").select("doc_id", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The document of the least id of each component, once if its row is repeated; rows without an id stay."""
    return keep_first(docs, dedup(docs, text, doc_id), doc_id)
