"""Token ids in Re-Pair grammar shards.

Documents are tokenized in ascending id order and their ids laid into shards. In each shard frequent pairs of ids are replaced
by nonterminals, again and again. A shard stores its rules with their expansion lengths, the remaining symbols and where its
documents begin, so any document, or any stretch of ids, is decoded without the rest.

Results for odd input: a null or empty text has the end id alone; rows without an id come first; rows of one id follow each
other by text; an empty table gives no shards and an empty result. A document is never cut, so a shard is as long as it needs.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyworks.llm.common import materialize, worker_state
from plyworks.llm.lexicon import Lexicon, gathered, of_units, sizes_of_units, strings
from plyworks.llm.lexicon import pieces as cut_batches

MAGIC, SHARD_IDS = b"RPG1", 1 << 18
#: A rule costs three words in the file, so a pair of fewer occurrences doesn't pay. Rounds end when no pair pays.
LEAST_COUNT, RULES_A_ROUND = 4, 2048
#: Slots in which pairs are counted, as a power of two.
SLOTS = 18
#: The bound of a worker's cache of units.
UNITS = 900_000


def _independent(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent pairs of which no symbol is the left of one and the right of another, the most frequent first, each in a slot of its own. Their occurrences can't overlap, but those of a pair of equals."""
    top = np.argsort(-counts, kind="stable")[: 2 * RULES_A_ROUND]
    lefts, rights, chosen = set(), set(), []
    for k, (a, b) in zip(top.tolist(), zip((pairs[top] >> np.uint64(32)).tolist(), (pairs[top] & np.uint64(0xFFFFFFFF)).tolist())):
        if a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        chosen.append(k)
        if len(chosen) == RULES_A_ROUND:
            break
    found = pairs[chosen]
    return found[np.sort(np.unique(_slots(found), return_index=True)[1])]


def _slots(keys: np.ndarray) -> np.ndarray:
    """A slot of 2 ** SLOTS for each pair."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _places(at: np.ndarray) -> np.ndarray:
    """Of ascending numbers the place of each in its run of successive ones."""
    return np.arange(len(at)) - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k stands for the two symbols of its row and is itself symbol base + k.

    A pair of old symbols never grows more frequent, so places whose pair is too rare are left alone from then on, and a round
    looks only at the others and at those beside new symbols. Counts by slot tell rare pairs before the others are sorted.
    """
    seq, rules = ids.astype(np.uint32), [np.zeros((0, 2), dtype=np.uint32)]
    top, at = base, np.arange(max(0, len(ids) - 1))
    while True:
        keys = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        slot = _slots(keys)
        often = np.flatnonzero(np.bincount(slot, minlength=1 << SLOTS)[slot] >= LEAST_COUNT)
        at, keys, slot = at[often], keys[often], slot[often]
        # In a run of one symbol its pair counts, and is taken, at every other place.
        same = np.flatnonzero(keys >> np.uint64(32) == keys & np.uint64(0xFFFFFFFF))
        passed = same[_places(at[same]) % 2 == 1]
        ordered = np.sort(np.delete(keys, passed))
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(starts, len(ordered)))
        often = counts >= LEAST_COUNT
        if not often.any():
            break
        chosen = _independent(ordered[starts[often]], counts[often])
        rule = np.full(1 << SLOTS, -1, dtype=np.int32)
        rule[_slots(chosen)] = np.arange(len(chosen))
        which = rule[slot]
        which[passed] = -1
        hit = np.flatnonzero(which >= 0)
        hit = hit[chosen[which[hit]] == keys[hit]]
        place, which = at[hit], which[hit]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        seq[place] = (top + which).astype(np.uint32)
        top += len(chosen)
        # One place more than there are symbols: what stands before the first.
        gone, mark = np.zeros(len(seq) + 1, dtype=bool), np.zeros(len(seq) + 1, dtype=bool)
        gone[place + 1] = True
        mark[at] = True
        mark[place - 1 - gone[place - 1]] = True
        left = np.flatnonzero(~gone[:-1])
        seq = seq[left]
        # The last symbol begins no pair.
        at = np.flatnonzero(mark[left[:-1]])
    return seq, np.concatenate(rules)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """The number of ids each rule expands to."""
    out = np.zeros(len(rules), dtype=np.uint32)
    done = 0
    while done < len(rules):
        # Rules of a round refer to earlier rounds only, so all whose parts are known can be done at once.
        part = rules[done:].astype(np.int64) - base
        known = int(np.argmax((part >= done).any(axis=1))) if (part >= done).any() else len(part)
        part = part[:known]
        out[done : done + known] = np.where(part < 0, 1, out[np.maximum(part, 0)]).sum(axis=1)
        done += known
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that the symbols stand for."""
    seq = symbols.astype(np.int64)
    while len(seq) and (big := seq >= base).any():
        sizes = np.where(big, 2, 1)
        ends = np.cumsum(sizes)
        out = np.empty(ends[-1], dtype=np.int64)
        out[ends[~big] - 1] = seq[~big]
        pairs = rules[seq[big] - base]
        out[ends[big] - 2] = pairs[:, 0]
        out[ends[big] - 1] = pairs[:, 1]
        seq = out
    return seq.astype(np.uint32)


def pack(ids: np.ndarray, starts: np.ndarray, base: int) -> bytes:
    """A shard: header; starts of documents (one more than there are), rules, their expansion lengths, symbols, little-endian."""
    symbols, rules = compress(ids, base)
    head = struct.pack("<4sIIIIQ", MAGIC, base, len(starts) - 1, len(rules), len(symbols), len(ids))
    return b"".join([head, *(x.astype("<u4").tobytes() for x in (starts, rules.ravel(), rule_lengths(rules, base), symbols))])


class Shard:
    """A packed shard. Symbols' ends in ids are summed once, so a stretch is found by bisection and only its symbols are expanded, from the rules' expansions laid end to end."""

    def __init__(self, blob: bytes):
        magic, self.base, docs, n_rules, n_symbols, self.n_ids = struct.unpack_from("<4sIIIIQ", blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize("<4sIIIIQ")
        if len(blob) != at + 4 * (docs + 1 + 3 * n_rules + n_symbols):
            raise ValueError("a shard of another length")
        take = lambda n, i: np.frombuffer(blob, "<u4", n, at + 4 * i)
        self.starts, self.rules = take(docs + 1, 0), take(2 * n_rules, docs + 1).reshape(-1, 2)
        self.lengths, self.symbols = take(n_rules, docs + 1 + 2 * n_rules).astype(np.int64), take(n_symbols, docs + 1 + 3 * n_rules)
        self.spelt = expand(np.arange(n_rules, dtype=np.int64) + self.base, self.rules, self.base)
        self.places = np.cumsum(self.lengths) - self.lengths
        sizes = np.ones(n_symbols, dtype=np.int64)
        big = self.symbols >= self.base
        sizes[big] = self.lengths[self.symbols[big] - self.base]
        self.ends = np.cumsum(sizes)

    def _spell(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ids of symbols that end at these places."""
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
        big = symbols >= self.base
        out[ends[~big] - 1] = symbols[~big]
        rule = symbols[big] - np.uint32(self.base)
        sizes = self.lengths[rule]
        before = np.cumsum(sizes) - sizes
        step = np.arange(sizes.sum())
        out[np.repeat(ends[big] - sizes - before, sizes) + step] = self.spelt[np.repeat(self.places[rule] - before, sizes) + step]
        return out

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids [start, end) of the shard."""
        if start >= end:
            return np.zeros(0, dtype=np.uint32)
        a, b = np.searchsorted(self.ends, start, side="right"), np.searchsorted(self.ends, end, side="left") + 1
        skipped = int(self.ends[a - 1]) if a else 0
        return self._spell(self.symbols[a:b], self.ends[a:b] - skipped)[start - skipped : end - skipped]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers spell bytes: printable ones of Latin-1 as they are, the others in order from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordEncoder:
    """A tokenizer that parts letters from marks, lowers case and never reaches over a blank or a line end: the units of texts are encoded once and their ids kept, up to a bound.

    Letters go straight to its model; all other units go through the whole tokenizer.
    """

    def __init__(self, path: str, share: float = 1):
        """share: of the cache's bound, for workers that hold other caches too."""
        import os

        self.most = int(UNITS * share)

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.base, self.spelling = self.tokenizer.model, self.tokenizer.get_vocab_size(), _byte_letters()
        self.units, self.added = Lexicon(self._learn, np.uint32), [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        for text in ("Abc, abc", "Élan### élan", "a(b)\n\nc's", "straße!? 'll"):
            if self.encode_column(pa.array([text]))[1].tolist() != self._ids([text])[0]:
                raise ValueError("the tokenizer doesn't part words as expected")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for i in range(0, len(texts), 4096) for x in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]

    def _spelt(self, unit: str) -> str | None:
        """How the model is given a unit of letters; None where the whole tokenizer is asked."""
        letters = unit[1:] if unit[0] in " \n" else unit
        if letters.isascii():
            return letters if letters.isalpha() else None
        lower = letters.lower()
        # Beyond the Latin blocks, and where normalizing or lowering makes marks, the whole tokenizer is asked.
        if max(letters) < "\u0250" and letters.isalpha() and lower.isalpha() and is_normalized("NFC", letters):
            return lower.encode().decode("latin-1").translate(self.spelling)
        return None

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, spelt = self.model.tokenize, list(map(self._spelt, units))
        found = [x and [t.id for t in tokenize(x)] for x in spelt]
        other = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(other, self._ids([units[k] for k in other])):
            found[k] = ids
        return np.array(list(map(len, found)), dtype=np.int64), np.array(list(chain.from_iterable(found)), dtype=np.uint32)

    def _marked(self, texts: pa.Array) -> np.ndarray:
        """The texts that hold the string of a token of the tokenizer's own, in whatever case; it is a token for the whole tokenizer only."""
        out = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            out |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        return np.flatnonzero(out)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of a column of texts without nulls."""
        self.units.bound(self.most)
        marked = self._marked(texts)
        if not len(marked):
            return of_units(self.units, texts, lower=True)
        plain = np.setdiff1d(np.arange(len(texts)), marked)
        sizes, ids = of_units(self.units, texts.take(pa.array(plain)), lower=True)
        whole = self._ids(texts.take(pa.array(marked)).to_pylist())
        sizes = np.concatenate([sizes, np.array(list(map(len, whole)), dtype=np.int64)])
        back = np.argsort(np.concatenate([plain, marked]))
        return gathered(np.concatenate([ids, np.array(list(chain.from_iterable(whole)), dtype=np.uint32)]), (np.cumsum(sizes) - sizes)[back], sizes[back])

    def count_column(self, texts: pa.Array, bounded: bool = True) -> np.ndarray:
        """The number of ids of each text. The cache's bound is looked at only if asked for."""
        if bounded:
            self.units.bound(self.most)
        out, marked = sizes_of_units(self.units, texts, lower=True), self._marked(texts)
        if len(marked):
            out[marked] = list(map(len, self._ids(texts.take(pa.array(marked)).to_pylist())))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        sizes, ids = self.encode_column(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(texts) else []


def word_encoder(path: str, share: float = 1) -> WordEncoder:
    held = worker_state().__dict__.setdefault("word_encoders", {})
    if (path, share) not in held:
        held[path, share] = WordEncoder(path, share)
    return held[path, share]


def write_shards(docs: DataFrame, path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes (part, before, doc_ids, n_ids, blob), a row for each shard, to the shared folder, and reads it back.

    Parts are ranges of ids in ascending order; before counts the ids of earlier shards of the part.
    """
    names = ["part", "before", "doc_ids", "n_ids", "blob"]

    def run(batches):
        from pyspark import TaskContext

        encoder, part, before = word_encoder(path), TaskContext.get().partitionId(), 0
        held, sizes, keys, size = [], [], [], 0

        def shard():
            n = np.concatenate(sizes)
            ids = np.concatenate(held)
            blob = pack(ids, np.concatenate([[0], np.cumsum(n)]), max(encoder.base, end_id + 1))
            lists = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(keys))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), lists, pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], names=names)

        for whole in batches:
            for rows in cut_batches(whole, 1):
                n, ids = encoder.encode_column(strings(rows.column(1)))
                # The end id goes behind the ids of each document.
                ids, n, at = np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1, 0
                ends = np.cumsum(n)
                while at < len(n):
                    # A shard ends with the first document that fills it.
                    start = int(ends[at - 1]) if at else 0
                    to = min(len(n), int(np.searchsorted(ends, start + shard_ids - size, side="left")) + 1)
                    held.append(ids[start : ends[to - 1]])
                    sizes.append(n[at:to])
                    keys.append(rows.column(0).slice(at, to - at))
                    size += len(held[-1])
                    at = to
                    if size >= shard_ids:
                        yield shard()
                        before += size
                        held, sizes, keys, size = [], [], [], 0
        if held:
            yield shard()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "part int, before bigint, doc_ids array<bigint>, n_ids bigint, blob binary"), "repair-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards' bytes."""
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    first, base = 0, {}
    for part in sorted(totals):
        base[part], first = first, first + totals[part]

    def run(batches):
        for batch in batches:
            for part, before, keys, blob in zip(*(batch.column(i) for i in range(4))):
                shard = Shard(blob.as_py())
                ids = shard.ids(0, shard.n_ids)
                if len(ids) != shard.n_ids:
                    raise ValueError("a shard's expansion has another length")
                raw, at = memoryview(ids.astype("<u4").tobytes()), shard.starts.astype(np.int64)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys.as_py(), pa.int64()), pa.array(at[:-1] + base[part.as_py()] + before.as_py()), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "doc_ids", "blob").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
