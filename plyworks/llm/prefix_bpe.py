"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece's bytes one token can end its encoding; it is the token t for which the prefix before t ends in a
token that may stand before t, which is to say that merging the bytes of the two by rank leaves both whole. The tokens stored
for all prefixes give the encoding of any prefix, let bytes be appended at their own cost, and, after an edit, are computed
anew only until they agree with the old ones again.

Results for odd input: a null or empty text has no tokens; repeated rows are encoded one by one; very long texts and pieces
take time in proportion to their length; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyworks.llm.common import OWN, small_batches, worker_state
from plyworks.llm.lexicon import Lexicon, Ragged, gathered, of_units, release, sizes_of_units, spans, strings
from plyworks.llm.lexicon import pieces as cut_batches

#: Bounds of a worker's caches; what doesn't fit is computed again.
PIECES, STRETCHES, PAIRS, LONGEST_CACHED = 250_000, 350_000, 50_000, 64
#: What encode_documents() takes of them, and the bytes of texts it encodes together.
DOCUMENTS_SHARE, DOCUMENTS_BYTES = 0.5, 1 << 20
#: Slots of the table in which pairs of tokens are looked up by whole arrays, as a power of two, and pieces that share an array.
SLOTS, TOGETHER = 20, 8192
# Fixed value: the pattern for which texts may be cut in front of single blanks and line ends, and between letters and marks.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with white space at an end, or beside a blank or line end, are split whole.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
UNEVEN = rf"[ \n]{WHITE}|{WHITE}[ \n]|^{WHITE}|{WHITE}$"


class Vocabulary:
    """Ranks, and how each token was merged."""

    def __init__(self, path: str, pattern: str, share: float = 1):
        """share: of the caches' bounds, for workers that hold other caches too."""
        import regex

        self.share = share

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split_text, self.cuts = regex.compile(pattern).findall, pattern == CUT_PATTERN
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.by_last: dict[int, list[int]] = {}
        lengths: dict[int, set[int]] = {}
        for token in self.ranks:
            lengths.setdefault(token[-1], set()).add(len(token))
        self.by_last = {byte: sorted(found, reverse=True) for byte, found in lengths.items()}
        # Of each token the two whose merge makes it, -1 for single bytes, and the token that two make, by one number of both.
        self.first_part, self.second_part = np.full((2, max(self.bytes_of) + 1), -1, dtype=np.int32)
        self.merged: dict[int, int] = {}
        for token, rank in self.ranks.items():
            if len(token) > 1:
                first, second = self._last_merge(token)
                self.first_part[rank], self.second_part[rank] = first, second
                self.merged[first << 32 | second] = rank
        self.parts = array("i", self.first_part.tolist()), array("i", self.second_part.tolist())
        merged = np.array(sorted(self.merged.items()), dtype=np.int64).reshape(-1, 2)
        self.merge_keys, self.merge_ranks = np.append(merged[:, 0], 1 << 62), np.append(merged[:, 1], -1)
        self.valid: dict[int, bool] = {}
        self._trie()
        self.slot_keys = np.full(1 << SLOTS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.slot_fits = np.zeros(1 << SLOTS, dtype=bool)
        every = range(max(self.bytes_of) + 1)
        self.sizes = np.array([len(self.bytes_of.get(k, b"")) for k in every])
        self.as_text, self.as_bytes = pa.array([str(k) for k in every]), pa.array([self.bytes_of.get(k, b"") for k in every], pa.binary())
        self.pieces, self.stretches = Lexicon(self._learn_pieces), Lexicon(self._learn_stretches)

    def _trie(self) -> None:
        """What each state spells, or -1, and its transitions. State 0 is dead, 1 the root.

        Most states have one transition, held as a byte and a state; those with more have a row of 256, the others share row 0.
        """
        tokens = sorted(self.ranks)
        sizes = np.array([len(x) for x in tokens])
        data = np.frombuffer(b"".join(x.ljust(self.longest, b"\0") for x in tokens), np.uint8).reshape(len(tokens), self.longest)
        shared = np.append(0, np.minimum(np.logical_and.accumulate(data[1:] == data[:-1], axis=1).sum(axis=1), sizes[:-1]))
        # In order, a token's prefixes that are longer than what it shares with the token before it are new states.
        depth = np.arange(1, self.longest + 1)
        row, at = np.nonzero((depth > shared[:, None]) & (depth <= sizes[:, None]))
        states = np.zeros((len(tokens), self.longest), dtype=np.int32)
        states[row, at] = child = np.arange(2, len(row) + 2, dtype=np.int32)
        np.maximum.accumulate(states, axis=0, out=states)
        parent, byte = np.where(at > 0, states[row, at - 1], 1), data[row, at]
        self.spelt = np.full(len(row) + 2, -1, dtype=np.int32)
        self.spelt[states[np.arange(len(tokens)), sizes - 1]] = [self.ranks[x] for x in tokens]
        children = np.bincount(parent, minlength=len(row) + 2)
        one = children[parent] == 1
        self.only_byte, self.only_next = np.full(len(children), -1, dtype=np.int16), np.zeros(len(children), dtype=np.int32)
        self.only_byte[parent[one]], self.only_next[parent[one]] = byte[one], child[one]
        self.row = np.where(children > 1, np.cumsum(children > 1), 0).astype(np.int32)
        self.next = np.zeros((int(self.row.max()) + 1, 256), dtype=np.int32)
        self.next[self.row[parent[~one]], byte[~one]] = child[~one]

    def _step(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return np.where(self.only_byte[states] == byte, self.only_next[states], self.next[self.row[states], byte])

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """may_follow() of whole arrays: a table of slots first, then the distinct pairs that aren't in their slots."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = lambda k: (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)
        slots = slot(keys)
        out = self.slot_fits[slots]
        missing = np.flatnonzero(self.slot_keys[slots] != keys)
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            fits = self._follows((new >> np.uint64(32)).astype(np.int64), (new & np.uint64(0xFFFFFFFF)).astype(np.int64))
            out[missing] = fits[back]
            slots, first = np.unique(slot(new), return_index=True)
            self.slot_keys[slots], self.slot_fits[slots] = new[first], fits[first]
        return out

    def _follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """may_follow() of whole arrays, worked out for all pairs together."""
        out, at, bound = np.ones(len(left), dtype=bool), np.arange(len(left)), np.full(len(left), 1 << 60)
        while len(at):
            keys = left << 32 | right
            place = np.searchsorted(self.merge_keys, keys)
            crossed = (self.merge_keys[place] == keys) & (self.merge_ranks[place] < bound)
            out[at[crossed]] = False
            undo_left, undo_right = self.second_part[left], self.first_part[right]
            by_left = (undo_right < 0) | ((undo_left >= 0) & (left > right))
            going = ~crossed & ((undo_left >= 0) | (undo_right >= 0))
            bound = np.where(by_left, left, right + 1)[going]
            left, right = np.where(by_left, undo_left, left)[going].astype(np.int64), np.where(by_left, right, undo_right)[going].astype(np.int64)
            at = at[going]
        return out

    def last_tokens(self, pieces: list[bytes]) -> np.ndarray:
        """extend() for every prefix of many pieces, the longest first, at once: a row for each, column n for the prefix of n bytes."""
        lengths = np.array([len(x) for x in pieces])
        width = int(lengths[0])
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(len(pieces), width)
        states = np.ones((len(pieces), width), dtype=np.int32)
        last = np.zeros((len(pieces), width + 1), dtype=np.int32)
        for at in range(1, width + 1):
            n = int(np.searchsorted(-lengths, -at, side="right"))
            now = states[:n, :at] = self._step(states[:n, :at], data[:n, at - 1, None])
            token = self.spelt[now]
            row, start = np.nonzero(token >= 0)
            token = token[row, start]
            fits = start == 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self._fit(last[row[inner], start[inner]], token[inner])
            last[row[fits], at] = token[fits]
        return last

    def _unwound(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of many pieces, the longest first: from each one's end back by the stored last tokens, all pieces at once."""
        last, at = self.last_tokens(pieces), np.array([len(x) for x in pieces])
        sizes, steps, active = np.zeros(len(pieces), dtype=np.int64), [], np.arange(len(pieces))
        while len(active):
            token = last[active, at[active]]
            steps.append((active, token))
            sizes[active] += 1
            at[active] -= self.sizes[token]
            active = active[at[active] > 0]
        ends = np.cumsum(sizes)
        ids = np.empty(int(ends[-1]), dtype=np.int32)
        for back, (rows, token) in enumerate(steps):
            ids[ends[rows] - 1 - back] = token
        return sizes, ids

    def _learn_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole, sizes, found = self.ranks.get, np.zeros(len(pieces), dtype=np.int64), {}
        rest = []
        for k, text in enumerate(pieces):
            rank = whole(data := text.encode())
            if rank is not None:
                found[k] = rank
            elif len(data) <= 4 * LONGEST_CACHED:
                rest.append((data, k))
            else:
                found[k] = unwind(self, self.prefixes(data))
        rest.sort(key=lambda x: -len(x[0]))
        table = Ragged()
        row = np.zeros(len(pieces), dtype=np.int64)
        for i in range(0, len(rest), TOGETHER):
            part = rest[i : i + TOGETHER]
            first = table.add(*self._unwound([data for data, _ in part]))
            row[[k for _, k in part]] = np.arange(first, first + len(part))
        if found:
            lists = [x if isinstance(x, list) else [x] for x in found.values()]
            first = table.add(np.array(list(map(len, lists))), np.array([i for x in lists for i in x], dtype=np.int32))
            row[list(found)] = np.arange(first, first + len(lists))
        return table.take(row)

    def _split_stretch(self, stretch: str) -> list[str]:
        """The pieces of a unit of an even text: one, for letters with or without a blank in front."""
        if stretch.isascii() and (stretch.isalpha() or (stretch[0] == " " and stretch[1:].isalpha())):
            return [stretch]
        return self.split_text(stretch)

    def _learn_stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces.of_lists(list(map(self._split_stretch, stretches)))

    def _bounded(self) -> None:
        self.stretches.bound(int(STRETCHES * self.share))
        self.pieces.bound(int(PIECES * self.share))

    def _uneven(self, texts: pa.Array) -> np.ndarray:
        return np.flatnonzero(pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)) if self.cuts else np.arange(len(texts))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a column of texts without nulls."""
        self._bounded()
        uneven = self._uneven(texts)
        if not len(uneven):
            sizes, ids = of_units(self.stretches, texts)
        else:
            even = np.setdiff1d(np.arange(len(texts)), uneven)
            some = self.pieces.of_lists([self.split_text(x) for x in texts.take(pa.array(uneven)).to_pylist()])
            rest = of_units(self.stretches, texts.take(pa.array(even))) if len(even) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            sizes = np.concatenate([some[0], rest[0]])
            back = np.argsort(np.concatenate([uneven, even]))
            sizes, ids = gathered(np.concatenate([some[1], rest[1]]), (np.cumsum(sizes) - sizes)[back], sizes[back])
        return np.concatenate([[0], np.cumsum(sizes)]), ids

    def count_column(self, texts: pa.Array, bounded: bool = True) -> np.ndarray:
        """The number of ids of each text. The caches' bounds are looked at only if asked for."""
        if bounded:
            self._bounded()
        uneven = self._uneven(texts)
        out = np.zeros(len(texts), dtype=np.int64)
        even = np.setdiff1d(np.arange(len(texts)), uneven)
        if len(even):
            out[even] = sizes_of_units(self.stretches, texts.take(pa.array(even)) if len(uneven) else texts)
        if len(uneven):
            out[uneven] = self.pieces.of_lists([self.split_text(x) for x in texts.take(pa.array(uneven)).to_pylist()])[0]
        return out

    def joined(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The ids of each text, decimal, joined by a space."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.as_text.take(pa.array(ids))), " ")

    def decoded(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The bytes that the ids of each text stand for."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.as_bytes.take(pa.array(ids))), b"")

    def encode_all(self, texts: list[str]) -> list[str]:
        """The ids of each text, decimal, joined by a space."""
        return self.joined(*self.encode_column(pa.array(texts, pa.string()))).to_pylist()

    def _last_merge(self, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves both tokens whole.

        Both are undone merge by merge, the later merge first. Some undone pair of right end and left end that would itself have
        been merged before the merge undone last shows that the boundary would have been crossed.
        """
        key = left << 32 | right
        known = self.valid.get(key)
        if known is not None:
            return known
        merged, (first, second), bound, out = self.merged, self.parts, 1 << 60, True
        while True:
            across = merged.get(left << 32 | right)
            if across is not None and across < bound:
                out = False
                break
            undo_left, undo_right = second[left], first[right]
            if undo_left < 0 and undo_right < 0:
                break
            # At equal ranks the one on the left was merged first, so the right one is undone first, and its bound includes its rank.
            if undo_right < 0 or (undo_left >= 0 and left > right):
                bound, left = left, undo_left
            else:
                bound, right = right + 1, undo_right
        if len(self.valid) < PAIRS:
            self.valid[key] = out
        return out

    def extend(self, data: bytes, last: list[int], at: int) -> int:
        """The last token of data[:at], from those of the shorter prefixes (last[0] is unused)."""
        ranks = self.ranks
        for n in self.by_last[data[at - 1]]:
            if n <= at:
                token = ranks.get(data[at - n : at])
                if token is not None and (n == at or self.may_follow(last[at - n], token)):
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def prefixes(self, data: bytes) -> list[int]:
        """extend() for every prefix: the longest token first, as most pieces end in one."""
        ranks, valid, follows, longest, last = self.ranks.get, self.valid.get, self.may_follow, self.longest, [0]
        add = last.append
        for at in range(1, len(data) + 1):
            for start in range(max(0, at - longest), at):
                token = ranks(data[start:at])
                if token is not None:
                    if not start:
                        break
                    fits = valid(last[start] << 32 | token)
                    if follows(last[start], token) if fits is None else fits:
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            add(token)
        return last

    def encode(self, text: str) -> str:
        """The ids of a whole text, decimal, joined by a space."""
        return self.encode_all([text])[0]

    def decode(self, ids: str) -> bytes:
        return b"".join(self.bytes_of[int(k)] for k in ids.split(" ")) if ids else b""


def unwind(vocabulary: Vocabulary, last: list[int]) -> list[int]:
    """The encoding that ends with the last prefix's token."""
    out, at = [], len(last) - 1
    while at > 0:
        out.append(last[at])
        at -= len(vocabulary.bytes_of[last[at]])
    return out[::-1]


class PrefixTable:
    """The bytes of one piece with the last token of each prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [0]
        self.append(data)

    def append(self, data: bytes) -> None:
        at = len(self.data)
        self.data += data
        for i in range(at + 1, len(self.data) + 1):
            self.last.append(self.vocabulary.extend(self.data, self.last, i))

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Puts data in the place of bytes [start, end); gives the number of prefixes computed anew."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last, agreed, done = old[: start + 1], 0, 0
        for i in range(start + 1, len(self.data) + 1):
            self.last.append(self.vocabulary.extend(self.data, self.last, i))
            done += 1
            # Behind the edit a token depends on the longest token's length of bytes and tokens before it.
            agreed = agreed + 1 if i > start + len(data) and old[i - shift] == self.last[i] else 0
            if agreed >= self.vocabulary.longest:
                self.last += old[i - shift + 1 :]
                break
        return done

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the first `length` bytes, all of them by default."""
        return unwind(self.vocabulary, self.last if length is None else self.last[: length + 1])


def vocabulary(path: str, pattern: str, share: float = 1) -> Vocabulary:
    """The worker's copy, loaded once."""
    state = worker_state()
    held = state.__dict__.setdefault("vocabularies", {})
    if (path, pattern, share) not in held:
        held[path, pattern, share] = Vocabulary(path, pattern, share)
        release()
    return held[path, pattern, share]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The columns in keep with n_tokens, ids_sha256 and decoded_sha256 of the bytes the ids decode to, and ids array<int> if asked for."""
    small_batches(docs.sparkSession)
    columns = list(keep)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        v = vocabulary(path, pattern, DOCUMENTS_SHARE)
        sha = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in spans(values)], pa.string())
        for whole in batches:
            for batch in cut_batches(whole, len(columns), DOCUMENTS_BYTES):
                offsets, found = v.encode_column(strings(batch.column(len(columns))))
                out = [batch.column(k) for k in range(len(columns))] + [pa.array(np.diff(offsets)), sha(v.joined(offsets, found)), sha(v.decoded(offsets, found))]
                arrays = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))] * ids
                yield pa.RecordBatch.from_arrays(out + arrays, names=[*columns, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
            release()

    return docs.select(*columns, F.col(text).cast("string").alias(OWN + "text")).mapInArrow(run, schema)
