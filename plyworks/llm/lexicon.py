"""Numbers of words, kept as ragged arrays, so that whole columns of texts are encoded without a step for each word.

Arrow cuts texts and tells their distinct words; only these are looked up, and what is new is learned at once. The numbers of a
text are then gathered by array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are encoded together: so many rows and bytes at most, but one text at least.
ROWS, BYTES = 4096, 3 << 20


class Ragged:
    """Rows of numbers laid end to end."""

    def __init__(self, dtype=np.int32):
        self.data, self.starts, self.sizes = np.empty(1 << 16, dtype), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.rows = self.used = 0

    @staticmethod
    def _grown(held: np.ndarray, need: int) -> np.ndarray:
        if need <= len(held):
            return held
        out = np.empty(max(need, 2 * len(held)), held.dtype)
        out[: len(held)] = held
        return out

    def add(self, sizes: np.ndarray, data: np.ndarray) -> int:
        """The number of the first of these rows."""
        first, at = self.rows, self.used
        self.rows, self.used = first + len(sizes), at + len(data)
        self.data = self._grown(self.data, self.used)
        self.starts, self.sizes = self._grown(self.starts, self.rows), self._grown(self.sizes, self.rows)
        self.data[at : self.used] = data
        self.sizes[first : self.rows] = sizes
        self.starts[first : self.rows] = at + np.cumsum(sizes) - sizes
        return first

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, data) of rows, in their order."""
        return gathered(self.data, self.starts[rows], self.sizes[rows])


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, data) of stretches of data."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return sizes, data[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class Lexicon:
    """Strings with the numbers learned of them. learn gets distinct strings and gives (sizes, numbers)."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype=np.int32):
        self.learn, self.dtype = learn, dtype
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = Ragged(self.dtype)

    def bound(self, most: int) -> None:
        """Forgets all where more strings, or many more numbers, are held. Row numbers from before are void then."""
        if len(self.at) > most or self.table.used > 16 * most:
            self.clear()

    def rows(self, strings: list[str]) -> np.ndarray:
        """The row of each of these distinct strings."""
        get = self.at.get
        out = np.array([get(s, -1) for s in strings], dtype=np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            names = [strings[i] for i in new.tolist()]
            first = self.table.add(*self.learn(names))
            out[new] = np.arange(first, first + len(names))
            self.at.update(zip(names, range(first, first + len(names))))
        return out

    def of_lists(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, numbers) of each list's strings, one after the other."""
        flat = [s for x in lists for s in x]
        distinct = list(dict.fromkeys(flat))
        place = dict(zip(distinct, self.rows(distinct).tolist()))
        sizes, data = self.table.take(np.array([place[s] for s in flat], dtype=np.int64))
        return summed(sizes, np.cumsum([0, *map(len, lists)])), data


def summed(sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of sizes between offsets."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _kinds() -> np.ndarray:
    """Of each byte: 1 an ASCII letter, 2 an ASCII mark but the apostrophe, 3 a blank or line end, 0 anything else."""
    out = np.zeros(256, dtype=np.uint8)
    for byte in range(128):
        c = chr(byte)
        out[byte] = 3 if c in " \n" else 1 if c.isalpha() else 2 if c.isprintable() and not c.isdigit() and c != "'" else 0
    return out


_KINDS = _kinds()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def units(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(offsets, units) of texts without nulls: a unit starts with a text, a blank or a line end, and where a mark meets a letter.

    Units lie in the texts' own bytes (or in a copy with ASCII letters in lower case); one after the other they are the text.
    """
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, "<i4", len(texts) + 1, 4 * texts.offset)
    data = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = _LOWER[data] if lower else data
    kind = _KINDS[data]
    start = kind == 3
    if len(kind):
        start[1:] |= (kind[1:] ^ kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0)
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.append(np.flatnonzero(start), len(data)).astype(np.int32)
    return np.searchsorted(at[:-1], offsets), pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))


def _rows(lexicon: Lexicon, found: pa.Array) -> np.ndarray:
    coded = found.dictionary_encode()
    # By numpy, as Arrow's own to_pylist() makes a scalar of each string first.
    return lexicon.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]


def of_units(lexicon: Lexicon, texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, numbers) of each text, the numbers of its units one after the other."""
    offsets, found = units(texts, lower)
    sizes, data = lexicon.table.take(_rows(lexicon, found))
    return summed(sizes, offsets), data


def sizes_of_units(lexicon: Lexicon, texts: pa.Array, lower: bool = False) -> np.ndarray:
    """The first of of_units() alone."""
    offsets, found = units(texts, lower)
    rows = _rows(lexicon, found)
    return summed(lexicon.table.sizes[rows], offsets)


def release() -> None:
    """Gives memory that nothing uses back to the system: a worker that has done its task stays, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, text: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded rows and bytes of the text column, one row at least."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    upto, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right"))
        to = min(max(to, at + 1), at + ROWS)
        yield batch.slice(at, to - at)
        at = to


def strings(column: pa.Array) -> pa.Array:
    """A column of texts as Arrow strings, null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def spans(values: pa.Array) -> Iterator[memoryview]:
    """The bytes of each string or binary of an array without nulls, uncopied."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, "<i4", len(values) + 1, 4 * values.offset).tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(at, at[1:]):
        yield view[a:b]
