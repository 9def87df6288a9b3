"""Helpers shared by the operators: column names, and word spans over whole Arrow batches.

Word code works on the UTF-8 bytes of many texts at once with numpy. A batch is cut into pieces of a
few megabytes, so a worker's memory follows the longest single text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import remove
from lodestone.storage import shared_folder as shared_dir
from lodestone.storage import written as materialise

__all__ = ["Texts", "doc_texts", "free_name", "lower_ascii", "materialise", "maybe_broadcast", "mix64", "remove", "row_pieces", "shared_dir", "shingle_hashes", "sorted_sets", "trimmed"]

#: Bytes of text that are worked on at a time.
PIECE_BYTES = 1 << 20
#: Rows that a broadcast side may have at most; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more rows than limit, else as it is (the join is shuffled)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, but a worker hands its free memory back to the system when the task ends; Spark keeps idle workers for later stages."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return inner


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(taken: list[str], name: str) -> str:
    """name, or name with underscores before it until no column has it (Spark ignores case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the one of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Texts:
    """Consecutive texts as one byte array: doc i has bytes[starts[i]:starts[i + 1]]."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts, self.n = data, starts, len(starts) - 1

    def lowered(self) -> Texts:
        return Texts(_LOWER[self.data], self.starts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end byte and document of each run of bytes other than 0x20 and 0x09-0x0D."""
        inside = ~_SPACE[self.data]
        step = np.empty(len(inside) + 1, dtype=bool)
        step[0], step[-1] = False, False
        if len(inside):
            step[0], step[-1] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=step[1:-1])
        # a text's border also parts words
        border = self.starts[1:-1]
        border = border[(border > 0) & (border < len(inside))]
        border = np.unique(border)
        cut = border[inside[border] & inside[border - 1]]
        edges = np.flatnonzero(step)
        first, end = edges[0::2], edges[1::2]
        if len(cut):
            first, end = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([end, cut]))
        return first, end, np.searchsorted(self.starts, first, side="right") - 1

    def word_hashes(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word's bytes and length: a polynomial by prefix sums, then mixed."""
        base, inverse = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
        n = len(self.data)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_TABLE[self.data] * _powers(base, n), out=sums[1:])
            h = (sums[end] - sums[first]) * _powers(inverse, n)[first]
            return mix64(h ^ (end - first).astype(np.uint64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n + 1:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base)]), dtype=np.uint64)
        if size <= 2 * PIECE_BYTES:
            _POWERS[int(base)] = have
    return have[: max(n, 1)]


def doc_texts(column: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, Texts) for successive pieces of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def shingle_hashes(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words of each document, and their documents.

    A document with fewer words, but not none, has its whole sequence as one shingle.
    """
    count = np.bincount(doc, minlength=n_docs)
    n = len(h)
    with np.errstate(over="ignore"):
        full = n - width + 1
        if full > 0:
            s = np.zeros(full, np.uint64)
            for k in range(width):
                s = mix64(s ^ h[k : k + full])
            whole = doc[:full] == doc[width - 1 :]
            s, d = s[whole], doc[:full][whole]
        else:
            s, d = np.zeros(0, np.uint64), np.zeros(0, doc.dtype)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            first = np.concatenate([[0], np.cumsum(count)[:-1]])[short]
            t = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                more = count[short] > k
                t[more] = mix64(t[more] ^ h[first[more] + k])
            t = mix64(t ^ count[short].astype(np.uint64) ^ np.uint64(0xA5A5A5A5))
            s, d = np.concatenate([s, t]), np.concatenate([d, short])
            order = np.argsort(d, kind="stable")
            s, d = s[order], d[order]
    return s, d


def sorted_sets(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each document in ascending order, their documents, and the documents' offsets."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, doc, np.searchsorted(doc, np.arange(n_docs + 1))


def row_pieces(sizes: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Successive ranges of rows whose sizes add up to most at most, or of one row."""
    ends, row = np.concatenate([[0], np.cumsum(sizes)]), 0
    while row < len(sizes):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        yield row, end
        row = end
