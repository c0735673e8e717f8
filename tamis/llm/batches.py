"""Arrow batches of texts in bounded pieces, and columns that survive clashing names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of text that one step of a worker holds as Python objects (one longer text is one step).
STEP_BYTES = 1 << 20


def steps(batches: Iterable[pa.RecordBatch], column: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts in ``column`` take ``limit`` bytes, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        low = 0
        while low < len(ends):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(low, high - low)
            low = high


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts; null is empty."""
    return [s if s is not None else "" for s in column.to_pylist()]


def chosen(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, under names of its own: ``id``, ``text`` and the rest."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *more)


# Word bytes of the two word-matching operators: digits, letters and every byte of a non-ASCII
# character; A-Z become a-z and all others a blank, so that bytes.split() gives the words.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return text.translate(WORD_TABLE).split()


class Remembered:
    """Codes of strings that were met before, in bounded memory.

    Two generations of at most ``limit`` strings (and one step's): a string that is met again
    moves to the young one, and the old one is dropped when the young one is full.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], limit: int) -> None:
        self._learn, self._limit = learn, limit
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """The codes of the strings of each list, one after the other."""
        if len(self._young) > self._limit:
            self._old, self._young = self._young, {}
        missing = set().union(*lists) - self._young.keys()
        for key in missing & self._old.keys():
            self._young[key] = self._old[key]
        new = sorted(missing - self._old.keys())
        self._young.update(zip(new, self._learn(new)))
        code = self._young.__getitem__
        return [b"".join(map(code, keys)) for keys in lists]
