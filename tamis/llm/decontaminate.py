"""Benchmark passages in documents, found by Wu-Manber multi-pattern search over words.

A window is 13 consecutive words of an item; an item with fewer words is one window of its
own length. Windows of one length form one search: a shift table over blocks of two words
says how far the search may jump, buckets by the window's last block and then its first
block select candidates, and a comparison of all words confirms each occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.batches import steps, utf8, words_of
from tamis.session import materialise

WINDOW = 13
# Benchmark text that one pass over the documents searches for; more text means more passes.
BLOCK_BYTES = 2 << 20


class WindowSearch:
    """All windows of one length: the tables of Wu-Manber with words as symbols."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, dict[tuple, list[str]]]] = {}

    def add(self, window: tuple[bytes, ...], item: str | None) -> None:
        size, length = self.block, self.length
        for end in range(size, length + 1):
            block = window[end - size : end]
            self.shift[block] = min(self.shift.get(block, self.default), length - end)
        starts = self.buckets.setdefault(window[-size:], {})
        items = starts.setdefault(window[:size], {}).setdefault(window, [])
        if item is not None and item not in items:
            items.append(item)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, items) of every place where a window occurs."""
        length, size, shift, default, buckets = self.length, self.block, self.shift, self.default, self.buckets
        end, n = length, len(words)
        while end <= n:
            block = tuple(words[end - size : end])
            jump = shift.get(block, default)
            if jump:
                end += jump
                continue
            start = end - length
            candidates = buckets[block].get(tuple(words[start : start + size]))
            if candidates is not None:
                items = candidates.get(tuple(words[start:end]))
                if items is not None:
                    yield start, items
            end += 1


def searches(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[WindowSearch]:
    """One search per window length that occurs among the items."""
    by_length: dict[int, WindowSearch] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        length = min(window, len(words))
        if length:
            search = by_length.setdefault(length, WindowSearch(length))
            for low in range(len(words) - length + 1):
                search.add(tuple(words[low : low + length]), item)
    return list(by_length.values())


def hits(words: list[bytes], tables: list[WindowSearch]) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint ascending ranges of hit words, and the items with an occurring window."""
    found: set[str] = set()
    ranges: list[tuple[int, int]] = []
    for table in tables:
        for start, items in table.occurrences(words):
            found.update(items)
            ranges.append((start, start + table.length))
    return merged(ranges), found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of lists of items, and the lists of about ``limit`` bytes at most (or one item).

    Items that repeat an id and a text are one. A list is fetched when it is asked for, so that
    the driver holds one at a time.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 if total <= limit else -(-2 * total // limit)
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    return parts, ([tuple(r) for r in dealt.filter(F.col("part") == p).select("item", "text").collect()] for p in range(parts))


RANGES = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
STATE = "_ranges array<struct<low:bigint,high:bigint>>, _items array<string>, _n_words bigint"
STATE_NAMES = ["_ranges", "_items", "_n_words"]


def _pass(items: list[tuple], window: int, text_at: int) -> Callable:
    """Add what one block of items hits; the state is the last three columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searches(items, window)
        for batch in steps(batches, text_at):
            totals, ranges, names = [], [], []
            old = zip(utf8(batch.column(text_at)), batch.column("_ranges").to_pylist(), batch.column("_items").to_pylist())
            for text, old_ranges, old_items in old:
                words = words_of(text)
                own, found = hits(words, tables)
                pairs = [(r["low"], r["high"]) for r in old_ranges or []]
                totals.append(len(words))
                ranges.append([{"low": a, "high": b} for a, b in merged(own + pairs)])
                names.append(sorted(found | set(old_items or [])))
            state = [pa.array(ranges, RANGES), pa.array(names, pa.list_(pa.string())), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *state], batch.schema.names)

    return run


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``_n_words``, ``_ranges`` of hit words and ``_items`` that occur.

    The items are searched for ``block_bytes`` at a time, so a worker's tables are bounded;
    with more than one block the passes are cut by checkpoints. Null and empty texts have no
    words and no hits; repeated documents give repeated rows, repeated items count once; an item with a null id marks
    words but is not listed; without items nothing is hit. Columns of those three names are
    replaced, all others stay.
    """
    count, blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    state = docs.drop(*STATE_NAMES)
    for definition in STATE.split(", "):
        name, kind = definition.split(" ", 1)
        state = state.withColumn(name, F.lit(None).cast(kind))
    for at, items in enumerate(blocks):
        state = state.mapInArrow(_pass(items, window, docs.drop(*STATE_NAMES).columns.index(text_col)), state.schema)
        if at + 1 < count:
            state = materialise(state)
    return state


def n_hit() -> Column:
    """Words inside the hit ranges."""
    return F.aggregate("_ranges", F.lit(0).cast("bigint"), lambda s, r: s + r["high"] - r["low"])


def contaminated() -> Column:
    """A twentieth of the words, and at least one, are hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("_n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and whether it is contaminated."""
    found = find_passages(docs.select(id_col, text_col), benchmark, text_col, **options)
    return found.select(
        id_col,
        F.col("_n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    return find_passages(docs, benchmark, text_col, **options).filter(~contaminated()).select(docs.columns)
