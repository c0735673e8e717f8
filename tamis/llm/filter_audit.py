"""Interaction of filters: what each one removes in every order of application.

Every row gets a mask with a bit per filter that it fails; rows are counted per part and mask.
The subsets of filters are walked in Gray-code order, one filter on or off at a time. Each mask
cell keeps a counter of the active filters that it fails; a cell whose counter leaves or reaches
zero leaves or rejoins the running survivors. The survivors of all subsets are stored, and every
step of every order is a difference of two stored states.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2**7 states and 7! orders of 7 steps.
MAX_FILTERS = 7
BLANKS = "\t\n\x0b\x0c\r"
# Rows of the result that one step of a worker holds.
STEP_ROWS = 50_000


def survivors(cells: np.ndarray) -> np.ndarray:
    """Rows left under each subset of filters; ``cells`` holds counts by mask, one row per mask.

    The result has one row per subset, the bits of its number being the active filters.
    """
    count = len(cells)
    failing = np.zeros(count, np.int64)
    running = cells.sum(axis=0)
    states = np.empty_like(cells)
    states[0] = running
    masks = np.arange(count)
    subset = 0
    for step in range(1, count):
        bit = (step & -step).bit_length() - 1
        subset ^= 1 << bit
        touched = masks[masks >> bit & 1 == 1]
        if subset >> bit & 1:
            running = running - cells[touched[failing[touched] == 0]].sum(axis=0)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            running = running + cells[touched[failing[touched] == 0]].sum(axis=0)
        states[subset] = running
    return states


def steps_of(cells: np.ndarray, names: list[str]) -> dict[str, np.ndarray]:
    """Columns of the audit of one part; ``cells`` holds (rows, extra counts ...) by mask."""
    bits = len(names)
    states = survivors(cells)
    every = (1 << bits) - 1
    masks = np.arange(1 << bits)
    fails = np.array([cells[masks >> b & 1 == 1, 0].sum() for b in range(bits)], np.int64)
    orders = np.array(list(permutations(range(bits))), np.int64).reshape(-1, bits)
    after = np.cumsum(1 << orders, axis=1)
    before = after - (1 << orders)
    lost = states[before] - states[after]
    removed = lost[:, :, 0]
    total = np.array([removed[orders == b].sum() for b in range(bits)], np.int64)
    return {
        "filter_order": np.repeat(["".join(names[b] for b in order) for order in orders], bits),
        "step": np.tile(np.arange(1, bits + 1, dtype=np.int32), len(orders)),
        "kept": states[after][:, :, 0].ravel(),
        "removed": removed.ravel(),
        "redundant": (fails[orders] - removed).ravel(),
        "unique_fails": (states[every ^ (1 << np.arange(bits)), 0] - states[every, 0])[orders].ravel(),
        "lost": lost[:, :, 1:].reshape(orders.size, cells.shape[1] - 1),
        "shapley": total[orders].ravel(),
    }


def interactions(rows: DataFrame, part: str, filters: dict[str, Column], losses: dict[str, Column] | None = None, weight: Column | None = None) -> DataFrame:
    """Rows kept, removed, redundant and lost at each step of every order of ``filters``.

    ``filters`` maps one-letter names to failure conditions (a null condition is no failure);
    ``losses`` maps column names to conditions whose removed rows are counted at each step.
    Result: (part, filter_order, step, kept, removed, redundant, unique_fails, <losses>,
    shapley), counts of type bigint. A null part is the empty string. An empty table gives no
    rows. ``weight`` is the number of rows that a row stands for.
    """
    names, losses = list(filters), losses or {}
    if not 0 < len(names) <= MAX_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"1 to {MAX_FILTERS} filters with one-letter names are needed")
    weight = F.lit(1) if weight is None else weight
    mask = sum((F.when(c, 1 << b).otherwise(0) for b, c in enumerate(filters.values())), F.lit(0))
    sums = [F.sum(weight), *(F.sum(F.when(c, weight).otherwise(0)) for c in losses.values())]
    cells = rows.groupBy(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"))
    cells = cells.agg(F.array(*(s.cast("bigint") for s in sums)).alias("counts"))
    # at most 2**7 cells a part
    parts = cells.groupBy("part").agg(F.collect_list("mask").alias("masks"), F.flatten(F.collect_list("counts")).alias("counts"))
    width = len(sums)
    shape = ", ".join(
        ["part string", "filter_order string", "step int"]
        + [f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", *losses, "shapley")]
    )
    columns = [c.split(" ")[0] for c in shape.split(", ")]
    per_part = math.factorial(len(names)) * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, max(1, STEP_ROWS // per_part)):
                out: list[list] = [[] for _ in columns]
                for name, masks, counts in zip(*(c.to_pylist() for c in batch.slice(low, max(1, STEP_ROWS // per_part)).columns)):
                    table = np.zeros((1 << len(names), width), np.int64)
                    table[masks] = np.array(counts, np.int64).reshape(-1, width)
                    found = steps_of(table, names)
                    lost = found.pop("lost")
                    values = [np.repeat(np.array([name], object), per_part), *(found[c] for c in columns[1:7]), *lost.T, found["shapley"]]
                    for column, value in zip(out, values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], columns)

    return parts.select("part", "masks", "counts").mapInArrow(run, shape)


def text_flags(text: Column) -> dict[str, Column]:
    """Failure conditions of a text by itself; words are runs of other characters than blanks."""
    words = F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")
    long = lambda c: c.cast("bigint")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * long(F.size(F.array_distinct(words))) < 50 * long(F.size(words)),
        "C": 100 * long(capitals) > 3 * long(F.length(text)),
        "D": text.rlike(r"[#$%&*|]"),
    }


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The five text filters in all orders, per part, with the good and the toxic rows lost.

    A to D are ``text_flags``; E fails if a row with a smaller id has the same text. A null
    text is empty; rows without an id count, but are no copy of any row and have none, nor a
    label. A document is good (toxic) if any of its ``labels`` rows says so; repeated rows of
    documents count as often as they stand.

    Equal texts meet by a hash of 256 bits. What meets there is the smallest id of a text, a
    partial minimum, so that copies in any number never come to one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    flags = text_flags(F.col("text"))
    marked = docs.select(F.col(id_col).alias("id"), F.col(part).alias("part"), text.alias("text"))
    marked = marked.select("id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), *(c.alias(f"fail_{n}") for n, c in flags.items()))
    # a row per document, so that only distinct ones are joined
    marked = marked.groupBy(*marked.columns).agg(F.count("*").alias("n"))
    first = marked.groupBy("hash").agg(F.min("id").alias("id")).filter("id IS NOT NULL").withColumn("first", F.lit(True))
    marked = marked.join(first, ["hash", "id"], "left")
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    said = said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    marked = marked.join(said, "id", "left")
    filters = {n: F.col(f"fail_{n}") for n in flags} | {"E": F.col("first").isNull() & F.col("id").isNotNull()}
    return interactions(marked, "part", filters, {"good_lost": F.col("good"), "toxic_lost": F.col("bad")}, F.col("n"))
