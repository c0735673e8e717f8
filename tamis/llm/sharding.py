"""Shards of near-equal bytes by histogram sort, with DataFrame functions alone.

Rows are ordered by (hash of the text, hash of the id): equal texts stand together, and a text
with very many copies can still be cut between two of them. Probes are the boundaries of 4096
ranges of that order. One pass counts the exact bytes in each range; every splitter then looks
only inside the one range that holds its target, until the bytes below it are within the
tolerance or the range is a single key. Shards are numbered by ranges of the same order that a
task can sort: one exchange brings each range's rows together, and the rows of the shard's
ranges before it, counted from the keys alone, are added to a row's place in its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import local_table, materialise

# Bytes that a row costs beside its text.
ROW_BYTES = 16
# Bits of the order that one pass refines; its counts are at most splitters x 4096 rows.
PROBE_BITS = 12
# Bits of one part of the order: a hash, shifted to be non-negative.
PART_BITS = 60
# A splitter may miss its target by this share of a shard.
TOLERANCE = 0.001
# Bytes of a range that one task sorts; with more than MOST_RANGES of them, ranges grow instead.
RANGE_BYTES = 64 << 20
MOST_RANGES = 1024
# A range may miss its end by this share of it.
RANGE_TOLERANCE = 0.5


def order_key(id_col: str, text_col: str) -> list[Column]:
    """The order's two parts, each in [0, 2^60)."""
    return [F.shiftrightunsigned(F.xxhash64(text_col), 64 - PART_BITS), F.shiftrightunsigned(F.xxhash64(id_col), 64 - PART_BITS)]


def _digit(depth: int) -> tuple[str, int]:
    """The part of the order that pass ``depth`` refines, and the bits below its digit."""
    per_part = PART_BITS // PROBE_BITS
    return ("_k1", "_k2")[depth // per_part], PART_BITS - PROBE_BITS * (depth % per_part + 1)


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The first key (of _k1, _k2) of shards 1, 2, ..., from the bytes in ``size``."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    targets = [total * s / shards for s in range(1, shards)]
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    # of each open splitter: the first key of its range and the bytes below that range
    open_at = {s: ((0, 0), 0) for s in range(len(targets))}
    depth, last = 0, 2 * PART_BITS // PROBE_BITS - 1
    while open_at and total:
        part, shift = _digit(depth)
        digit = F.shiftright(part, shift).bitwiseAND((1 << PROBE_BITS) - 1).cast("int").alias("digit")
        ranges = sorted({low for low, _ in open_at.values()})
        if depth == 0:
            inside = keyed.withColumn("range", F.lit(0))
        else:
            # the ranges are fewer than the splitters: a small local table
            place = local_table(keyed.sparkSession, [(*low, i) for i, low in enumerate(ranges)], "a bigint, b bigint, range int")
            above = shift + PROBE_BITS
            on_first = part == "_k1"
            cut = lambda c: F.shiftleft(F.shiftright(c, above), above)
            match = (cut("_k1") == F.col("a")) if on_first else (F.col("_k1") == F.col("a")) & (cut("_k2") == F.col("b"))
            inside = keyed.join(F.broadcast(place), match)
        counts: dict[int, dict[int, int]] = {}
        for r in inside.groupBy("range", digit).agg(F.sum("size").alias("size")).collect():
            counts.setdefault(r["range"], {})[r["digit"]] = r["size"]
        going = {}
        for s, (low, below) in open_at.items():
            key, bytes_below = low, below
            for d, size in sorted(counts.get(ranges.index(low), {}).items()):
                key = (low[0] + (d << shift), low[1]) if part == "_k1" else (low[0], low[1] + (d << shift))
                if bytes_below + size >= targets[s]:
                    break
                bytes_below += size
            after = (key[0] + (1 << shift), 0) if part == "_k1" else (key[0], key[1] + (1 << shift))
            to_low, to_high = targets[s] - bytes_below, bytes_below + size - targets[s]
            if min(to_low, to_high) <= slack or depth == last:
                found[s] = key if to_low <= to_high else after
            else:
                going[s] = (key, bytes_below)
        open_at, depth = going, depth + 1
    return [found.get(s, (1 << PART_BITS, 0)) for s in range(len(targets))]


def _place(keys: list[tuple[int, int]], first: int = 0) -> Column:
    """The number of splitters at or below the row's key: a balanced tree of comparisons."""
    if not keys:
        return F.lit(first)
    mid = len(keys) // 2
    a, b = keys[mid]
    reached = (F.col("_k1") > a) | ((F.col("_k1") == a) & (F.col("_k2") >= b))
    return F.when(reached, _place(keys[mid + 1 :], first + mid + 1)).otherwise(_place(keys[:mid], first))


def _ranged(placed: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """``placed`` with ``_range``: the number of cuts at or below the row's key.

    Cuts are looked up by the first digit of the key, so that a row is compared with the few
    of that digit only (many, if one text holds many rows).
    """
    if not cuts:
        return placed.withColumn("_range", F.lit(0))
    _, shift = _digit(0)
    inside: dict[int, list[tuple[int, int]]] = {}
    for cut in cuts:
        inside.setdefault(cut[0] >> shift, []).append(cut)
    rows, before = [], 0
    for digit in range(1 << PROBE_BITS):
        here = inside.get(digit, [])
        rows.append((digit, before, [{"a": a, "b": b} for a, b in here]))
        before += len(here)
    # one row per value of a digit
    table = local_table(placed.sparkSession, rows, "_digit int, _before int, _cuts array<struct<a: bigint, b: bigint>>")
    key = F.struct(F.col("_k1").alias("a"), F.col("_k2").alias("b"))
    found = placed.withColumn("_digit", F.shiftright("_k1", shift).cast("int")).join(F.broadcast(table), "_digit")
    return found.withColumn("_range", F.col("_before") + F.size(F.filter("_cuts", lambda c: c <= key))).drop("_digit", "_before", "_cuts")


def shard_by_bytes(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """All rows and columns of ``docs`` with ``size``, ``shard`` (from 0) and ``slot``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 16; the sizes of the shards
    differ by at most about twice ``tolerance`` and one document. ``slot`` counts a shard's
    rows from 0 without gaps in its order. Rows with the same id and text cannot be told
    apart and share a shard; a null id or text is a value like any other; an empty table has
    no shards. Columns of the given names or starting with ``_k`` are replaced, as are
    ``_range``, ``_rows_before``, ``_digit``, ``_before`` and ``_cuts``.
    """
    k1, k2 = order_key(id_col, text_col)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint") + ROW_BYTES
    sized = docs.drop("_range", "_rows_before", "_digit", "_before", "_cuts").withColumns({"_k1": k1, "_k2": k2, "size": size})
    keyed = materialise(sized.select("_k1", "_k2", "size"))
    total = keyed.agg(F.sum("size")).first()[0] or 0
    keys = splitters(keyed, shards, tolerance)
    ranges = min(MOST_RANGES, max(1, -(-total // range_bytes)))
    cuts = splitters(keyed, ranges, RANGE_TOLERANCE)
    place = lambda df: _ranged(df.withColumn("shard", _place(keys).cast("int")), cuts)
    # at most shards + ranges rows
    counted = sorted(tuple(r) for r in place(keyed).groupBy("shard", "_range").agg(F.count("*")).collect())
    offsets, before = [], {}
    for shard, part, rows in counted:
        offsets.append((shard, part, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + rows
    offset = F.broadcast(local_table(docs.sparkSession, offsets, "shard int, _range int, _rows_before bigint"))
    by = Window.partitionBy("shard", "_range").orderBy("_k1", "_k2", id_col)
    numbered = place(sized).withColumn("slot", F.row_number().over(by) - 1).join(offset, ["shard", "_range"])
    slot = (F.col("slot") + F.col("_rows_before")).cast("bigint")
    made = {"_k1", "_k2", "size", "shard", "slot", "_range", "_rows_before", "_digit", "_before", "_cuts"}
    return numbered.select(*[c for c in docs.columns if c.lower() not in made], "size", "shard", slot.alias("slot"))
