"""Exact ranks and rank cuts over groups of any size.

A stratified split, a sample, a fold or a pruning quota all ask the same: which rows
are the first r of their group in a given order? Sorting a class into one task does
not scale, so ``rank_band`` finds, per group, the row at each wanted rank by counting
ranges of the order, ever finer (a distributed selection), and then compares every row
with those few cuts. Wide rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.keyed import Order
from tamis.session import SMALL_ROWS, bounded, join_small, local_table, materialise

Bounds = Callable[[DataFrame], DataFrame]
Cut = tuple[int, str]

# More groups than this are not listed on the driver.
MAX_GROUPS = SMALL_ROWS
# Ranges holding at most this many rows are sorted directly.
DIRECT_ROWS = 200_000
# Counters per range and pass: parts of a range of heads, or 3 hex digits of the tail.
PARTS = 4096
TAIL_DIGITS = 3
# Up to this many rows, a plain top-k (one heap per task) is used.
HEAP_ROWS = 10_000
BELOW_ALL: Cut = (-(1 << 63), "")
ABOVE_ALL: Cut = ((1 << 63) - 1, "~")


def group_key(groups: Sequence[str]) -> Column:
    """One null-safe text key for a list of grouping columns."""
    if not groups:
        return F.lit("")
    return F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in groups])


def rank_band(
    df: DataFrame,
    order: Order,
    bounds: Bounds,
    groups: Sequence[str] = (),
    out: str = "band",
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Add ``out``: how many of its group's rank bounds lie below the row's rank.

    ``bounds`` receives one row per group (``groups``, ``n``) and adds an ascending
    ``bounds ARRAY<BIGINT>``. A row of rank r (from 1) gets the number of bounds b with
    b < r: with bounds [70, 85] the bands 0, 1, 2 hold 70, 15 and the remaining rows.
    """
    groups = list(groups)
    rows = df.select(*groups, group_key(groups).alias("_g"), order.head.alias("_head"), order.tail.alias("_tail"))
    sizes = rows.groupBy("_g", *groups).agg(
        F.count("*").alias("n"), F.min("_head").alias("_lo"), F.max("_head").alias("_hi")
    )
    rows = rows.select("_g", "_head", "_tail")
    small = bounded(sizes, MAX_GROUPS)
    if small is None:
        return _rank_band_many_groups(df, order, bounds, groups, out, rows, sizes, direct_rows)
    sized = bounds(small).select("_g", "n", "_lo", "_hi", "bounds").collect()
    cuts = _find_cuts(rows, sized, direct_rows)
    if groups:
        return _apply_cuts(df.withColumn("_g", group_key(groups)), order, cuts, out).drop("_g")
    return _with_band(df, order, [(F.lit(h), F.lit(t)) for h, t in cuts.get("", [])], out)


def _with_band(df: DataFrame, order: Order, cuts: list[tuple[Column, Column]], out: str) -> DataFrame:
    """Add the number of cuts that come before the row."""
    band = F.lit(0)
    if order.is_random:
        # The hash is computed once per row, into a column of its own.
        for _, tail in cuts:
            band = band + F.when(F.col("_tail") > tail, 1).otherwise(0)
        return df.withColumn("_tail", order.tail).withColumn(out, band.cast("int")).drop("_tail")
    for head, tail in cuts:
        # Equal heads are rare, and only they need the hash.
        beyond = (order.head > head) | ((order.head == head) & (order.tail > tail))
        band = band + F.when(beyond, 1).otherwise(0)
    return df.withColumn(out, band.cast("int"))


def _apply_cuts(df: DataFrame, order: Order, cuts: dict[str, list[Cut]], out: str) -> DataFrame:
    """Rows of the groups in ``cuts`` (by ``_g``) with their band; no row is moved."""
    width = max((len(c) for c in cuts.values()), default=0)
    padded = [(g, c + [ABOVE_ALL] * (width - len(c))) for g, c in cuts.items()]
    table = local_table(
        df.sparkSession,
        [(g, [h for h, _ in c], [t for _, t in c]) for g, c in padded],
        "_g string, _heads array<bigint>, _tails array<string>",
    )
    pairs = [(F.col("_heads")[i], F.col("_tails")[i]) for i in range(width)]
    return _with_band(df.join(F.broadcast(table), "_g"), order, pairs, out).drop("_heads", "_tails")


def cuts_at_ranks(
    df: DataFrame, order: Order, ranks: Sequence[int], n: int, direct_rows: int = DIRECT_ROWS
) -> list[Cut]:
    """Head and tail of the rows at given ranks (1..n) of the whole table."""
    rows = df.select(F.lit("").alias("_g"), order.head.alias("_head"), order.tail.alias("_tail"))
    ends = rows.agg(F.min("_head").alias("lo"), F.max("_head").alias("hi")).first()
    found = _search(rows, [_Target("", r, r, n, ends.lo, ends.hi) for r in sorted(set(ranks))], direct_rows)
    return [found[("", r)] for r in ranks]


# --- selection ---------------------------------------------------------------------


@dataclass(frozen=True)
class _Target:
    """A wanted rank, and the range of the order it is known to lie in."""

    group: str
    rank: int
    # Rank among the ``count`` rows of the range: heads lo..hi, and, once they are equal,
    # tails starting with ``prefix``.
    left: int
    count: int
    lo: int
    hi: int
    prefix: str = ""

    @property
    def range(self) -> tuple:
        return (self.group, self.lo, self.hi, self.prefix)


@dataclass(frozen=True)
class GroupSize:
    """A group's key, rows, least and largest head, and wanted rank bounds."""

    _g: str
    n: int
    _lo: int
    _hi: int
    bounds: list[int]


def cuts_at_bounds(rows: DataFrame, sizes: list[GroupSize], direct_rows: int = DIRECT_ROWS) -> dict[str, list[Cut]]:
    """For each group, the order's place (head, tail) at each of its rank bounds.

    ``rows`` (``_g``, ``_head``, ``_tail``) is scanned once per pass, the ranges of all groups
    together, and may be a projection that multiplies rows: it is never stored.
    """
    return _find_cuts(rows, sizes, direct_rows)


def _find_cuts(rows: DataFrame, sized: list, direct_rows: int) -> dict[str, list[Cut]]:
    wanted = {(s._g, b): _Target(s._g, b, b, s.n, s._lo, s._hi) for s in sized for b in s.bounds if 0 < b < s.n}
    found = _search(rows, list(wanted.values()), direct_rows)

    def cut(s, b) -> Cut:
        if b <= 0:
            return BELOW_ALL
        return ABOVE_ALL if b >= s.n else found[(s._g, b)]

    return {s._g: [cut(s, b) for b in s.bounds] for s in sized}


def _in_ranges(rows: DataFrame, targets: list[_Target]) -> tuple[DataFrame, DataFrame]:
    """Rows within the targets' ranges, and the targets, both with the range's number ``_r``."""
    numbers = {r: i for i, r in enumerate(sorted({t.range for t in targets}))}
    table = [(i, *r) for r, i in numbers.items()]
    ranges = local_table(rows.sparkSession, table, "_r int, _g string, _lo bigint, _hi bigint, _prefix string")
    inside = (F.col("_head") >= F.col("_lo")) & (F.col("_head") <= F.col("_hi"))
    if any(t.prefix for t in targets):
        inside = inside & F.col("_tail").startswith(F.col("_prefix"))
    wanted = [(numbers[t.range], t.group, t.rank, t.left) for t in targets]
    wanted_table = local_table(rows.sparkSession, wanted, "_r int, _group string, _rank bigint, _left bigint")
    return rows.join(F.broadcast(ranges), "_g").filter(inside), F.broadcast(wanted_table)


def _search(rows: DataFrame, targets: list[_Target], direct_rows: int) -> dict[tuple[str, int], Cut]:
    """Head and tail at every wanted (group, rank)."""
    found: dict[tuple[str, int], Cut] = {}
    by_name = {(t.group, t.rank): t for t in targets}
    while True:
        wide = [t for t in by_name.values() if t.count > direct_rows and t.lo < t.hi]
        tied = [t for t in by_name.values() if t.count > direct_rows and t.lo == t.hi]
        if not wide and not tied:
            break
        for crowded, part in ((wide, _head_part()), (tied, _tail_part())):
            for hit in _narrow(rows, crowded, part) if crowded else []:
                name = (hit._group, hit._rank)
                old = by_name[name]
                left = hit._left - (hit._cum - hit._c)
                if old.lo < old.hi:
                    step = -(-(old.hi - old.lo + 1) // PARTS)
                    lo = old.lo + int(hit._part) * step
                    by_name[name] = replace(old, left=left, count=hit._c, lo=lo, hi=min(old.hi, lo + step - 1))
                elif hit._part == "":
                    found[name] = (old.lo, old.prefix)
                    del by_name[name]
                else:
                    by_name[name] = replace(old, left=left, count=hit._c, prefix=old.prefix + hit._part)
    rest = list(by_name.values())
    if rest:
        near, wanted = _in_ranges(rows, rest)
        place = F.row_number().over(Window.partitionBy("_r").orderBy("_head", "_tail"))
        hits = (
            near.select("_r", "_head", "_tail", place.cast("bigint").alias("_left"))
            .join(wanted, ["_r", "_left"])
            .collect()
        )
        found.update({(h._group, h._rank): (h._head, h._tail) for h in hits})
    return found


def _head_part() -> Column:
    """Place of the head among ``PARTS`` equal parts of its range."""
    return F.expr(f"(_head - _lo) div ((_hi - _lo + {PARTS}) div {PARTS})")


def _tail_part() -> Column:
    """The next digits of the tail after its prefix."""
    return F.col("_tail").substr(F.length("_prefix") + 1, F.lit(TAIL_DIGITS))


def _narrow(rows: DataFrame, targets: list[_Target], part: Column) -> list:
    """The part of its range that holds each target, with rows up to and in the part."""
    near, wanted = _in_ranges(rows, targets)
    counts = near.groupBy("_r", part.alias("_part")).agg(F.count("*").alias("_c"))
    # At most PARTS counters per range.
    upto = Window.partitionBy("_r").orderBy("_part")
    return (
        counts.withColumn("_cum", F.sum("_c").over(upto))
        .join(wanted, "_r")
        .filter((F.col("_cum") >= F.col("_left")) & (F.col("_cum") - F.col("_c") < F.col("_left")))
        .collect()
    )


def _rank_band_many_groups(
    df: DataFrame,
    order: Order,
    bounds: Bounds,
    groups: list[str],
    out: str,
    rows: DataFrame,
    sizes: DataFrame,
    direct_rows: int,
) -> DataFrame:
    """Same result when the groups themselves are too many for the driver.

    Groups above a size limit are few and get cuts as usual; every other group is small
    enough to be sorted in one task.
    """
    sized = bounds(sizes).select("_g", "n", "_lo", "_hi", "bounds")
    hot = bounded(sized.filter(F.col("n") > direct_rows), MAX_GROUPS)
    while hot is None:
        direct_rows *= 4
        hot = bounded(sized.filter(F.col("n") > direct_rows), MAX_GROUPS)
    hot_rows = hot.collect()
    names = F.broadcast(hot.select("_g"))
    keyed = df.withColumn("_g", group_key(groups))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(order.head, order.tail))
    calm = (
        keyed.join(names, "_g", "left_anti")
        .withColumn("_rank", place)
        .join(sized.filter(F.col("n") <= direct_rows).select("_g", "bounds"), "_g")
        .withColumn(out, F.expr("size(filter(bounds, b -> b < _rank))").cast("int"))
        .drop("_rank", "bounds")
    )
    if not hot_rows:
        return calm.drop("_g")
    cuts = _find_cuts(rows.join(names, "_g", "left_semi"), hot_rows, direct_rows)
    return calm.unionByName(_apply_cuts(keyed, order, cuts, out)).drop("_g")


# --- uses --------------------------------------------------------------------------


def fixed_bounds(*bounds: int) -> Bounds:
    """The same rank bounds for every group."""
    return lambda sizes: sizes.withColumn("bounds", F.array(*[F.lit(b).cast("bigint") for b in bounds]))


def first_in_group(df: DataFrame, order: Order, n: int, groups: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of every group."""
    return rank_band(df, order, fixed_bounds(n), groups, "_band").filter("_band = 0").drop("_band")


def global_rank(df: DataFrame, order: Order, out: str = "rank") -> DataFrame:
    """Add the exact rank (from 1) of every row over the whole table.

    The range-sorted rows are checkpointed, which freezes their partitions; a row's
    rank is its position there plus the rows of earlier partitions.
    """
    keyed = df.withColumns({"_head": order.head, "_tail": order.tail})
    frozen = materialise(keyed.orderBy("_head", "_tail").drop("_head", "_tail"))
    placed = frozen.withColumn("_id", F.monotonically_increasing_id()).withColumn(
        "_pid", F.shiftright("_id", 33).cast("int")
    )
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = (
        placed.groupBy("_pid")
        .agg(F.count("*").alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        .select("_pid", "_before")
    )
    position = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        join_small(placed, offsets, "_pid")
        .withColumn(out, F.col("_before") + position + 1)
        .drop("_id", "_pid", "_before")
    )


def top_k(df: DataFrame, order: Order, k: int, out: str = "pick") -> DataFrame:
    """The first ``k`` rows in order with their place (from 1)."""
    if k <= 0:
        return df.limit(0).withColumn(out, F.lit(0).cast("bigint"))
    if k <= HEAP_ROWS:
        best = df.withColumns({"_head": order.head, "_tail": order.tail}).orderBy("_head", "_tail").limit(k)
        place = F.row_number().over(Window.orderBy("_head", "_tail")).cast("bigint")
        return best.withColumn(out, place).drop("_head", "_tail")
    return global_rank(first_in_group(df, order, k), order, out)
