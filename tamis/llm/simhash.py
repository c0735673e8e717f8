"""SimHash near-duplicates: fingerprints linked by vantage-point trees.

Two fingerprints that differ in at most ``radius`` bits differ in at most ``radius // parts``
bits of one of ``parts`` disjoint bit blocks. Each block has a vantage-point tree under the
Hamming distance of that block, searched with the smaller radius. The upper levels of a tree
deal fingerprints to shards; a fingerprint whose ball crosses a level's bound also visits the
shard on the other side, so that every pair meets in the home shard of one of the two. Within
a shard the tree goes on, with vantage points from the shard. Nothing is approximate: pairs
that meet are compared over all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.batches import chosen, steps, utf8
from tamis.llm.components import components
from tamis.session import join_small, materialise

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
PARTS = 3
# Home fingerprints of a shard at which a tree's shared levels end, and of one task's block.
SHARD_ROWS = 32_768
BLOCK_ROWS = 65_536
# Fingerprints that are compared directly.
LEAF_ROWS = 1024
LEAF_PAIRS = 1 << 22
MIN_LEVELS = 3
# Shingle hashes whose bits are counted at once.
COUNT_ROWS = 65_536


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a UTF-8 text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    lows, highs = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(lows), COUNT_ROWS):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(lows[at : at + COUNT_ROWS], highs[at : at + COUNT_ROWS])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(lows), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed long. Null texts have no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            found = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return chosen(docs, id_col, text_col).mapInArrow(run, f"id {kind}, fp bigint")


def _masks(parts: int) -> list[int]:
    """Disjoint bit blocks that cover the fingerprint."""
    edges = [BITS * p // parts for p in range(parts + 1)]
    return [sum(1 << b for b in range(low, high)) for low, high in zip(edges, edges[1:])]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _distance(vantage: int, mask: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(vantage & mask))).bitwiseAND(F.lit(_signed(mask))))


def _vantage(tree: int, level: int) -> int:
    """The shared vantage point of a tree's level: a fixed pseudo-random code."""
    return xxhash.xxh64_intdigest(f"vantage {tree} {level}", SEED)


def _bounds(classes: DataFrame, masks: list[int], levels: int) -> dict[tuple[int, int], int]:
    """The median distance of each level, from exact counts over all fingerprints."""
    cells = [
        F.struct(F.lit(t).alias("t"), F.lit(k).alias("k"), _distance(_vantage(t, k), mask).alias("d"))
        for t, mask in enumerate(masks)
        for k in range(levels)
    ]
    counts = classes.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.t", "c.k", "c.d").count()
    out: dict[tuple[int, int], int] = {}
    # at most trees x levels x 65 rows
    rows = sorted(counts.collect())
    totals: dict[tuple[int, int], int] = {}
    for t, k, _, n in rows:
        totals[t, k] = totals.get((t, k), 0) + n
    below: dict[tuple[int, int], int] = {}
    for t, k, d, n in rows:
        below[t, k] = below.get((t, k), 0) + n
        if 2 * below[t, k] >= totals[t, k]:
            out.setdefault((t, k), d)
    return out


def _visits(classes: DataFrame, tree: int, mask: int, levels: int, bounds: dict, reach: int) -> DataFrame:
    """(tree, shard, home, node, fp): the home shard of a fingerprint and those its ball touches."""
    rows = classes.withColumns({"shard": F.lit(0), "home": F.lit(True)})
    for level in range(levels):
        d, bound = _distance(_vantage(tree, level), mask), bounds[tree, level]
        inside = d <= bound
        other = F.when(inside, d + reach > bound).otherwise(d - reach <= bound)
        own = F.when(inside, 0).otherwise(1)
        sides = F.array(F.struct(own.alias("side"), F.lit(True).alias("stay")), F.struct((1 - own).alias("side"), F.lit(False).alias("stay")))
        rows = rows.withColumn("s", F.explode(F.when(other, sides).otherwise(F.slice(sides, 1, 1))))
        rows = rows.select("node", "fp", (F.col("shard") * 2 + F.col("s.side")).alias("shard"), (F.col("home") & F.col("s.stay")).alias("home"))
    return rows.withColumn("tree", F.lit(tree))


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints of ``a`` (rows) and ``b`` (columns) are within ``radius``."""
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def _spread(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of dense points: whole neighbourhoods leave the rest at once."""
    rest = np.arange(len(fps))
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            width = max(1, LEAF_PAIRS // len(rest))
            wave, frontier = frontier[:width], frontier[width:]
            mask = near(fps[wave], fps[rest], radius)
            reached = mask.any(axis=0)
            if reached.any():
                yield wave[mask.argmax(axis=0)[reached]], rest[reached]
                frontier, rest = np.concatenate([frontier, rest[reached]]), rest[~reached]


def _search(fps: np.ndarray, home: np.ndarray, around: np.ndarray, mask: np.uint64, reach: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between ``home`` and ``around`` (which holds ``home``): positions in ``fps``."""
    stack = [(home, around)]
    while stack:
        home, around = stack.pop()
        if not len(home):
            continue
        if len(home) > LEAF_ROWS:
            vantage = fps[home[len(home) // 2]]
            own = np.bitwise_count((fps[home] ^ vantage) & mask)
            far = np.bitwise_count((fps[around] ^ vantage) & mask).astype(np.int16)
            bound = int(np.median(own))
            inner = own <= bound
            first = (home[inner], around[far <= bound + reach])
            second = (home[~inner], around[far > bound - reach])
            if max(len(first[1]), len(second[1])) < 0.95 * len(around) and inner.any() and not inner.all():
                stack += [first, second]
                continue
        width = max(1, LEAF_PAIRS // max(1, len(around)))
        for at in range(0, len(home), width):
            part = home[at : at + width]
            found = near(fps[part], fps[around], radius)
            if np.count_nonzero(found) > 16 * (len(home) + len(around)):
                yield from ((around[a], around[b]) for a, b in _spread(fps[around], radius))
                break
            rows, columns = np.nonzero(found)
            a, b = part[rows], around[columns]
            yield a[a != b], b[a != b]


def shard_links(fps: np.ndarray, nodes: np.ndarray, home: np.ndarray, mask: int, reach: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, smallest node of its tree) of the links found in one shard."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.argsort(nodes, kind="stable")
    fps, nodes, home = fps[order], nodes[order], home[order]
    touched: set[int] = set()
    for left, right in _search(fps, np.nonzero(home)[0], np.arange(len(fps)), np.uint64(mask), reach, radius):
        for a, b in zip(left.tolist(), right.tolist()):
            touched.add(a)
            touched.add(b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    members = np.array(sorted(touched), np.int64)
    roots = np.array([root(x) for x in members.tolist()], np.int64)
    keep = members != roots
    return nodes[members[keep]], nodes[roots[keep]]


def links(classes: DataFrame, radius: int = RADIUS, parts: int = PARTS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between the nodes of ``classes`` (node, fp; fp distinct) whose transitive
    closure is that of all pairs within ``radius`` bits."""
    total = classes.count()
    levels = max(MIN_LEVELS, math.ceil(math.log2(max(1, total / shard_rows))))
    masks, reach = _masks(parts), radius // parts
    bounds = _bounds(classes, masks, levels) if total else {(t, k): 0 for t in range(parts) for k in range(levels)}
    rows = None
    for tree, mask in enumerate(masks):
        own = _visits(classes, tree, mask, levels, bounds, reach)
        rows = own if rows is None else rows.unionByName(own)
    # A shard with many home rows is cut into blocks of home rows x blocks of all its rows.
    sizes = rows.groupBy("tree", "shard").agg(F.count("*").alias("n_all"), F.count_if("home").alias("n_home")).filter("n_home > 0")
    cut = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    sizes = sizes.select("tree", "shard", cut("n_home").alias("rows_cut"), cut("n_all").alias("all_cut"))
    rows = join_small(rows, sizes, ["tree", "shard"])
    spot = F.xxhash64("fp", "tree")
    as_home = rows.filter("home").withColumns(
        {"i": F.array(F.pmod(spot, F.col("rows_cut")).cast("int")), "j": F.sequence(F.lit(0), F.col("all_cut") - 1)}
    )
    as_all = rows.withColumns(
        {"i": F.sequence(F.lit(0), F.col("rows_cut") - 1), "j": F.array(F.pmod(spot, F.col("all_cut")).cast("int"))}
    ).withColumn("home", F.lit(False))
    placed = as_home.unionByName(as_all).withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        nodes = table.column("node").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        # a fingerprint that is both is listed twice: keep its home row
        order = np.lexsort((~home, nodes))
        fps, nodes, home = fps[order], nodes[order], home[order]
        first = np.concatenate(([True], nodes[1:] != nodes[:-1])) if len(nodes) else home
        a, b = shard_links(fps[first], nodes[first], home[first], masks[key[0].as_py()], reach, radius)
        return pa.table({"a": a, "b": b}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    shape = placed.select("tree", "shard", "i", "j", "node", "fp", "home")
    return shape.groupBy("tree", "shard", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    id that can be reached over links, the row's own included. Texts without words (null,
    empty, blank) have fingerprint zero and link like any other; repeated rows stay. A row
    with a null id takes its fingerprint's component, which is null if no row with an id has
    that fingerprint. Equal fingerprints are one node, so copies are never expanded to pairs.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, shingle).withColumn("id", F.col("id").cast("bigint")))
    classes = materialise(marked.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node")))
    joined = components(links(classes, radius))
    owner = classes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    found = marked.join(owner, "fp", "left")
    return found.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component_id").cast(docs.schema[id_col].dataType),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Groups are the components of ``near_duplicates``.
    Of rows that repeat the kept id, one stays; rows with a null id all stay. The ids to remove
    are broadcast if they are few by count, otherwise both sides are shuffled.
    """
    found = near_duplicates(docs, id_col, text_col, radius, shingle).filter(F.col(id_col).isNotNull())
    ids = materialise(found.groupBy(id_col).agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")))
    rest = join_small(docs, ids.filter(F.col(id_col) != F.col("component_id")).select(id_col), id_col, "left_anti")
    repeated = ids.filter((F.col(id_col) == F.col("component_id")) & (F.col("n") > 1)).select(id_col)
    if repeated.isEmpty():
        return rest.select(docs.columns)
    once = join_small(rest, repeated, id_col, "left_anti")
    return once.unionByName(join_small(rest, repeated, id_col, "left_semi").dropDuplicates([id_col])).select(docs.columns)
