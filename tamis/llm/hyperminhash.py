"""HyperMinHash near-duplicates: compressed registers, bands, corrected estimates, whole sets.

The hash of a shingle chooses a bucket; a bucket keeps its smallest remaining hash as the count
of leading zeros with ten mantissa bits, sixteen bits in all. Bands of registers bring similar
sets to common keys: a pair at the asked similarity has no key in common with a probability of
at most about 5e-8. Pairs that meet are estimated by their equal registers, less the equal ones that
chance gives to different hashes; those not clearly below the threshold are verified on
the whole sets, so that every link is exact.

Every set first meets one pivot per key, the member that shares most keys with others, which
joins dense groups of any size at once; these pairs are as many as the rows of keys at most. What is
then still in several components is compared inside tasks. Sets with one home (the component of
the pivot of their largest key) meet in cells of one or two blocks of whole sets, and only links
that join components leave a cell. Sets of different homes meet by key with their registers,
and pairs whose estimate passes are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tamis.llm.batches import chosen, steps, utf8
from tamis.llm.components import components
from tamis.session import HOT_ROWS, bounded, join_by_size, join_small, materialise

SEED = 42
SHINGLE = 4
PERCENT = 80
BANDS, BAND = 32, 4
BUCKETS = BANDS * BAND
MANTISSA = 10
# Standard errors by which an estimate may lie below the threshold.
ERRORS = 4.0
# The chance that one register is equal for two different sets of one size, times 2**MANTISSA
# (the published constant of the approximate count of collisions).
CHANCE = 0.169919487159739
# Shingles of a block of sets (a set counts as LEAST shingles at least), and candidates of a set that
# are verified at once.
BLOCK_SHINGLES = 1 << 20
LEAST = 512
AT_ONCE = 64
# Members of a key that one task compares by registers.
KEY_ROWS = 2048


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words (of all words, if fewer)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lows, highs = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(lows, highs)), np.uint64, len(lows)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Sixteen bits per bucket: leading zeros and mantissa of its smallest hash; 0 is empty."""
    rest, bucket = np.divmod(hashes, np.uint64(BUCKETS))
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket.astype(np.int64), rest)
    filled = least != np.iinfo(np.uint64).max
    fraction, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
    zeros = (64 - exponent).astype(np.int64)
    mantissa = np.floor((2 * fraction - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(filled, (zeros << MANTISSA) + mantissa + 1, 0).astype(np.uint16)


def estimated(equal: np.ndarray, used: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from equal and used (not both empty) registers, less the collisions by chance."""
    large, small = np.maximum(n_a, n_b), np.minimum(n_a, n_b)
    ratio = large / np.maximum(small, 1)
    by_chance = CHANCE / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    share = equal / np.maximum(used, 1)
    return np.maximum(0.0, (share - by_chance) / (1 - by_chance))


def promising(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of registers (in the last axis) may reach the threshold."""
    same = a == b
    filled = (a != 0) | (b != 0)
    used = filled.sum(axis=-1)
    limit = percent / 100
    error = np.sqrt(limit * (1 - limit) / np.maximum(used, 1))
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return fits & (estimated((same & filled).sum(axis=-1), used, n_a, n_b) >= limit - ERRORS * error)


def links_of(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``others`` are similar enough to ``one``; sorted sets that are not empty."""
    every = np.concatenate(others)
    sizes = np.array([len(o) for o in others])
    found = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    both = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * both >= percent * (len(one) + sizes - both)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, n, whole, regs) per row: set size, 128-bit name of the set, registers; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            sets = [shingles(t, shingle) for t in utf8(batch.column(1))]
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "whole", "regs"])

    base = chosen(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    return base.mapInArrow(run, "id bigint, n bigint, whole binary, regs binary")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, node, n): a row per band of a set that is not empty there."""
    parts = [F.substring("regs", 2 * BAND * b + 1, 2 * BAND) for b in range(BANDS)]
    keys = F.array(*(F.when(p != F.lit(bytes(2 * BAND)), F.xxhash64(p, F.lit(b))) for b, p in enumerate(parts)))
    return classes.select(F.explode(F.array_compact(keys)).alias("key"), "node", "n")


def _join_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Inner join on ``key`` to a stored row per key; keys of very many rows (``size``) are broadcast."""
    hot = bounded(keys.filter(F.col("size") > HOT_ROWS))
    if hot is None:
        return join_by_size(rows, keys, "key", "size")
    if hot.isEmpty():
        return rows.join(keys, "key")
    calm = rows.join(F.broadcast(hot.select("key")), "key", "left_anti")
    return rows.join(F.broadcast(hot), "key").unionByName(calm.join(keys.filter(F.col("size") <= HOT_ROWS), "key"))


def _estimated_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, n_a, n_b) whose estimate passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 4):
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (4, 5))
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(promising(left, right, n_a, n_b, percent)))

    side = lambda s: classes.select(F.col("node").alias(s), F.col("regs").alias(f"regs_{s}"))
    met = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).join(side("a"), "a").join(side("b"), "b")
    # an id with several texts meets once for each
    return met.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, made): the sets of all texts of the ids ``nodes`` (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            made = [shingles(t, shingle).tobytes() or None for t in utf8(batch.column(1))]
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["node", "made"])
            yield found.filter(found.column(1).is_valid())

    base = chosen(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    return join_small(base, nodes.select(F.col("node").alias("id")), "id", "left_semi").mapInArrow(run, "node bigint, made binary")


def _verified(docs: DataFrame, pairs: DataFrame, blocks: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b; stored) that are links by their whole sets.

    ``blocks`` (node, block) deals sets that are likely alike to one block; a cell holds the pairs
    of two blocks, so that a set goes once to each cell it has pairs in.
    """

    def run(cell: tuple, sets: pa.Table, pairs: pa.Table) -> pa.Table:
        by_node: dict[int, list[np.ndarray]] = {}
        for node, data in zip(*(sets.column(c).to_pylist() for c in ("node", "made"))):
            by_node.setdefault(node, []).append(np.frombuffer(data, np.uint64))
        ok = [
            any(links_of(x, by_node[b], percent).any() for x in by_node.get(a, ())) if b in by_node else False
            for a, b in zip(*(pairs.column(c).to_pylist() for c in ("a", "b")))
        ]
        return pairs.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (blocks.select(F.col("node").alias(s), F.col("block").alias(f"block_{s}")) for s in ("a", "b"))
    dealt = pairs.join(left, "a").join(right, "b")
    dealt = materialise(dealt.select("a", "b", F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("cell")))
    wanted = materialise(dealt.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = _sets(docs, wanted.select("node").distinct(), id_col, text_col, shingle)
    members = join_small(sets, wanted, "node").select(F.col("cell").alias("place"), "node", "made")
    return members.groupBy("place").cogroup(dealt.groupBy("cell")).applyInArrow(run, "a bigint, b bigint")


def cell_links(nodes: np.ndarray, blocks: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links that join components of a cell; with two blocks, only pairs across them are compared.

    Sets are visited by size, so that those of fitting size follow each other; candidates are
    verified by falling estimate, and what a link has joined is not compared again.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    nodes, blocks, labels, sets = nodes[order], blocks[order], labels[order].copy(), [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    regs = np.array([registers(s) for s in sets]).reshape(-1, BUCKETS)
    across = len(np.unique(blocks)) > 1
    ends = np.searchsorted(percent * sizes, 100 * sizes, "right")
    a, b = [], []
    for x in range(len(sets)):
        near = np.arange(x + 1, ends[x])
        near = near[(labels[near] != labels[x]) & ((blocks[near] != blocks[x]) | (not across))]
        near = near[promising(regs[x][None, :], regs[near], sizes[x], sizes[near], percent)] if len(near) else near
        near = near[np.argsort(-(regs[near] == regs[x]).sum(axis=1), kind="stable")]
        while len(near):
            some, near = near[:AT_ONCE], near[AT_ONCE:]
            for y in some[links_of(sets[x], [sets[y] for y in some], percent)].tolist():
                if labels[y] != labels[x]:
                    a.append(int(nodes[x]))
                    b.append(int(nodes[y]))
                    labels[labels == labels[y]] = labels[x]
            near = near[labels[near] != labels[x]]
    return a, b


def _within_homes(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, block_shingles: int) -> DataFrame:
    """Links between ``nodes`` (node, n, label, home; stored) of one home and several labels."""
    homes = nodes.groupBy("home").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.sum(F.greatest("n", F.lit(LEAST))) / block_shingles).cast("int").alias("cuts")
    )
    mine = join_small(nodes, homes.filter("low < high").select("home", "cuts"), "home")
    mine = mine.withColumn("block", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: F.struct(F.least(i, "block").alias("i"), F.greatest(i, "block").alias("j")))
    wanted = materialise(mine.select("home", "node", "label", "block", F.inline(others)))
    sets = _sets(docs, wanted.select("node").distinct(), id_col, text_col, shingle)
    members = join_small(sets, wanted, "node").select("home", "i", "j", "node", "label", "block", "made")

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(m, np.uint64) for m in table.column("made").to_pylist()]
        a, b = cell_links(*(table.column(c).to_numpy() for c in ("node", "block", "label")), sets, percent)
        return pa.table({"a": a, "b": b}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return members.groupBy("home", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _across_homes(rest: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different homes and labels that share a key and whose estimate passes.

    ``rest``: (key, size, node, n, label, home, regs); ``size`` counts the rows of the key.
    """
    cuts = F.ceil(F.col("size") / F.lit(KEY_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("node"), cuts).cast("int")
    others = F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j")))
    placed = rest.select("key", own.alias("own"), "node", "n", "label", "home", "regs", F.inline(others))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("n").to_numpy(), kind="stable")
        node, n, label, home, own = (table.column(c).to_numpy()[order] for c in ("node", "n", "label", "home", "own"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)[order]
        across = len(np.unique(own)) > 1
        ends = np.searchsorted(percent * n, 100 * n, "right")
        pairs = []
        for x in range(len(node)):
            near = np.arange(x + 1, ends[x])
            near = near[(label[near] != label[x]) & (home[near] != home[x]) & ((own[near] != own[x]) | (not across))]
            if len(near):
                near = near[promising(regs[x][None, :], regs[near], n[x], n[near], percent)]
                pairs.append(np.stack([np.minimum(node[near], node[x]), np.maximum(node[near], node[x])], axis=1))
        found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return placed.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def _labels(near: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the component that each node belongs to so far."""
    return near.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("label"))


def _links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, block_shingles: int) -> DataFrame:
    """Links (a, b) between nodes whose transitive closure is that of all similar pairs."""
    rows = _keys(classes)
    sizes = materialise(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    # at most a key per band for each node, here and below
    met = _join_keys(rows, sizes).groupBy("node")
    met = materialise(met.agg(F.max("n").alias("n"), F.sum("size").alias("liking"), F.collect_list(F.struct("size", "key")).alias("keys")))
    each = met.select("node", "n", "liking", F.inline("keys"))
    best = each.groupBy("key").agg(F.max(F.struct("liking", (-F.col("node")).alias("minus"), "n")).alias("best"), F.max("size").alias("size"))
    pivots = materialise(best.select("key", "size", (-F.col("best.minus")).alias("pivot"), F.col("best.n").alias("n_pivot")))
    near = _join_keys(each.select("key", "node", "n"), pivots).groupBy("node")
    near = materialise(near.agg(F.max("n").alias("n"), F.collect_list(F.struct("size", "pivot", "n_pivot", "key")).alias("keys")))
    # the group of a set is that of its largest key
    homes = near.select("node", "n", F.array_max("keys")["pivot"].alias("home"))
    cuts = homes.groupBy("home").agg(F.ceil(F.sum(F.greatest("n", F.lit(LEAST))) / block_shingles).cast("int").alias("cuts"))
    spot = F.pmod(F.xxhash64("node"), F.col("cuts"))
    blocks = materialise(homes.join(cuts, "home").select("node", F.xxhash64("home", spot).alias("block")))
    mates = F.array_distinct(F.transform("keys", lambda k: F.struct(k["pivot"].alias("pivot"), k["n_pivot"].alias("n_pivot"))))
    pairs = near.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.inline(mates)).filter("a <> pivot")
    pairs = pairs.select("a", F.col("pivot").alias("b"), "n_a", F.col("n_pivot").alias("n_b"))
    tried = materialise(_estimated_pairs(pairs, classes, percent))
    links = materialise(_verified(docs, tried, blocks, id_col, text_col, shingle, percent))
    # keys of two have met; in larger ones all but the pivot may be open
    labels = materialise(_labels(near, links))
    pivot_labels = labels.select(F.col("node").alias("home"), F.col("label").alias("at"))
    homes = homes.join(pivot_labels, "home").select("node", "n", F.col("at").alias("home"))
    nodes = materialise(homes.join(labels, "node"))
    links = materialise(links.unionByName(_within_homes(docs, nodes, id_col, text_col, shingle, percent, block_shingles)))
    nodes = nodes.drop("label").join(_labels(near, links), "node")
    rest = near.select("node", F.inline("keys")).filter("size > 2 AND node <> pivot").select("key", "node")
    rest = materialise(rest.join(nodes, "node"))
    mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("home").alias("first"), F.max("home").alias("last"), F.count("*").alias("size"))
    mixed = materialise(mixed.filter("low < high AND first < last").select("key", "size"))
    rest = _join_keys(rest, mixed).join(classes.select("node", "regs"), "node")
    found = materialise(_across_homes(rest, percent).join(tried, ["a", "b"], "left_anti"))
    return materialise(links.unionByName(_verified(docs, found, blocks, id_col, text_col, shingle, percent)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``.

    A row's set holds its distinct runs of ``shingle`` words; rows link if the Jaccard similarity of
    their sets is ``percent`` hundredths or more. ``component_id`` is the smallest id that can be
    reached over links, the row's own included; ``kept`` marks the row with that id. Texts without
    words (null, empty, blank) have an empty set and link with nothing. Equal sets are one node, so
    that copies are never expanded to pairs. Rows that repeat an id are one document, also with
    other texts. A row with a null id takes the component of its set, null if no row with an
    id has that set, and is not kept. Ids are integers.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError("ids must be integers")
    marked = materialise(sketches(docs, id_col, text_col, shingle))
    named = marked.filter("id IS NOT NULL AND whole IS NOT NULL")
    classes = named.groupBy("whole").agg(F.min("id").alias("node"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = materialise(classes)
    links = _links(docs, classes, id_col, text_col, shingle, percent, block_shingles)
    # texts of one id
    several = materialise(named.groupBy("id").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).filter("low < high").select("id"))
    if not several.isEmpty():
        texts = named.join(several, "id").select("id", "whole").distinct().join(classes.select("whole", "node"), "whole")
        links = links.unionByName(texts.select(F.col("id").alias("a"), F.col("node").alias("b")))
    joined = classes.select("whole", "node", "size").join(components(links), "node", "left")
    owner = materialise(joined.select("whole", "size", F.coalesce("component", "node").alias("component_id")))
    bare = marked.drop("regs")
    found = join_by_size(bare.filter("whole IS NOT NULL"), owner, "whole", "size").drop("size")
    lost = bare.filter("whole IS NULL").withColumn("component_id", F.col("id"))
    nameless = bare.filter("id IS NULL AND whole IS NOT NULL").join(owner.select("whole"), "whole", "left_anti").withColumn("component_id", F.lit(None).cast("bigint"))
    kind = docs.schema[id_col].dataType
    every = found.unionByName(lost).unionByName(nameless)
    return every.select(
        F.col("id").cast(kind).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component_id").cast(kind),
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of its component; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, percent, shingle).filter(~F.col("kept") & F.col(id_col).isNotNull())
    return join_small(docs, materialise(gone.select(id_col).distinct()), id_col, "left_anti").select(docs.columns)
