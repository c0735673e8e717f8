"""Nearest neighbours from randomly rotated one-bit codes with exact reranking.

Vectors are centred, rotated by a random orthogonal matrix and reduced to signs. With its
norm and the inner product of the unit vector and its code, a packed code gives an unbiased
estimate of the inner product with any query and a bound on its error. Queries are reduced to
four bits a component, so that an estimate is four ANDs and bit counts a word. Per block of
vectors, those with the smallest estimates are compared exactly first; of the others, only
those whose least possible distance is within the tenth smallest exact one so far.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import materialise

SEED = 11
# Error bounds in standard errors of the estimate. A neighbour is missed if its estimate errs by more
# and by more than its distance to the tenth: with a probability below 5e-3 each, none of 1,000 on sf0.1.
ERRORS = 2.6
# Bits of a component of a query.
QUERY_BITS = 4
# Vectors a query is compared with exactly before any is left out.
FIRST = 64
# Vectors and queries of a block.
VECTOR_ROWS = 16_384
QUERY_ROWS = 1_024
# Estimates held at once.
CELLS = 1 << 21


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero and has finite components alone."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    # a null or NaN component makes forall null or false
    return vectors.filter(F.coalesce(F.forall(vec_col, fine), F.lit(False)) & F.exists(vec_col, lambda x: x != 0))


def centre(vectors: DataFrame, vec_col: str = "embedding") -> np.ndarray | None:
    """The mean vector; a table with vectors of several lengths is an error."""
    size = F.size(vec_col)
    low, high = vectors.agg(F.min(size), F.max(size)).first()
    if low is None:
        return None
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} components")
    sums = vectors.agg(*(F.avg(F.get(vec_col, F.lit(i)).cast("double")) for i in range(low))).first()
    return np.array(sums, np.float64)


def codes(matrix: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, norms, inner products of unit vectors with their codes)."""
    turned = (matrix - middle) @ rotation(matrix.shape[1])
    norms = np.linalg.norm(turned, axis=1)
    agree = np.abs(turned).sum(axis=1) / (math.sqrt(matrix.shape[1]) * np.where(norms > 0, norms, 1))
    return np.packbits(turned > 0, axis=1, bitorder="little"), norms, np.where(norms > 0, agree, 1)


def words(packed: np.ndarray) -> np.ndarray:
    """Packed bits as whole 64-bit words, filled up with zeros."""
    spare = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, spare)))).view("<u8")


def signed_sums(bits: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries x vectors) sums of the queries' components, signed by the vectors' bits, and per
    query the standard error of a component.

    Components are rounded to sixteen levels between the query's ends, whose bits are counted
    plane by plane.
    """
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / (2**QUERY_BITS - 1)
    levels = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.uint8)
    total = np.zeros((len(turned), len(bits)))
    for place in range(QUERY_BITS):
        plane = words(np.packbits((levels >> place) & 1, axis=1, bitorder="little"))
        for w in range(bits.shape[1]):
            total += np.bitwise_count(plane[:, None, w] & bits[None, :, w]) * float(2**place)
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    total *= 2 * step[:, None]
    total += 2 * low[:, None] * ones
    total -= (levels * step[:, None] + low[:, None]).sum(axis=1)[:, None]
    return total, step / math.sqrt(12)


def candidates(
    bits: np.ndarray, norms: np.ndarray, agree: np.ndarray, matrix: np.ndarray, queries: np.ndarray, middle: np.ndarray, own: np.ndarray, k: int
) -> np.ndarray:
    """(queries x vectors) which vectors are to be compared exactly for the ``k`` nearest of the block.

    ``own`` marks pairs that are one row and never count.
    """
    if len(matrix) <= max(k, FIRST):
        return ~own
    dim = queries.shape[1]
    turned = (queries - middle) @ rotation(dim)
    lengths = np.linalg.norm(turned, axis=1)
    sums, rough = signed_sums(bits, turned)
    # inner products with the unit vectors, and their errors
    sums /= math.sqrt(dim) * agree
    variance = lengths[:, None] ** 2 * np.maximum(0.0, 1 - agree**2) / max(1, dim - 1)
    slack = ERRORS * np.sqrt(variance + rough[:, None] ** 2) / agree
    mid = lengths[:, None] ** 2 + norms**2 - 2 * norms * sums
    mid[own] = np.inf
    count = max(k, FIRST)
    first = np.argpartition(mid, count - 1, axis=1)[:, :count]
    rows = np.repeat(np.arange(len(queries)), count)
    known = exact_distances(queries[rows], matrix[first.ravel()]).reshape(len(queries), count)
    known[np.take_along_axis(own, first, axis=1)] = np.inf
    bound = np.partition(known, k - 1, axis=1)[:, k - 1 : k] ** 2 * (1 + 1e-9)
    # the triangle inequality bounds the distance whatever the code says
    least = np.maximum(mid - 2 * norms * slack, (lengths[:, None] - norms) ** 2)
    keep = least <= bound + 1e-9 * (1 + norms**2 + lengths[:, None] ** 2)
    np.put_along_axis(keep, first, True, axis=1)
    return keep & ~own


def exact_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs of rows, components added in order, in double precision."""
    total = np.zeros(len(left))
    for i in range(left.shape[1]):
        total += (left[:, i] - right[:, i]) ** 2
    return np.sqrt(total)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found for each query.

    Queries are rows of the same table; a query's own row (its id) is no candidate. Ties go to
    the smaller id, and repeated rows are candidates each. Null ids, and vectors that are
    null, zero or not finite, take no part. Fewer than ``k`` candidates: all of them. Vectors
    and queries are dealt to blocks of bounded size; each block of vectors meets each block of
    queries once and keeps ``k`` rows per query.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    pick = lambda df: usable(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")), "v").filter("id IS NOT NULL")
    stored = materialise(pick(vectors))
    asked = materialise(pick(queries))
    middle = centre(stored, "v")
    shape = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if middle is None:
        return vectors.sparkSession.createDataFrame([], shape)
    n_blocks = max(1, -(-stored.count() // VECTOR_ROWS))
    q_blocks = max(1, -(-asked.count() // QUERY_ROWS))

    def code(batches):
        for batch in batches:
            matrix = _matrix(batch.column("v"))
            packed, norms, agree = codes(matrix, middle)
            bits = pa.array([b.tobytes() for b in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, bits, pa.array(norms), pa.array(agree)], [*batch.schema.names, "code", "norm", "agree"])

    element = stored.schema["v"].dataType.simpleString()
    coded = stored.mapInArrow(code, f"id bigint, v {element}, code binary, norm double, agree double")
    spot = F.xxhash64("id", F.lit(SEED))
    # every vector goes to its block once per block of queries, every query to all vector blocks
    left = coded.withColumns({"a": F.pmod(spot, F.lit(n_blocks)).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))})
    right = asked.withColumns({"b": F.pmod(spot, F.lit(q_blocks)).cast("int"), "a": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))})

    def search(near: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if near.num_rows and wanted.num_rows:
            ids, matrix = near.column("id").to_numpy(), _matrix(near.column("v").combine_chunks())
            bits = words(np.frombuffer(b"".join(near.column("code").to_pylist()), np.uint8).reshape(len(ids), -1))
            norms, agree = near.column("norm").to_numpy(), near.column("agree").to_numpy()
            query_ids, queries_of = wanted.column("id").to_numpy(), _matrix(wanted.column("v").combine_chunks())
            step = max(1, CELLS // len(ids))
            for at in range(0, len(query_ids), step):
                part = slice(at, at + step)
                keep = candidates(bits, norms, agree, matrix, queries_of[part], middle, query_ids[part, None] == ids, k)
                q, c = np.nonzero(keep)
                score = np.concatenate(
                    [exact_distances(queries_of[part][q[a : a + 65536]], matrix[c[a : a + 65536]]) for a in range(0, len(q), 65536)] or [np.zeros(0)]
                )
                order = np.lexsort((ids[c], score, q))
                q, c, score = q[order], c[order], score[order]
                first = np.searchsorted(q, q, "left")
                top = np.arange(len(q)) - first < k
                out.append((query_ids[part][q[top]], ids[c[top]], score[top]))
        columns = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select(
        F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)
