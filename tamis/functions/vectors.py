"""Column expressions over probability and embedding arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.session import as_col

# Keeps logarithms finite; fixed value.
LOG_FLOOR = 1e-12
# Beyond this many dimensions, one aggregate per dimension makes too large a plan.
WIDE_DIM = 256


def argmax_index(probs: str | Column) -> Column:
    """Position (from 0) of the largest element, the first on ties."""
    p = as_col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def entropy(probs: str | Column) -> Column:
    return F.aggregate(as_col(probs), F.lit(0.0), lambda acc, p: acc - p * F.log(p + F.lit(LOG_FLOOR)))


def least_confidence(probs: str | Column) -> Column:
    return F.lit(1.0) - F.array_max(as_col(probs))


def margin_uncertainty(probs: str | Column) -> Column:
    top = F.sort_array(as_col(probs), False)
    return F.lit(1.0) - (top[0] - top[1])


def largest_other(probs: str | Column, label: str | Column) -> Column:
    """Largest probability among the places other than ``label``."""
    return F.array_max(
        F.transform(as_col(probs), lambda p, j: F.when(j != as_col(label), p))
    )


def own_probability(probs: str | Column, label: str | Column) -> Column:
    return F.element_at(as_col(probs), as_col(label).cast("int") + 1)


def place_of(label: str | Column, classes: Sequence) -> Column:
    """Where in ``classes`` the label is (from 0); NULL for a label that is not among them."""
    if list(classes) == list(range(len(classes))):
        place = as_col(label).cast("int")
        return F.when(place.between(0, len(classes) - 1), place)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), as_col(label))
    return F.when(place > 0, place - 1).cast("int")


def class_at(place: str | Column, classes: Sequence) -> Column:
    """The class at a place (from 0)."""
    if list(classes) == list(range(len(classes))):
        return as_col(place).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), as_col(place).cast("int") + 1)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    gaps = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)


def vector_dim(df: DataFrame, vec: str) -> int:
    """Length of the vectors, read from one row."""
    row = df.filter(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).first()
    if row is None:
        raise ValueError("no vectors to read a dimension from")
    return row.d


def vector_sums(
    df: DataFrame, groups: list[str], vec: str, squares: bool = False, dim: int | None = None
) -> DataFrame:
    """Per group: ``n``, ``sums`` and, on request, ``squares`` per dimension.

    Vectors of different lengths are an error. Pre-aggregated in every task, so hot groups cost no more than others.
    """
    dim = dim or vector_dim(df, vec)
    powers = {"sums": 1, "squares": 2} if squares else {"sums": 1}
    if dim <= WIDE_DIM:
        # One expression text per array: building it column by column costs more than the job.
        terms = {1: "sum(double(`{v}`[{i}]))", 2: "sum(double(`{v}`[{i}]) * double(`{v}`[{i}]))"}
        even = f"min(size(`{vec}`)) = {dim} AND max(size(`{vec}`)) = {dim}"
        arrays = [
            F.expr(
                f"CASE WHEN {even} THEN array({', '.join(terms[power].format(v=vec, i=i) for i in range(dim))}) "
                f"WHEN max(size(`{vec}`)) IS NOT NULL THEN raise_error('vectors of different lengths') END"
            ).alias(name)
            for name, power in powers.items()
        ]
        return df.groupBy(*groups).agg(F.count("*").alias("n"), *arrays)
    x = F.col("_x").cast("double")
    sums = {"sums": F.sum(x), "squares": F.sum(x * x)}
    even = F.when(F.size(vec) == dim, F.col(vec)).when(F.col(vec).isNotNull(), F.raise_error(F.lit("vectors of different lengths")))
    long = df.select(*groups, F.posexplode(even).alias("_i", "_x")).groupBy(*groups, "_i")
    long = long.agg(F.count("*").alias("n"), *[sums[name].alias(f"_{name}") for name in powers])
    # One entry per dimension.
    packed = [F.sort_array(F.collect_list(F.struct("_i", f"_{name}"))).alias(name) for name in powers]
    arrays = [F.col(f"{name}._{name}").alias(name) for name in powers]
    return long.groupBy(*groups).agg(F.max("n").alias("n"), *packed).select(*groups, "n", *arrays)
