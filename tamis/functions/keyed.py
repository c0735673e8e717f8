"""Keyed hashing in place of random generators.

A row's place in any random order depends on (seed, use, key) only, never on
partitioning, and the same md5 is available in other SQL engines.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
# Scores are compared as whole numbers of 1e-9.
SCORE_SCALE = 1_000_000_000
# The place of rows without a score, after all others.
NO_SCORE = 1 << 61


@dataclass(frozen=True)
class Order:
    """A total order of rows: a whole-number ``head``, ties by a text ``tail`` unique per row.

    A purely random order has the same head everywhere.
    """

    head: Column
    tail: Column
    is_random: bool = False


def key_code(key: str | Sequence[str], use: str, seed: int = SEED) -> Column:
    """md5 over seed, use and key: a random but reproducible sort code (32 hex digits)."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = [F.lit(str(seed)), F.lit(use), *[F.col(k).cast("string") for k in keys]]
    return F.md5(F.concat_ws("|", *parts))


def uniform(code: Column) -> Column:
    """Uniform in [0, 1) with 52 bits from the leading digits of a sort code."""
    return F.conv(F.substring(code, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def key_uniform(key: str | Sequence[str], use: str, seed: int = SEED) -> Column:
    return uniform(key_code(key, use, seed))


def score_units(score: Column) -> Column:
    """A score as a whole number of 1e-9."""
    return F.floor(score * F.lit(float(SCORE_SCALE)) + F.lit(0.5)).cast("bigint")


def random_order(key: str | Sequence[str], use: str, seed: int = SEED) -> Order:
    """Keyed random order."""
    return Order(F.lit(0).cast("bigint"), key_code(key, use, seed), is_random=True)


def score_order(score: str | Column, key: str, descending: bool = False, seed: int = SEED) -> Order:
    """By score to 9 digits; equal scores fall in keyed random order, null and NaN come last."""
    value = (F.col(score) if isinstance(score, str) else score).cast("double")
    units = score_units(F.when(~F.isnan(value), value))
    return Order(F.coalesce(-units if descending else units, F.lit(NO_SCORE)), key_code(key, "tie", seed))
