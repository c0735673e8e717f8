"""Session-level helpers: durable materialisation and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# A side is broadcast only after it was fetched and found within both bounds.
SMALL_ROWS = 200_000
SMALL_BYTES = 64 * 1024 * 1024
# A group larger than this is joined apart from the others; at most n / HOT_ROWS exist.
HOT_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tamis-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame | None:
    """``df`` as a local relation, or None when it exceeds the bounds.

    Rows are taken partition by partition, so a large table costs a few of its
    partitions and never sends more than a small multiple of ``max_rows``.
    """
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        return None
    table = _arrow(rows, df.schema)
    return None if table.nbytes > max_bytes else df.sparkSession.createDataFrame(table, df.schema)


def _arrow(rows: list, schema: StructType) -> pa.Table:
    columns = {f.name: [r[i] for r in rows] for i, f in enumerate(schema.fields)}
    return pa.Table.from_pydict(columns, schema=to_arrow_schema(schema))


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A driver-held list as a local relation of known size."""
    schema = StructType.fromDDL(ddl)
    return spark.createDataFrame(_arrow(rows, schema), schema)


def small_rows(df: DataFrame, what: str, max_rows: int = SMALL_ROWS) -> list:
    """Rows of a model-sized table (classes, folds, conditions); too many is an error."""
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} {what}")
    return rows


def join_small(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "inner",
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Join that broadcasts ``right`` when its checked size allows, else shuffles both sides."""
    small = bounded(right, max_rows)
    return left.join(right if small is None else F.broadcast(small), on, how)


def join_by_size(
    left: DataFrame,
    right: DataFrame,
    on: str,
    size: str,
    hot_rows: int = HOT_ROWS,
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Inner join of rows to one summary row per ``on``, whose ``size`` counts its rows.

    Few summary rows are broadcast. Otherwise the groups above ``hot_rows`` are few
    (n / hot_rows) and are joined by broadcast, so that no group's rows ever meet in one
    task; the rest goes by shuffle.
    """
    whole = bounded(right, max_rows)
    if whole is not None:
        return left.join(F.broadcast(whole), on)
    hot = bounded(right.filter(F.col(size) > hot_rows), max_rows)
    while hot is None:
        hot_rows *= 10
        hot = bounded(right.filter(F.col(size) > hot_rows), max_rows)
    if hot.isEmpty():
        return left.join(right, on)
    cold = right.filter(F.col(size) <= hot_rows)
    calm = left.join(F.broadcast(hot.select(on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(calm.join(cold, on))


def join_wanted(left: DataFrame, right: DataFrame, on: str, spread: str, per_task: int) -> DataFrame:
    """Inner join to unique but wide rows, some of which are wanted very often.

    Only right rows that are wanted take part. A right row wanted more than ``per_task``
    times is repeated by its own count, and its left rows are spread over the copies by
    ``spread``. ``left`` is read twice: pass a materialised one.
    """
    counts = left.groupBy(on).agg(F.count("*").alias("_wanted"))
    right = join_small(right, counts.select(on), on, "left_semi")
    hot = bounded(counts.filter(F.col("_wanted") > per_task))
    while hot is None:
        per_task *= 10
        hot = bounded(counts.filter(F.col("_wanted") > per_task))
    if hot.isEmpty():
        return left.join(right, on)
    copies = hot.select(on, F.ceil(F.col("_wanted") / F.lit(per_task)).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(F.broadcast(copies), on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    repeated = right.join(F.broadcast(copies), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(repeated, [on, "_salt"]).drop("_salt")


def as_col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
