"""Importance resampling towards a target: rows whose words are likelier in the target corpus.

Words are hashed to buckets. The counts of all buckets over the source and the target corpus give
a gain per bucket, an array that is applied to every text. A keyed Gumbel draw is added to the
mean gain of a text, so that the highest scores are a weighted sample without replacement.

The scores are ranked by parallel sorting with regular samples: each run (a partition) is
sorted, every ``stride``-th row of a run is a sample, and regular picks of the sorted samples are
the splitters. Rows are exchanged once by splitter, each segment is put in order by itself, and
the counts of the segments before it turn places within a segment into ranks. Segments that lie
wholly below the drawn share are not exchanged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tamis.llm.batches import chosen, steps, utf8, words_of
from tamis.session import materialise

BUCKETS = 10_000
LONGEST_RUN = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
# Regular samples per segment; a segment holds at most 1/segments of the rows and a stride per run.
SAMPLES = 256
# Words whose bucket a worker remembers.
KNOWN_WORDS = 1 << 18
KEY = ("minus", "id", "n_features", "spot")


class Buckets(dict):
    """Bucket of a word, remembered up to ``KNOWN_WORDS`` words."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.count = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        bucket = self[word] = zlib.crc32(word) % self.count
        return bucket


def features(text: bytes, known: Buckets, longest: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``longest`` consecutive words, repeats included."""
    words = words_of(text)
    runs = [words, *([b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, longest + 1))]
    return np.concatenate([np.fromiter(map(known.__getitem__, r), np.int64, len(r)) for r in runs])


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """Features per bucket over all texts: one sum per task, summed again by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in steps(batches, 0):
            for text in utf8(batch.column(0)):
                total += np.bincount(features(text, known, longest), minlength=buckets)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    # at most one row per bucket
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which a bucket is likelier in the target, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(row_id: int | None, seed: int = SEED) -> int:
    """The keyed draw of a row in thousandths, rounded down; a null id is drawn as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, longest: int = LONGEST_RUN) -> DataFrame:
    """(id, n_features, weight, score) per row; null and wordless texts have weight 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for batch in steps(batches, 1):
            found = [features(t, known, longest) for t in utf8(batch.column(1))]
            sizes = np.array([len(f) for f in found], np.int64)
            sums = np.array([gain[f].sum() for f in found], np.int64)
            weight = sums // np.maximum(sizes, 1)
            draws = np.array([gumbel(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(weight), pa.array(weight + draws)], ["id", "n_features", "weight", "score"])

    base = chosen(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    return base.mapInArrow(run, "id bigint, n_features bigint, weight bigint, score bigint")


def _coded(*columns: np.ndarray) -> np.ndarray:
    """Rows of signed integers as byte strings that sort as the rows do."""
    wide = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1).astype(">u8")
    return np.ascontiguousarray(wide).view(f"S{8 * len(columns)}").ravel()


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    """Codes of the first columns, which are those of ``KEY`` and hold no null."""
    return _coded(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(KEY))))


def _splitters(rows: DataFrame, total: int, segments: int) -> np.ndarray:
    """Codes of the splitters: regular picks of the sorted regular samples of the sorted runs."""
    stride = max(1, total // (SAMPLES * segments))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            # the middle row of each full stride, and of what is left over
            picks = np.arange((stride // 2 - at) % stride, batch.num_rows, stride)
            at += batch.num_rows
            if len(picks):
                yield batch.take(pa.array(picks))

    found = rows.select(*KEY).sortWithinPartitions(*KEY).mapInArrow(sample, ", ".join(f"{k} bigint" for k in KEY))
    table = found.toArrow()  # at most SAMPLES + 1 per segment, and one per run
    codes = np.sort(_coded(*(table.column(k).to_numpy() for k in KEY)))
    picks = np.arange(1, segments) * len(codes) // segments
    return np.unique(codes[picks]) if len(codes) else codes


def top_ranked(rows: DataFrame, wanted: int, segments: int | None = None) -> DataFrame:
    """``rows`` (id, n_features, weight, score) with ``rank``: 1 .. ``wanted`` by falling score.

    Ties go to the smaller id, then to fewer features; a null id comes last. Other rows have a
    null rank. Rows that are equal in all columns share their ranks out in any way. ``rows`` must
    be stored (materialised): a row's place in it tells rows apart that are equal otherwise.
    """
    spark = rows.sparkSession
    segments = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = F.coalesce(F.col("id"), F.lit((1 << 63) - 1))
    keyed = rows.select((-F.col("score")).alias("minus"), ordered.alias("id"), "n_features", F.monotonically_increasing_id().alias("spot"), F.col("id").isNull().alias("lost"), "weight")
    total = keyed.count()
    cuts = _splitters(keyed, total, segments)
    shape = "minus bigint, id bigint, n_features bigint, spot bigint, lost boolean, weight bigint"
    names = [c.split(" ")[0] for c in shape.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment = np.searchsorted(cuts, _codes(batch), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*names, "segment"])

    placed = keyed.mapInArrow(place, f"{shape}, segment int")
    counts = np.zeros(segments, np.int64)
    for segment, n in placed.groupBy("segment").count().collect():  # a row per segment
        counts[segment] = n
    offsets = np.concatenate(([0], np.cumsum(counts)))
    last = int(np.searchsorted(offsets, wanted, "left"))  # segments from here on hold no drawn row

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = -1, 0
        for batch in batches:
            segment = batch.column(len(names)).to_numpy()
            starts = np.nonzero(np.concatenate(([len(segment) > 0 and segment[0] != current], segment[1:] != segment[:-1])))[0]
            places = np.empty(len(segment), np.int64)
            edges = [0, *starts.tolist(), len(segment)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if segment[low] != current:
                    current, at = segment[low], 0
                places[low:high] = offsets[current] + at + np.arange(1, high - low + 1)
                at += high - low
            found = pa.array(places, mask=places > wanted)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], found], [*names, "rank"])

    above = placed.filter(F.col("segment") < last).repartitionById(max(1, last), F.col("segment"))
    above = above.sortWithinPartitions("segment", *KEY).mapInArrow(rank, f"{shape}, rank bigint")
    below = placed.filter(F.col("segment") >= last).select(*names, F.lit(None).cast("bigint").alias("rank"))
    return above.unionByName(below).select(
        F.when(~F.col("lost"), F.col("id")).alias("id"), "n_features", "weight", (-F.col("minus")).alias("score"), "rank"
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    longest: int = LONGEST_RUN,
    target_text_col: str = "text",
    segments: int | None = None,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``.

    ``weight`` is the mean gain of the row's features, rounded down; ``score`` adds the keyed
    draw. Of the rows with ``min_words`` words or more, ``percent`` in a hundred with the highest
    scores have ranks 1, 2, ...; the others have none. Null texts have no words; rows
    with a null id take part and lose ties; repeated rows each take part. Ids are integers.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError("ids must be integers")
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    rows = materialise(scored(docs, gain, id_col, text_col, seed, longest))
    # runs of 1 to ``longest`` of w words number w + (w - 1) + ..., so this many make min_words words
    enough = sum(max(0, min_words - n) for n in range(longest))
    fit = F.col("n_features") >= enough
    n_fit = rows.filter(fit).count()
    ranked = top_ranked(rows.filter(fit), percent * n_fit // 100, segments)
    rest = rows.filter(~fit).withColumn("rank", F.lit(None).cast("bigint"))
    kind = docs.schema[id_col].dataType
    return ranked.unionByName(rest).select(F.col("id").cast(kind).alias(id_col), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws; a repeated id is drawn if one of its rows is."""
    picked = resample(docs, target, id_col, **options).filter("rank IS NOT NULL").select(id_col).distinct()
    return docs.join(picked, id_col, "left_semi").select(docs.columns)
