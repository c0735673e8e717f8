"""Token ids of all documents in files of byte-aligned variable-length codes.

Ids are replaced by their rank by frequency, so that common tokens take one byte. Four ranks
share a control byte (two bits each: the number of data bytes less one), kept apart from the
data bytes; a numpy table of the 256 control bytes gives the lengths when decoding. The files
are blocks in Parquet: Spark's writer commits them whole, on any store, also when a task is
run again. A block holds whole documents in ascending id order.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType
from tokenizers import Tokenizer

from tamis.llm.batches import chosen, steps, strings
from tamis.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
# Ids of a block; a longer document is a block of its own.
BLOCK_IDS = 1 << 17
# Ids of one file's range of documents.
FILE_IDS = 16 << 20
# Pre-tokens whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 500_000


# A text without these characters, in which neither composition nor case depends on neighbours,
# is cut here into the tokenizer's own pre-tokens; "<|" may begin a special token.
HARD = re.compile(r"[^\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]")
PRE_TOKENS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")
# Pre-tokens that the library gets at once.
LEARN_ROWS = 4096


# The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others in turn for
# the characters from U+0100.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LEVEL = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


def byte_level(text: str) -> str:
    return text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(_BYTE_LEVEL)


class Known(dict):
    """The codes of keys met before; a key met for the first time is learned where it is looked up.

    What the ``older`` codes hold moves here when it is met again.
    """

    def __init__(self, learn: Callable[[str], bytes], older: dict[str, bytes]) -> None:
        super().__init__()
        self._learn, self.older = learn, older

    def __missing__(self, key: str) -> bytes:
        code = self.older.get(key)
        if code is None:
            code = self._learn(key)
        self[key] = code
        return code


class Encoder:
    """Whole-text ids of a tokenizer that drops white space, pre-token by pre-token.

    A text's ids are those of its pre-tokens, one after the other; pre-tokens that were met
    before are looked up. Blank-separated pieces with other than simple characters go through
    the tokenizer's own normalisation and splitting instead; no pre-token holds white space.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.kind = "H" if self.wide == "<u2" else "I"
        self.known = Known(self._pre_token, {})

    def _pre_token(self, key: str) -> bytes:
        return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(byte_level(key))]).tobytes()

    def _learn_pieces(self, keys: set[str]) -> None:
        """Whole pieces (a blank in front) go through the tokenizer many at once."""
        known, older = self.known, self.known.older
        new = sorted(k for k in keys if k not in known and k not in older)
        for at in range(0, len(new), LEARN_ROWS):
            some = new[at : at + LEARN_ROWS]
            coded = self.tokenizer.encode_batch_fast([k[1:] for k in some], add_special_tokens=False)
            known.update((k, array(self.kind, e.ids).tobytes()) for k, e in zip(some, coded))

    def encode(self, texts: list[str], last: int | None) -> list[bytes]:
        """The ids of each text as little-endian numbers (two bytes each if all ids of the
        vocabulary fit, else four), with ``last`` appended."""
        if len(self.known) > REMEMBERED:
            # two generations are kept: what is not met again goes with the older one
            self.known = Known(self._pre_token, dict(self.known))
        tail = b"" if last is None else np.array([last], self.wide).tobytes()
        pieces: set[str] = set()
        lists = [keys_of(t, pieces) for t in texts]
        self._learn_pieces(pieces)
        code = self.known.__getitem__
        return [b"".join(map(code, keys)) + tail for keys in lists]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path)


def is_simple(text: str) -> bool:
    return "<|" not in text and (text.isascii() and text.replace("\n", " ").isprintable() or not HARD.search(text))


def keys_of(text: str, pieces: set[str]) -> list[str]:
    """The pre-tokens of a text, and its other pieces with a blank in front, which ``pieces`` gets too."""
    if is_simple(text):
        return PRE_TOKENS.findall(text.lower())
    keys: list[str] = []
    for piece in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
        if is_simple(piece):
            keys += PRE_TOKENS.findall(piece.lower())
        else:
            keys.append(" " + piece)
            pieces.add(keys[-1])
    return keys


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    control = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    control[: len(ranks)] = sizes - 1
    control = (control.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) < sizes[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


@lru_cache(maxsize=1)
def control_table() -> np.ndarray:
    """The four data lengths of every control byte."""
    return ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers that ``pack`` coded."""
    sizes = control_table()[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < sizes[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def encode(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, counts) per row: little-endian ids of the whole text, two bytes each if
    all ids of the vocabulary fit, else four. Null texts are empty; repeated rows stay.

    Every task adds one row of ``counts`` alone: how often each id stands in its rows, as
    little-endian 64-bit numbers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("id", _arrow(kind)), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        size = np.dtype(encoder.wide).itemsize
        total = np.zeros(0, np.int64)
        for batch in steps(batches, 1):
            ids = encoder.encode(strings(batch.column(1)), end_id)
            total = added(total, np.bincount(np.frombuffer(b"".join(ids), encoder.wide)))
            sizes = pa.array([len(x) // size for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], schema=schema)
        if len(total):
            yield pa.RecordBatch.from_pylist([{"counts": total.astype("<i8").tobytes()}], schema)

    return chosen(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, counts binary")


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two counts of ids, the shorter one filled up with zeros."""
    short, long = sorted((a, b), key=len)
    total = long.copy()
    total[: len(short)] += short
    return total


def frequencies(encoded: DataFrame) -> DataFrame:
    """(token, n) over all documents, from the counts of the tasks that encoded them; each task
    adds up what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total = added(total, np.frombuffer(counts.as_py(), "<i8"))
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "n"])

    counted = encoded.filter("counts IS NOT NULL").select("counts")
    return counted.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


BLOCK = "part int, block int, start bigint, ids array<{kind}>, counts array<bigint>, control binary, data binary"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents below ``path`` in ascending document order.

    ``ranks`` has the vocabulary's tokens by falling frequency (ties: smaller token first),
    ``blocks`` the coded documents: of which range of documents (``part``), its blocks in
    order, and ``start``, the ids before the block within its part. Null ids come first,
    equal ids next to each other. Without documents both are empty.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    wide = encoder_of(vocabulary).wide
    encode(docs, vocabulary, end_id, id_col, text_col).write.parquet(f"{path}/encoded")
    encoded = spark.read.parquet(f"{path}/encoded")
    # at most one row per vocabulary entry
    listed = sorted(((r["token"], r["n"]) for r in frequencies(encoded).collect()), key=lambda r: (-r[1], r[0]))
    tokens = [t for t, _ in listed]
    spark.createDataFrame(pa.table({"rank": pa.array(range(len(tokens)), pa.int64()), "token": pa.array(tokens, pa.int64())})).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(tokens, default=0) + 1, np.uint32)
    rank_of[tokens] = np.arange(len(tokens), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = block = start = held = 0
        ids: list = []
        texts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            flat = np.frombuffer(b"".join(texts), wide)
            control, data = pack(rank_of[flat])
            size = np.dtype(wide).itemsize
            row = [[part], [block], [start], [ids], [[len(t) // size for t in texts]], [control], [data]]
            start, block, held = start + len(flat), block + 1, 0
            made = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, shape)], schema=shape)
            ids.clear()
            texts.clear()
            return made

        for batch in steps(batches, 1):
            for number, coded, at in zip(*(c.to_pylist() for c in batch.columns)):
                part = at
                ids.append(number)
                texts.append(coded)
                held += len(coded)
                if held >= BLOCK_IDS * np.dtype(wide).itemsize:
                    yield flush()
        if ids:
            yield flush()

    shape = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("ids", pa.list_(_arrow(kind))), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
    total = sum(n for _, n in listed)
    parts = max(spark.sparkContext.defaultParallelism, -(-total // FILE_IDS))
    ranged = encoded.filter("counts IS NULL").repartitionByRange(parts, "id").sortWithinPartitions("id", "n_tokens", "ids")
    ranged.select("id", "ids", F.spark_partition_id().alias("part")).mapInArrow(run, BLOCK.format(kind=kind)).write.parquet(f"{path}/blocks")


def _arrow(kind: str) -> pa.DataType:
    return to_arrow_type(DataType.fromDDL(kind))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files: ``start`` counts the ids of
    all documents before it, ``ids`` are little-endian unsigned 32-bit ids."""
    tokens = np.array([r["token"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    # one row per file: where its first id stands among all
    sizes = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x))).collect())
    base, before = {}, 0
    for part, size in sizes:
        base[part], before = before, before + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, _, start, numbers, counts, control, data = (c[row].as_py() for c in batch.columns)
                flat = tokens[unpack(control, data, sum(counts))]
                ends = np.cumsum([0, *counts])
                pieces = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, batch.column(3).type.value_type), pa.array(ends[:-1] + start + base[part]), pa.array(counts, pa.int64()), pa.array(pieces, pa.binary())],
                    ["id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) as the written files say."""
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, vocabulary or public_tokenizers.path(VOCABULARY), END_ID, id_col, text_col)
    return read(docs.sparkSession, path).select(F.col("id").alias(id_col), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
