"""SentencePiece BPE encoding and decoding, giant documents by a max-plus parallel scan.

A text's BPE segmentation is the one path of pieces in which every two neighbours stay as they
are when BPE is run on the two alone. So segmentation is a best path: an arc between
neighbours that are stable weighs 0, any other minus infinity. A giant document is cut into
chunks of fixed length. The states at a cut are the pieces that could stand across or up to
it; a chunk yields the matrix of best weights from each state at its start to each at its
end. The matrices of a document are combined in the max-plus semiring, which gives the piece
at every cut, and each chunk is then backtraced on its own.

Ordinary words inside a text (a blank starts a word, no piece has one further inside) are
looked up; only words that are cut, or very long, go over the lattice.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tamis.llm.batches import Remembered, steps, strings
from tamis.session import join_small, materialise

VOCABULARY = "piece_bpe_32k.model"
BLANK = "▁"
# Characters of a chunk; a longer text goes by the parallel scan.
CHUNK = 1 << 15
# Longer words go over the lattice, whose cost is in proportion to their length.
LONG_WORD = 256
# Words whose ids a worker remembers.
REMEMBERED = 120_000
# Pairs of neighbours whose stability a worker remembers.
STABLE_PAIRS = 100_000

_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
Piece = tuple[int, int]  # start and end in the normalised text


class Vocabulary:
    """Pieces, scores and ids of a model file with byte fallback and no normalisation."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.ids = {
            self.model.id_to_piece(i): i for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))
        }
        self.scores = {p: self.model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("pieces with a blank inside are not supported")
        self.written = [b""] * len(ids)
        for p, i in self.ids.items():
            self.written[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.written[i] = bytes([b])
        self._stable: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, left: str, right: str) -> bool:
        """Whether two pieces next to each other stay as they are."""
        if BLANK not in right[0] or left[-1] == BLANK:
            known = self._stable.get((left, right))
            if known is None:
                if len(self._stable) > STABLE_PAIRS:
                    self._stable.clear()
                known = self._stable[left, right] = self.merge(left + right) == [left, right]
            return known
        return True

    def starting(self, text: str, at: int) -> Iterator[int]:
        """Ends of the pieces that start at a place: known pieces, and any single character."""
        yield at + 1
        for end in range(at + 2, min(len(text), at + self.longest) + 1):
            if text[at:end] in self.ids:
                yield end

    def ids_of(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        return [known] if known is not None else [self.bytes[b] for b in piece.encode()]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalised(text: str) -> str:
    """The model's own form: a blank in front, blanks as a visible sign."""
    return BLANK + text.replace(" ", BLANK) if text else ""


# --- max-plus algebra -----------------------------------------------------------------

LOST = -np.inf


def max_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The matrix of best weights over the states between two chunks; associative."""
    if not left.shape[1]:
        return np.full((left.shape[0], right.shape[1]), LOST)
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


# --- the lattice ----------------------------------------------------------------------


def across(text: str, cut: int, words: Vocabulary) -> list[Piece]:
    """The states at a cut: pieces that hold the character before it. None stand at the ends."""
    if cut <= 0 or cut > len(text):
        return []
    return [(s, e) for s in range(max(0, cut - words.longest), cut) for e in words.starting(text, s) if e >= cut]


def forward(text: str, low: int, high: int, entries: list[Piece], words: Vocabulary) -> tuple[dict[Piece, np.ndarray], dict[int, list[Piece]]]:
    """Best weights of every piece that starts in [low, high), as vectors over the entries.

    Without entries the start at ``low`` is the one entry.
    """
    values: dict[Piece, np.ndarray] = {}
    ending: dict[int, list[Piece]] = {}
    n = max(1, len(entries))
    unit = np.full((n, n), LOST)
    np.fill_diagonal(unit, 0.0)
    for i, piece in enumerate(entries):
        values[piece] = unit[i]
        ending.setdefault(piece[1], []).append(piece)
    for start in range(low, high):
        before = ending.get(start)
        if not before and (entries or start != low):
            continue
        for end in words.starting(text, start):
            piece = text[start:end]
            reached = None if entries or start != low else unit[0]
            for left in before or ():
                if words.stable(text[left[0] : left[1]], piece):
                    value = values[left]
                    reached = value if reached is None else np.maximum(reached, value)
            if reached is not None and reached.max() > LOST:
                values[start, end] = reached
                ending.setdefault(end, []).append((start, end))
    return values, ending


def word_starts(text: str, low: int, high: int) -> tuple[int, int] | None:
    """The first and the last place in [low, high) where a word starts; None if there is none.

    No piece lies across such a place, so every segmentation has a cut there.
    """
    first = low
    while first < high and not _starts(text, first):
        first += 1
    if first >= high:
        return None
    last = high - 1
    while not _starts(text, last):
        last -= 1
    return first, last


def _starts(text: str, at: int) -> bool:
    return at == 0 or (text[at] == BLANK and text[at - 1] != BLANK)


def transfer(text: str, low: int, high: int, words: Vocabulary) -> np.ndarray:
    """The chunk's matrix: states at ``low`` (or the text's start) x states at ``high``."""
    entries, exits = across(text, low, words), across(text, high, words)
    lost = np.full(max(1, len(entries)), LOST)
    where = word_starts(text, low, high)
    if where is None:
        values, _ = forward(text, low, high, entries, words)
        columns = [values.get(e, lost) for e in exits]
        return np.stack(columns, axis=1) if columns else np.zeros((len(lost), 0))
    first, last = where
    into = np.zeros(1)
    if entries:
        values, ending = forward(text, low, first, entries, words)
        into = np.max([values[p] for p in ending.get(first, [])] or [lost], axis=0)
    values, _ = forward(text, last, high, [], words)
    out = np.array([values[e][0] if e in values else LOST for e in exits])
    return into[:, None] + out[None, :]


def _path(text: str, goal: Piece, values: dict, ending: dict, stop: int, words: Vocabulary) -> list[Piece]:
    """The pieces before and with ``goal`` that start at ``stop`` or later."""
    path = [goal]
    while path[-1][0] > stop:
        here = text[path[-1][0] : path[-1][1]]
        left = next(p for p in ending[path[-1][0]] if values[p].max() > LOST and words.stable(text[p[0] : p[1]], here))
        path.append(left)
    return [p for p in reversed(path) if p[0] >= stop]


def lattice_word(text: str, words: Vocabulary) -> list[int]:
    """Ids of one word of any length, over the lattice alone."""
    values, ending = forward(text, 0, len(text), [], words)
    goal = next(p for p in ending[len(text)])
    return [i for a, b in _path(text, goal, values, ending, 0, words) for i in words.ids_of(text[a:b])]


def backtrace(text: str, low: int, high: int, state_in: int, state_out: int, encoder: WordEncoder) -> bytes:
    """Ids of the pieces that start in the chunk, given its states' numbers at both ends."""
    words = encoder.words
    entries, exits = across(text, low, words), across(text, high, words)
    entry, goal = entries[state_in] if entries else None, exits[state_out]
    if entry == goal:
        return b""
    begin = entry[1] if entry else low
    where = word_starts(text, low, high)
    seed = [entry] if entry else []

    def flat(path: list[Piece]) -> bytes:
        return array("I", [i for a, b in path for i in words.ids_of(text[a:b])]).tobytes()

    if where is None:
        values, ending = forward(text, low, high, seed, words)
        return flat(_path(text, goal, values, ending, begin, words))
    first, last = where
    front = b""
    if begin < first:
        values, ending = forward(text, low, first, seed, words)
        front = flat(_path(text, next(p for p in ending[first] if p != entry), values, ending, begin, words))
    values, ending = forward(text, last, high, [], words)
    return front + encoder.encode([text[first:last]])[0] + flat(_path(text, goal, values, ending, last, words))


class WordEncoder:
    """Ids of texts that start with a word, word by word; words met before are looked up."""

    def __init__(self, path: str) -> None:
        self.words = vocabulary(path)
        self.known = Remembered(self._learn, REMEMBERED)

    def _learn(self, new: list[str]) -> list[bytes]:
        # the model puts one blank in front itself, except of nothing
        short = [w for w in new if 1 < len(w) <= LONG_WORD]
        ids = dict(zip(short, self.words.model.encode([w[1:].replace(BLANK, " ") for w in short], num_threads=1)))
        return [array("I", ids[w] if w in ids else lattice_word(w, self.words)).tobytes() for w in new]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of normalised texts, as little-endian unsigned 32-bit numbers."""
        return self.known.joined([_WORDS.findall(t) for t in texts])


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """A worker's encoder, kept from task to task."""
    return WordEncoder(path)


def decode(ids: np.ndarray, words: Vocabulary) -> bytes:
    """The UTF-8 text of ids, with the blank that the model puts in front."""
    return b"".join(map(words.written.__getitem__, ids.tolist()))


# --- documents ------------------------------------------------------------------------

CHUNK_ROW = "row bigint, chunk int, low int, high int, window string"
MATRIX_ROW = "row bigint, chunk int, span int, rows int, columns int, weights binary"
STATE_ROW = "row bigint, span int, chunk int, state_in int, state_out int"
# Neighbouring chunks whose matrices one task multiplies.
SPAN = 64


def _split(batches: Iterator[pa.RecordBatch], size: int, margin: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks of normalised texts with ``margin`` characters around."""
    for batch in steps(batches, 1, 1):
        row, text, rest = batch.column(0)[0], normalised(batch.column(1)[0].as_py()), [c[0].as_py() for c in batch.columns[2:]]
        for chunk, low in enumerate(range(0, len(text), size)):
            high, begin = min(len(text), low + size), max(0, low - margin)
            values = [row.as_py(), chunk, low - begin, high - begin, text[begin : high + margin], *rest]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _resolve(matrices: list[np.ndarray], first: int, last: int | None) -> list[int]:
    """The states after each matrix on the best path from ``first`` to ``last`` (or the best)."""
    value = np.full((1, matrices[0].shape[0]), LOST)
    value[0, first] = 0.0
    values = [value]
    for matrix in matrices:
        values.append(max_plus(values[-1], matrix))
    state = int(values[-1][0].argmax()) if last is None else last
    states = [state]
    for value, matrix in zip(values[-2:0:-1], matrices[:0:-1]):
        state = int((value[0] + matrix[:, state]).argmax())
        states.append(state)
    return states[::-1]


def _matrices(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    table = table.sort_by("chunk")
    shapes = zip(table.column("rows").to_pylist(), table.column("columns").to_pylist(), table.column("weights").to_pylist())
    return table, [np.frombuffer(w, np.float32).reshape(r, c) for r, c, w in shapes]


def _states(matrices: DataFrame) -> DataFrame:
    """(row, span, chunk, state_in, state_out) of every chunk on its document's best path.

    The matrices of a span are multiplied in one task, then the spans' products of a document
    give the states between spans, then every span is resolved between its two.
    """
    arrow = lambda columns, names: pa.table([pa.array(c, pa.int64() if n == "row" else pa.int32()) for c, n in zip(columns, names)], names)

    def product(table: pa.Table) -> pa.Table:
        table, chain = _matrices(table)
        total = chain[0]
        for matrix in chain[1:]:
            total = max_plus(total, matrix)
        head = table.slice(0, 1)
        made = pa.table([head.column("row"), head.column("span"), head.column("span"), *(pa.array([n], pa.int32()) for n in total.shape), pa.array([total.astype(np.float32).tobytes()], pa.binary())], list(head.column_names))
        return made

    def between(table: pa.Table) -> pa.Table:
        table, chain = _matrices(table)
        outs = _resolve(chain, 0, None)
        spans = table.column("chunk").to_pylist()
        return arrow([table.column("row").to_pylist(), spans, spans, [0, *outs[:-1]], outs], STATE_NAMES)

    def within(chunks: pa.Table, ends: pa.Table) -> pa.Table:
        table, chain = _matrices(chunks)
        first, last = ends.column("state_in")[0].as_py(), ends.column("state_out")[0].as_py()
        outs = _resolve(chain, first, last)
        return arrow([*(table.column(n).to_pylist() for n in ("row", "span", "chunk")), [first, *outs[:-1]], outs], STATE_NAMES)

    products = matrices.groupBy("row", "span").applyInArrow(product, MATRIX_ROW)
    spans = products.groupBy("row").applyInArrow(between, STATE_ROW)
    return matrices.groupBy("row", "span").cogroup(spans.groupBy("row", "span")).applyInArrow(within, STATE_ROW)


PROOF = ["n_tokens", "ids_crc32", "n_chars", "decoded_crc32"]
STATE_NAMES = ["row", "span", "chunk", "state_in", "state_out"]


def _short(path: str, names: list[str]) -> Step:
    """The step that encodes whole texts: (id, text, rest...) to rows of ``names``."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in steps(batches, 1):
            ids = encoder.encode([normalised(t) for t in strings(batch.column(1))])
            n = batch.num_rows
            columns = [batch.column(0), *batch.columns[2:], pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return short


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), model: str | None = None, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """(id, keep..., row, chunk, ids): the model's ids of every whole text, as little-endian
    unsigned 32-bit numbers.

    The first table has the texts below ``chunk`` characters, a row each (``row`` is null);
    the second has a row per chunk of the longer ones, in order, with a ``row`` number that
    tells repeated documents apart. Null and empty texts have no ids. Columns not named are
    not read.
    """
    path = model or public_tokenizers.path(VOCABULARY)
    whole, giant = _by_length(docs, id_col, text_col, keep, chunk)
    names, shape = _coded(whole)
    return whole.mapInArrow(_short(path, names), shape), _encode_giant(giant, keep, path, chunk)


def _by_length(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], chunk: int) -> tuple[DataFrame, DataFrame]:
    """(id, text, keep...) of the texts below ``chunk`` characters, and of the others."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    length = F.coalesce(F.length("text"), F.lit(0))
    return base.filter(length < chunk), base.filter(length >= chunk)


def _coded(base: DataFrame) -> tuple[list[str], str]:
    """Names and types of ``encode``'s rows."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.drop("text").schema)
    shape = f"{fields}, row bigint, chunk int, ids binary"
    return [*base.drop("text").columns, "row", "chunk", "ids"], shape


def _encode_giant(texts: DataFrame, keep: tuple[str, ...], path: str, chunk: int) -> DataFrame:
    """A row per chunk of the texts, by the parallel scan."""
    margin = vocabulary(path).longest
    names, shape = _coded(texts)
    giant = texts.select(F.monotonically_increasing_id().alias("row"), "text", "id", *keep)
    chunk_shape = f"{CHUNK_ROW}, {shape.split(', row bigint')[0]}"
    chunk_arrow = _schema(chunk_shape)
    split = giant.mapInArrow(lambda b: _split(b, chunk, margin, chunk_arrow), chunk_shape)
    chunks = materialise(split.repartition("row", "chunk"))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in steps(batches, 4):
            rows, numbers, lows, highs, windows = (c.to_pylist() for c in batch.columns)
            made = [transfer(w, a, b, words) for w, a, b in zip(windows, lows, highs)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    pa.array(numbers, pa.int32()),
                    pa.array([n // SPAN for n in numbers], pa.int32()),
                    pa.array([m.shape[0] for m in made], pa.int32()),
                    pa.array([m.shape[1] for m in made], pa.int32()),
                    pa.array([m.astype(np.float32).tobytes() for m in made], pa.binary()),
                ],
                ["row", "chunk", "span", "rows", "columns", "weights"],
            )

    matrices = chunks.select("row", "chunk", "low", "high", "window").mapInArrow(matrix, MATRIX_ROW)
    placed = chunks.join(materialise(_states(materialise(matrices))).drop("span"), ["row", "chunk"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in steps(batches, 4):
            parts = [c.to_pylist() for c in (batch.column(n) for n in ("window", "low", "high", "state_in", "state_out"))]
            ids = [backtrace(*values, encoder) for values in zip(*parts)]
            columns = [batch.column(n) for n in names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names)

    order = ["row", "chunk", "low", "high", "window", "id", *keep, "state_in", "state_out"]
    return placed.select(*order).mapInArrow(trace, shape)


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def digests(whole: DataFrame, cut: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document of ``encode``'s two tables: n_tokens, ids_crc32 (of all ids as written),
    n_chars and decoded_crc32 (of the decoded text); other columns are kept.

    Chunks of a document are read in order as a stream.
    """
    path = model or public_tokenizers.path(VOCABULARY)
    keep = [c for c in whole.columns if c not in ("row", "chunk", "ids")]
    run, shape = _digest(path, whole.select(*keep).schema)
    return whole.select("row", "chunk", "ids", *keep).mapInArrow(run, shape).unionByName(_digest_giant(cut, path))


def _digest(path: str, kept: StructType) -> tuple[Step, str]:
    """The step from rows of (row, chunk, ids, kept...) to digests, and the types of its rows."""
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} bigint" for n in PROOF)])
    names = [*kept.names, *PROOF]
    arrow_shape = _schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        state: list | None = None
        for batch in steps(batches, 2):
            out = []
            for row, chunk, coded, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if state is not None and (chunk == 0 or row is None):
                    out.append(state)
                    state = None
                if state is None:
                    state = [*rest, 0, 0, 0, 0]
                text = decode(np.frombuffer(coded, "<u4"), words)[1 if chunk == 0 else 0 :]
                state[-4] += len(coded) // 4
                state[-3] = zlib.crc32(coded, state[-3])
                state[-2] += len(text.decode("utf-8", "replace"))
                state[-1] = zlib.crc32(text, state[-1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow_shape)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(state, arrow_shape)], names)

    return run, shape


def _digest_giant(cut: DataFrame, path: str) -> DataFrame:
    keep = [c for c in cut.columns if c not in ("row", "chunk", "ids")]
    run, shape = _digest(path, cut.select(*keep).schema)
    ordered = cut.select("row", "chunk", "ids", *keep).repartition("row").sortWithinPartitions("row", "chunk")
    return ordered.mapInArrow(run, shape)


def encode_proved(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """``encode`` in one table, with the proof beside the ids: (id, keep..., row, chunk, ids,
    n_tokens, ids_crc32, n_chars, decoded_crc32, round_trip).

    A text below ``chunk`` characters is a row; a longer one is a row per chunk, in order of
    ``chunk``, whose ``row`` tells repeated documents apart. The proof is that of the whole
    document on each of its rows. A U+2581 of the source comes back as a blank, by the model's
    format; anything else must come back as it was.

    Whole texts are encoded and decoded by one worker, so that a task holds the vocabulary once."""
    path = public_tokenizers.path(VOCABULARY)
    source = F.crc32(F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(BLANK), F.lit(" ")))
    keep = (*keep, "_source")
    whole, giant = _by_length(docs.withColumn("_source", source), id_col, text_col, keep, chunk)
    names, shape = _coded(whole)
    short = _short(path, names)
    run, proof_shape = _digest(path, StructType([]))
    proof_arrow = _schema(proof_shape)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            # a document is a row, so the digests come in the order of the rows
            found = pa.Table.from_batches(run([batch.select(["row", "chunk", "ids"])]), proof_arrow).combine_chunks()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(c.combine_chunks() for c in found.columns)], [*names, *PROOF])

    cut = materialise(_encode_giant(giant, keep, path, chunk))
    proofs = materialise(_digest_giant(cut.select(F.col("row").alias("_row"), "row", "chunk", "ids"), path))
    proved = join_small(cut.withColumn("_row", F.col("row")), proofs, "_row").select(*names, *PROOF)
    found = whole.mapInArrow(both, f"{shape}, {proof_shape}").unionByName(proved)
    return found.withColumn("round_trip", F.col("decoded_crc32") == F.col("_source")).drop("_source").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """A row per document of ``encode_proved``, without its ids: (id, keep..., n_tokens, ids_crc32,
    n_chars, decoded_crc32, round_trip)."""
    return encode_proved(docs, id_col, text_col, keep, chunk).filter("chunk = 0").drop("row", "chunk", "ids")
