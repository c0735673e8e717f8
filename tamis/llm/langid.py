"""Language of whole texts by a byte convolutional network, trained in numpy.

A window of fixed length goes through a byte embedding, filters of several widths, the
maximum over places and a softmax. For prediction, embedding and filters fold into tables over
pairs of bytes, so that a convolution is a sum of two table rows. A text is cut into windows that
cover all its bytes; its probabilities are the mean over its windows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tamis.llm.batches import steps, strings
from tamis.session import local_table

WINDOW = 64
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
# Bounds of the training sample: rows of each language, bytes of each row, rows in all.
ROWS_PER_LANGUAGE = 400
BYTES_PER_ROW = 512
SAMPLE_ROWS = 80_000
STEPS = 500
BATCH = 64
SEED = 7
# Windows that a worker convolves at once.
WINDOW_ROWS = 256

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """Class names, embedding (256 x e), filters (width -> width x e x f) with biases, output layer."""

    classes: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What two bytes add to the filters: the first two of a place to all filters, the
        next two to those wider than two."""
        parts = {w: [(self.embed @ f[k]).astype(np.float32) for k in range(w)] for w, f in self.filters.items()}
        pair = lambda a, b: (a[:, None, :] + (0 if b is None else b[None, :, :]) + np.zeros((1, 256, 1), np.float32)).reshape(1 << 16, -1)
        first = [pair(p[0], p[1]) for p in parts.values()]
        then = [pair(p[2], p[3] if w > 3 else None) for w, p in parts.items() if w > 2]
        return np.ascontiguousarray(np.concatenate(first, axis=1)), np.ascontiguousarray(np.concatenate(then, axis=1))


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All bytes of a text in rows of ``size``; the last is filled with blanks.

    Letter case and byte 0 carry no meaning here: A-Z become a-z.
    """
    data = text.lower()
    rows = max(1, -(-len(data) // size))
    return np.frombuffer(data.ljust(rows * size, b" "), np.uint8).reshape(rows, size)


def pooled(rows: np.ndarray, model: Model, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Maximum of every filter over the places of each window, rectified."""
    pairs = rows[:, :-1].astype(np.intp) * 256 + rows[:, 1:]
    first, then = tables
    sums = first.take(pairs[:, : rows.shape[1] - 3], axis=0)
    sums[:, :, FILTERS:] += then.take(pairs[:, 2:], axis=0)
    return np.maximum(sums.max(axis=1) + np.concatenate(list(model.biases.values())), 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, bytes]], seed: int = SEED, n_steps: int = STEPS) -> Model:
    """Fit by Adam on (language, bytes): each step draws windows evenly over the languages."""
    rng = np.random.default_rng(seed)
    rows = sorted(rows)
    classes = sorted({lang for lang, _ in rows})
    by_class = []
    for name in classes:
        cut = [windows(text) for lang, text in rows if lang == name]
        by_class.append(np.concatenate(cut))
    embed = rng.normal(0, 0.5, (256, EMBED))
    filters = {w: rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)) for w in WIDTHS}
    biases = {w: np.zeros(FILTERS) for w in WIDTHS}
    out = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(classes)))
    bias = np.zeros(len(classes))
    params = [embed, *filters.values(), *biases.values(), out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    model = Model(classes, embed, filters, biases, out, bias)
    for step in range(1, n_steps + 1):
        y = rng.integers(0, len(classes), BATCH)
        x = np.stack([by_class[c][rng.integers(len(by_class[c]))] for c in y])
        grads = _gradients(model, x, y)
        rate = 0.01 * min(1.0, 2.0 * (1 - step / (n_steps + 1)))
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _gradients(model: Model, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy, in the order of the parameters."""
    n, size = x.shape
    seen = model.embed[x]
    views, tops, maxima = {}, {}, {}
    places = size - max(model.filters) + 1
    for w, f in model.filters.items():
        view = np.lib.stride_tricks.sliding_window_view(seen, w, axis=1)[:, :places].transpose(0, 1, 3, 2).reshape(n, places, -1)
        z = view @ f.reshape(-1, FILTERS)
        top = z.argmax(axis=1)
        views[w], tops[w] = view, top
        maxima[w] = np.take_along_axis(z, top[:, None], axis=1)[:, 0] + model.biases[w]
    pool = np.concatenate([maxima[w] for w in model.filters], axis=1)
    active = pool > 0
    hidden = pool * active
    d = softmax(hidden @ model.out + model.bias)
    d[np.arange(n), y] -= 1
    d /= n
    d_hidden = (d @ model.out.T) * active
    d_embed = np.zeros_like(model.embed)
    d_filters, d_biases = [], []
    at = 0
    rows = np.arange(n)[:, None]
    for w, f in model.filters.items():
        part = d_hidden[:, at : at + FILTERS]
        at += FILTERS
        picked = views[w][rows, tops[w]]  # n x filters x (w * e)
        d_filters.append(np.einsum("nf,nfk->kf", part, picked).reshape(f.shape))
        d_biases.append(part.sum(axis=0))
        for k in range(w):
            spread = part[:, :, None] * f[k].T[None]  # n x filters x e
            np.add.at(d_embed, x[rows, tops[w] + k].reshape(-1), spread.reshape(-1, EMBED))
    return [d_embed, *d_filters, *d_biases, hidden.T @ d, d.sum(axis=0)]


def predict(texts: list[str], model: Model, tables: tuple) -> list[tuple[str, float]]:
    """(language, probability) of whole texts; ``und`` where there is no letter."""
    lettered = [i for i, t in enumerate(texts) if _LETTER.search(t)]
    out = [("und", 0.0)] * len(texts)
    if not lettered:
        return out
    sums = np.zeros((len(texts), len(model.classes)))
    counts = np.zeros(len(texts), np.int64)

    def add(parts: list[np.ndarray], owners: list[np.ndarray]) -> None:
        rows, owner = np.concatenate(parts), np.concatenate(owners)
        np.add.at(sums, owner, softmax(pooled(rows, model, tables) @ model.out + model.bias))
        np.add.at(counts, owner, 1)

    parts, owners, held = [], [], 0
    for i in lettered:
        cut = windows(texts[i].encode())
        for at in range(0, len(cut), WINDOW_ROWS):
            part = cut[at : at + WINDOW_ROWS]
            parts.append(part)
            owners.append(np.full(len(part), i))
            held += len(part)
            if held >= WINDOW_ROWS:
                add(parts, owners)
                parts, owners, held = [], [], 0
    if parts:
        add(parts, owners)
    means = sums[lettered] / counts[lettered, None]
    best = means.argmax(axis=1)
    for row, i in enumerate(lettered):
        out[i] = (model.classes[best[row]], float(min(1.0, means[row, best[row]])))
    return out


def training_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, bytes_per_row: int = BYTES_PER_ROW
) -> list[tuple[str, bytes]]:
    """A bounded sample of the labelled rows: for each language the rows whose keyed hash is
    smallest, and of each a piece from a hashed place in its text.

    Many languages have fewer rows each, so that there are ``SAMPLE_ROWS`` in all at most; of more
    languages than that, the most frequent ones are learned. Repeated rows count once.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS).collect()
    if not sizes:
        return []
    rows_per_language = min(rows_per_language, max(1, SAMPLE_ROWS // len(sizes)))
    # a hash bound per language keeps about twice the rows wanted; the smallest hashes follow
    spot = F.pmod(F.xxhash64(F.lit(SEED), "id", "text"), F.lit(1 << 30))
    limits = [(r["lang"], int(min(1.0, (2 * rows_per_language + 50) / r["count"]) * (1 << 30))) for r in sizes]
    bounds = local_table(docs.sparkSession, limits, "lang string, bound bigint")
    place = F.col("spot") % F.greatest(F.lit(1), F.length("text") - bytes_per_row + 1) + 1
    drawn = labelled.withColumn("spot", spot).join(F.broadcast(bounds), "lang").filter("spot < bound")
    drawn = drawn.select("lang", "spot", F.substring("text", place.cast("int"), F.lit(bytes_per_row)).alias("piece")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "piece")) <= rows_per_language
    found = drawn.withColumn("first", first).filter("first").select("lang", "spot", "piece").collect()
    return [(lang, piece.encode()[:bytes_per_row]) for lang, _, piece in sorted(map(tuple, found))]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> Model | None:
    """A model from the labelled rows of a table; None if no row has a language and a text."""
    rows = training_rows(labelled, id_col, text_col, lang_col, **bounds)
    return train(rows) if rows else None


def classify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced).

    ``und`` with score 0 where the text is null or has no letter; null with score 0 for other
    texts if no model could be learned. Nothing but the text is read for a prediction.
    """
    frozen = pickle.dumps(model)
    base = docs.drop("lang_pred", "score")
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(frozen)
        tables = own.tables() if own else ()
        for batch in steps(batches, at):
            texts = strings(batch.column(at))
            found = predict(texts, own, tables) if own else [(None if _LETTER.search(t) else "und", 0.0) for t in texts]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score"])

    shape = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return base.mapInArrow(run, shape)
