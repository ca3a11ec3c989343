"""Quality classifier by co-training of a text view and a metadata view.

Two naive Bayes classifiers see a document from two sides: the text's words, their shapes and their
repetition; and the page's metadata (language, source, length). Both start from labelled documents.
In every round each one scores all documents, and where it is confident its opinion becomes a
label for the other one. Each view is calibrated by logistic regression on labelled documents that
it was not trained on; the calibrated log-odds of both, less one prior, score every document.

Labels are used up to ``LABELLED`` documents, those with the smallest hashes of their ids; a fifth of
them (crc32 of the id) is kept for calibration. Everything else covers all documents: each round is
one pass, whose counts are added up on the executors. Only count vectors of fixed size and the
calibration rows, bounded by ``LABELLED``, reach the driver.

A document labelled twice takes the higher label; NULL labels and ids are no labels. Without labels
of both kinds every document scores 0.5 and stays. NULL text has no words, NULL metadata is a value
like any other; rows are scored one by one; other columns stay as they are.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veedor.llm.arrays import NON_SPACE, pieces, tidy, utf8, word_hashes, words
from veedor.llm.sums import SLICES, added, sliced
from veedor.runtime import stage

LABELLED = 20_000
ROUNDS = 2
CONFIDENT = 0.95
#: A document is rejected when the probability that it is good is below this.
KEEP_FROM = 0.5
SMOOTH = 0.5
CALIBRATION_OF = 5

WORD_BITS, SHAPES, PAIR_BITS = 14, 1 << 9, 12
TEXT_EDGES = np.cumsum([0, 1 << WORD_BITS, SHAPES, 1 << PAIR_BITS, 2])
META_SIZE = 1 << 10
META = ("lang", "source", "n_chars")

# Classes of bytes, one bit each: lower case, upper case, digit, sentence mark, other mark, beyond ASCII.
_BITS = np.full(256, 16, np.uint8)
_BITS[97:123], _BITS[65:91], _BITS[48:58], _BITS[128:] = 1, 2, 4, 32
_BITS[[ord(c) for c in ".,;:"]] = 8


class TextView(NamedTuple):
    """Per token: its features (word, shape, pair of shapes, repetition); per text: its first token."""

    features: np.ndarray  # 4 rows
    first: np.ndarray


def text_view(data: np.ndarray, offsets: np.ndarray) -> TextView:
    w = words(data, offsets, NON_SPACE)
    n = len(w.start)
    if not n:
        return TextView(np.zeros((4, 0), np.int64), w.first)
    h = word_hashes(w)
    bits = np.append(_BITS[data], np.uint8(0))
    flags = np.bitwise_or.reduceat(bits, np.stack([w.start, w.end], 1).ravel())[::2].astype(np.int64)
    tail = np.log2(bits[w.end - 1]).astype(np.int64)
    shape = flags * 8 + tail
    begins = np.zeros(n, bool)
    begins[w.first[:-1][np.diff(w.first) > 0]] = True
    before = np.where(begins, 0, np.roll(shape, 1))
    pair = ((before * 40503 + shape) * 2654435761 >> 7) & ((1 << PAIR_BITS) - 1)
    again = (~begins & (h == np.roll(h, 1))).astype(np.int64)
    rows = np.stack([(h >> np.uint64(64 - WORD_BITS)).astype(np.int64), shape, pair, again])
    return TextView(rows + TEXT_EDGES[:4, None], w.first)


def meta_view(values: list[tuple]) -> np.ndarray:
    """Features of each document: every value, length by its power of two, and all values together."""
    slot = {}
    out = np.empty((len(values), len(META) + 1), np.int64)
    for k, row in enumerate(values):
        if row not in slot:
            parts = [f"{place}:{x}" for place, x in enumerate((*row, row))]
            slot[row] = [zlib.crc32(x.encode()) % META_SIZE for x in parts]
        out[k] = slot[row]
    return out


def _metadata(columns: list[Column]) -> Column:
    """Metadata as an array of strings; numbers by the power of two."""
    return F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


class Bayes(NamedTuple):
    """Log ratio of good to bad of every feature, within its group."""

    ratio: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, edges: np.ndarray) -> Bayes:
        """``counts``: of bad, then of good documents."""
        bad, good = counts.reshape(2, -1).astype(np.float64) + SMOOTH
        parts = [np.log(g / g.sum()) - np.log(b / b.sum()) for g, b in zip(np.split(good, edges[1:-1]), np.split(bad, edges[1:-1]))]
        return Bayes(np.concatenate(parts))

    def text(self, view: TextView) -> np.ndarray:
        """Mean ratio of each group over a text's tokens; 0 without tokens."""
        total = np.concatenate([np.zeros((4, 1)), np.cumsum(self.ratio[view.features], 1)], 1)
        sums = total[:, view.first[1:]] - total[:, view.first[:-1]]
        return (sums / np.maximum(np.diff(view.first), 1)).T

    def meta(self, view: np.ndarray) -> np.ndarray:
        return self.ratio[view]


class Calibration(NamedTuple):
    weights: np.ndarray  # the last one is the constant
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray) -> Calibration:
        """Logistic regression by Newton steps, with a small penalty on the weights."""
        prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        w = np.append(np.zeros(x.shape[1]), prior)
        full = np.hstack([x, np.ones((len(x), 1))])
        penalty = np.diag(np.append(np.full(x.shape[1], 0.1), 1e-6))
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
            hess = (full * (p * (1 - p))[:, None]).T @ full + penalty
            change = np.linalg.solve(hess, full.T @ (y - p) - penalty @ w)
            w = w + np.clip(change, -5, 5)
            if np.abs(change).max() < 1e-8:
                break
        return Calibration(w, prior)


class Views(NamedTuple):
    """Both classifiers with their calibrations."""

    text: Bayes
    meta: Bayes
    text_fit: Calibration
    meta_fit: Calibration

    def log_odds(self, text: TextView, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.text_fit.log_odds(self.text.text(text)), self.meta_fit.log_odds(self.meta.meta(meta))

    def combined(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(text + meta - self.text_fit.prior)))


def _views(batch: pa.RecordBatch, text_at: int, meta_at: int):
    """(first row, row after the last, text view, metadata view) of bounded runs of a batch."""
    data, offsets = utf8(batch.column(text_at))
    for a, b in pieces(offsets):
        meta = meta_view([tuple(x) for x in batch.column(meta_at).slice(a, b - a).to_pylist()])
        yield a, b, text_view(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), meta


TEXT_SIZE = int(TEXT_EDGES[-1])
META_EDGES = np.array([0, META_SIZE])
COUNTS = 2 * (TEXT_SIZE + META_SIZE)


class Counts:
    """Feature counts of bad and good documents for both views."""

    def __init__(self):
        self.text, self.meta = np.zeros(2 * TEXT_SIZE, np.int64), np.zeros(2 * META_SIZE, np.int64)

    def add(self, text: TextView, meta: np.ndarray, text_label: np.ndarray, meta_label: np.ndarray) -> None:
        """Labels 0 and 1; -1 is none."""
        token = np.repeat(text_label, np.diff(text.first))
        own = token >= 0
        self.text += np.bincount((text.features[:, own] + TEXT_SIZE * token[own]).ravel(), minlength=2 * TEXT_SIZE)
        own = meta_label >= 0
        self.meta += np.bincount((meta[own] + META_SIZE * meta_label[own][:, None]).ravel(), minlength=2 * META_SIZE)

    def rows(self) -> pa.RecordBatch:
        parts = sliced(np.concatenate([self.text, self.meta]))
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])


def _count_labelled(batches):
    """Counts of documents (id, text, meta, label) with their labels."""
    counts = Counts()
    for batch in batches:
        label = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, text, meta in _views(batch, 1, 2):
            counts.add(text, meta, label[a:b], label[a:b])
    yield counts.rows()


def _count_confident(shared, labelled):
    """Counts of all documents (id, text, meta) that the other view is confident about; labelled ones are left out."""
    edge = np.log(CONFIDENT / (1 - CONFIDENT))

    def run(batches):
        views, known, counts = shared.value, labelled.value, Counts()
        for batch in batches:
            free = np.array([x not in known for x in batch.column(0).to_pylist()], bool)
            for a, b, text, meta in _views(batch, 1, 2):
                by_text, by_meta = views.log_odds(text, meta)
                opinion = lambda x: np.where(free[a:b] & (np.abs(x) >= edge), (x > 0).astype(np.int64), -1)  # noqa: B023, E731
                counts.add(text, meta, opinion(by_meta), opinion(by_text))
        yield counts.rows()

    return run


def _fit(rows: DataFrame, counts: np.ndarray) -> Views:
    """Classifiers from counts, calibrated on ``rows`` (id, text, meta, label)."""
    text, meta = Bayes.of(counts[: 2 * TEXT_SIZE], TEXT_EDGES), Bayes.of(counts[2 * TEXT_SIZE :], META_EDGES)
    shared = rows.sparkSession.sparkContext.broadcast((text, meta))

    def measure(batches):
        text, meta = shared.value
        for batch in batches:
            for a, b, seen, about in _views(batch, 1, 2):
                x = np.hstack([text.text(seen), meta.meta(about)])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(3).slice(a, b - a)], ["x", "label"])

    found = rows.mapInArrow(tidy(measure), "x array<double>, label int").collect()
    x = np.array([r.x for r in found]).reshape(len(found), 4 + len(META) + 1)
    y = np.array([r.label for r in found], np.float64)
    return Views(text, meta, Calibration.of(x[:, :4], y), Calibration.of(x[:, 4:], y))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, meta_cols: tuple[str, ...], rounds: int = ROUNDS) -> Views | None:
    """The classifiers after ``rounds`` of exchange; None without labels of both kinds."""
    context = docs.sparkSession.sparkContext
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _metadata(_meta_columns(docs, meta_cols)).alias("meta"))
    each = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    sample = stage(each.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(LABELLED), "quality-labels")
    rows = stage(narrow.join(F.broadcast(sample), "id").select("id", "text", "meta", "label"), "quality-labelled")
    for_fit = F.crc32(F.col("id").cast("string").cast("binary")) % CALIBRATION_OF == 0
    learn, fit = rows.where(~for_fit), rows.where(for_fit)
    kinds = {(r.f, r.label) for r in rows.select(for_fit.alias("f"), "label").distinct().collect()}
    if len(kinds) < 4:
        return None
    schema = "slice int, counts binary"
    own = added(learn.mapInArrow(tidy(_count_labelled), schema), COUNTS)
    views = _fit(fit, own)
    known = context.broadcast({r.id for r in sample.collect()})
    for _ in range(rounds):
        shared = context.broadcast(views)
        views = _fit(fit, own + added(narrow.mapInArrow(tidy(_count_confident(shared, known)), schema), COUNTS))
    return views


def _meta_columns(docs: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """Metadata columns; a missing one is NULL, a number is replaced by its power of two."""
    out = []
    for name in names:
        if name not in docs.columns:
            out.append(F.lit(None))
        elif docs.schema[name].dataType.typeName() in ("long", "integer", "double"):
            out.append(F.floor(F.log2(F.greatest(F.col(name), F.lit(1)))))
        else:
            out.append(F.col(name))
    return out


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    meta_cols: tuple[str, ...] = META,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` (all by default) of every document as ``row``, with text_score, meta_score and score:
    the probabilities of a good document by either view and by both."""
    views = train(docs, labels, id_col, text_col, label_col, meta_cols)
    row = F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("row")
    if views is None:
        half = F.lit(0.5)
        return docs.select(row, half.alias("text_score"), half.alias("meta_score"), half.alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(views)
    rows = docs.select(row, F.col(text_col).alias("text"), _metadata(_meta_columns(docs, meta_cols)).alias("meta"))

    def run(batches):
        views = shared.value
        for batch in batches:
            for a, b, text, meta in _views(batch, 1, 2):
                by_text, by_meta = views.log_odds(text, meta)
                chance = lambda x: pa.array(1 / (1 + np.exp(-x)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), chance(by_text), chance(by_meta), pa.array(views.combined(by_text, by_meta))],
                    ["row", "text_score", "meta_score", "score"],
                )

    zero = F.lit(0.0)
    return rows.mapInArrow(tidy(run), rows.select("row", zero.alias("text_score"), zero.alias("meta_score"), zero.alias("score")).schema)


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, **names) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    return score(docs, labels, **names).where(F.col("score") >= keep_from).select("row.*")
