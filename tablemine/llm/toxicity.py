"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the only labelled class; all other text counts
as unlabelled, some of it toxic.  A linear classifier over hashed words and
word beginnings minimises the risk

    prior * R+(toxic)  +  max(0, R-(unlabelled) - prior * R-(toxic)),

in which the unlabelled text, corrected by the toxic share among it, stands
for the harmless class.  Where that estimate falls below zero the classifier
has begun to learn single documents, and the step goes the other way.  Several
classifiers, each on its own part of the unlabelled text, vote by their mean.

Fitted here, with numpy, on bounded samples (``TOXIC_DOCS``,
``UNLABELLED_DOCS``); every document is scored by its whole text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, read, slices

#: Documents sampled for the fit, by a hash of the id (expected numbers).
TOXIC_DOCS, UNLABELLED_DOCS = 2_000, 8_000
#: Hash space of the features; of those that at least ``LEAST_DOCS`` toxic
#: documents of the sample hold, the classifier keeps up to ``KEPT`` whose
#: share is ``LEAST_Z`` standard errors or more above that of unlabelled ones.
BUCKETS, KEPT, LEAST_DOCS, LEAST_Z = 1 << 22, 5_000, 3, 4
#: Bytes of a word's beginning that make a feature beside the word itself.
BEGINNINGS = (4, 5, 6)
CLASSIFIERS, STEPS, RATE, DECAY = 3, 300, 0.1, 4e-3
#: Folds by crc32 of the id; labels of fold 0 are never learnt from.
FOLDS = 5

#: Letters stay (capitals as small ones), also beyond ASCII; all else parts words.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _lettered(column: pa.Array) -> pa.Array:
    """The texts with everything but letters blank."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = _LETTERS[np.frombuffer(raw, np.uint8)[off[0]:off[-1]]] if raw is not None else np.empty(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((off - off[0]).tobytes()), pa.py_buffer(data)])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text (words and beginnings of words, as
    buckets) and where each text's begin, with the total at the end."""
    words = Words(_lettered(column))
    n = len(column)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(words.starts))
    size = words.last - words.first
    found = [(doc, mix(words.ids ^ np.uint64(0x5851F42D4C957F2D)))]
    padded = np.append(words.data, np.zeros(8, np.uint8))
    for k in BEGINNINGS:
        long = np.flatnonzero(size >= k)
        code = np.full(len(long), k, np.uint64)
        for j in range(k):
            code = code << np.uint64(8) | padded[words.first[long] + j].astype(np.uint64)
        found.append((doc[long], mix(code)))
    doc = np.concatenate([d for d, _ in found])
    code = (np.concatenate([c for _, c in found]) % np.uint64(BUCKETS)).astype(np.int64)
    each = np.unique(doc * BUCKETS + code)
    return (each % BUCKETS).astype(np.int32), np.searchsorted(each // BUCKETS, np.arange(n + 1))


# -- the classifier -------------------------------------------------------

@dataclass
class Classifier:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def margins(self, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.full(len(starts) - 1, self.bias)
        at = np.minimum(np.searchsorted(self.buckets, found), len(self.buckets) - 1)
        w = np.where(self.buckets[at] == found, self.weights[at], 0.0)
        return np.diff(np.concatenate([[0.0], np.cumsum(w)])[starts]) + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(prior: float, toxic: np.ndarray, unlabelled: np.ndarray) -> tuple[float, float]:
    """The two parts of the estimate, from margins: of toxic documents taken
    for harmless, and (not yet cut at 0) of harmless ones taken for toxic."""
    loss = lambda x: np.logaddexp(0, x)
    return prior * loss(-toxic).mean(), loss(unlabelled).mean() - prior * loss(toxic).mean()


class Sample:
    """Some documents' kept features as one flat array."""

    def __init__(self, docs: list[np.ndarray], kept: np.ndarray) -> None:
        sizes, flat = [], []
        for d in docs:
            at = np.minimum(np.searchsorted(kept, d), len(kept) - 1) if len(kept) else np.zeros(0, np.int64)
            own = at[kept[at] == d] if len(kept) else at
            flat.append(own)
            sizes.append(len(own))
        self.flat = np.concatenate([np.zeros(0, np.int64), *flat])
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        self.n = len(docs)

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, w[self.flat], self.n)

    def pull(self, by_doc: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.flat, by_doc[self.doc], width)

    def part(self, docs: np.ndarray) -> Sample:
        out = object.__new__(Sample)
        number = np.full(self.n, -1)
        number[docs] = np.arange(len(docs))
        own = number[self.doc] >= 0
        out.flat, out.doc, out.n = self.flat[own], number[self.doc[own]], len(docs)
        return out


def chosen(toxic: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The features whose share of toxic documents lies furthest above that
    of unlabelled ones, in standard errors."""
    count = [np.unique(np.concatenate([np.zeros(0, np.int32), *x]), return_counts=True) for x in (toxic, unlabelled)]
    (names, n), (others, m) = count
    at = np.minimum(np.searchsorted(others, names), max(len(others) - 1, 0))
    beside = np.where(others[at] == names, m[at], 0) if len(others) else np.zeros(len(names), np.int64)
    p, q = n / max(len(toxic), 1), beside / max(len(unlabelled), 1)
    rate = (n + beside + 1) / (len(toxic) + len(unlabelled) + 1)
    z = np.where(n >= min(LEAST_DOCS, max(len(toxic), 1)), (p - q) / np.sqrt(rate * (1 / max(len(toxic), 1) + 1 / max(len(unlabelled), 1))), -1.0)
    best = np.lexsort((names, -z))[:KEPT]
    return np.sort(names[best[z[best] > LEAST_Z]])


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> list[Classifier]:
    """Classifiers by non-negative risk; none without toxic documents (all
    scores are then the prior)."""
    if not toxic or not unlabelled:
        return []
    prior = min(max(prior, 1e-4), 0.999)
    kept = chosen(toxic, unlabelled)
    good, rest = Sample(toxic, kept), Sample(unlabelled, kept)
    out = []
    for k in range(CLASSIFIERS):
        # each leaves out another part of the unlabelled text
        own = np.flatnonzero(np.arange(rest.n) % (CLASSIFIERS + 1) != k) if rest.n > CLASSIFIERS else np.arange(rest.n)
        out.append(Classifier(kept, *_descend(good, rest.part(own), prior, len(kept))))
    return out


def _descend(toxic: Sample, unlabelled: Sample, prior: float, width: int) -> tuple[np.ndarray, float]:
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    first, second, first_b, second_b = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p, u = toxic.margins(w) + b, unlabelled.margins(w) + b
        _, harmless = risk(prior, p, u)
        up, down = sigmoid(p) / toxic.n * prior, sigmoid(u) / unlabelled.n
        if harmless >= 0:
            of_toxic, of_rest = -prior / toxic.n * sigmoid(-p) - up, down
        else:  # only the part below zero, uphill
            of_toxic, of_rest = up, -down
        g = toxic.pull(of_toxic, width) + unlabelled.pull(of_rest, width) + DECAY * prior * w
        gb = float(of_toxic.sum() + of_rest.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        first_b, second_b = 0.9 * first_b + 0.1 * gb, 0.999 * second_b + 0.001 * gb * gb
        c, d = 1 - 0.9 ** step, 1 - 0.999 ** step
        w = w - RATE * (first / c) / (np.sqrt(second / d) + 1e-8)
        b = b - RATE * (first_b / c) / (np.sqrt(second_b / d) + 1e-8)
    return w, b


# -- on Spark -------------------------------------------------------------

def fold(id_column: Column) -> Column:
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(FOLDS))


def _thinned(df: DataFrame, rows: int, wanted: int, seed: int) -> DataFrame:
    """About ``wanted`` of ``rows`` rows, by a hash of the id."""
    if rows <= wanted:
        return df
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(wanted / rows * (1 << 30)))


def _sampled(docs: DataFrame) -> list[np.ndarray]:
    """Features of some documents, in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found, starts = features(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([found[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())],
                ["doc_id", "found"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, found binary").collect()
    return [np.frombuffer(r.found, np.int32) for r in sorted(rows, key=lambda r: (r.doc_id, r.found))]


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[Classifier], float]:
    """Fit on the documents whose id is not of fold 0.  The prior is the share
    of toxic ones among the labelled; text of labelled harmless documents is
    unlabelled text like any other."""
    learnt = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learnt = learnt.where(fold(F.col("doc_id")) != 0)
    n, toxic = learnt.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return [], 0.0
    text = docs.where("doc_id is not null").where(fold(F.col("doc_id")) != 0)
    names = _thinned(learnt.where("toxic = 1"), toxic, TOXIC_DOCS, 1).select("doc_id")
    # bounded by TOXIC_DOCS, so it may go to all tasks
    bad = _sampled(text.join(F.broadcast(names), "doc_id", "left_semi"))
    rest = _sampled(_thinned(text, text.count(), UNLABELLED_DOCS, 2))
    return fit(bad, rest, toxic / n), toxic / n


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row.

    Null text scores like an empty one; without toxic labels all score 0;
    repeated rows each give a row, equal texts the same score; a null id is not
    held out and trains nothing; an empty table gives no rows; other columns
    are ignored.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    models, prior = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = features(part.column("text"))
            score = np.mean([sigmoid(m.margins(*found)) for m in models], 0) if models else np.full(part.num_rows, prior)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score)],
                                             ["doc_id", "held_out", "score"])

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    out = docs.select("doc_id", "text", held).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``."""
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
