"""Quality classifier: naive Bayes features in a linear support vector machine."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, return_freed

#: Lengths of the n-grams of bytes, and bits of the table that they are hashed into.
GRAMS, TABLE_BITS = (1, 2, 3, 4), 18
#: Labelled documents that the model is fitted on, at most.
MAX_FIT = 4000
FOLDS = 3
THRESHOLD = 0.3
SEED = 2


def repeats(text: str) -> list[int]:
    """Places of indicators of n-grams of equal words: the eighths reached by the share of words that are as one or two before, and of words that are repeats."""
    words = text.split()
    shares = [sum(map(str.__eq__, words, words[lag:])) / max(1, len(words) - lag) for lag in (1, 2)]
    shares.append(1 - len(set(words)) / max(1, len(words)))
    return [zlib.crc32(f"{i} {k}".encode()) >> (32 - TABLE_BITS) for i, share in enumerate(shares) for k in range(1, int(8 * share + 0.999) + 1)]


def grams(text: str, scratch: np.ndarray) -> np.ndarray:
    """Places of the byte n-grams and of the repeats that a text has, each once; ``scratch`` is a table of False and is so again after."""
    x = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    h = np.zeros(len(x), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(257) + x[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            scratch[(h * np.uint32(2654435761) ^ np.uint32(n * 40503)) >> np.uint32(32 - TABLE_BITS)] = True
    scratch[repeats(text)] = True
    found = np.flatnonzero(scratch).astype(np.int32)
    scratch[found] = False
    return found


class Rows:
    """Places of many texts in one array, so that fitting leaves no heap of small ones behind on the driver."""

    def __init__(self, texts: Iterable[str], block: int = 256):
        scratch = np.zeros(2**TABLE_BITS, bool)
        blocks, waiting, lengths = [], [], []
        for text in texts:
            waiting.append(grams(text, scratch))
            lengths.append(len(waiting[-1]))
            if len(waiting) == block:
                blocks.append(np.concatenate(waiting))
                waiting = []
        self.places = np.concatenate([*blocks, *waiting, np.zeros(0, np.int32)])
        self.ends = np.cumsum([0, *lengths])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.places[self.ends[i] : self.ends[i + 1]]


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))); ``weights`` hold the log-count ratios already."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        r = self.ratio[found]
        return float(self.weights[found] @ r / max(np.sqrt(r @ r), 1e-12)) + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50))))


def log_count_ratio(rows: Sequence[np.ndarray], labels: np.ndarray, inside: np.ndarray | None = None, smooth: float = 1.0) -> np.ndarray:
    """For each place, the log of its share of class 1's indicators over its share of class 0's."""
    counts = np.full((2, 2**TABLE_BITS), smooth)
    for i in range(len(rows)) if inside is None else inside:
        counts[int(labels[i]), rows[i]] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0]).astype(np.float32)


def fit_hinge(rows: Sequence[np.ndarray], labels: np.ndarray, ratio: np.ndarray, inside: np.ndarray | None = None, cost: float = 1.0, rounds: int = 20, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Linear hinge loss by dual coordinate descent over unit-length rows of scaled indicators; a constant gives the bias."""
    rng = np.random.default_rng(seed)
    y = np.where(labels == 1, 1.0, -1.0)
    weights, bias = np.zeros(len(ratio), np.float32), 0.0
    alpha = np.zeros(len(rows))
    inside = np.arange(len(rows)) if inside is None else inside
    share = {v: (y[inside] == v).mean() for v in (1.0, -1.0)}
    most = np.array([cost * 0.5 / max(share[v], 1e-9) for v in y])  # both classes weigh the same
    scale = np.zeros(len(rows), np.float32)
    for i in inside:
        r = ratio[rows[i]]
        scale[i] = 1 / max(np.sqrt(float(r @ r)), 1e-12)
    for _ in range(rounds):
        largest = 0.0
        for i in inside[rng.permutation(len(inside))]:
            found = rows[i]
            x = ratio[found] * scale[i]
            gradient = y[i] * (float(weights[found] @ x) + bias) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), most[i])  # a row and the constant have a squared length of 2
            change = (new - alpha[i]) * y[i]
            if change:
                alpha[i] = new
                weights[found] += np.float32(change) * x
                bias += change
                largest = max(largest, abs(change))
        if largest < 1e-3:
            break
    return weights, bias


def fit_logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, toward smoothed targets."""
    positive, negative = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * theta)
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(texts: Iterable[str], labels: np.ndarray, seed: int = SEED) -> Model:
    """Fit on labelled texts; scores are calibrated on margins of folds that were held out."""
    rows = Rows(texts)
    if len(set(labels.tolist())) < 2:
        # One class only, or none: the score is that class's smoothed share.
        share = (labels.sum() + 1) / (len(labels) + 2)
        zero = np.zeros(2**TABLE_BITS, np.float32)
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    fold = np.random.default_rng(seed).permutation(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        inside = np.flatnonzero(fold != k)
        ratio = log_count_ratio(rows, labels, inside)
        part = Model(ratio, *fit_hinge(rows, labels, ratio, inside))
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(rows[i])
    ratio = log_count_ratio(rows, labels)
    return Model(ratio, *fit_hinge(rows, labels, ratio), *fit_logistic(margins, labels))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, seed: int = SEED) -> Model:
    """A model from at most ``max_fit`` labelled documents that are not held out.

    Of conflicting labels of a document the lower counts; null labels and
    labels of no document don't. The documents are chosen by a hash of their
    id, among ids only; then the texts of these come to the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_fit)
    # At most max_fit rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).toArrow()
    return_freed(docs.sparkSession)
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    texts = rows.column("text").combine_chunks()
    return fit((texts[i].as_py() or "" for i in order), rows.column("quality").to_numpy()[order].astype(float), seed)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to ``docs`` by its column text; columns of these names are replaced.

    A null text counts as empty, which has the score of a document without
    n-grams. Whole texts are read, however long; nothing but the text is an
    input, so repeated rows and equal texts have equal scores. An empty table
    is empty; other columns are kept, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a table of fixed size
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scratch = np.zeros(2**TABLE_BITS, bool)
        for batch in batches:
            at = batch.schema.names.index("text")
            scores = [model.score(model.margin(grams(t.as_py() or "", scratch))) for t in batch.column(at)]
            passed = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(passed, pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields), "score double", "predicted int"])
    return map_in_arrow(docs.select(*kept), run, schema)


def classify(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted, by a model learned from ``labels`` (doc_id, quality).

    Without usable labels, or with those of one class, the score is that
    class's smoothed share. For what else is defined see learn and score.
    """
    return score(docs, learn(docs, labels, max_fit), threshold)
