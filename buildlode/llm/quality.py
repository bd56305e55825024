"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text is shared by all grades; ordered thresholds cut its
score into grades: P(grade <= k) = sigmoid(threshold[k] - score). Features are hashed
sequences of ``GRAM`` bytes, counted over the whole text and divided by their number, and
the share of words that repeat the word before. A score is one table look-up for each
byte and costs the same for any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kernels as K
from .common import held_out, labelled_sample, small_batches

GRAM = 3
BITS = 16
#: Number of the feature after the hashed ones: words that repeat the one before them.
REPEAT = 1 << BITS
#: Bound of the labelled rows a model is fitted on, chosen by a hash of the doc_id.
SAMPLE = 6_000
#: A document is selected if P(grade >= SELECT_GRADE) is at least SELECT_AT.
SELECT_GRADE, SELECT_AT = 1, 0.5
STEPS, RATE, DECAY = 300, 0.05, 1e-3
_MULT = np.uint32(0x9E3779B1)


def _codes(data: np.ndarray) -> np.ndarray:
    """Hashed GRAM-byte sequence that starts at each byte but the last GRAM - 1."""
    h = np.zeros(max(0, len(data) - GRAM + 1), np.uint32)
    for i in range(GRAM):
        h += data[i : i + len(h)]
        h *= _MULT
    return h >> np.uint32(32 - BITS)


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """False where a sequence would reach over the end of its text."""
    ok = np.ones(n, bool)
    for back in range(1, GRAM):
        at = offsets[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def _repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of the words of each text that repeat the word before them."""
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offsets, K.NOT_SPACE)
    words, texts = K.hash_words(data, starts, ends), K.owners(first)
    same = np.flatnonzero((words[1:] == words[:-1]) & (texts[1:] == texts[:-1])) + 1
    return np.bincount(texts[same], minlength=len(offsets) - 1) / np.maximum(np.diff(first), 1)


def _sums(column, weights: np.ndarray):
    """Mean weight of the sequences of each text, and the weight of its repetition."""
    out = np.zeros(len(column))
    for low, data, offsets in K.buffers(column):
        value = weights[_codes(data)].astype(np.float64)
        ok = _inside(offsets, len(value))
        value[~ok] = 0
        total = np.concatenate([[0.0], np.cumsum(value)])
        count = np.maximum(np.diff(offsets) - GRAM + 1, 0)
        ends = np.minimum(offsets, len(value))
        out[low : low + len(count)] = np.where(count > 0, (total[ends[1:]] - total[ends[:-1]]) / np.maximum(count, 1), 0)
        out[low : low + len(count)] += weights[REPEAT] * _repeats(data, offsets)
    return out


def _features(column):
    """Sparse rows: text number, code and share of the text's sequences."""
    rows, cols, shares = [], [], []
    for low, data, offsets in K.buffers(column):
        codes = _codes(data).astype(np.int64)
        ok = np.flatnonzero(_inside(offsets, len(codes)))
        text = np.searchsorted(offsets, ok, "right") - 1
        both, n = np.unique((text << BITS) | codes[ok], return_counts=True)
        text = both >> BITS
        rows.append(low + text)
        cols.append(both & ((1 << BITS) - 1))
        shares.append(n / np.bincount(text, n, minlength=len(offsets))[text])
        repeats = _repeats(data, offsets)
        some = np.flatnonzero(repeats)
        rows.append(low + some)
        cols.append(np.full(len(some), REPEAT))
        shares.append(repeats[some])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(shares)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class OrdinalModel:
    """``thresholds`` rise; grade k of ``grades`` lies between thresholds k - 1 and k."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every grade but the highest."""
        return _sigmoid(self.thresholds[None, :] - scores[:, None])

    def tail(self, scores: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= the given one)."""
        below = sum(g < grade for g in self.grades)
        if below == 0:
            return np.ones(len(scores))
        return 1 - self.at_most(scores)[:, below - 1] if below < len(self.grades) else np.zeros(len(scores))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        below = np.concatenate([np.zeros((len(scores), 1)), self.at_most(scores), np.ones((len(scores), 1))], 1)
        return np.diff(below, axis=1) @ np.array(self.grades, float)


def fit(column, given: np.ndarray) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty, by full-batch Adam steps.

    Without any rated text the model knows grade 0 only and selects everything.
    """
    grades = sorted(set(given.tolist())) or [0]
    k = len(grades) - 1
    if k == 0:
        return OrdinalModel(grades, np.zeros(REPEAT + 1, np.float32), np.zeros(0))
    y = np.searchsorted(grades, given)
    rows, cols, shares = _features(column)
    used, cols = np.unique(cols, return_inverse=True)
    n = len(y)
    # Features are scaled towards like spread, so one rate serves rare and frequent ones;
    # the term added keeps rare ones small, or each text would be learned by its own.
    scale = 1 / (np.sqrt(np.bincount(cols, shares**2, minlength=len(used)) / n) + 1e-2)
    x = shares * scale[cols]
    shares_at_most = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n
    # theta: first threshold, then logarithms of the gaps, so thresholds stay ordered.
    first = np.log(shares_at_most / (1 - shares_at_most))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    params = np.concatenate([np.zeros(len(used)), theta])
    mean, spread = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, theta = params[:-k], params[-k:]
        gaps = np.exp(theta[1:])
        cut = np.concatenate([theta[:1], theta[0] + np.cumsum(gaps)])
        score = np.bincount(rows, x * w[cols], minlength=n)
        upper = np.where(y < k, _sigmoid(cut[np.minimum(y, k - 1)] - score), 1.0)
        lower = np.where(y > 0, _sigmoid(cut[np.maximum(y - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = (du - dl) / n  # of the loss in the score
        g_cut = np.bincount(np.minimum(y, k - 1), -du * (y < k) / n, minlength=k)
        g_cut += np.bincount(np.maximum(y - 1, 0), dl * (y > 0) / n, minlength=k)
        after = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, x * slope[rows], minlength=len(used)) + DECAY * w, after[:1], after[1:] * gaps])
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        params -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(REPEAT + 1, np.float32)
    weights[used] = params[:-k] * scale
    theta = params[-k:]
    return OrdinalModel(grades, weights, np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))]))


def _fit_task(batches):
    got = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("grade", pa.int64())]))
    column = K.whole(got.column("text"))
    model = fit(column, got.column("grade").to_numpy())
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.grades], pa.list_(pa.int64())), pa.array([model.weights.tobytes()], pa.binary()),
         pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))], names=["grades", "weights", "thresholds"])


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` rows of ``ratings`` (doc_id, grade) that are not held out.

    Only the doc_ids and grades of the sample are broadcast; the texts go to the one task
    that fits. Ratings without a grade or a document are left out; a doc_id rated twice
    counts twice.
    """
    small_batches(docs.sparkSession)
    rated = labelled_sample(ratings.filter("grade is not null"), sample, "grade")
    rated = rated.select(F.col("doc_id").alias("_rated"), F.col("grade").cast("long").alias("grade"))
    texts = docs.select(docs["doc_id"].cast("long").alias("_doc"), docs["text"].cast("string").alias("text"))
    chosen = texts.join(F.broadcast(rated), F.col("_doc") == F.col("_rated"))
    # A fixed order, so that a rerun adds up the same numbers in the same order.
    chosen = chosen.repartition(1).sortWithinPartitions("_doc", "grade", F.xxhash64("text")).select("text", "grade")
    row = chosen.mapInArrow(_fit_task, "grades array<long>, weights binary, thresholds array<double>").first()
    if row is None:
        return fit(pa.array([], pa.string()), np.zeros(0, np.int64))
    return OrdinalModel(list(row.grades), np.frombuffer(row.weights, np.float32), np.array(row.thresholds))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for low quality, 1 for good but toxic, 2 for good texts."""
    good = F.col("quality").cast("long")
    return labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(good == 0, 0).otherwise(good + F.when(F.col("toxic") == 1, 0).otherwise(1)).cast("long").alias("grade"),
    )


def _score_task(model, grade: int):
    def run(batches):
        for batch in batches:
            scores = _sums(batch.column("text"), model.value.weights)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.value.expected(scores)), pa.array(model.value.tail(scores, grade))],
                names=[*batch.schema.names, "expected_grade", "p_tail"])

    return run


def score(docs: DataFrame, model: OrdinalModel, grade: int = SELECT_GRADE) -> DataFrame:
    """``docs`` with expected_grade and p_tail, the probability of ``grade`` or better.

    One pass without a shuffle. A null or empty text gets the score 0. Input columns
    named expected_grade or p_tail are replaced.
    """
    sent = docs.drop("expected_grade", "p_tail")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*sent.schema.fields, *(StructField(c, DoubleType()) for c in ("expected_grade", "p_tail"))])
    return sent.mapInArrow(_score_task(shared, grade), schema)


def quality_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, expected_grade, p_tail, selected for every row.

    Learned only from rows whose crc32 fold is not 2. Repeated rows get equal results;
    an empty table gives an empty result; without labels everything is selected.
    """
    model = train(docs, graded(labels), sample)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return score(rows, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "expected_grade", "p_tail", (F.col("p_tail") >= SELECT_AT).alias("selected")
    )


def select(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that the model selects."""
    model = train(docs, graded(labels), sample)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].cast("string").alias("text"))
    return score(rows, model).filter(F.col("p_tail") >= SELECT_AT).select("row.*")
