"""Toxicity by noisy-channel deobfuscation.

Obfuscated words (1d10t, s c u m, cloooown) are decoded first. The spans that may be
obfuscated become lattices of characters: a digit or sign may stand for letters, a
separator between single letters may be filler, a repeated letter may stand for one or
two. A Viterbi search finds the reading that is most probable under a trigram character
model of all documents and the cost of each such change. Then the restored text is
scored: a logistic regression weighs the words and word beginnings that mark toxic texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut_lineage, held_out, labelled_sample, small_batches

#: Bound of the labelled rows that markers are learned from, chosen by a hash of the doc_id.
SAMPLE = 12_000
PREDICT_AT = 0.3
#: Word beginnings that are markers of their own, in bytes.
STEMS = (4, 5)
#: A marker is kept if at least this share of its texts is toxic.
LEAST_SHARE = 0.5
STEPS, RATE, DECAY = 600, 0.05, 2e-6

# The letters that a digit or sign may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "#": "h",
}
SIGNS = re.escape("".join(READINGS))
#: Spans that may be obfuscated: signs inside or at the ends of words, digits with other
#: signs, spaced single letters, repetition. Digits alone are a number.
#: Each starts where a run of its characters starts and never gives back what it took, so a
#: search reads a text a fixed number of times, whatever runs it holds.
SPACED = rf"(?<![^\W_])(?:[a-z{SIGNS}][ ._-]++){{2,}}[a-z{SIGNS}](?![^\W_])"
MIXED = rf"(?<![a-z{SIGNS}])(?=[a-z]*+[{SIGNS}])[{SIGNS}]*+[a-z][a-z{SIGNS}]*+"
UNNUMBERED = re.escape("".join(c for c in READINGS if not c.isdigit()))
ALL_SIGNS = rf"(?<![^\W_])(?<![{SIGNS}])(?=[{UNNUMBERED}]*+[0-9])(?![0-9]++(?![{SIGNS}]))[{SIGNS}]{{3,}}(?![^\W_])"
SUSPECT = re.compile(rf"{SPACED}|{MIXED}|{ALL_SIGNS}|(?<![a-z])[a-z]*([a-z])\1\1[a-z]*+")
#: Logarithms of the channel: a sign read as a letter, or left as it is inside a word or at
#: an end; a separator between single letters as filler or as a gap; a repeated letter as
#: one or as two.
AS_LETTER, AS_GAP, AS_IS, FILLER, REAL, ONCE, TWICE = map(math.log, (0.5, 0.001, 0.0003, 0.7, 0.1, 0.6, 0.3))
#: The same for each sign of a span without a letter, which is left or read as a whole.
NO_WORD = math.log(0.007)
#: Signs that may follow a word whose last signs are read as letters.
CLOSING = "!*#+|"

# Symbols of the character model: gap, a to z, any other letter.
CLASSES = 28
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[128:] = 27
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in READINGS]] = True
_ASCII = K.table((0x61, 0x7A))
_WORD = K.table((0x30, 0x39), (0x61, 0x7A))


def _trigrams(batches):
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for _, data, offsets in K.buffers(batch.column("text")):
            c = np.insert(_CLASS[K.LOWER[data]], offsets[:-1], 0)
            c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])] if len(c) else c
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | two before) over all documents; context (0, 0) is a word's start."""
    counts = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_trigrams, "code long, n long")
    counts = counts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most CLASSES cubed rows
    n = np.zeros(CLASSES**3)
    n[counts["code"].to_numpy()] = counts["n"].to_numpy()
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    n[0, 0] = n[:, 0].sum(0)
    pairs = n[1:].sum(0) + 0.1
    pairs /= pairs.sum(1, keepdims=True)
    return np.log((n + 5 * pairs[None]) / (n.sum(2, keepdims=True) + 5))


def _core(span: str) -> tuple[int, int]:
    """First and last place that is no sign at an end; both the length without any."""
    some = [i for i, c in enumerate(span) if c not in READINGS]
    return (some[0], some[-1]) if some else (len(span), len(span))


def _options(span: str) -> tuple[list[list[tuple[str, float]]], list[str], list[int]]:
    """The lattice: for each place the strings it may stand for, with their costs.

    Also the character of the place and where it is in the span.

    A space or a sign in an option is a gap between words, the empty string is nothing.
    """
    spaced = any(c in " ._-" for c in span)
    inside = range(*_core(span))
    out, signs, at, i = [], [], [], 0
    while i < len(span):
        c, j = span[i], i
        signs.append(c)
        at.append(i)
        while j < len(span) and span[j] == c and c not in READINGS:
            j += 1
        if c in " ._-":
            while j < len(span) and span[j] in " ._-":
                j += 1
            out.append([("", FILLER), (" ", REAL)])
        elif "a" <= c <= "z" and j - i >= 3:
            out.append([(c, ONCE), (c + c, TWICE)])
        elif c in READINGS:
            letters = READINGS[c]
            out.append([(x, AS_LETTER - math.log(len(letters))) for x in letters] + ([(c, AS_GAP)] if i in inside or spaced else []))
            j = i + 1
        else:
            out.append([(c, 0.0)])
            j = i + 1
        i = j
    return out, signs, at


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0


def _unchained(text: tuple | None) -> str:
    parts = []
    while text is not None:
        text, part = text
        parts.append(part)
    return "".join(reversed(parts))


def decode(span: str, model: np.ndarray) -> str:
    """The most probable reading of a lower-cased span (Viterbi over two symbols).

    Signs before the word and after it may be left as they are: then nothing follows or
    precedes them but more of these. The phase of a state is 0 before the word, 1 in it,
    2 after it. A repeated sign that is no digit is left for the price of one. Readings are
    chains that share their beginnings, so time and memory grow with the span.
    """
    best: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
    first, last = _core(span)

    def better(reached, state, value, text):
        if state not in reached or value > reached[state][0]:
            reached[state] = (value, text)

    for options, c, start in zip(*_options(span), strict=True):
        reached: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
        again = start > 0 and span[start - 1] == c and not c.isdigit()
        for (phase, a, b), (value, text) in best.items():
            if c in READINGS and (phase == 0 and start < first or phase and start > last):
                if first == len(span) and phase == 0:
                    better(reached, (0, 0, 0), value + NO_WORD, (text, c))
                elif first < len(span) and not (phase == 1 and start > last + 1 and (again or c not in CLOSING)):
                    better(reached, (phase and 2, 0, 0), value + (0.0 if again else AS_IS), (text, c))
            for letters, cost in options if phase < 2 and not (first == len(span) and phase == 0 and text) else ():
                x, y, v = a, b, value + cost
                for letter in letters:
                    z = _symbol(letter)
                    if z or y:
                        v += model[x, y, z]
                        x, y = y, z
                if y == 0:
                    x = 0  # the next word starts afresh
                better(reached, (1, x, y), v, (text, letters) if letters else text)
        best = reached
    ends = [(v + (model[a, b, 0] if b and phase < 2 else 0.0), t) for (phase, a, b), (v, t) in best.items()]
    highest = max(v for v, _ in ends)
    return max(_unchained(t) for v, t in ends if v == highest)


class Restorer:
    """Restores texts; readings of spans met before are kept, up to a bounded number."""

    KEPT = 100_000

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def span(self, match: re.Match) -> str:
        span = match[0]
        found = self.known.get(span)
        if found is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            found = self.known[span] = decode(span, self.model)
        return found

    def text(self, text: str) -> str:
        return SUSPECT.sub(self.span, text)

    def column(self, column) -> pa.Array:
        """Lower-cased texts with their suspect spans decoded, whole texts."""
        column = column.fill_null("") if column.null_count else column
        changed: dict[int, str] = {}
        for low, data, offsets in K.buffers(column):
            data = K.LOWER[data]
            if not len(data):
                continue
            letter, sign = _ASCII[data], _SIGN[data]
            mark = np.zeros(len(data), bool)
            mark[:-1] |= sign[:-1] & letter[1:] | letter[:-1] & sign[1:]
            digit = (data >= 48) & (data <= 57)
            mark[:-1] |= sign[:-1] & sign[1:] & (digit[:-1] != digit[1:])
            mark[:-2] |= letter[:-2] & (data[:-2] == data[1:-1]) & (data[:-2] == data[2:])
            gap = (data == 32) | (data == 46) | (data == 45) | (data == 95)
            one = letter | sign
            mark[:-4] |= one[:-4] & gap[1:-3] & one[2:-2] & gap[3:-1] & one[4:]
            # A single letter with several separators after it.
            wide = one[:-2] & gap[1:-1] & gap[2:]
            wide[1:] &= ~_WORD[data[:-3]]
            mark[:-2] |= wide
            texts = np.unique(np.searchsorted(offsets, np.flatnonzero(mark), "right") - 1)
            for i in texts.tolist():
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                changed[low + i] = self.text(raw.decode())
        if not changed:
            return column
        texts = column.to_pylist()
        for i, text in changed.items():
            texts[i] = text
        return pa.array(texts, pa.string())


def _markers(column):
    """Text number and hash of the words and word beginnings of restored texts."""
    for low, data, offsets in K.buffers(column):
        data = K.LOWER[data]
        starts, ends, first = K.spans(data, offsets, K.LETTER)
        texts = low + K.owners(first)
        yield texts, K.hash_words(data, starts, ends, 99)
        for size in STEMS:
            long = np.flatnonzero(ends - starts >= size)
            yield texts[long], K.hash_words(data, starts[long], starts[long] + size, size)


def _marker_counts(model):
    def run(batches):
        restorer = Restorer(model.value)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
            for texts, h in _markers(restorer.column(batch.column("text"))):
                order = np.lexsort((texts, h))
                texts, h = texts[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (texts[1:] != texts[:-1])
                texts, h = texts[new], h[new]
                names, which = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(np.bincount(which, minlength=len(names)).astype(np.int64)),
                     pa.array(np.bincount(which, toxic[texts], len(names)).astype(np.int64))], names=["marker", "n", "n_toxic"])

    return run


@dataclass
class ToxicModel:
    characters: np.ndarray
    #: Sorted hashes of the markers, the weight of each, and that of a text without any.
    markers: np.ndarray
    weights: np.ndarray
    bias: float


def _found(column, markers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and marker numbers of the distinct markers in each restored text."""
    pairs = [np.zeros((2, 0), np.int64)]
    if len(markers):
        quick = np.zeros(1 << 16, bool)
        quick[(markers >> np.uint64(48)).astype(np.int64)] = True
        for texts, h in _markers(column):
            some = np.flatnonzero(quick[(h >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(markers, h[some]), len(markers) - 1)
            hit = markers[place] == h[some]
            pairs.append(np.unique(np.stack([texts[some[hit]], place[hit]]), axis=1))
    texts, place = np.concatenate(pairs, axis=1)
    return texts, place


def _score(column, model: ToxicModel) -> np.ndarray:
    texts, place = _found(column, model.markers)
    logit = np.full(len(column), model.bias)
    np.add.at(logit, texts, model.weights[place])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _marked_texts(model):
    """The markers of each text of the sample, by number."""

    def run(batches):
        restorer = Restorer(model.value.characters)
        for batch in batches:
            texts, place = _found(restorer.column(batch.column("text")), model.value.markers)
            order = np.argsort(texts, kind="stable")
            parts = np.split(place[order], np.cumsum(np.bincount(texts, minlength=batch.num_rows))[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))], names=["toxic", "found"])

    return run


def _fit_task(size: int):
    """Logistic regression on marker presence. Words that copies of one text share have
    the same texts and share one weight between them, so none of them is a marker alone."""

    def run(batches):
        toxic, found = [], []
        for batch in batches:
            toxic += batch.column("toxic").to_pylist()
            found += batch.column("found").to_pylist()
        y = np.array(toxic, float) == 1
        rows = np.repeat(np.arange(len(y)), [len(f) for f in found])
        cols = np.array([c for f in found for c in f], np.int64)
        params, mean, spread = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
        params[-1] = -2.0
        for step in range(1, STEPS + 1):
            logit = params[-1] + np.bincount(rows, params[cols], minlength=len(y))
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
            g = np.append(np.bincount(cols, slope[rows], minlength=size), slope.sum())
            g[:-1] += DECAY * params[:-1]
            mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
            params -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-10)
        yield pa.RecordBatch.from_arrays([pa.array([params.tolist()], pa.list_(pa.float64()))], names=["params"])

    return run


def _score_task(model):
    def run(batches):
        restorer = Restorer(model.value.characters)
        for batch in batches:
            restored = restorer.column(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_score(restored, model.value)), restored.cast(pa.string())],
                names=["doc_id", "score", "restored"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """Character counts over all documents; markers from at most ``sample`` labelled rows.

    A marker must be in toxic texts so much more often than chance that none of all
    candidates is expected to be there by accident. Rows of fold 2 are left out.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    characters = character_model(docs)
    rated = labelled_sample(labels.filter("toxic is not null"), sample, "toxic")
    rated = rated.select(F.col("doc_id").alias("_rated"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(docs["doc_id"].cast("long").alias("_doc"), docs["text"].cast("string").alias("text"))
    chosen = texts.join(F.broadcast(rated), F.col("_doc") == F.col("_rated")).select("text", "toxic")
    chosen = chosen.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).cache()
    known, toxic = chosen.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    base = min(max(toxic / known, 1e-6), 1 - 1e-6) if known else 0.5
    bias = math.log(base / (1 - base))
    model = ToxicModel(characters, np.zeros(0, np.uint64), np.zeros(0), bias)
    if not toxic:
        chosen.unpersist()
        return model
    counts = (
        chosen.mapInArrow(_marker_counts(context.broadcast(characters)), "marker long, n long, n_toxic long")
        .groupBy("marker")
        .agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
        .filter("n > 1")
    )
    counts = cut_lineage(counts, "marker-counts")
    gain = F.col("n_toxic") * F.log(F.col("n_toxic") / (F.col("n") * base))
    likely = counts.filter((F.col("n_toxic") > 0) & (F.col("n_toxic") / (F.col("n") + 1) >= LEAST_SHARE))
    found = likely.filter(gain >= math.log(max(counts.count(), 1)) + 1).select("marker").toArrow()
    model.markers = np.sort(found["marker"].to_numpy().view(np.uint64))
    if len(model.markers):
        marked = chosen.mapInArrow(_marked_texts(context.broadcast(model)), "toxic int, found array<long>")
        marked = marked.repartition(1).sortWithinPartitions("toxic", "found")
        fitted = marked.mapInArrow(_fit_task(len(model.markers)), "params array<double>").first().params
        model = ToxicModel(characters, model.markers, np.array(fitted[:-1]), fitted[-1])
    chosen.unpersist()
    return model


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and the restored text of every row.

    A null or empty text gets the score of a text without markers. Without labels, or
    without a toxic one, all texts get the same score. Repeated rows get equal results;
    an empty table gives an empty result. Of ``docs`` only doc_id and text are read, and
    of the text only what it says: labels, lang and source never enter a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = rows.mapInArrow(_score_task(model), "doc_id long, score double, restored string")
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "restored"
    )
