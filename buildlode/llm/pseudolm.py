"""Language-model scores by masked pseudo-likelihood.

Each token of a text is masked in turn and predicted by a small network from the words on
both sides. The logarithms of these probabilities are summed for the text. The network is
trained in numpy inside Spark tasks: each task starts from the same parameters, learns on
every position of its own texts, and the results are averaged, twice. So a score also hangs,
slightly, on how the rows are dealt to tasks.

The tokens are the most frequent words of all documents; the others fall into classes by
their hash, so that every word is a token. The network predicts a token in two steps, its
group and then the token among those of the group: the product is an exact distribution over
all tokens at the price of two short layers. A word of a class then adds the logarithm of its
share in the class, by the counts of all words of all documents, which stay a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import KEY, cut_lineage, keyed, spread

WORDS, CLASSES = 4096, 64
TOKENS = WORDS + CLASSES
#: Tokens of a group, in order of frequency; the classes are the last group.
GROUP = 64
GROUPS = TOKENS // GROUP
#: Words seen on each side, width of an embedding and of the hidden layer.
SIDE, WIDTH, HIDDEN = 2, 16, 32
ROUNDS, RATE, BATCH = 2, 0.1, 4096
#: Squares of slopes that Adagrad starts from.
START = 1e-6
#: Positions scored at a time.
BLOCK = 8192
#: Rows multiplied at a time: a small product needs no copies of its factors.
ROWS = 256
#: Parameters changed at a time, so that they stay in a core's cache.
SLICE = 1 << 15
#: Bytes of encoded texts, two a word, that are taken at a time.
ENCODED = 1 << 17
#: Words whose shares are sent to all tasks; rarer ones are joined to the table of counts.
LISTED = 1 << 16
#: Count of all the words of a class together that the corpus does not hold.
UNSEEN = 0.5
OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]
SHAPES = (
    (TOKENS + 1, WIDTH), (len(OFFSETS) * WIDTH, HIDDEN), (HIDDEN,),
    (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN + 1, GROUP),
)


def _split(params: np.ndarray) -> list[np.ndarray]:
    sizes = [int(np.prod(s)) for s in SHAPES]
    return [p.reshape(s) for p, s in zip(np.split(params, np.cumsum(sizes)[:-1]), SHAPES, strict=True)]


def _start(counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Small random weights; the biases of the last layers are the frequencies of the tokens."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.3, SHAPES[0])
    w1 = rng.normal(0, 1 / np.sqrt(SHAPES[1][0]), SHAPES[1])
    each = np.reshape(counts, (GROUPS, GROUP)) + 0.5
    group = each.sum(1)
    biases = np.log(group / group.sum()), np.log(each / group[:, None])
    w3 = np.zeros(SHAPES[5])
    w3[:, HIDDEN] = biases[1]
    parts = (embedding, w1, np.zeros(SHAPES[2]), np.zeros(SHAPES[3]), biases[0], w3)
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


@dataclass
class PseudoModel:
    #: Hashes of the frequent words, sorted, and their tokens: ranks by frequency.
    words: np.ndarray
    ranks: np.ndarray
    params: np.ndarray
    #: How often each token occurs in the corpus.
    counts: np.ndarray | None = None

    def __post_init__(self):
        # Where the words with the same first 16 bits begin.
        self.begin = np.searchsorted(self.words, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int32)
        self.most = int(np.diff(self.begin, append=len(self.words)).max())

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        out = WORDS + (hashes >> np.uint64(58)).astype(np.uint16)
        place = self.begin[hashes >> np.uint64(48)]
        for _ in range(self.most):
            at = np.minimum(place, len(self.words) - 1)
            out = np.where(self.words[at] == hashes, self.ranks[at], out)
            place += 1
        return out


def _hashes(column):
    """First row, first word of each text and word hashes of the buffers."""
    for low, data, offsets in K.buffers(column):
        data = K.LOWER[data]
        starts, ends, first = K.spans(data, offsets, K.NOT_SPACE)
        yield low, first, K.hash_words(data, starts, ends)


def _streams(model: PseudoModel, batch: pa.RecordBatch):
    """First row, first word of each text and tokens of the buffers of texts or of encoded rows."""
    if "tokens" not in batch.schema.names:
        for low, first, h in _hashes(batch.column("text")):
            yield low, first, model.tokens(h)
        return
    for low, data, offsets in K.buffers(batch.column("tokens"), ENCODED):
        yield low, offsets // 2, data.view(np.uint16)


def _stream(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with SIDE times TOKENS before, between and after texts, and where they lie.

    The neighbours of a token are those beside it; TOKENS is what lies beyond a text's ends.
    """
    at = np.arange(len(tokens)) + SIDE * (K.owners(first) + 1)
    out = np.full(len(tokens) + SIDE * len(first), TOKENS, np.uint16)
    out[at] = tokens
    return out, at


def _times(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``a @ b``, ROWS rows of ``a`` at a time."""
    if len(a) <= ROWS:
        return np.matmul(a, b, out=out)
    n = len(a) - len(a) % ROWS
    np.matmul(a[:n].reshape(-1, ROWS, a.shape[1]), b, out=out[:n].reshape(-1, ROWS, out.shape[1]))
    if n < len(a):
        np.matmul(a[n:], b, out=out[n:])
    return out


def _cross(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """``a.T @ b``, ROWS rows of both at a time."""
    if len(a) <= ROWS:
        np.matmul(a.T, b, out=out)
        return
    n = len(a) - len(a) % ROWS
    blocks = a[:n].reshape(-1, ROWS, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(-1, ROWS, b.shape[1])
    np.add.reduce(blocks, axis=0, out=out)
    if n < len(a):
        out += a[n:].T @ b[n:]


def _biased(params: np.ndarray) -> np.ndarray:
    """The weights of the groups with their biases as the last row, which lies behind them."""
    start = sum(int(np.prod(s)) for s in SHAPES[:3])
    return params[start : start + (HIDDEN + 1) * GROUPS].reshape(HIDDEN + 1, GROUPS)


def _hidden(parts: list[np.ndarray], stream: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and hidden layer, with a last column of ones, of the tokens SIDE + ``order``."""
    embedding, w1, b1 = parts[:3]
    near = np.empty((len(order), len(OFFSETS)), np.intp)
    for j, d in enumerate(OFFSETS):
        near[:, j] = stream[SIDE + d :].take(order)
    x = embedding.take(near.ravel(), 0).reshape(len(order), len(OFFSETS) * WIDTH)
    inner = _times(x, w1, np.empty((len(order), HIDDEN), np.float32))
    inner += b1
    hidden = np.ones((len(order), HIDDEN + 1), np.float32)
    hidden[:, :HIDDEN] = np.tanh(inner, out=inner)
    return x, hidden


def _logits(biased: np.ndarray, w3: np.ndarray, hidden: np.ndarray, own: list[tuple[int, slice]]) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all groups and of the tokens of a position's own group."""
    outer = _times(hidden, biased, np.empty((len(hidden), GROUPS), np.float32))
    inner = np.empty((len(hidden), GROUP), np.float32)
    for g, part in own:
        _times(hidden[part], w3[g], inner[part])
    return outer, inner


def _exp(logits: np.ndarray) -> np.ndarray:
    """Exponentials in place and their sums by row. Logits stay within 60 of zero."""
    if logits.size and not (logits.max() <= 60 and logits.min() >= -60):
        np.clip(logits, -60, 60, out=logits)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], np.float32)


def _groups(group: np.ndarray) -> list[tuple[int, slice]]:
    """The groups that occur and their rows; ``group`` is sorted."""
    ends = np.searchsorted(group, np.arange(GROUPS + 1))
    return [(g, slice(ends[g], ends[g + 1])) for g in range(GROUPS) if ends[g] < ends[g + 1]]


def _word_counts(batches):
    for batch in batches:
        for _, _, h in _hashes(batch.column("text")):
            words, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, its hash, and ``n`` for every word of every document; a written table."""
    found = keyed(docs).select("text").mapInArrow(_word_counts, "word long, n long")
    return cut_lineage(found.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def count_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the WORDS most frequent words, their ranks and the counts of all tokens.

    A fixed number of rows reaches the driver.
    """
    top = counts.orderBy(F.col("n").desc(), "word").limit(WORDS)
    rows = sorted(((r.word, r.n) for r in top.collect()), key=lambda r: (-r[1], r[0]))
    words = np.array([w & 0xFFFFFFFFFFFFFFFF for w, _ in rows], np.uint64)
    number = F.shiftrightunsigned("word", 58).cast("int").alias("number")
    rest = counts.join(F.broadcast(top.select("word")), "word", "left_anti").groupBy(number).agg(F.sum("n").alias("n"))
    tokens = np.zeros(TOKENS)
    tokens[: len(rows)] = [n for _, n in rows]
    for r in rest.collect():
        tokens[WORDS + r.number] = r.n
    order = np.argsort(words)
    return words[order], order.astype(np.uint16), tokens


class Learner:
    """Minibatch steps with rates by Adagrad."""

    def __init__(self, params: np.ndarray):
        self.params, self.squares, self.seen = params.copy(), np.full(len(params), START, np.float32), 0
        self.parts, self.biased = _split(self.params), _biased(self.params)

    def gradient(self, stream: np.ndarray) -> tuple[int, np.ndarray]:
        """Tokens of the stream but for SIDE at both ends, and the mean slope of their loss."""
        grad = np.zeros_like(self.params)
        return self._slopes(stream, grad)[0], grad

    def _slopes(self, stream: np.ndarray, grad: np.ndarray) -> tuple[int, np.ndarray]:
        """Tokens learned from, and those whose embeddings have a slope; ``grad`` comes as zeros."""
        _, w1, _, w2, _, w3 = self.parts
        g_embedding, g_w1, g_b1, _, _, g_w3 = _split(grad)
        target = stream[SIDE:-SIDE]
        order = np.argsort(target, kind="stable")
        order = order[: np.searchsorted(target[order], np.uint16(TOKENS))]
        n, rows, target = len(order), np.arange(len(order)), target[order]
        if not n:
            return 0, np.zeros(0, np.uint16)
        x, hidden = _hidden(self.parts, stream, order)
        group, own = target // GROUP, _groups(target // GROUP)
        outer, error = _logits(self.biased, w3, hidden, own)
        for probability, column in ((outer, group), (error, target % GROUP)):
            probability *= (1 / (n * _exp(probability)))[:, None]
            probability[rows, column] -= 1 / n
        inner, more = _times(outer, w2.T.copy(), np.empty((n, HIDDEN), np.float32)), np.empty((n, HIDDEN), np.float32)
        for g, part in own:
            _times(error[part], w3[g, :HIDDEN].T, more[part])
            _cross(hidden[part], error[part], g_w3[g])
        _cross(hidden, outer, _biased(grad))
        inner += more
        hidden = hidden[:, :HIDDEN].copy()
        hidden *= hidden
        inner *= np.subtract(1, hidden, out=hidden)
        _cross(x, inner, g_w1)
        g_b1[:] = np.ones(n, np.float32) @ inner
        # The slope of an embedding is gathered per place of the stream, then per token.
        size = len(stream) - 2 * SIDE
        back = np.zeros((size, HIDDEN), np.float32)
        back[order] = inner
        slope, one = np.zeros((len(stream), WIDTH), np.float32), np.empty((size, WIDTH), np.float32)
        for j, d in enumerate(OFFSETS):
            slope[SIDE + d : SIDE + d + size] += _times(back, w1[j * WIDTH : (j + 1) * WIDTH].T.copy(), one)
        order = np.argsort(stream, kind="stable")
        names = stream[order]
        begin = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        names = names[begin]
        g_embedding[names] = np.add.reduceat(slope.take(order, 0), begin, axis=0)
        return n, names

    def step(self, stream: np.ndarray) -> None:
        grad = np.zeros_like(self.params)
        n, names = self._slopes(stream, grad)
        self.seen += n
        # Nothing changes where the slope is zero, so only the embeddings met are visited.
        size = int(np.prod(SHAPES[0]))
        params, squares, slopes = (a[:size].reshape(SHAPES[0]) for a in (self.params, self.squares, grad))
        met = params[names], squares[names]
        _descend(*met, slopes[names])
        params[names], squares[names] = met
        for a in range(size, len(grad), SLICE):
            _descend(*(v[a : a + SLICE] for v in (self.params, self.squares, grad)))


def _descend(params: np.ndarray, squares: np.ndarray, grad: np.ndarray) -> None:
    """A step of Adagrad in place; ``grad`` is overwritten."""
    square = grad * grad
    squares += square
    grad /= np.sqrt(squares, out=square)
    grad *= RATE
    params -= grad


def _learn(model):
    """A task's parameters after its own texts, and the number of positions learned from."""

    def run(batches):
        learner, held, size = Learner(model.value.params), [], 0
        for batch in batches:
            for _, first, tokens in _streams(model.value, batch):
                held.append(_stream(tokens, first)[0])
                size += len(held[-1])
                if size >= BATCH + 2 * SIDE:
                    stream, a = np.concatenate(held), 0
                    while a + BATCH + 2 * SIDE <= size:
                        learner.step(stream[a : a + BATCH + 2 * SIDE])
                        a += BATCH
                    held, size = [stream[a:]], size - a
        if size:
            learner.step(np.concatenate(held))
        if learner.seen:
            blocks = np.array_split(learner.params, 8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(8), pa.int32()), pa.array([learner.seen] * 8, pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())],
                names=["block", "seen", "params"])

    return run


def _average(batches):
    """Mean of the task's parameters, weighted by what each has seen."""
    sums: dict[int, tuple[np.ndarray, int]] = {}
    for batch in batches:
        for block, seen, params in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            total, n = sums.get(block, (0.0, 0))
            sums[block] = (total + np.frombuffer(params, np.float32).astype(float) * seen, n + seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([(t / n).tolist() for t, n in sums.values()], pa.list_(pa.float64()))],
        names=["block", "params"])


def start(counts: DataFrame) -> PseudoModel:
    """The tokens of a corpus by its ``word_counts``, with parameters that learned nothing yet."""
    words, ranks, tokens = count_words(counts)
    return PseudoModel(words, ranks, _start(tokens), tokens)


def train(docs: DataFrame, counts: DataFrame | None = None) -> PseudoModel:
    """Counts words and learns over all documents; texts stay in their tasks.

    ``counts`` are the ``word_counts`` of the documents, if they are there. The driver gets the frequent words and the averaged parameters, both of fixed size.
    """
    return learn(keyed(docs), start(word_counts(docs) if counts is None else counts))


def learn(rows: DataFrame, model: PseudoModel) -> PseudoModel:
    """The model after ROUNDS over all ``rows``, keyed texts or those that ``encode`` wrote."""
    context = rows.sparkSession.sparkContext
    texts = rows.select("tokens" if "tokens" in rows.columns else "text")
    for _ in range(ROUNDS):
        learned = texts.mapInArrow(_learn(context.broadcast(model)), "block int, seen long, params binary")
        # Written once, in an order that does not hang on which task came first.
        learned = cut_lineage(learned, "learned")
        merged = spread(learned, "block").sortWithinPartitions("block", "seen", "params")
        rows = merged.mapInArrow(_average, "block int, params array<double>").orderBy("block").collect()
        if rows:
            model = PseudoModel(model.words, model.ranks, np.concatenate([r.params for r in rows]).astype(np.float32), model.counts)
    return model


class Scorer:
    """Log-probabilities of all tokens of a buffer."""

    def __init__(self, model: PseudoModel):
        self.model, self.parts = model, _split(model.params)

    def __call__(self, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return self.of_tokens(first, self.model.tokens(hashes))

    def of_tokens(self, first: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        biased = _biased(self.model.params)
        stream, at = _stream(tokens, first)
        out = np.zeros(len(tokens), np.float32)
        for a in range(0, len(tokens), BLOCK):
            target, place = tokens[a : a + BLOCK], at[a : a + BLOCK]
            order = np.argsort(target, kind="stable")
            target = target[order]
            _, hidden = _hidden(self.parts, stream[place[0] - SIDE : place[-1] + SIDE + 1], place[order] - place[0])
            outer, inner = _logits(biased, self.parts[5], hidden, _groups(target // GROUP))
            out[a + order] = _logs(outer, target // GROUP) + _logs(inner, target % GROUP)
        return out


def _logs(logits: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax in one column of each row; the logits are overwritten."""
    rows, total = np.arange(len(column)), _exp(logits)
    return np.log(logits[rows, column] / total)


def _score_task(model):
    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for low, first, h in _hashes(batch.column("text")):
                rows = len(first) - 1
                n[low : low + rows] = np.diff(first)
                total[low : low + rows] = np.bincount(K.owners(first), scorer(first, h), rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(KEY[0]), pa.array(n), pa.array(total)], names=["doc_id", "n_tokens", "log_likelihood"])

    return run


def score(docs: DataFrame, model: PseudoModel) -> DataFrame:
    """doc_id, n_tokens, log_likelihood of the tokens and its mean for every row.

    The pseudo-log-likelihood is the sum over all tokens of the whole text; a word of a
    class counts as its class. A null or
    empty text has no tokens, sum 0 and no mean. Repeated rows get equal results; an
    empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = keyed(docs).mapInArrow(_score_task(shared), "doc_id long, n_tokens long, log_likelihood double")
    return found.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.nullif(F.col("n_tokens"), F.lit(0)))


def _listed(counts: DataFrame, model: PseudoModel, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words of classes that occur often.

    The bound is the least power of two that at most ``most`` words reach.
    """
    power = F.floor(F.log2("n")).cast("int").alias("power")
    sizes = {r.power: r["count"] for r in counts.groupBy(power).count().collect()}
    sizes[max(sizes, default=0) + 1] = 0
    least = min(p for p in sizes if sum(n for q, n in sizes.items() if q >= p) <= most)
    rows = counts.filter(F.col("n") >= 1 << least).toArrow()
    words, n = rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    rare = model.tokens(words) >= WORDS
    return words[rare], n[rare]


def _encode(model, listed):
    """Tokens of whole texts, the logarithms of the shares of their listed words, and the words
    of classes left to be joined with how often each occurs."""

    def run(batches):
        words, logs = listed.value
        for batch in batches:
            n, shares, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), [np.zeros(0, np.uint16)]
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for low, first, h in _hashes(batch.column("text")):
                rows, text = len(first) - 1, K.owners(first)
                n[low : low + rows] = np.diff(first)
                tokens.append(model.value.tokens(h))
                other = np.flatnonzero(tokens[-1] >= WORDS)
                if len(words):
                    place = np.minimum(np.searchsorted(words, h[other]), len(words) - 1)
                    known = words[place] == h[other]
                    shares[low : low + rows] = np.bincount(text[other[known]], logs[place[known]], rows)
                    other = other[~known]
                other = other[np.lexsort((h[other], text[other]))]
                t, w = text[other], h[other]
                begin = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (w[1:] != w[:-1])]))[: len(t)]
                found.append((low + t[begin], w[begin], np.diff(begin, append=len(t))))
            owner, word, times = (np.concatenate(x) for x in zip(*found, strict=True))
            each = pa.StructArray.from_arrays([pa.array(word.view(np.int64)), pa.array(times)], names=["word", "times"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)
            ends = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
            encoded = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(tokens))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(KEY[0]), pa.array(n), pa.array(shares), rest, encoded],
                names=["doc_id", "n_tokens", "shares", "rest", "tokens"])

    return run


def encode(docs: DataFrame, model: PseudoModel, counts: DataFrame, most: int = LISTED) -> DataFrame:
    """Every row as tokens and shares of words in their classes; a written table.

    Words are hashed here only: rounds of learning and the scores read two bytes a word. At
    most ``most`` words are sent to all tasks; the others of a class lie in ``rest``.
    """
    words, n = _listed(counts, model, most)
    logs = np.log(n / (model.counts[model.tokens(words)] + UNSEEN))
    context = docs.sparkSession.sparkContext
    task = _encode(context.broadcast(model), context.broadcast((words, logs)))
    schema = "doc_id long, n_tokens long, shares double, rest array<struct<word: long, times: long>>, tokens binary"
    found = keyed(docs).mapInArrow(task, schema).withColumn("row", F.monotonically_increasing_id())
    return cut_lineage(found, "encoded")


def _encoded_task(model):
    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for low, first, tokens in _streams(model.value, batch):
                rows = len(first) - 1
                total[low : low + rows] = np.bincount(K.owners(first), scorer.of_tokens(first, tokens), rows)
            names = ["row", "doc_id", "n_tokens", "shares"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(total)], names=[*names, "sum"])

    return run


def score_words(docs: DataFrame, model: PseudoModel, counts: DataFrame, most: int = LISTED) -> DataFrame:
    """As ``score``, but log_likelihood is that of the words, not of their classes.

    A word of a class adds log(n / (N + UNSEEN)), where n of the N words of its class in
    the corpus are this word; one that the corpus does not hold has UNSEEN for n.
    ``counts`` are the ``word_counts`` that the model was trained with. At most ``most`` words
    are sent to all tasks; how many does not change a result.
    """
    return score_encoded(encode(docs, model, counts, most), model, counts)


def score_encoded(encoded: DataFrame, model: PseudoModel, counts: DataFrame) -> DataFrame:
    """``score_words`` of the rows that ``encode`` wrote with the words of this model."""
    task = _encoded_task(encoded.sparkSession.sparkContext.broadcast(model))
    schema = "row long, doc_id long, n_tokens long, shares double, sum double"
    found = encoded.select("row", "doc_id", "n_tokens", "shares", "tokens").mapInArrow(task, schema)
    rest = encoded.select("row", F.explode("rest").alias("rest")).select("row", "rest.word", "rest.times")
    classes = F.array(*(F.lit(float(c) + UNSEEN) for c in model.counts[WORDS:]))
    size = classes.getItem(F.shiftrightunsigned("word", 58).cast("int"))
    log = F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)) / size)
    sums = rest.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * log).alias("more"))
    total = F.col("sum") + F.col("shares") + F.coalesce("more", F.lit(0.0))
    out = found.join(sums, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.nullif(F.col("n_tokens"), F.lit(0)))
