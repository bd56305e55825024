"""Language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability. The probability
of a word is the sum over all ways to cut it into pieces, which a forward algorithm adds
up; a text's is the product over its words. Piece probabilities are learned by
expectation-maximisation on texts of known language. Distinct words of a buffer are
scored once, all at the same time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fold, held_out, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Longest piece in bytes, with the mark of a word's start.
PIECE = 12
#: A word of more bytes is scored in parts of so many.
PART = 40
#: Bound of the rows the model is fitted on, chosen by a hash of the doc_id.
SAMPLE = 6_000
ROUNDS = 4
UNKNOWN = "und"


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Lower-cased letter pieces of the vocabulary, a word's start as a space, and all bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode().lower()
        if len(piece) <= PIECE and all(K.LETTER[b] for b in piece[1:]) and (K.LETTER[piece[0]] or piece[0] == 32):
            found.add(piece)
    return sorted(found)


@dataclass
class Pieces:
    """The vocabulary, looked up by the hash of a piece's bytes."""

    hashes: np.ndarray
    order: np.ndarray
    longest: int = PIECE

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        hashes = K.hash_words(data, ends - [len(p) for p in pieces], ends)
        order = np.argsort(hashes)
        return cls(hashes[order], order, max(map(len, pieces)))

    def arcs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Arcs of all words' lattices: word, from, to (offsets in the word) and piece."""
        up, down = K.powers(K.BASES[0], len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(K._BYTE[data] * up[:-1], out=sums[1:])
        word = np.repeat(np.arange(len(starts)), ends - starts)
        at = np.flatnonzero(_inside(starts, ends, len(data)))
        room = ends[word] - at
        out = ([], [], [], [])
        for length in range(1, self.longest + 1):
            fit = np.flatnonzero(room >= length)
            begin = at[fit]
            h = K.mix((sums[begin + length] - sums[begin]) * down[begin] + np.uint64(length))
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[place] == h)
            own = word[fit[hit]]
            begin = (begin[hit] - starts[own]).astype(np.int32)
            for list_, values in zip(out, (own, begin, begin + np.int32(length), self.order[place[hit]]), strict=True):
                list_.append(values)
        return tuple(np.concatenate(x) for x in out)


def _inside(starts, ends, n):
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


class Lattice:
    """Lattices of many words; sums over all their segmentations."""

    def __init__(self, pieces: Pieces, data, starts, ends):
        self.lengths = ends - starts
        word, begin, to, self.piece = pieces.arcs(data, starts, ends)
        order = np.argsort(to, kind="stable")
        self.word, self.begin, self.to, self.piece = word[order], begin[order], to[order], self.piece[order]
        self.width = int(self.lengths.max(initial=0)) + 1
        self.steps = np.searchsorted(self.to, np.arange(self.width + 1))

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """(position, word): summed probability of all paths to the position."""
        n = len(self.lengths)
        alpha = np.zeros((self.width, n))
        alpha[0] = 1
        flat = alpha.reshape(-1)
        source = self.begin.astype(np.int64) * n + self.word
        weight = probability[self.piece]
        for t in range(1, self.width):
            a, b = self.steps[t], self.steps[t + 1]
            alpha[t] = np.bincount(self.word[a:b], flat[source[a:b]] * weight[a:b], n)
        return alpha

    def totals(self, probability: np.ndarray) -> np.ndarray:
        return self.forward(probability)[self.lengths, np.arange(len(self.lengths))]

    def expected(self, probability: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all words, each as often as its count."""
        n = len(self.lengths)
        alpha = self.forward(probability)
        total = alpha[self.lengths, np.arange(n)]
        beta = np.zeros((self.width, n))
        beta[self.lengths, np.arange(n)] = 1
        flat_a, flat_b = alpha.reshape(-1), beta.reshape(-1)
        source = self.begin.astype(np.int64) * n + self.word
        target = self.to.astype(np.int64) * n + self.word
        weight = probability[self.piece]
        back = np.argsort(-self.begin, kind="stable")
        steps = np.searchsorted(-self.begin[back], -np.arange(self.width - 1, -1, -1), "left")
        steps = np.append(steps, len(back))
        for i in range(len(steps) - 1):
            arcs = back[steps[i] : steps[i + 1]]
            np.add.at(flat_b, source[arcs], weight[arcs] * flat_b[target[arcs]]) if len(arcs) else None
        use = flat_a[source] * weight * flat_b[target] * (counts / np.maximum(total, 1e-300))[self.word]
        return np.bincount(self.piece, use, len(probability))


@dataclass
class LanguageModel:
    langs: list[str]
    prior: np.ndarray
    #: (language, piece)
    probability: np.ndarray
    pieces: Pieces = field(repr=False)


def _words(data, offsets):
    """Words of a buffer, each with a space in front; long words in parts."""
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offsets, K.LETTER)
    texts = K.owners(first)
    parts = (ends - starts + PART - 1) // PART
    if (parts > 1).any():
        begin = np.cumsum(parts) - parts
        number = np.arange(parts.sum()) - np.repeat(begin, parts)
        starts, whole, texts = np.repeat(starts, parts) + number * PART, np.repeat(ends, parts), np.repeat(texts, parts)
        ends = np.minimum(starts + PART, whole)
    return data, starts, ends, texts


def _distinct(data, starts, ends):
    """Bytes, starts and ends of the distinct words, and the number of each word."""
    hashes = K.hash_words(data, starts, ends)
    _, where, number = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = (ends - starts)[where] + 1
    to = np.cumsum(lengths)
    out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    source = np.arange(len(out)) - np.repeat(to - lengths, lengths) + np.repeat(starts[where], lengths) - 1
    inside = np.ones(len(out), bool)
    inside[to - lengths] = False
    out[inside] = data[source[inside]]
    return out, to - lengths, to, number


def fit(column, langs: np.ndarray, pieces: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their share of the rows, and (language, piece) probabilities."""
    names = sorted(set(langs.tolist()))
    index, size = Pieces.of(pieces), len(pieces)
    own = np.searchsorted(names, langs) if names else np.zeros(0, np.int64)
    counts: dict[tuple[int, bytes], int] = {}
    for low, raw, offsets in K.buffers(column, 8 * K.CHUNK):
        data, starts, ends, texts = _words(raw, offsets)
        if not len(starts):
            continue
        flat, a, b, number = _distinct(data, starts, ends)
        both, n = np.unique(own[low + texts] * len(a) + number, return_counts=True)
        raw_words = flat.tobytes()
        for key, times in zip(both.tolist(), n.tolist(), strict=True):
            lang, word = divmod(key, len(a))
            key = (lang, raw_words[a[word] : b[word]])
            counts[key] = counts.get(key, 0) + times
    probability = np.full((len(names), size), 1 / size)
    for lang in range(len(names)):
        words = [(w, n) for (own_lang, w), n in counts.items() if own_lang == lang]
        if not words:
            continue
        words.sort()
        ends = np.cumsum([len(w) for w, _ in words])
        data = np.frombuffer(b"".join(w for w, _ in words), np.uint8)
        lattice = Lattice(index, data, ends - [len(w) for w, _ in words], ends)
        times = np.array([n for _, n in words], float)
        for _ in range(ROUNDS):
            use = lattice.expected(probability[lang], times) + 0.05
            probability[lang] = use / use.sum()
    share = np.bincount(own, minlength=len(names)) / max(1, len(own))
    return names, share, probability


def _fit_task(pieces):
    def run(batches):
        got = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("lang", pa.string())]))
        column = K.whole(got.column("text"))
        langs = np.array(got.column("lang").to_pylist(), dtype=object)
        names, share, probability = fit(column, langs, pieces.value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array([p.tobytes() for p in probability], pa.binary())],
            names=["lang", "share", "probability"])

    return run


def train(docs: DataFrame, sample: int = SAMPLE, vocabulary: str = VOCABULARY) -> LanguageModel:
    """Fit on at most ``sample`` rows that have a language and are not held out.

    The rows are the first by a hash of the doc_id; their texts go to the one task that
    fits, never to the driver. The model's size is languages times pieces.
    """
    small_batches(docs.sparkSession)
    pieces = read_pieces(vocabulary)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")
    ).filter("lang is not null and doc_id is not null")
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    known = rows.filter(fold("doc_id") != 2)
    last = known.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = known.filter(order <= last) if last is not None else known.limit(0)
    chosen = chosen.repartition(1).sortWithinPartitions("doc_id", "lang", F.xxhash64("text")).select("text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    fitted = chosen.mapInArrow(_fit_task(shared), "lang string, share double, probability binary").collect()
    return LanguageModel(
        [r.lang for r in fitted],
        np.array([r.share for r in fitted]),
        np.array([np.frombuffer(r.probability) for r in fitted]).reshape(len(fitted), len(pieces)),
        Pieces.of(pieces),
    )


def _has_letter(column, low: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with a letter of any script; only texts without A-Z are looked at one by one."""
    plain = np.concatenate([[0], np.cumsum(K.LETTER[data] & (data < 128))])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def predict(column, model: LanguageModel):
    """Number of the best language of each text, -1 without letters, and its posterior."""
    n, k = len(column), len(model.langs)
    best, posterior = np.full(n, -1), np.zeros(n)
    for low, raw, offsets in K.buffers(column, 8 * K.CHUNK):
        rows = len(offsets) - 1
        letters = _has_letter(column, low, raw, offsets)
        total = np.tile(np.log(np.maximum(model.prior, 1e-12)), (rows, 1))
        data, starts, ends, texts = _words(raw, offsets)
        if len(starts) and k:
            flat, a, b, number = _distinct(data, starts, ends)
            for low_word in range(0, len(a), 50_000):
                part = slice(low_word, low_word + 50_000)
                base, stop = a[part][0], b[part][-1]
                lattice = Lattice(model.pieces, flat[base:stop], a[part] - base, b[part] - base)
                logs = np.stack([np.log(np.maximum(lattice.totals(p), 1e-300)) for p in model.probability])
                own = np.flatnonzero((number >= low_word) & (number < low_word + 50_000))
                for lang in range(k):
                    total[:, lang] += np.bincount(texts[own], logs[lang, number[own] - low_word], rows)
        if k:
            shifted = np.exp(total - total.max(1, keepdims=True))
            best[low : low + rows] = np.where(letters, total.argmax(1), -1)
            posterior[low : low + rows] = np.where(letters, shifted.max(1) / shifted.sum(1), 0.0)
    return best, posterior


def _predict_task(model):
    def run(batches):
        langs = np.array([*model.value.langs, UNKNOWN], dtype=object)
        for batch in batches:
            best, score = predict(batch.column("text"), model.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs[best], pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"])

    return run


def language_report(docs: DataFrame, sample: int = SAMPLE, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the language) for every row.

    Learned from text and lang of rows whose crc32 fold is not 2. ``und`` with score 0
    where the text is null or has no letter, or nothing could be learned. Words are runs
    of letters; equal rows get equal results; an empty table gives an empty result.
    Columns other than doc_id, text and lang are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample, vocabulary))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = rows.mapInArrow(_predict_task(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
