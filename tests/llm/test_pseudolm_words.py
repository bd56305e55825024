"""Which positions op6 learns from, and what its scores say of words."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from buildlode.llm import pseudolm

TEXTS = ["a b c", "one", "", "x y z w v u t s r q p o n"] + [f"word{i} and word{i + 1} or" for i in range(900)]


def test_every_position_is_learned_from():
    model = pseudolm.PseudoModel(np.zeros(0, np.uint64), np.zeros(0, np.uint16), pseudolm._start(np.zeros(pseudolm.TOKENS)))
    batch = pa.RecordBatch.from_pydict({"text": TEXTS, "_text_hash": list(range(len(TEXTS)))})
    out = next(pseudolm._learn(SimpleNamespace(value=model))([batch]))
    assert set(out.column("seen").to_pylist()) == {sum(len(t.split()) for t in TEXTS)}


def test_words_are_scored_and_not_their_classes(spark):
    rng = np.random.default_rng(4)
    frequent = [f"f{i}" for i in range(pseudolm.WORDS)]
    rare = [f"r{i}" for i in range(400)]
    texts = [" ".join(frequent * 30)] + [" ".join(rng.choice(rare, 25)) for _ in range(80)]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = pseudolm.word_counts(corpus)
    model = pseudolm.train(corpus, counts)

    def hashed(text):
        (_, _, h), = pseudolm._hashes(pa.array([text]))
        return h

    # Invented words, each of the same class as the real word in its place.
    spare = {}
    for i in range(20_000):
        spare.setdefault(int(hashed(f"zz{i}")[0] >> np.uint64(58)), []).append(f"zz{i}")
    real = texts[5]
    false = " ".join(spare[int(h >> np.uint64(58))].pop() for h in hashed(real))
    rows = [(1, real), (2, false), (3, None), (4, texts[0]), (1, real)]
    asked = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.log_likelihood for r in pseudolm.score(asked, model).collect()}
    assert abs(plain[1] - plain[2]) < 1e-4

    n = {np.uint64(r.word & (2**64 - 1)): r.n for r in counts.collect()}
    sizes = {}
    for w, k in n.items():
        if w not in model.words:
            sizes[w >> np.uint64(58)] = sizes.get(w >> np.uint64(58), 0) + k
    want = {3: 0.0, 4: plain[4]}
    for i, text in ((1, real), (2, false)):
        want[i] = plain[i] + sum(np.log(n.get(w, 0.5) / (sizes[w >> np.uint64(58)] + 0.5)) for w in hashed(text) if w not in model.words)
    for most in (pseudolm.LISTED, 30, 0):
        got = pseudolm.score_words(asked, model, counts, most).collect()
        assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4]
        for r in got:
            assert abs(r.log_likelihood - want[r.doc_id]) < 1e-3
            assert r.mean_log_likelihood is None if r.doc_id == 3 else r.mean_log_likelihood < 0
    assert want[2] < want[1] - 20


def plain_logs(params, tokens):
    """Log-probability of each token of one text, by the whole distribution in doubles."""
    embedding, w1, b1, w2, b2, w3 = pseudolm._split(params)
    out = []
    for i, token in enumerate(tokens):
        near = [tokens[i + d] if 0 <= i + d < len(tokens) else pseudolm.TOKENS for d in pseudolm.OFFSETS]
        hidden = np.tanh(np.concatenate(embedding[near]) @ w1 + b1)
        groups = np.exp(hidden @ w2 + b2)
        inside = np.exp(np.append(hidden, 1) @ w3)
        p = ((groups / groups.sum())[:, None] * inside / inside.sum(1, keepdims=True)).ravel()
        assert abs(p.sum() - 1) < 1e-9
        out.append(np.log(p[token]))
    return np.array(out)


def random_model(rng):
    words = np.unique(rng.integers(0, 1 << 63, pseudolm.WORDS, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    params = pseudolm._start(rng.integers(0, 50, pseudolm.TOKENS)) + rng.normal(0, 0.2, sum(int(np.prod(s)) for s in pseudolm.SHAPES))
    return pseudolm.PseudoModel(words, rng.permutation(len(words)).astype(np.uint16), params.astype(np.float32))


def test_scores_equal_a_plain_softmax():
    rng = np.random.default_rng(8)
    model = random_model(rng)
    lengths = [1, 0, 2, 3, 40, 0]
    hashes = np.where(rng.random(46) < 0.6, rng.choice(model.words, 46), rng.integers(0, 1 << 63, 46).astype(np.uint64))
    first = np.concatenate([[0], np.cumsum(lengths)])
    tokens = [int(model.ranks[list(model.words).index(h)]) if h in model.words else pseudolm.WORDS + int(h >> np.uint64(58)) for h in hashes]
    assert model.tokens(hashes).tolist() == tokens
    want = np.concatenate([plain_logs(model.params.astype(float), tokens[a:b]) for a, b in zip(first, first[1:])])
    assert np.allclose(pseudolm.Scorer(model)(first, hashes), want, atol=1e-4)


def test_gradient_equals_the_slope_of_the_loss():
    rng = np.random.default_rng(9)
    params = random_model(rng).params
    texts = [rng.integers(0, pseudolm.TOKENS, n).tolist() for n in (12, 1, 5)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    stream, _ = pseudolm._stream(np.concatenate(texts), first)
    n, grad = pseudolm.Learner(params).gradient(stream)
    assert n == 18

    def loss(p):
        return -sum(plain_logs(p, t).sum() for t in texts) / n

    start, double, eps = 0, params.astype(float), 1e-5
    for shape in pseudolm.SHAPES:  # each part of the parameters by itself
        size = int(np.prod(shape))
        step = np.zeros(len(double))
        step[start : start + size] = rng.normal(size=size)
        slope = (loss(double + eps * step) - loss(double - eps * step)) / (2 * eps)
        assert abs(slope - grad @ step) < 1e-3 * max(1, abs(slope))
        start += size


def test_shuffled_words_lose_what_both_sides_told():
    rng = np.random.default_rng(3)
    pairs = [(f"l{i}", f"m{i}", f"r{i}") for i in range(12)]
    texts = [" ".join(" ".join(pairs[k]) for k in rng.integers(0, 12, 60)) for _ in range(400)]
    (_, first, h), = pseudolm._hashes(pa.array(texts))
    words, n = np.unique(h, return_counts=True)
    counts = np.zeros(pseudolm.TOKENS)
    counts[: len(words)] = n
    model = pseudolm.PseudoModel(words, np.arange(len(words), dtype=np.uint16), pseudolm._start(counts), counts)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    out = next(pseudolm._learn(SimpleNamespace(value=model))([batch]))
    learned = np.concatenate([np.frombuffer(b, np.float32) for b in out.column("params").to_pylist()])
    model = pseudolm.PseudoModel(words, model.ranks, learned, counts)
    order = texts[0].split()
    shuffled = rng.permutation(order).tolist()
    (_, first, h), = pseudolm._hashes(pa.array([" ".join(order), " ".join(shuffled)]))
    logs = pseudolm.Scorer(model)(first, h)
    assert logs[: len(order)].sum() > logs[len(order) :].sum() + 100


def test_texts_are_hashed_once_for_all_rounds_and_scores(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(9000)], n)) for n in (300, 0, 4, 60, 1)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    counts = pseudolm.word_counts(docs)
    model = pseudolm.start(counts)
    encoded = pseudolm.encode(docs, model, counts, 20)
    assert "text" not in encoded.columns
    # Learning and scoring from the encoded rows is learning and scoring from the texts.
    learned = pseudolm.learn(encoded.coalesce(1), model)
    assert np.allclose(learned.params, pseudolm.train(docs, counts).params, atol=1e-4)
    assert not np.allclose(learned.params, model.params, atol=1e-2)
    want = {r.doc_id: r for r in pseudolm.score_words(docs, learned, counts).collect()}
    got = pseudolm.score_encoded(encoded, learned, counts).collect()
    assert sorted(r.doc_id for r in got) == list(range(6))
    for r in got:
        assert r.n_tokens == want[r.doc_id].n_tokens == len((texts[r.doc_id] or "").split())
        assert abs(r.log_likelihood - want[r.doc_id].log_likelihood) < 1e-3
