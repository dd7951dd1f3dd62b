import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import scoring
from wattline.llm.catalog import QUERIES
from wattline.llm.language import id_remainder

from .conftest import SMALL


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def base_scores(rows, learns):
    c = Counter(t for i, text in rows if learns(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return n, [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for _, t in rows]


def test_token_keys():
    texts = ["The the  THE\tx", None, "", " a\x0bb\x1cc É é ", "x" * 3000 + " y", "q"]
    keys, sizes = scoring.token_keys(texts)
    want = [tokens(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, keys.tolist(), strict=True))) == len(set(flat)) == len(set(keys.tolist()))


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([(k, "the cat sat on the mat and the dog ran " * (k % 5 + 1)) for k in range(40)], "doc_id long, text string")
    counts = scoring.stash(scoring.count_tokens(rows), "counts")
    return scoring.fit(rows, scoring.vocabulary(counts))


def test_probabilities_sum_to_one(model):
    """Over all frequent words, and over each class of the others as a whole."""
    v = model.vocab
    states = np.random.default_rng(0).normal(size=(3, scoring.HIDDEN)).astype(np.float32)
    symbols = np.concatenate([np.arange(len(v.class_of)), np.arange(scoring.FREQUENT, scoring.FREQUENT + scoring.ENDINGS)]).astype(np.int32)
    empty = [k for k in range(scoring.WORD_CLASSES) if not len(v.members[k])]
    for s in states:
        p = 10 ** model.log10_output(np.repeat(s[None], len(symbols), axis=0), symbols)
        logit = s @ model.p["wc"] + model.p["bc"]
        spare = (np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum())[empty].sum()
        assert abs(p.sum() + spare - 1) < 1e-4


def test_state_is_carried_through_a_document_and_begins_anew(model):
    texts = ["the cat sat on the mat and the dog ran " * 60, "the dog", "", "cat cat cat", "the cat sat"] * 3
    keys, sizes = scoring.token_keys(texts)
    symbols = model.vocab.look_up(keys)[0]
    together = np.add.reduceat(model.log10_tokens(symbols, sizes), np.cumsum(sizes) - sizes)
    for text, value in zip(texts, together, strict=True):
        k, n = scoring.token_keys([text])
        alone, h, last = 0.0, np.zeros((1, scoring.HIDDEN), np.float32), model.vocab.end_symbol
        for y in model.vocab.look_up(k)[0]:
            h = model.step(np.array([last]), h)[0]
            alone += model.log10_output(h, np.array([y]))[0]
            last = y
        assert abs(alone - value) < 1e-3 * max(1, abs(alone))


def test_gradients_by_differences(model):
    """Gradients of the output layer against small changes of the loss."""
    m = model.copy()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(1)
    states, symbols = rng.normal(size=(20, scoring.HIDDEN)), rng.choice([*range(len(m.vocab.class_of)), scoring.FREQUENT + 3], 20).astype(np.int32)
    loss = lambda: -m.log10_output(states, symbols).mean() * math.log(10)
    grads, d = m._output_gradient(states, symbols)
    for name, at in (("wc", (2, 1)), ("bc", (0,)), ("ww", (1, 3)), ("bw", (2,))):
        old = m.p[name][at]
        m.p[name][at] = old + 1e-5
        up = loss()
        m.p[name][at] = old - 1e-5
        down = loss()
        m.p[name][at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5


def test_recurrent_gradients_by_differences(model, monkeypatch):
    """Gradients of the gates (input, recurrent and bias) through all steps of a window, documents ending inside it."""
    m = model.copy()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(4)
    symbols = rng.choice([*range(6), scoring.FREQUENT + 2], scoring.WINDOW).astype(np.int32)
    symbols[5] = m.vocab.end_symbol

    def loss():
        total, h, last = 0.0, np.zeros((1, scoring.HIDDEN)), m.vocab.end_symbol
        for y in symbols:
            h = m.step(np.array([last]), h if last != m.vocab.end_symbol else h * 0)[0]
            total -= m.log10_output(h, np.array([y]))[0] * math.log(10)
            last = y
        return total / len(symbols)

    found = {}
    monkeypatch.setattr(scoring.Model, "_update", lambda self, name, grad, memory, rate, rows=None: found.update({name: (grad, rows)}))
    m.train(symbols, {}, 0.1)
    grad_x, rows = found["x"]
    own = int(symbols[0])
    places = [("u", (k, j), found["u"][0][k, j]) for k, j in ((0, 1), (3, 20), (7, 40))]
    places += [("b", (j,), found["b"][0][j]) for j in (2, 19, 35)] + [("x", (own, j), grad_x[np.flatnonzero(rows == own)[0], j]) for j in (0, 18, 33)]
    for name, at, grad in places:
        old = m.p[name][at]
        m.p[name][at] = old + 1e-4
        up = loss()
        m.p[name][at] = old - 1e-4
        down = loss()
        m.p[name][at] = old
        assert abs((up - down) / 2e-4 - grad) < 1e-6 + 1e-3 * abs(grad), (name, at)


def test_every_token_is_a_target(model, monkeypatch):
    """One pass takes each token of the stream into the loss once."""
    symbols = np.random.default_rng(2).integers(0, len(model.vocab.class_of), 5000).astype(np.int32)
    met, gradient = [], scoring.Model._output_gradient
    monkeypatch.setattr(scoring.Model, "_output_gradient", lambda self, states, y: met.append(y) or gradient(self, states, y))
    model.copy().train(symbols, memory={}, rate=0.001)
    assert np.bincount(np.concatenate(met)).tolist() == np.bincount(symbols).tolist()


def test_large_logits_keep_gradients_and_scores_finite(model):
    """Rows beyond the range that needs no shift give the same as a softmax in float64."""
    rng = np.random.default_rng(3)
    s, w, bias = rng.normal(size=(40, 16)).astype(np.float32), rng.normal(size=(9, 16)).astype(np.float32), rng.normal(size=9).astype(np.float32)
    at = rng.integers(0, 9, 40)
    for large in (1, 40):
        logit = (s * large).astype(np.float64) @ w.T + bias
        share = np.exp(logit - logit.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        q = share - np.eye(9)[at]
        got = scoring._gradient_at(s * np.float32(large), w, bias, at, np.float32(0.5))
        for a, b in zip(got, (q @ w / 2, q.T @ s * large / 2, q.sum(axis=0) / 2), strict=True):
            assert np.allclose(a, b, rtol=1e-3, atol=1e-4 * large)
        logs = scoring._log_softmax_at((s * np.float32(large)) @ w.T, bias, at)
        assert np.allclose(logs, np.log(np.maximum(share[np.arange(40), at], 1e-300)), rtol=1e-4, atol=1e-4)


def test_symbols_of_a_class_are_neighbours(model):
    for members in model.vocab.members:
        assert np.array_equal(members, np.arange(members[0], members[0] + len(members)) if len(members) else members)


def test_class_softmax_in_pieces(model, monkeypatch):
    """The pieces in which the class softmax is computed change neither scores nor gradients."""
    rng = np.random.default_rng(4)
    states, symbols = rng.normal(size=(50, scoring.HIDDEN)).astype(np.float32), rng.integers(0, len(model.vocab.class_of), 50).astype(np.int32)
    whole = model.log10_output(states, symbols), *model._output_gradient(states, symbols)
    monkeypatch.setattr(scoring, "OUTPUT_ROWS", 7)
    pieces = model.log10_output(states, symbols), *model._output_gradient(states, symbols)
    assert np.allclose(whole[0], pieces[0], atol=1e-5) and np.allclose(whole[2], pieces[2], atol=1e-6)
    assert all(np.allclose(whole[1][k], pieces[1][k], atol=1e-5) for k in whole[1])


def test_odd_rows(odd_docs, odd_rows, no_docs):
    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    got = scoring.score(odd_docs.withColumn("score", F.lit("clash")).withColumn("key", F.lit(1)), id_remainder("doc_id", 10) != 0).collect()
    n, want = base_scores([(r[0], r[1]) for r in odd_rows], learns)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == sorted((t, k, round(b, 4)) for t, k, b in want)
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert scoring.score(no_docs, F.lit(True)).count() == 0
    blank = scoring.score(odd_docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in blank} == {(0, 0, 0.0, 0.0)}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    learns = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    got = {r.doc_id: r for r in QUERIES["op1_gated_lm"](spark, SMALL).collect()}
    n, want = base_scores(rows, learns)
    for (i, _), (t, k, b) in zip(rows, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns(i), t, k, n) and abs(r.base_score - b) < 1e-6 * abs(b)
    assert len(got) == len(rows) and sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)

