"""The models against plain loops: trees, convolutions, and marginals by enumeration."""

import itertools
import math

import numpy as np
import pytest

pytest.importorskip("blockloom.llm")
from blockloom.llm import htmltext, learning, quality, toxicity  # noqa: E402


def test_trees_against_a_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 5))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    inner = model.feature.shape[1]
    for row, got in zip(x, model.margin(x)):
        want = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            at = 0
            while at < inner:
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            want += v[at - inner]
        assert abs(got - want) < 1e-9
    assert ((model.score(x) > 0.5) == (x[:, 0] + x[:, 1] * x[:, 2] > 0)).mean() > 0.9


def test_convolution_against_loops():
    r = np.random.default_rng(2)
    seen = [(r.integers(0, toxicity.BUCKETS, (2, n)).astype(np.int32), -1) for n in (0, 1, 2, 3, 7, 40)]
    net = toxicity.fit([(r.integers(0, 500, (2, 6)).astype(np.int32), 0) for _ in range(40)], (np.arange(40) % 4 == 0).astype(float), np.arange(40) % 5 == 0)
    for ids, _ in seen:
        words = [net.table[a].astype(np.float32) + net.table[b].astype(np.float32) for a, b in ids.T]
        pad = max(toxicity.WIDTHS) - 1 + (not words)
        words += [np.zeros(toxicity.DIM, dtype=np.float32)] * pad
        want = net.base
        k = 0
        for w, f, b in zip(toxicity.WIDTHS, net.filters, net.bias):
            for j in range(toxicity.FILTERS):
                most = max(sum(float(words[at + i] @ f[i][:, j]) for i in range(w)) for at in range(len(words) - w + 1))
                want += max(0.0, most + float(b[j])) * float(net.out[k])
                k += 1
        assert abs(net.margin(ids) - want) < 1e-3


def test_marginals_against_enumeration():
    r = np.random.default_rng(3)
    model = htmltext.TreeModel(r.normal(0, 0.7, htmltext.N_FEATURES), np.exp(r.normal(0, 0.8, (4, 2, 2))))
    for source in ("<div><p>a b</p><nav><a href=x>c</a></nav></div>", "<article><h1>t</h1><p>u<b>v</b></article><footer>w</footer>", "<ul><li>a<li>b</ul>plain"):
        page = htmltext.Page(source)
        n = len(page.tag)
        unary = [max(-12.0, min(12.0, sum(model.weights[k] * v for k, v in f))) for f in htmltext.features(page)]
        total, on = 0.0, [0.0] * n
        for state in itertools.product((0, 1), repeat=n):
            weight = math.exp(sum(u for u, s in zip(unary, state) if s))
            for e in range(1, n):
                weight *= model.pair[htmltext.KINDS.get(page.tag[e], 0), state[page.parent[e]], state[e]]
            total += weight
            for e in range(n):
                on[e] += weight * state[e]
        assert all(abs(got - w / total) < 1e-9 for got, w in zip(model.marginals(page), on))


def test_text_without_elements_is_kept():
    model = htmltext.trained()
    assert model.text("plain  words &amp; more") == "plain words & more" and model.text("") == "" and model is htmltext.trained()


def test_rows_that_repeat_an_id_give_the_same_sample(spark):
    rows = [(1, "a b"), (1, "c d"), (1, None), (6, "e")]
    labels = spark.createDataFrame([(i, 1) for i in (1, 6)], "doc_id long, quality int")
    got = [{r.id: bytes(r.text) for r in learning.sample_texts(spark.createDataFrame(rows[::d], "doc_id long, text string").repartition(n), labels, "quality", 10).collect()} for d, n in ((1, 1), (-1, 3))]
    assert got[0] == got[1]
