"""Quality weights and the toxicity network against plain Python: counts, weights, forward pass, gradients."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loanlens.llm import quality, toxicity


def pieces_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    one = re.findall(r"[a-z0-9\u0080-\U0010ffff]+|[^a-z0-9\u0080-\U0010ffff\x20\x09-\x0D]+", lower)
    return one, list(zip(one, one[1:]))


def bucket(gram, buckets):
    """Bucket of one n-gram, from a text that holds nothing else."""
    found, _ = quality.ngrams(pa.array([" ".join(gram) if isinstance(gram, tuple) else gram]), buckets)
    return int(found[-1])


@pytest.mark.parametrize("buckets", [64, 100_000])
def test_quality_weights(spark, buckets):
    rng = random.Random(2)
    vocabulary = ["the", "The", "of,", "end.", "$$", "x9", "été", "a-b", "数据", "!"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25)))) for i in range(60)] + [(60, None), (61, ""), (3, "a second row of three"), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels, buckets=buckets)
    raw, target = [1.0] * buckets, [1.0] * buckets
    for k, t in rows:
        for gram in sum(pieces_of(t), []):
            raw[bucket(gram, buckets)] += 1
            target[bucket(gram, buckets)] += k is not None and k < 40 and k % 3 != 0
    want = [math.log(t / sum(target)) - math.log(r / sum(raw)) for t, r in zip(target, raw)]
    assert np.allclose(model.ratio, want, rtol=1e-12, atol=1e-12)
    for r in quality.sample(docs, model).collect():
        sums = [sum(want[bucket(g, buckets)] for g in sum(pieces_of(t), [])) if pieces_of(t)[0] else None for k, t in rows if k == r.doc_id]
        assert any(w is None and r.weight is None or w is not None and r.weight is not None and abs(w - r.weight) < 1e-9 for w in sums)


def corpus():
    rng = np.random.default_rng(4)
    features = rng.integers(0, 40, (50, 3))
    texts = [rng.integers(0, 50, n) for n in [1, 2, 3, 7, 20, 5, 9, 14, 30, 4, 0, 6]]
    return texts, features, np.array([1, 0, 1, 0, 1, 0, 0, 1, 1, 0, 0, 1])


def forward(net, table, filters, offset, out, bias, words, features):
    """One text's logit in plain loops: embeddings, each filter at each place, the largest response, a logistic layer."""
    rows = net.rows(features)
    size = table.shape[1]
    embedded = [[sum(table[r][s] for r in rows[w]) for s in range(size)] for w in words] or [[0.0] * size]
    total, at = float(bias), 0
    for w, b in zip(filters, offset):
        for f in range(w.shape[2]):
            seen = [sum(embedded[p + o][s] * w[o][s][f] for o in range(len(w)) if p + o < len(embedded) for s in range(size)) for p in range(len(embedded))]
            total += max(0.0, max(seen) + b[f]) * out[at + f]
        at += w.shape[2]
    return total


def parameters(net):
    return [net.table.astype(float), [w.astype(float) for w in net.filters], [b.astype(float) for b in net.offset], net.out.astype(float), float(net.bias)]


def test_forward_pass():
    texts, features, labels = corpus()
    net = toxicity.train(texts, features, labels, epochs=3)
    want = [forward(net, *parameters(net), t, features) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.logits(np.concatenate(texts), first, net.responses(features))
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_gradient():
    """The first step of training (all texts in one batch) follows the numeric gradient of the weighted loss."""
    texts, features, labels = corpus()
    before, after = (toxicity.train(texts, features, labels, epochs=n, batch=len(texts), rate=1e-4) for n in (0, 1))
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    start = parameters(before)

    def loss(table, filters, offset, out, bias):
        z = np.array([forward(before, table, filters, offset, out, bias, t, features) for t in texts])
        return float((weight * (np.logaddexp(0, z) - labels * z)).sum()) + 0.5e-4 * float((out ** 2).sum())

    def implied(old, new):
        """Adagrad moves by rate * g / sqrt(1e-3 + g * g)."""
        d = (old - new) / 1e-4
        return d * np.sqrt(1e-3 / np.maximum(1 - d * d, 1e-12))

    def numeric(change):
        h = 1e-5
        return (loss(*change(h)) - loss(*change(-h))) / (2 * h)

    def moved(what, index, k=None):
        def change(h):
            now = [start[0].copy(), [w.copy() for w in start[1]], [b.copy() for b in start[2]], start[3].copy(), start[4]]
            if what == 4:
                now[4] += h
            else:
                (now[what] if k is None else now[what][k])[index] += h
            return now
        return change

    assert implied(start[4], float(after.bias)) == pytest.approx(numeric(moved(4, None)), rel=1e-3, abs=1e-5)
    rng = np.random.default_rng(1)
    for f in rng.choice(len(start[3]), 6, replace=False):
        assert implied(start[3][f], after.out[f]) == pytest.approx(numeric(moved(3, f)), rel=2e-3, abs=2e-5)
    for k, w in enumerate(start[1]):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in w.shape)
            # float32 holds a step of 1e-4 to about three digits
            assert implied(w[at], float(after.filters[k][at])) == pytest.approx(numeric(moved(1, at, k)), rel=0.05, abs=2e-3)
