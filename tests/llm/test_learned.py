"""Quality, toxicity and embedding dedup: fixtures with known answers, odd rows, and held-out labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm import embedding_dedup, quality, toxicity

SF1 = "/root/testdata/sf0.1"


def good(rng):
    return " ".join(rng.choice("the of and a in that is was for it with as his on be at by".split()) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(20, 80)))


def bad(rng):
    return " ".join(rng.choice("BUY NOW CLICK free $$$ !!! win ### cash".split()) for _ in range(rng.randrange(20, 80)))


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, bad(rng) if i % 5 == 0 else good(rng)) for i in range(300)] + [(400, None), (401, ""), (402, " \n"), (1, rng.choice([good(rng)])), (None, good(rng))]
    docs = spark.createDataFrame([r + (0.5, "en", "s", 1) for r in rows], "doc_id long, text string, weight double, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 300, 3)] + [(None, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.sample(docs, model).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {k for k, t in rows if t and t.strip() and (k is None or k >= 300 or k % 5)}
    assert {(r.doc_id, r.text) for r in quality.resample(docs, labels).collect()} == {(k, t) for k, t in rows if k in kept and t and t.strip()}
    assert quality.resample(docs, labels).columns == docs.columns
    assert quality.sample(docs.limit(0), model).count() == 0
    assert quality.resample(docs, labels.limit(0)).count() >= 0


def test_gumbel_draws_in_proportion(spark):
    """Equal weights: which documents the top k are depends on the noise alone, evenly."""
    docs = spark.createDataFrame([(i, "same text") for i in range(4000)], "doc_id long, text string")
    drawn = quality.sample(docs, quality.Model(np.zeros(100)), k=1000, temperature=1.0).where("kept")
    ids = [r.doc_id for r in drawn.collect()]
    assert len(ids) == 1000 and abs(np.mean(ids) - 2000) < 150


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), 5.0, 1e300 * rng.random(), 1e-300]) for _ in range(1000)]
    assert quality.kth_largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k) == sorted(values, reverse=True)[k - 1]


def test_best_cut():
    assert quality.best_cut([(-3.0, 0), (-1.0, 0), (1.0, 1), (2.0, 1)]) == 0.0
    assert quality.best_cut([]) == 0.0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    held = labels.where(toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(docs, net).join(held, "doc_id").select("score", "toxic", "predicted").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert np.mean([(toxic.score > c).mean() for c in clean.score]) > 0.9
    assert toxic.predicted.mean() > 0.8 and clean.predicted.mean() < 0.02


def test_toxicity_rows(spark):
    rng = random.Random(2)
    rows = [(i, good(rng) + (" you idiot " if i % 3 == 0 else " ") + good(rng), ["en", None][i % 2]) for i in range(240)]
    odd = [(500, None, "en"), (501, "", None), (502, "!?", "xx"), (503, "idiot " * 30000, "en"), (0, rows[0][1], "en"), (None, rows[0][1], "en")]
    docs = spark.createDataFrame([r + (1.0,) for r in rows + odd], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    again = toxicity.fit(docs, labels)
    assert np.array_equal(net.table, again.table) and net.shift == again.shift
    got = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    assert toxicity.score(docs, net).count() == len(rows) + len(odd)
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(240))
    assert got[500].score == got[501].score == got[502].score and got[500].predicted == 0 and got[503].predicted == 1
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_samples_hold_one_row_of_a_repeated_key(spark, monkeypatch):
    """A labelled key in a third of all rows sends one row to the driver."""
    rng = random.Random(4)
    rows = [(i, bad(rng) if i % 3 == 0 else good(rng), "en") for i in range(60)] + [(0, bad(rng) + f" {i}", "en") for i in range(30)] + [(0, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "best_cut", lambda weighed: seen.append(len(weighed)) or 0.0)
    quality.fit(docs, labels)
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, *a: seen.append(len(texts)) or train(texts, *a))
    toxicity.fit(docs, labels)
    assert seen == [60, 48]


def links(rows, threshold=0.93):
    def fine(k, v, label):
        return k is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, root = [0] * len(rows), {k: k for k, _, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, u, x) in enumerate(rows):
        for j, (b, v, y) in enumerate(rows):
            if i != j and fine(a, u, x) and fine(b, v, y) and x == y and len(u) == len(v):
                p, q = (np.array(z, float) / np.abs(z).max() for z in (u, v))
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= threshold:
                    n[i] += 1
                    one, two = sorted((find(a), find(b)))
                    root[two] = one
    return sorted(((k, n[i], find(k), k is not None and find(k) == k) for i, (k, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("bucket, block", [(1024, 1024), (32, 16), (1024, 7)])
def test_near_vectors(spark, bucket, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.normal(size=16) * 0.08
        rows.append((i, [float(x) for x in v], int(i % 12 // 4)))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, [2 * x for x in rows[0][1]], 0), (203, rows[0][1], 1), (5, rows[5][1], rows[5][2])]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [None] + [1.0] * 15, 0), (304, [float("nan")] * 16, 0), (305, [float("inf")] * 16, 0), (306, rows[0][1], None), (None, rows[0][1], 0), (307, [1e200, 1e200], 0), (308, [1e-200, 1e-200], 0), (309, [1.0, 1.0], 0), (310, [1.0], 0), (311, [-1.0], 0)]
    frame = spark.createDataFrame([r + (0, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, code string").repartition(3)
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(frame, bucket=bucket, block=block, recall=0.9999).collect()), key=str)
    assert got == links(rows)
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_recall_of_each_label(spark):
    """Production recall, with sign bits in the large label: small labels beside it stay exhaustive."""
    rng = np.random.default_rng(3)

    def at_cosine(u, c):
        w = rng.normal(size=u.shape)
        w -= (w * u).sum(1, keepdims=True) * u
        return c * u + math.sqrt(1 - c * c) * w / np.linalg.norm(w, axis=1, keepdims=True)

    u = rng.normal(size=(2500, 16))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    both = np.concatenate([u, at_cosine(u, 0.9305)])
    rows = [(i, v.tolist(), 0 if i % 2500 < 1000 else i % 2500) for i, v in enumerate(both)]
    assert embedding_dedup.tables(2000, 0.93, embedding_dedup.RECALL, 32)[0] > 0
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), bucket=32).collect()}
    assert all(got[i].n_links == 1 and got[i].component_id == i % 2500 for i in got if i % 2500 >= 1000)
    large = both[[i for i in range(5000) if i % 2500 < 1000]]
    want = int((large @ large.T >= 0.93).sum()) - len(large)
    assert 0.98 * want <= sum(got[i].n_links for i in got if i % 2500 < 1000) <= want


def test_tables_follow_recall():
    assert embedding_dedup.tables(1000, 0.93, 0.99, 1024) == (0, 1)
    for n in (10**4, 10**6, 10**9):
        bits, tables = embedding_dedup.tables(n, 0.93, 0.99, 1024)
        assert n / 2**bits <= 1024 and 1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables >= 0.99
