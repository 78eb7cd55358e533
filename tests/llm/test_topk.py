"""Top-k search against a plain nested loop, over several block sizes."""

import math

from pyspark.sql import functions as F

from loanlens.llm import topk_search


def brute(rows, k, every, scale=64.0):
    kept = {}
    for key, v in rows:
        if key is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[key] = min(kept.get(key, v), v)
    w = {key: [math.floor(scale * x) for x in v] for key, v in kept.items()}
    out = []
    for q in w:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(w[q], w[c])), c) for c in w if c != q)[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores)]
    return sorted(out)


def test_against_nested_loop(spark):
    rows = [(i, [math.sin(i * j) if (i + j) % 3 else 0.0 for j in range(1, 6)]) for i in range(60)]
    rows += [(i, [0.25] * 5) for i in range(100, 130)]  # ties
    rows += [(7, [9.0] * 5), (7, [9.0] * 5), (None, [1.0] * 5), (200, None), (201, [None, 1.0]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (220, [0.0] * 5), (240, [1.0, 2.0])]
    frame = spark.createDataFrame([r + (1, 2) for r in rows], "vec_id long, embedding array<double>, score int, terms int")
    want = brute(rows, 7, 20)
    for block in ((8192, 512), (10, 2), (1, 1)):
        got = topk_search.top_k(frame, 7, 20, rows=block[0], queries=block[1])
        assert sorted(map(tuple, got.collect())) == want
    assert topk_search.top_k(frame.where(F.lit(False)), 7, 20).count() == 0


def test_large_weights(spark):
    rows = [(0, [1e10, 3.0]), (1, [1e10, 2.0]), (2, [-1e9, 1.0]), (3, [5e7, 1.0]), (4, [2.0, 1.0])]
    got = {r.vec_id: r.score for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5).collect()}
    assert got[4] == 64 * 10**10 * 128 + 192 * 64 and got[3] == 64 * 10**10 * 64 * 5 * 10**7 + 192 * 64 if 64 * 10**10 * 64 * 5 * 10**7 < 2**63 else got[3] == 2**63 - 1
    assert got[1] == 2**63 - 1


