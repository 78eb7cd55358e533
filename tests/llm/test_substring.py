"""Substring dedup against a plain scan over all runs."""

import hashlib
import random
import re

from loanlens.llm import substring_dedup as s


def brute(rows, length):
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first = {}
    for k, w in words:
        if k is not None:
            for i in range(len(w) - length + 1):
                run = tuple(w[i:i + length])
                first[run] = min(first.get(run, k), k)
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if k is not None and first[tuple(w[i:i + length])] < k:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: rng.choice("a b c dé ef, x. the of".split()) + str(rng.randrange(300))
    passages = [[word() for _ in range(rng.randrange(length - 3, 4 * length))] for _ in range(6)]
    rows = []
    for k in range(80):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) // 2))
            parts += rng.choice([p, p[a:], p[:a], [word() for _ in range(30)]])
        rows.append((k, rng.choice([" ", "\n", "  \t"]).join(parts)))
    return rows + [(5, "other text with a repeated key"), rows[9], rows[9], (None, rows[9][1]), (200, None), (201, ""), (202, " \n ")]


def test_against_scan(spark):
    for length, seed in ((50, 1), (24, 2), (7, 3)):
        rows = corpus(seed, length)
        frame = spark.createDataFrame([r + (1, "x") for r in rows], "doc_id long, text string, n_words int, places string").repartition(5)
        want = brute(rows, length)
        got = [tuple(r) for r in s.substring_dedup(frame, length=length).collect()]
        assert sorted(got, key=str) == want


def test_hot_windows(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, f"{passage} own {k} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for k in range(1200)]
    got = {r.doc_id: r.n_removed for r in s.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()}
    assert got[0] == 0 and all(got[k] == 61 for k in range(1, 1200))


def test_nothing_repeats(spark):
    rows = [(1, "a b c"), (2, "d e f")]
    assert {r.n_removed for r in s.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    assert s.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels():
    assert s.levels(50) == [25, 50] and s.levels(7) == [7] and s.levels(96) == [12, 24, 48, 96]
