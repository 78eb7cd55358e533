"""The n-gram join against all pairs, with frequent tokens from two documents on."""

import random
import uuid

import numpy as np
import pytest

from loanlens.llm import ngram_join as j


def brute(rows, size, percent):
    sets = []
    for k, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append((k, {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()))
    keys = [k for k, _ in sets if k is not None]
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((k, len(s), None if k is None else find(k)) for k, s in sets), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "Of", "and,", "é"]) + str(rng.randrange(400))
    rows, boiler = [], [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([3, 12, 40, 150, 400, 1060]))] for _ in range(12)]
    for k in range(n):
        base = list(rng.choice(bases)) if rng.random() < 0.8 else boiler + [word() for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(1 + len(base) // 12)):
            base[rng.randrange(len(base))] = word()
        text = rng.choice([" ", "\n", " \t"]).join(base)
        rows.append((k, text.upper().replace("É", "é") if rng.random() < 0.1 else text))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "one two"), (3, "a key twice with another text"), rows[7], (None, rows[7][1])]


@pytest.mark.parametrize("seed, size, percent, frequent", [(1, 3, 90, 8), (2, 5, 80, 2), (3, 2, 60, 1)])
def test_against_all_pairs(spark, seed, size, percent, frequent):
    rows = corpus(seed, 150)
    frame = spark.createDataFrame([r + (0, 0) for r in rows], "doc_id long, text string, n int, rep int").repartition(4)
    got = sorted((tuple(r) for r in j.join(frame, size=size, percent=percent, frequent=frequent).collect()), key=str)
    assert got == brute(rows, size, percent)


@pytest.mark.parametrize("name, value", [("ROUNDS", 0), ("BLOCK", 300)])
def test_any_parameters(spark, monkeypatch, name, value):
    monkeypatch.setattr(j, name, value)
    rows = corpus(6, 120)
    got = sorted((tuple(r) for r in j.join(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=80, frequent=3).collect()), key=str)
    assert got == brute(rows, 3, 80)


def test_empty(spark):
    assert j.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_sets_share_an_entry():
    """For any frequent tokens and sizes: sets at the threshold have an index entry in common."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        percent = int(rng.choice([60, 80, 90, 95]))
        n = int(rng.integers(2, 700))
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = base
        while True:
            drop, add = rng.integers(0, 2 + n // 8, 2)
            other = np.unique(np.concatenate([rng.permutation(base)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            common = len(np.intersect1d(base, other))
            if len(other) and 100 * common >= percent * (len(base) + len(other) - common):
                break
        share = rng.choice([0.0, 0.05, 0.3, 0.7, 1.0])
        frequent = lambda h: (j.mix(h + np.uint64(5)) % np.uint64(1000)) < share * 1000
        a, b = (np.concatenate(j.index_entries(h, frequent(h), percent)) for h in (base, other))
        assert np.array_equal(base, other) or len(np.intersect1d(a, b)), (percent, len(base), len(other), share)


def test_common_passage_makes_no_pairs(spark, monkeypatch):
    """Documents that share one passage and nothing else: no more candidates, however many they are."""
    seen = []
    monkeypatch.setattr(j, "possible", lambda pairs, sketches, percent, f=j.possible: (seen.append(pairs.count()), f(pairs, sketches, percent))[1])
    made = {}
    for n in (400, 1600):
        rng = random.Random(n)
        passage = [f"p{i}" for i in range(120)]
        rows = [(k, " ".join(passage + [f"w{k}_{i}" for i in range(rng.randrange(40, 80))])) for k in range(n)]
        seen.clear()
        got = j.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=3, percent=90).collect()
        assert all(r.component_id == r.doc_id for r in got) and len(got) == n
        made[n] = sum(seen)
    assert made[1600] <= 5 * max(made[400], 100)


def test_nothing_is_left_but_what_the_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loanlens.llm.shared.scratch", lambda spark: f"{tmp_path}/{uuid.uuid4().hex}")
    out = j.join(spark.createDataFrame(corpus(3, 60), "doc_id long, text string"), size=3, percent=90)
    assert len(list(tmp_path.iterdir())) <= 2 + 1 + j.ROUNDS  # the list of rows, the last stars; one star table a round
    assert out.count() == 69


def test_a_pair_comes_from_the_first_entry_it_shares(spark, monkeypatch):
    """Documents of different groups that share many entries: the last round's join makes each pair once, and misses none."""
    folds = dict.fromkeys(j.FOLDS, 0)
    rng = random.Random(4)
    held = {d: {0, *rng.sample(range(1, 90), 40)} if d < 30 else set(rng.sample(range(1, 90), 3)) for d in range(60)}
    rows = spark.createDataFrame([(e - 45, d, d // 3 if d < 12 else d) for d, es in held.items() for e in es] * 2, "entry long, doc long, part long")
    own = rows.select("doc").distinct().select("doc", j.F.lit(100).alias("n"), *[j.F.lit(v).cast("long").alias(c) for c, v in folds.items()])
    want = {(a, b) for a in held for b in held if a < b and held[a] & held[b] and not (b < 12 and a // 3 == b // 3)}
    for seen in (j.SEEN, 2):  # with a short list of entries some pairs come twice
        monkeypatch.setattr(j, "SEEN", seen)
        now = j.numbered(rows).join(own, "doc").cache()
        mains = now.groupBy("entry", "part").agg(j.F.count("*").alias("c")).groupBy("entry").agg(j.F.max_by("part", j.F.struct("c", "part")).alias("main"))
        got = [tuple(sorted((r.doc, r.y))) for r in j.across(now, mains, 90).collect()]
        assert set(got) == want and (seen == 2 or len(got) == len(want))
        now.unpersist()
