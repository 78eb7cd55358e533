"""The corpus pipeline, stage by stage against plain Python on its own input; shared helpers."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loanlens.llm import bpe, line_dedup, shared
from tests.llm.test_filters_and_mix import targets
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of each stage, and the stage's function."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(100000, None, "en", "src0", 0), (100001, "", "en", None, 0), (None, "no key but words enough to stand", "en", "src1", 32)], docs.schema)
    docs = shared.materialize(docs.unionByName(odd).unionByName(docs.where("doc_id = 3")))
    out = []
    for _, stage in corpus_pipeline.STAGES:
        result = shared.materialize(stage(spark, docs, SF))
        out.append((docs, result))
        docs = result
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
    columns = stages[0][0].columns
    assert all(result.columns == columns for _, result in stages[:-1])


def test_quality_keeps_rows_unchanged_and_good_ones(spark, stages):
    before, after = map(rows, stages[0])
    assert set(after) <= set(before) and {3} <= {k for k, _, _ in after}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {k for k, _, _ in after}
    good = [k for k, q in labels.items() if q == 1]
    bad = [k for k, q in labels.items() if q == 0]
    assert np.mean([k in kept for k in good]) > 0.97 and np.mean([k in kept for k in bad]) < 0.3


def test_lines(stages):
    before, after = map(rows, stages[1])
    want = []
    for k, t, s in before:
        pages = [x for x in before if x[2] == s]
        drop = lambda line: line.strip(" ") and (n := sum(line in (p[1] or "").split("\n") for p in pages)) >= line_dedup.MIN_PAGES and n / len(pages) > line_dedup.RATIO  # noqa: E731, B023
        want.append((k, None if t is None else "\n".join(x for x in t.split("\n") if not drop(x)), s))
    assert sorted(after, key=str) == sorted(want, key=str)
    assert stages[1][1].where("n_chars <> length(text)").count() == 0


def test_near_duplicates(stages):
    before, after = map(rows, stages[2])
    assert sorted(after, key=str) == one_of_each_group(before)


def one_of_each_group(before):
    """Rows that stay: every row is a document, the one with the smallest doc_id stands for its group."""
    before = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
    group = {k: c for k, _, c in brute([(k, r[1]) for k, r in enumerate(before)], 5, 80)}
    return sorted((r for k, r in enumerate(before) if group[k] == k), key=str)


def test_rows_that_repeat_a_key_or_have_none(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c = words(80), words(80), words(80)
    table = [(1, a)] * 3 + [(None, a)] * 2 + [(2, b), (2, c), (None, c), (None, c + " more"), (None, words(60)), (None, None), (None, None), (3, ""), (0, b + " end")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in table], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = rows(corpus_pipeline.near_stage(spark, docs, SF))
    assert sorted(got, key=str) == one_of_each_group([(k, t, "s") for k, t in table])
    assert len(got) == 1 + 1 + 1 + 1 + 3  # of a, of b, of c, the other text, the three without words


def test_mix(stages):
    before, after = map(rows, stages[3])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, got = {}, {}
    for _, t, s in before:
        sizes[s] = sizes.get(s, 0) + size(t)
    for _, t, s in after:
        got[s] = got.get(s, 0) + size(t)
    want = targets(sizes)
    assert all(abs(got.get(s, 0) - want[s]) <= 0.01 * want[s] + 3 for s in want)
    texts = {}
    for k, t, s in before:
        texts.setdefault((k, s), []).append(t)
    cut = [(k, t, s) for k, t, s in after if t not in texts[k, s]]
    assert all(any(" ".join(re.findall(r"\S+", whole)).startswith(t) for whole in texts[k, s]) for k, t, s in cut)
    assert len(cut) <= 2 * len(sizes)


def test_tokens(stages):
    library = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {}
    for k, t, _ in rows(stages[4][0]):
        texts.setdefault(k, []).append(t)
    for r in stages[4][1].collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.n_tokens and r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()
        assert any(ids == library.encode(t, add_special_tokens=False).ids and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for t in texts[r.doc_id])


@pytest.mark.parametrize("in_a_task", [1 << 18, 20])
def test_components(spark, monkeypatch, in_a_task):
    monkeypatch.setattr(shared, "_EDGES", in_a_task)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(100, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect()}
    assert got == {k: find(k) for k in root}
    assert shared.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_bits(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = shared.Bits.build(df, "h")
    inside = np.array([r.h for r in df.collect()], np.int64).view(np.uint64)
    outside = np.array([r.h for r in spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("h")).collect()], np.int64).view(np.uint64)
    assert bits.test(inside).all() and bits.test(outside).mean() < 0.1
    assert not shared.Bits.build(df.limit(0), "h").test(inside).any()
