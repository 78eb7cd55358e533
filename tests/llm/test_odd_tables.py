"""Extra columns with clashing names, hot keys, and intermediates, for operators and stages alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loanlens.llm import bpe, embedding_dedup, fingerprints, line_dedup, mixing, ngram_join, quality, shared, substring_dedup, target_resampling, topk_search, url_filter, whitening

#: Names that results, joins or intermediates use somewhere.
NAMES = """_name _nth _piece _taken _row _key _src _size _h _task _before _upto before row c0 c1 size start words epoch from rank slot target taken
    _line_dedup_host _line_dedup_lines _line_dedup_kept host lines of kept key text_ doc n a b rep token entry component component_id node h
    weight score draw n_grams bucket places touched lose fingerprint id to need print next edited c chunk first upto task n_words n_features
    v i s vec page url_ verdict rule path_ value index label_ toxic quality_ flagged predicted held_out""".split()
EXTRA = {n: f"{n}!" for n in NAMES}


def with_extra(df):
    return df.select("*", *[F.lit(v).alias(n) for n, v in EXTRA.items()])


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    words = [" ".join(f"w{k}" for k in rng.integers(0, 400, 30)) + "\nshared line" for _ in range(30)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(words + words[:5])] + [(None, None, None, None, None), (None, "", None, "a", 0)]
    return with_extra(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)).persist()


@pytest.mark.parametrize("keeps", [mixing.mixed, line_dedup.line_dedup])
def test_operators_that_keep_columns(docs, keeps):
    out = keeps(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.select(*NAMES).distinct().collect()
    assert [r.asDict() for r in got] == [EXTRA]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    assert [r.asDict() for r in out.select(*NAMES).distinct().collect()] in ([EXTRA], [])


@pytest.mark.parametrize("run", [
    lambda d: bpe.bpe(d), lambda d: fingerprints.edited(d), lambda d: ngram_join.join(d), lambda d: substring_dedup.substring_dedup(d),
    lambda d: target_resampling.resample(d, d), lambda d: quality.sample(d, quality.Model(np.zeros(64)))])
def test_operators_on_texts(docs, run):
    names = run(docs).columns
    plain = docs.drop(*NAMES)
    value = lambda df: sorted(map(str, (tuple(r) for r in df.select(*names).collect())))
    assert value(run(docs)) == value(run(plain))


def test_operators_on_other_tables(spark):
    urls = with_extra(spark.createDataFrame([(1, "http://a.net/es/1"), (None, None)], "page_id long, url string"))
    assert url_filter.url_filter(urls).count() == 2
    vectors = with_extra(spark.createDataFrame([(k, [float(k), 1.0, 2.0 * k], 1) for k in range(40)] + [(None, None, None)], "vec_id long, embedding array<float>, label int"))
    assert whitening.whiten(vectors).count() == 120
    assert embedding_dedup.near_vectors(vectors).count() == 41
    assert topk_search.top_k(vectors).count() == 2 * 20


def test_many_rows_without_a_key_mix_in_linear_time(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("five words and no key").alias("text"), F.lit("s").alias("source"), F.col("id").cast("string").alias("own"))
    out = mixing.mixed(rows.repartition(6))
    got = out.groupBy("own").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert {r["count"]: r.n for r in got} == {1: 15_000, 2: 15_000}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.scratch(Session())
