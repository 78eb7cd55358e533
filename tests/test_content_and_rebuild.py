"""Sketched medians, content checksums, wide counts, unordered previews, footer profiles, bucketed roll-ups,
the saved scorecard, and tables rebuilt in place."""

import os
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens import LendingData, registry
from loanlens.operators import approx_median, exact_median, median, rank_within
from loanlens.plans import dashboard, gold, quality, reports, risk
from loanlens.sources import catalog, sinks
from loanlens.sources.schemas import CHECKSUM_KEYS
from tests.helpers import lending

from .conftest import SF001


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- approximate median ------------------------------------------------------------------------

def _groups():
    rng = np.random.default_rng(9)
    out = {"hot": rng.normal(0, 1e6, 60_000), "ties": rng.choice([1.0, 1.0, 1.0, 5.0, 9.0], 9_000), "one value": np.full(4_000, 3.5),
           "skewed": rng.exponential(1, 20_000) ** 6, "one": np.array([7.0]), "two": np.array([1.0, 2.0])}
    return {g: v.tolist() for g, v in out.items()}


@pytest.mark.parametrize("rank_error", [0.05, 0.001])
def test_sketched_median_stays_within_its_rank_error(spark, rank_error):
    groups = _groups()
    rows = [(g, x, "x") for g, xs in groups.items() for x in xs] + [("two", None, "x"), ("none", None, "x"), (None, 4.0, "x")]
    df = spark.createDataFrame(rows, "g string, v double, __v string").repartition(9)
    med = approx_median(df, ["g"], "v", rank_error, "m", {"n": "count", "lo": "min", "hi": "max", "mean": "avg", "s": "sum"})
    got = {r.g: r for r in med.collect()}
    assert set(got) == {*groups, None}
    for g, xs in groups.items():
        m, n = got[g].m, len(xs)
        below, upto = sum(x < m for x in xs), sum(x <= m for x in xs)
        assert m in xs and below <= n / 2 + rank_error * n + 1 and upto >= n / 2 - rank_error * n - 1, g
        assert (got[g].n, got[g].lo, got[g].hi) == (n, min(xs), max(xs)) and got[g].mean == pytest.approx(np.mean(xs))
    checked = {r.g: r.ok for r in rank_within(df, ["g"], "v", med, "m", rank_error, "ok").collect()}
    assert checked == {g: True for g in got}
    far = med.withColumn("m", F.col("hi"))
    assert not {r.g: r.ok for r in rank_within(df, ["g"], "v", far, "m", rank_error, "ok").collect()}["hot"]


def test_exact_median_stays_the_default(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 10.0)], "g string, v double")
    assert _rows(median(df, ["g"], "v")) == _rows(exact_median(df, ["g"], "v")) == [("a", 2.5)]
    assert _rows(median(df, ["g"], "v", approx=0.1))[0][1] in (2.0, 3.0)
    assert _rows(approx_median(df.limit(0), ["g"], "v", 0.1)) == []
    with pytest.raises(ValueError, match="rank_error"):
        approx_median(df, ["g"], "v", 0.0)
    ctx = LendingData.from_fixtures(spark, SF001)
    exact, near = (reports.salary_by_profession(ctx, 1, approx) for approx in (None, 0.0001))
    assert exact.columns == near.columns
    assert _rows(exact.drop("MEDIAN_SALARY")) == _rows(near.drop("MEDIAN_SALARY"))
    plan = _plan(reports.salary_by_profession(ctx, 1, 0.01))
    assert "partial_percentile_approx" in plan


def test_sketch_of_infinite_and_nan_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(g, x) for g, xs in {"a": [1.0, nan, 2.0], "b": [nan, nan, 1.0], "c": [-inf, -inf, 3.0]}.items() for x in xs], "g string, v double")
    assert _rows(approx_median(df, ["g"], "v", 0.01)) == [("a", 2.0), ("b", inf), ("c", -inf)]


# ---- content checksums -------------------------------------------------------------------------

ROWS = [(1, 10.5, "a", None), (2, 20.25, "b", 4), (3, 30.0, "ab", None), (2_000_000_000_000, -1.0, "", 7)]


def _sums(spark, rows):
    df = spark.createDataFrame(rows, "k long, x double, t string, n int").repartition(3)
    return {r.COLUMN_NAME: r.CHECKSUM for r in catalog.column_profile({"t": df}, keys={"t": "k"}).collect()}


def test_checksums_do_not_depend_on_order(spark):
    assert _sums(spark, ROWS) == _sums(spark, ROWS[::-1])
    assert set(_sums(spark, []).values()) == {"0"}


@pytest.mark.parametrize("changed, column", [
    ([(1, 20.25, "a", None), (2, 10.5, "b", 4), *ROWS[2:]], "x"),  # two numbers swapped: same extrema, same sum
    ([(1, 10.5, "b", None), (2, 20.25, "a", 4), *ROWS[2:]], "t"),  # two texts swapped
    ([ROWS[0], (2, 20.25, "b", 7), ROWS[2], (2_000_000_000_000, -1.0, "", 4)], "n"),
    ([ROWS[0], (2, 20.26, "b", 4), *ROWS[2:]], "x"),  # a value inside the range
    ([ROWS[0], ROWS[0], *ROWS[2:]], "k"),  # one row lost, another twice
    ([ROWS[0], (2, 20.25, "b", None), ROWS[2], (2_000_000_000_000, -1.0, "", 7)], "n"),
])
def test_checksums_tell_contents(spark, changed, column):
    before, after = _sums(spark, ROWS), _sums(spark, changed)
    assert before[column] != after[column]
    if column != "k":
        assert {c for c in before if before[c] != after[c]} == {column}


def test_checksum_is_combined_before_the_shuffle(spark):
    ctx = LendingData.from_fixtures(spark, SF001)
    assert "partial_sum" in _plan(catalog.column_profile({"bureau": ctx.raw["bureau"]}, keys=CHECKSUM_KEYS))


# ---- stage counts --------------------------------------------------------------------------------

def test_wide_count_shows_a_doubled_roll_up(spark):
    ctx = lending(spark, app=[dict(SK_ID_CURR=k) for k in (1, 2, 3)], bureau=[dict(SK_ID_CURR=1), dict(SK_ID_CURR=2)])
    count = lambda c: {r.STAGE: r.ROW_COUNT for r in quality.stage_counts(c).collect()}
    good = count(ctx)
    assert (good["application_train_clean"], good["master_dataset"], good["bureau_features"]) == (3, 3, 2)
    broken = LendingData(spark, ctx.raw)
    broken.__dict__["bureau_features"] = ctx.bureau_features.unionByName(ctx.bureau_features.where("SK_ID_CURR = 1"))
    assert count(broken)["master_dataset"] == 4
    lost = LendingData(spark, ctx.raw)
    lost.__dict__["wide"] = ctx.wide.where("SK_ID_CURR <> 3")
    assert count(lost)["master_dataset"] == 2


# ---- previews ------------------------------------------------------------------------------------

def test_unordered_preview_reads_no_further_than_it_must(spark):
    raw = LendingData.from_fixtures(spark, SF001).raw["bureau"]
    shown = catalog.preview(raw, n=7)
    plan = _plan(shown)
    assert "CollectLimit" in plan and "Sort" not in plan and "TakeOrdered" not in plan and "Exchange" not in plan
    rows = shown.collect()
    assert len(rows) == 7 and shown.columns == raw.columns
    assert set(map(tuple, rows)) <= set(map(tuple, raw.collect()))
    assert catalog.preview(raw.limit(0)).collect() == [] and catalog.preview(raw.limit(3)).count() == 3
    assert "TakeOrdered" in _plan(catalog.preview(raw, ["SK_ID_BUREAU"]))


def test_preview_check_counts_null_rows(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, None)], "a int, b string")
    assert _rows(catalog.preview_check({"t": df, "empty": df.limit(0)})) == [("empty", 0, 0), ("t", 3, 3)]


# ---- profiles from footers -----------------------------------------------------------------------

def test_footer_profile_equals_the_scan(spark):
    folder = tempfile.mkdtemp(prefix="footer-")
    raw = LendingData.from_fixtures(spark, SF001).raw
    paths = {}
    for name in ("application_train", "bureau"):
        raw[name].repartition(3).write.parquet(os.path.join(folder, name))
        paths[name] = os.path.join(folder, name)
    got = {(r.TABLE_NAME, r.COLUMN_NAME): r for r in catalog.footer_profile(spark, paths).collect()}
    scanned = catalog.column_profile({k: spark.read.parquet(v) for k, v in paths.items()}).collect()
    assert len(got) == len(scanned)
    for r in scanned:
        f = got[r.TABLE_NAME, r.COLUMN_NAME]
        assert (f.POSITION, f.DATA_TYPE, f.NON_NULL_COUNT, f.MIN_NUMBER, f.MAX_NUMBER) == (r.POSITION, r.DATA_TYPE, r.NON_NULL_COUNT, r.MIN_NUMBER, r.MAX_NUMBER)
        assert f.ROW_COUNT == raw[r.TABLE_NAME].count()


def test_footer_aggregates_are_pushed(spark):
    name = sinks.save(LendingData.from_fixtures(spark, SF001).application, "footer_t", database="loanlens_test")
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "csv")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = own.read.parquet(sinks.location(spark, name)).select("AMT_CREDIT", "CODE_GENDER")
    plan = _plan(df.agg(*sum(catalog.footer_aggregates(df), [])))
    pushed = re.search(r"PushedAggregation: \[([^\]]*)", plan).group(1)
    assert "COUNT(*)" in pushed and "MIN(AMT_CREDIT)" in pushed and "COUNT(CODE_GENDER)" in pushed
    # the caller's own session keeps its settings
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_footer_profile_of_nested_and_empty_tables(spark):
    folder = tempfile.mkdtemp(prefix="footer-")
    spark.createDataFrame([(1, [1, 2], None), (None, None, 0.5)], "a int, b array<int>, c double").write.parquet(f"{folder}/t")
    spark.createDataFrame([], "a int").write.parquet(f"{folder}/e")
    got = {(r.TABLE_NAME, r.COLUMN_NAME): (r.ROW_COUNT, r.NON_NULL_COUNT, r.MIN_NUMBER, r.MAX_NUMBER) for r in catalog.footer_profile(spark, {"t": f"{folder}/t", "e": f"{folder}/e"}).collect()}
    assert got == {("t", "a"): (2, 1, 1.0, 1.0), ("t", "b"): (2, None, None, None), ("t", "c"): (2, 1, 0.5, 0.5), ("e", "a"): (0, 0, None, None)}


# ---- shared key layout -----------------------------------------------------------------------------

def test_bucketed_roll_ups_join_without_exchange(spark):
    ctx = LendingData.from_fixtures(spark, SF001)
    counts = {}
    names = gold.build_tables(ctx, "loanlens_layout_t", buckets=4, rollups=True, row_counts=counts)
    assert set(gold.ROLLUP_TABLES) <= set(names) and counts["bureau_features"] == ctx.bureau_features.count()
    saved = gold.from_tables(spark, "loanlens_layout_t")
    wide = lambda: risk.risk_wide(saved.application, saved.bureau_features, saved.previous_features, saved.payment_features)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (wide(), saved.slim):
            plan = _plan(df)
            assert "Exchange" not in plan and plan.count("SortMergeJoin") == (3 if df is not saved.slim else 2)
        assert _rows(reports.risk_score(saved)) == _rows(reports.risk_score(ctx))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounded = lambda df: _rows(df.select(*[F.round(c, 6) if t == "double" else c for c, t in df.dtypes]))
    assert rounded(wide()) == rounded(ctx.wide)


def test_buckets_grow_in_number_with_the_applicants(spark, monkeypatch):
    ctx = lending(spark, app=[dict(SK_ID_CURR=k) for k in [*range(1, 23), None, 7]], bureau=[dict(SK_ID_CURR=k % 9) for k in range(30)])
    monkeypatch.setattr(registry, "ctx_for", lambda spark, sf_dir: ctx)
    monkeypatch.setattr(gold, "ROWS_PER_BUCKET", 2)
    got = registry.risk_wide_bucketed(spark, "")
    assert _rows(got) == _rows(registry.QUERIES["risk_wide"](spark, ""))
    for table in ("application_train", *gold.ROLLUP_TABLES):
        told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED loanlens_bucketed.{table}").collect()}
        assert told["Num Buckets"] == str(-(-ctx.application.count() // 2)) == "12"
    monkeypatch.undo()
    assert gold.buckets_for(ctx.application) == gold.FEWEST_BUCKETS


# ---- saved scorecard -------------------------------------------------------------------------------

def test_scored_rows_are_read_from_their_own_copy(spark):
    ctx = LendingData.from_fixtures(spark, SF001)
    want = _rows(reports.risk_score_rows(ctx)), _rows(reports.risk_score(ctx))
    ctx.persist_scored()
    plan = _plan(reports.risk_score(ctx))
    assert all("/scored/" in f for f in ctx.scored.inputFiles()) and "orders" not in plan and "AGE_RISK_SCORE" not in re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert (_rows(reports.risk_score_rows(ctx)), _rows(reports.risk_score(ctx))) == want
    ctx.persist_slim()  # another slim table: the copy scored from the old one is not used any more
    assert not any("/scored/" in f for f in ctx.scored.inputFiles()) and _rows(reports.risk_score(ctx)) == want[1]


# ---- rebuild in place ------------------------------------------------------------------------------

def test_refresh_of_the_tables_that_it_reads(spark):
    db, names = "loanlens_place_t", ["risk_score", "default_kpis"]
    ctx = LendingData.from_fixtures(spark, SF001)
    dashboard.refresh(ctx, db, names=names, buckets=2)
    before = {k: _rows(spark.table(f"{db}.{k}")) for k in ("application_train", "master_dataset", "report_risk_score")}
    dashboard.refresh(gold.from_tables(spark, db), db, names=names, buckets=2)
    assert {k: _rows(spark.table(f"{db}.{k}")) for k in before} == before
    left = {t.name for t in spark.catalog.listTables(db)}
    assert not any(sinks.STAGED in t or sinks.REPLACED in t for t in left)


def test_saved_tables_are_compressed_by_the_stronger_codec(spark):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([(k, float(k)) for k in range(50)], "a int, b double")
    for codec, more in (("ZSTD", {}), ("SNAPPY", {"codec": "snappy"})):
        folder = sinks.location(spark, sinks.save(df, "t", database="loanlens_codec_t", **more)).removeprefix("file:")
        files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
        kinds = {pq.ParquetFile(f"{folder}/{f}").metadata.row_group(0).column(i).compression for f in files for i in (0, 1) if pq.ParquetFile(f"{folder}/{f}").metadata.num_rows}
        assert kinds == {codec} and _rows(spark.table("loanlens_codec_t.t")) == _rows(df)


def test_a_build_that_fails_leaves_the_old_tables(spark, monkeypatch):
    db = "loanlens_abort_t"
    ctx = lending(spark, app=[dict(SK_ID_CURR=k) for k in (1, 2, 3)], bureau=[dict(SK_ID_CURR=1)])
    gold.build_tables(ctx, db, staged=True)
    other = lending(spark, app=[dict(SK_ID_CURR=9)])

    def fails(df, name, *args, real=gold.save, **more):
        if name.startswith("previous_application"):
            raise RuntimeError("disk full")
        return real(df, name, *args, **more)

    monkeypatch.setattr(gold, "save", fails)
    with pytest.raises(RuntimeError, match="disk full"):
        gold.build_tables(other, db, staged=True)
    assert sorted(r.SK_ID_CURR for r in gold.from_tables(spark, db).application.collect()) == [1, 2, 3]
    monkeypatch.undo()
    gold.build_tables(other, db, staged=True)
    assert [r.SK_ID_CURR for r in gold.from_tables(spark, db).application.collect()] == [9]


def test_a_swap_that_was_cut_short(spark):
    db = "loanlens_swap_t"
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    sinks.save(one, "t", database=db)
    spark.sql(f"ALTER TABLE `{db}`.`t` RENAME TO `{db}`.`t{sinks.REPLACED}`")  # ended before the new name was given
    sinks.restore(spark, db, "t")
    assert _rows(spark.table(f"{db}.t")) == [(1,)]
    sinks.save(two, f"t{sinks.STAGED}", database=db)
    sinks.save(one, f"t{sinks.REPLACED}", database=db)  # ended before the old one was dropped
    sinks.swap(spark, db, "t")
    assert _rows(spark.table(f"{db}.t")) == [(2,)] and {t.name for t in spark.catalog.listTables(db)} == {"t"}
