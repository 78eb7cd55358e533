"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host when the share of the host's pages that contain it exceeds
``ratio``.  A page counts a line once, however often it repeats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.shared import let, materialize

#: A line goes when more than this share of its host's pages contain it ...
RATIO = 0.1
#: ... and at least so many pages do: on a host of three pages every line has a third.
MIN_PAGES = 5


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): hashes of each host's boilerplate lines.

    Pages with two lines in common are not compared; (host, line) is counted, combined before
    the shuffle, and a host's pages are one count.  The list of a host is bounded: it has at
    most (distinct lines a page, on average) / ``ratio`` entries.
    """
    named = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = named.groupBy("host").agg(F.count("*").alias("pages"))
    lines = named.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(x))))).alias("line"))
    counts = lines.where("line IS NOT NULL").groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("n") / F.col("pages") > ratio)
    return common.groupBy(counts["host"].alias("host")).agg(F.collect_set("line").alias("lines"))


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``.

    All columns stay; ``line_dedup`` (struct of n_lines, n_dropped) is added, in place of an input
    column of that name.  Lines are separated by ``\n`` and compared whole; blank lines are kept.
    Null text stays null with zero lines, its page still counts for the host; pages without a host
    share the null host; a text of boilerplate alone becomes empty; repeated rows are pages of
    their own; no rows give none.  The host lists are written first, so Spark broadcasts them only
    if their measured size allows, and else joins with AQE splitting a hot host's pages.  A page's
    lines meet its host's list by hashing, once.
    """
    columns = pages.columns
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    own = pages.toDF(*at.values())
    lists = materialize(boilerplate(own, at[host], at[text], ratio, min_pages)).select(F.col("host").alias("of"), "lines")
    joined = own.join(lists, F.col(at[host]).eqNullSafe(F.col("of")), "left")
    split, whole = F.split(F.col(at[text]), "\n"), F.col(at[text])

    def without(bad: Column) -> Column:
        return F.filter(split, lambda x: ~((F.trim(x) != "") & F.array_contains(bad, F.xxhash64(x))))

    bad = F.array_intersect("lines", F.transform(split, lambda x: F.xxhash64(x)))
    kept = F.when(F.col("lines").isNull(), split).otherwise(let(bad, without))
    out = joined.withColumn("kept", kept)
    n = F.when(whole.isNull(), 0).otherwise(F.coalesce(F.size(split), F.lit(0))).cast("long")
    left = F.when(whole.isNull(), 0).otherwise(F.size("kept")).cast("long")
    return out.select(
        *[(F.array_join("kept", "\n") if c == text else F.col(at[c])).alias(c) for c in columns if c != "line_dedup"],
        F.struct(n.alias("n_lines"), (n - left).alias("n_dropped")).alias("line_dedup"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, its source as host: doc_id, n_lines, n_dropped and the text left."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", "text")


ORACLE = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT l.source, l.line FROM (SELECT DISTINCT doc_id, source, line FROM l WHERE trim(line) <> '') l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source GROUP BY l.source, l.line, t.pages
  HAVING count(*) >= {MIN_PAGES} AND count(*)::DOUBLE / t.pages > {RATIO}),
marked AS (SELECT l.*, bad.line IS NOT NULL AS is_bad FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_bad) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_bad), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
