"""Quality by importance resampling: hashed n-gram models of good and of all text, Gumbel top-k.

The target model counts the hashed n-grams (1 and 2 tokens) of documents labelled good, the raw
model those of all documents.  A document's log importance weight is the sum of
log(target / raw) over its n-grams; the k highest weights plus Gumbel noise are a sample
without replacement in proportion to the weights.  k is the number of documents whose weight
reaches the cut that parts labelled good and bad documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loanlens.llm.shared import materialize
from loanlens.llm.text import SPACE, Hasher, Words, mix, pieces

#: Hash buckets of n-grams, and what is added to each bucket's counts.
BUCKETS, PRIOR = 10_000, 1.0
#: Labelled rows of each class that the target model and the cut are fitted on, at most.
LABELLED = 20_000
#: The noise is multiplied by this: 1 samples in proportion to the weights, 0 takes the highest.
TEMPERATURE = 0.1
#: For the cut, a good document lost counts as much as so many bad ones kept (as shares of their class).
GOOD_COST = 10.0

_HASH = Hasher(11)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of tokens (runs of letters and digits, or of other signs; A-Z lower-cased) and n + 1 offsets."""
    words = Words(column, fold=True)
    data = words.data
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    kind = np.where(SPACE[data], 0, np.where(_LETTER[data], 1, 2)).astype(np.int8)
    edge = np.zeros(len(data) + 1, bool)
    edge[words.offsets] = True
    change = np.concatenate([[True], kind[1:] != kind[:-1], [True]]) | edge
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    inside = kind[start] > 0
    start, end = start[inside], end[inside]
    return _HASH.word(data, start, end), np.searchsorted(start, words.offsets)


def ngrams(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each 1-gram and 2-gram, and the document it stands in."""
    h, first = tokens(column)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else doc
    two = mix(h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1]) if len(pair) else h[:0]
    bucket = (np.concatenate([h, two]) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.concatenate([doc, doc[pair]])


def gumbel(key: Column) -> Column:
    """Standard Gumbel noise that depends on the key alone, so that reruns draw the same sample."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest of a double column, exactly: each round counts 4,096 equal steps of the range left."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return None
    while low < high:
        step = (high - low) / 4096
        if step <= 0 or low + step == low or high - step == high:
            top = values.where(F.col(column).between(low, high)).groupBy(column).count().orderBy(F.desc(column)).limit(1 << 16).collect()
            for row in top:
                k -= row["count"]
                if k <= 0:
                    return row[0]
            return low
        cell = F.least(F.floor((F.col(column) - low) / step), F.lit(4095))
        counts = values.where(F.col(column).between(low, high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for row in sorted(counts.collect(), key=lambda r: -r.c):
            if row.n >= k:
                low, high = row.lo, row.hi
                break
            k -= row.n
    return low


@dataclass
class Model:
    """log(target / raw) of each bucket, and the cut on log weights."""

    ratio: np.ndarray
    cut: float = 0.0


def labelled_sample(labels: DataFrame, key: str, label: str, limit: int) -> tuple[set, set]:
    """Keys labelled good and bad; of more than ``limit`` of a class, those with the lowest hash."""
    out = []
    for value in (1, 0):
        own = labels.where((F.col(label) == value) & F.col(key).isNotNull()).select(key).distinct()
        out.append({r[0] for r in own.orderBy(F.xxhash64(key), key).limit(limit).collect()})
    return out[0], out[1]


def weigh(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, n_grams, weight): the log importance weight of every row; no tokens: null."""
    ratio = model.ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                bucket, doc = ngrams(part.column("text"), len(ratio))
                n = np.bincount(doc, minlength=part.num_rows)
                w = np.bincount(doc, weights=ratio[bucket], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n.astype(np.int64)), pa.array(w, mask=n == 0)], ["key", "n_grams", "weight"])

    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, f"key {dict(docs.dtypes)[key]}, n_grams long, weight double")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", buckets: int = BUCKETS, limit: int = LABELLED) -> Model:
    """Models from the n-grams of all documents; the target's from labelled good ones.

    A task adds up its counts and sends one row a bucket, whatever it has read.  For the cut, a
    labelled key that stands in several rows counts once, with the text of the lowest hash.
    Without good labels all weights are 0.
    """
    good, bad = labelled_sample(labels, key, label, limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                bucket, doc = ngrams(part.column("text"), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                chosen = np.array([k in good for k in part.column("key").to_pylist()], bool)
                target += np.bincount(bucket[chosen[doc]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    counts = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(buckets, PRIOR), np.full(buckets, PRIOR)
    for row in counts.collect():  # one row a bucket
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    model = Model(np.log(target / target.sum()) - np.log(raw / raw.sum()) if good else np.zeros(buckets))
    if good and bad:
        sample_rows = [(k, 1) for k in good] + [(k, 0) for k in bad]  # 2 * limit at most
        chosen = docs.sparkSession.createDataFrame(sample_rows, f"_key {dict(docs.dtypes)[key]}, _label int")
        known = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_key")
        of = F.struct("_key", "_label", F.xxhash64("_text").alias("_h")).alias("of")
        weighed = weigh(known.select(of, "_text"), "of", "_text", model).where("weight IS NOT NULL")
        # one row, however often a key stands; weights are shuffled, not texts
        one = weighed.groupBy("key._key", "key._label").agg(F.min(F.struct("key._h", "weight")).alias("row"))
        model.cut = best_cut([(r.weight, r._label) for r in one.select("row.weight", "_label").collect()])
    return model


def best_cut(rows: list[tuple[float, int]]) -> float:
    """The weight that best parts good from bad (see GOOD_COST), in the middle of its gap."""
    rows = sorted(rows)
    n_good = max(1, sum(y for _, y in rows))
    n_bad = max(1, len(rows) - n_good)
    best, at, gain, i = 0.0, rows[0][0] if rows else 0.0, 0.0, 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            gain += -GOOD_COST / n_good if rows[j][1] else 1 / n_bad
            j += 1
        if gain > best:
            best, at = gain, (rows[j - 1][0] + rows[j][0]) / 2 if j < len(rows) else rows[-1][0] + 1.0
        i = j
    return at


def sample(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(key, n_grams, weight, draw, kept) of every row.

    ``kept`` are the ``k`` largest draws (weight + temperature * Gumbel noise of the key) and
    those equal to the last of them; ``k`` defaults to the number of weights at the cut or
    above.  Texts without tokens (null, empty, blank) have no weight and are not kept; repeated
    keys draw the same noise; a null key draws the noise of null; no rows give none.
    """
    weighed = weigh(docs, key, text, model)
    weighed = materialize(weighed.withColumn("draw", F.col("weight") + temperature * gumbel(F.col("key"))))
    k = weighed.where(F.col("weight") >= model.cut).count() if k is None else k
    least = kth_largest(weighed, "draw", k)
    kept = F.lit(False) if least is None else F.coalesce(F.col("draw") >= least, F.lit(False))
    return weighed.select(F.col("key").alias(key), "n_grams", "weight", "draw", kept.alias("kept"))


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, all columns unchanged."""
    model = fit(docs, labels)
    drawn = sample(docs, model)
    kept = drawn.where("kept").agg(F.min("draw")).first()[0]
    if kept is None:
        return docs.limit(0)
    ratio = model.ratio

    @F.arrow_udf(DoubleType())
    def weight(text: pa.Array) -> pa.Array:
        out = []
        for part in pieces(pa.RecordBatch.from_arrays([text], ["text"]), "text"):
            bucket, doc = ngrams(part.column("text"), len(ratio))
            n = np.bincount(doc, minlength=part.num_rows)
            out.append(pa.array(np.bincount(doc, weights=ratio[bucket], minlength=part.num_rows), mask=n == 0))
        return pa.concat_arrays(out or [pa.array([], pa.float64())])

    # the same sum and noise as in ``sample``, so no text is shuffled for a join
    return docs.where(weight(F.col("text")) + TEMPERATURE * gumbel(F.col("doc_id")) >= kept)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of all ``documents`` (one row for each that is kept): doc_id, n_grams, weight, draw, kept."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return sample(docs, fit(docs, labels)).where("kept")
