"""Importance resampling towards the distribution of target texts, on exact word n-grams.

A 256-byte table lower-cases A-Z and blanks every separator in UTF-8, ``bytes.split`` yields
the words, and the CRC of a run is the seed of the run that is one word longer, so every n-gram
costs one ``zlib.crc32`` of its last word.  Counters reduce words to counts before anything is
looked up, and each task's counts to one row a bucket before anything is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.shared import materialize
from loanlens.llm.text import pieces, utf8

#: Fixed values of the query: longest run of words, buckets, seed, fewest words of a drawn document, percentage drawn.
WORDS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Scores and gains are in thousandths.
UNIT = 1000
#: Bytes of one text that are split at once; a longer text is split piece by piece, at separators.
PIECE = 1 << 20
#: Rows of equal (key, score) that one row becomes in a task.
_CHUNK = 1 << 14
#: Distinct words whose bucket a task remembers.
_KEEP = 1 << 16


def _byte_table() -> bytes:
    """Digits, a-z and all bytes from 128 on stay, A-Z become a-z, everything else a space."""
    word = [*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]
    upper = range(ord("A"), ord("Z") + 1)
    return bytes(b if b in word else b + 32 if b in upper else 0x20 for b in range(256))


TABLE = _byte_table()


def word_pieces(raw: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``limit`` bytes of text."""
    clean, start = raw.translate(TABLE), 0
    while start < len(clean):
        end = clean.find(b" ", start + limit) if start + limit < len(clean) else -1
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def run_hashes(raw: bytes, longest: int, limit: int = PIECE) -> tuple[Counter, int]:
    """How often each run of 1 to ``longest`` words stands in a text, by CRC, and its number of words.

    A run's CRC is that of its words joined by one space.
    """
    out, n, before = Counter(), 0, []
    for words in word_pieces(raw, limit):
        n += len(words)
        for word, times in Counter(words).items():
            out[crc32(word)] += times
        if longest > 1:
            both = before + words
            seeds = [crc32(w) for w in both]
            for k in range(1, longest):
                seeds = [crc32(w, crc32(b" ", s)) for s, w in zip(seeds, both[k:])]
                # runs that end before this piece are counted already
                out.update(seeds[max(0, len(before) - k):])
            before = both[len(both) - min(len(both), longest - 1):]
    return out, n


class _Buckets(dict):
    """word -> bucket, remembered for at most _KEEP words."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEEP:
            self.clear()
        self[word] = bucket = crc32(word) % self.buckets
        return bucket


def _text_rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch, and their texts as bytes (null: empty)."""
    for part in pieces(batch, "text"):
        data, at = utf8(part.column("text"))
        raw = data.tobytes()
        yield part, [raw[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist())]


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> dict[int, int]:
    """Runs in each bucket over all texts; a task sends one row for each bucket it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket_of = Counter(), _Buckets(buckets)
        for batch in batches:
            for _, raws in _text_rows(batch):
                for raw in raws:
                    if longest == 1:
                        for words in word_pieces(raw):
                            for word, times in Counter(words).items():
                                total[bucket_of[word]] += times
                    else:
                        for h, times in run_hashes(raw, longest)[0].items():
                            total[h % buckets] += times
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket long, n long")
    return {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # one row a bucket


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Thousandths of the log ratio of target to raw in each bucket, one added to every count."""
    s, t = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(UNIT * math.log((target.get(b, 0) + 1.0) * s / ((raw.get(b, 0) + 1.0) * t))) for b in range(buckets)]


def noise(key: object, seed: int) -> int:
    """Thousandths of Gumbel noise that depends on seed and key alone; a null key counts as no text."""
    h = int(sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-UNIT * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, key: str, text: str, gain: list[int], longest: int, seed: int) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(buckets)
        for batch in batches:
            for part, raws in _text_rows(batch):
                keys, rows = part.column("key").to_pylist(), []
                for k, raw in zip(keys, raws):
                    if longest == 1:
                        total = n = 0
                        for words in word_pieces(raw):
                            n += len(words)
                            total += sum(gain[bucket_of[word]] * times for word, times in Counter(words).items())
                        n_words = n
                    else:
                        hashes, n_words = run_hashes(raw, longest)
                        n = sum(hashes.values())
                        total = sum(gain[h % buckets] * times for h, times in hashes.items())
                    weight = total // n if n else 0
                    rows.append((n_words, n, weight, weight + noise(k, seed)))
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(x, pa.int64()) for x in zip(*rows))], ["key", "n_words", "n_features", "weight", "score"])

    schema = f"key {dict(docs.dtypes)[key]}, n_words long, n_features long, weight long, score long"
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def draw(weighed: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``weighed`` with rank: 1, 2, 3 ... for the highest scores (ties to the smaller key, null keys last), else null.

    Drawn are floor(percent * N / 100) of the N rows with at least ``least_words`` words.  Rows
    that agree in all columns are one row with a count until they are ranked; ranks come from a
    range partitioning, so no task sorts all rows, and none holds more than a chunk of equal ones.
    """
    columns = weighed.columns
    equal = weighed.where(F.col("n_words") >= least_words).groupBy(*columns).agg(F.count("*").alias("c"))
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("n_features"), F.asc("n_words")]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            c = np.asarray(batch.column("c"), np.int64)
            ends = upto + np.cumsum(c)
            upto = int(ends[-1]) if len(ends) else upto
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(c), task)), pa.array(ends)], [*batch.schema.names, "task", "upto"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in equal.schema.fields)
    placed = materialize(equal.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, f"{fields}, task long, upto long"))
    # one row a task
    before = placed.groupBy("task").agg(F.max("upto").alias("n")).select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    n = placed.agg(F.sum("c")).first()[0] or 0
    drawn = percent * n // 100
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / _CHUNK)))
    chunks = placed.join(before, "task").select(*columns, "c", (F.col("before") + F.col("upto") - F.col("c")).alias("first"), chunk.alias("chunk"))
    chunks = chunks.repartition("first", "chunk")
    at = F.col("chunk") * _CHUNK
    each = chunks.select(*columns, F.explode(F.sequence(F.col("first") + at + 1, F.col("first") + F.least(at + _CHUNK, "c"))).alias("rank"))
    ranked = each.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = WORDS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row's key, n_words, n_features, weight, score and rank (null: not drawn).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; features are
    all runs of 1 to ``longest`` of them.  Null, empty and blank texts have no features and
    weight 0; a null key draws the noise of an empty one and stands behind other keys in a tie;
    rows with a repeated key draw the same noise and are ranked each (those that agree in all
    else in any order); a text is split in pieces of about 1 MB, whole; an empty table gives no
    rows, an empty target equal weights up to the raw counts.  Other columns are not read.
    """
    raw = bucket_counts(docs, text, longest, buckets)
    gain = gains(raw, bucket_counts(target, target_text, longest, buckets), buckets)
    weighed = materialize(weigh(docs, key, text, gain, longest, seed))
    return draw(weighed, least_words, percent).withColumnRenamed("key", key)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` towards the texts of ``benchmark``: doc_id, n_features, weight, score, rank."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: the polynomial's byte table, then one table look-up for each byte of a word.
ORACLE = f"""
WITH t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
q AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
f AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY doc_id, word),
h AS (SELECT word, hex(encode(word)) AS code FROM (SELECT word FROM f UNION SELECT word FROM q)),
b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(code) // 2 + 1), lambda i: ('0x' || substr(code, 2 * i - 1, 2))::BIGINT)),
    lambda c, x: xor(c // 256, t.crc[xor(c, x) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket FROM h, t),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN b USING (word) GROUP BY bucket),
u AS (SELECT bucket, count(*) AS t FROM q JOIN b USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM u)::DOUBLE AS big_t),
g AS (
  SELECT bucket, floor({UNIT} * ln((coalesce(t, 0) + 1) * (big_s + {BUCKETS}) / ((s + 1) * (big_t + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN u USING (bucket), totals),
w AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM f JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
r AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    floor(-{UNIT} * ln(-ln((('0x' || left(sha256('{SEED}:' || d.doc_id), 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS noise
  FROM d LEFT JOIN w USING (doc_id)),
o AS (
  SELECT doc_id, n_features, weight, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY weight + noise DESC, doc_id) AS place,
    count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n FROM r)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM o
"""
