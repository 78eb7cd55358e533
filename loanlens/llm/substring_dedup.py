"""Substring dedup by level-wise doubling.

A run of ``length`` words can repeat only if every shorter run in it repeats.  So short
windows are compared first, and windows that repeat at one length alone are extended to twice
that length, until the wanted length is reached or no candidates survive.  Below the wanted
length a run is represented by the window with the lowest hash in it: two equal runs choose
the same, and a text sends a few per cent of its short windows only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from loanlens.llm.shared import Bits, discard, materialize
from loanlens.llm.text import Hasher, Words, binaries, pieces, signed

#: Words in a run that must not repeat.
LENGTH = 50
#: The shortest length compared: halving stops above it.
SHORTEST = 12

_ONE, _TWO = Hasher(31), Hasher(37)


def levels(length: int) -> list[int]:
    """The lengths compared, each half of the next."""
    out = [length]
    while out[0] % 2 == 0 and out[0] // 2 >= SHORTEST:
        out.insert(0, out[0] // 2)
    return out


def lowest(words: Words, hashes: np.ndarray, short: int, length: int) -> np.ndarray:
    """For each word position (meaningful where a run of ``length`` starts): the lowest hash of ``short`` words in the run."""
    n = len(hashes)
    start = np.arange(max(0, n - short + 1))
    m = _ONE.sequence(hashes, start, start + short)
    span, want = 1, length - short + 1
    while span * 2 <= want:
        m = np.minimum(m[:-span], m[span:]) if len(m) > span else m[:0]
        span *= 2
    rest = want - span
    m = np.minimum(m[: len(m) - rest], m[rest:]) if len(m) > rest else m[:0]
    return m


@dataclass
class Runs:
    """All runs of ``length`` words of a batch: first word, document, and lowest hashes of each level."""

    words: Words
    start: np.ndarray
    doc: np.ndarray
    low: list[np.ndarray]
    one: np.ndarray  # hashes of words

    @classmethod
    def of(cls, column: pa.Array, length: int, shorter: list[int]) -> Runs:
        words = Words(column)
        one = _ONE.word(words.data, words.start, words.end)
        start, share = words.windows(length)
        doc = words.owner(np.diff(share))
        return cls(words, start, doc, [lowest(words, one, s, length)[start] for s in shorter], one)


def short_windows(docs: DataFrame, length: int, shorter: list[int], passed: list) -> DataFrame:
    """(h, doc) of the next level's lowest windows of runs that passed all levels before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                runs = Runs.of(part.column("text"), length, shorter)
                alive = np.ones(len(runs.start), bool)
                for low, bits in zip(runs.low, passed):
                    alive &= bits.value.test(low)
                low, doc = runs.low[len(passed)][alive], runs.doc[alive]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(low[new])), part.column("doc").take(pa.array(doc[new]))], ["h", "doc"])

    return docs.mapInArrow(run, "h long, doc long")


def long_hashes(docs: DataFrame, length: int, shorter: list[int], passed: list) -> DataFrame:
    """(a, doc) of runs that passed all levels: the run's hash, once for each document and stretch of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                runs, keep = survivors(part.column("text"), length, shorter, passed)
                a = _ONE.sequence(runs.one, runs.start[keep], runs.start[keep] + length)
                yield pa.RecordBatch.from_arrays([pa.array(signed(a)), part.column("doc").take(pa.array(runs.doc[keep]))], ["a", "doc"])

    return docs.mapInArrow(run, "a long, doc long")


def survivors(column: pa.Array, length: int, shorter: list[int], passed: list) -> tuple[Runs, np.ndarray]:
    """All runs of the texts, and which of them passed all levels."""
    runs = Runs.of(column, length, shorter)
    alive = np.ones(len(runs.start), bool)
    for low, bits in zip(runs.low, passed):
        alive &= bits.value.test(low)
    return runs, np.flatnonzero(alive)


def long_windows(docs: DataFrame, length: int, shorter: list[int], passed: list, twice) -> DataFrame:
    """(a, b, doc, at) of runs whose hash is among those ``twice`` met: two hashes of the run, and its place (fingerprint of the text, first word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                runs, keep = survivors(part.column("text"), length, shorter, passed)
                a = _ONE.sequence(runs.one, runs.start[keep], runs.start[keep] + length)
                met = twice.value.test(a)
                keep, a = keep[met], a[met]
                start, doc, words = runs.start[keep], runs.doc[keep], runs.words
                two = _TWO.word(words.data, words.start, words.end) if len(keep) else runs.one
                b = _TWO.sequence(two, start, start + length)
                at = fingerprints(words, runs.one)[doc] << 32 | (start - words.first[doc])
                yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b)), part.column("doc").take(pa.array(doc)), pa.array(at)], ["a", "b", "doc", "at"])

    return docs.mapInArrow(run, "a long, b long, doc long, at long")


def fingerprints(words: Words, hashes: np.ndarray) -> np.ndarray:
    """31 bits of each document's whole word sequence: tells rows with one doc_id apart."""
    return (_ONE.sequence(hashes, words.first[:-1], words.first[1:]) >> np.uint64(33)).astype(np.int64)


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """(doc, fingerprint, places): first words of runs that also stand in a document with a smaller key.

    Every step counts before it shuffles: a hash becomes one row a task with its smallest and
    largest document, however often it stands.  Only runs whose 64-bit hash stands in two documents
    are then told apart by 128 bits and joined with the first document that has them; of that join
    one side has a row a run, so AQE can split a run that many documents share.
    """
    spark = docs.sparkSession
    known = docs.where("doc IS NOT NULL")
    *shorter, _ = levels(length)
    passed = []

    def met_twice(hashes: DataFrame, column: str):
        counts = hashes.groupBy(column).agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        found = materialize(counts.where("low < high").select(column))
        bits = Bits.build(found, column)
        discard(found)
        return bits

    for step in [*shorter, None]:
        bits = met_twice(long_hashes(known, length, shorter, passed), "a") if step is None else met_twice(short_windows(known, length, shorter, passed), "h")
        passed.append(spark.sparkContext.broadcast(bits))
        if not bits.table.any():
            return spark.createDataFrame([], "doc long, fingerprint long, places array<int>")
    rows = materialize(long_windows(known, length, shorter, passed[:-1], passed[-1]))
    for b in passed:
        b.destroy()
    firsts = rows.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    later = rows.join(firsts, ["a", "b"]).where("doc > first").select("doc", "at")
    return later.groupBy("doc", F.shiftright("at", 32).alias("fingerprint")).agg(F.collect_set(F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("places"))


def kept(column: pa.Array, places: list, length: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, number removed, and what is left: bytes and n + 1 offsets (words joined by one space)."""
    words = Words(column)
    n = len(words.start)
    change = np.zeros(n + 1, np.int64)
    for i, own in enumerate(places):
        if own is not None and len(own):
            first = words.first[i] + np.asarray(own, np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, first + length, -1)
    stays = np.cumsum(change)[:n] == 0
    total = np.concatenate([[0], np.cumsum(stays)])
    removed = words.count - (total[words.first[1:]] - total[words.first[:-1]])
    at = np.flatnonzero(stays)
    doc = words.owner(words.count)[at]
    final = np.ones(len(at), bool)  # the last word left of a document has no space after it
    final[:-1] = doc[1:] != doc[:-1]
    mark = np.zeros(len(words.raw) + 2, np.int8)
    np.add.at(mark, words.start[at], 1)
    np.add.at(mark, words.end[at] + ~final, -1)
    inside = np.cumsum(mark, dtype=np.int8)[: len(words.raw)].astype(bool)
    spaced = words.raw.copy()
    spaced[words.end[at[~final]]] = 0x20
    left = spaced[inside]
    return words, removed, left, np.concatenate([[0], np.cumsum(inside)])[words.offsets]


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """Every row's key, n_words, n_removed, kept_sha256 and, if asked for, the kept text.

    A word goes if a run of ``length`` words that covers it also starts in a document with a
    smaller key; runs are taken from the input as it is.  Null texts are empty.  A row with a
    null key loses nothing and takes nothing from others; rows with a repeated key are judged
    each, and never against each other.  Other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    found = materialize(repeated(rows, length))
    touched = docs.sparkSession.sparkContext.broadcast(Bits.build(found.select(F.xxhash64("doc").alias("h")), "h"))
    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def finish(batch: pa.RecordBatch, places: list) -> pa.RecordBatch:
        words, removed, left, at = kept(batch.column("text"), places, length)
        raw = left.tobytes()
        hashes = [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
        out = [batch.column("doc"), pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(hashes, pa.string())]
        return pa.RecordBatch.from_arrays(out + [binaries(left, at).cast(pa.string())] * with_text, ["doc", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield finish(part, [])

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                own = fingerprints(words, _ONE.word(words.data, words.start, words.end))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("text"), pa.array(own)], ["doc", "text", "fingerprint"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield finish(part, [np.asarray(x.values) if x.is_valid else None for x in part.column("places")])

    @F.arrow_udf(BooleanType())
    def may_lose(h: pa.Array) -> pa.Array:
        return pa.array(touched.value.test(np.asarray(h, np.int64).view(np.uint64)))

    # only texts that may lose words are shuffled to meet their places
    marked = rows.withColumn("lose", F.col("doc").isNotNull() & may_lose(F.xxhash64("doc")))
    rest = marked.where("NOT lose").select("doc", "text").mapInArrow(whole, schema)
    some = marked.where("lose").select("doc", "text").mapInArrow(printed, "doc long, text string, fingerprint long")
    some = some.join(found, ["doc", "fingerprint"], "left").select("doc", "text", "places").mapInArrow(cut, schema)
    return rest.unionByName(some).withColumnRenamed("doc", key)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
runs AS (
  SELECT doc_id, i, array_to_string(words[i:i + {LENGTH - 1}], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {LENGTH - 2})) AS i FROM w WHERE len(words) >= {LENGTH})),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS first FROM runs) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS i FROM later),
marked AS (
  SELECT x.doc_id, x.i, x.word, gone.i IS NOT NULL AS is_gone
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w) x LEFT JOIN gone USING (doc_id, i)),
left_ AS (SELECT doc_id, count(*) FILTER (is_gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT is_gone) AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(l.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ l USING (doc_id)
"""
