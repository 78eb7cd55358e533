"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot rank r of a source takes the r-th block of T words of its shuffled text, read at most
twice, and the last slot what is left of the source's target.  A slot of words a to b of a
target g stands at (a + u * (b - a)) / g of the schedule, where u is the golden-ratio point
frac((i + 1/2) * phi) of the i-th source, so that sources of one slot are spread too.  Every
source, however small, thus comes within one word of its target at the end of the schedule,
and within a block of its share at any prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loanlens.llm.shared import discard, materialize
from loanlens.llm.text import Words, pieces

#: Weights of the sources in code point order, repeating; words of the mix as a
#: share of all words; how often a text may be read.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Small inputs have about so many slots; from blocks of BLOCK words on, slots grow with the words.
SLOTS, BLOCK = 1 << 20, 128
#: A word, for Java's patterns.
WORD = r"[^\x20\x09-\x0D]+"
_CHUNK = 1 << 14  # slots of one source that one row becomes
_PHI = 0.6180339887498949


@F.arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in each text; null: 0."""
    batch = pa.RecordBatch.from_arrays([text], ["t"])
    return pa.concat_arrays([pa.array(Words(p.column("t")).count, pa.int64()) for p in pieces(batch, "t")] or [pa.array([], pa.int64())])


@dataclass
class Mix:
    """What the schedule needs: documents with their place in their source's shuffled stream, sources, and ranked slots."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int


def source_key(source: str):
    """A source's name without null: the null source is one source."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit(""))


def plan_sources(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> tuple[DataFrame, float]:
    """(_src, source, source_size, target, place in the order of sources) and the words of the whole mix.

    Ranks come from a range partitioning (no single-task sort of all sources).  The level of
    ``target = min(epochs * size, level * weight)`` is raised until no source is above its
    limit; each round is one aggregate of two numbers.
    """
    totals = sizes.groupBy("_src", "source").agg(F.sum("_size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    sorted_ = totals.repartitionByRange(order).sortWithinPartitions(order)
    placed = materialize(sorted_.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    before = placed.groupBy("p").agg(F.count("*").alias("n")).select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = placed.join(before, "p").withColumn("place", F.col("before") + F.col("i"))
    ranked = materialize(ranked.select("_src", "source", "source_size", "place", weight.alias("w"), (F.col("source_size") * float(epochs)).alias("limit")))
    words, sum_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    budget = float(words or 0) * share
    level = budget / sum_w if sum_w else 0.0
    while budget:
        above = F.col("limit") < F.col("w") * level
        full, rest = ranked.agg(F.sum(F.when(above, F.col("limit")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        raised = (budget - full) / rest if rest else level
        if raised <= level:
            break
        level = raised
    return ranked.select("_src", "source", "source_size", F.least("limit", F.col("w") * level).alias("target"), "place"), budget


def rank_slots(sources: DataFrame, block: int) -> DataFrame:
    """(slot, _src, rank, length): each source's blocks in order of their places, as long in all as its target in whole words.

    A source's slots come from rows of _CHUNK slots each, and are numbered by a range
    partitioning, so that no task holds all slots or all of a large source.
    """
    at = (F.col("place") + 0.5) * _PHI
    shares = sources.select("_src", F.floor(F.col("target") + 0.5).alias("goal"), (at - F.floor(at)).alias("u")).where("goal > 0")
    shares = shares.withColumn("n", F.ceil(F.col("goal") / block))
    chunks = shares.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _CHUNK))).alias("chunk")).repartition("_src", "chunk")
    first = F.col("chunk") * _CHUNK
    ranks = chunks.select("*", F.explode(F.sequence(first, F.least(first + _CHUNK, "n") - 1)).alias("rank"))
    ranks = ranks.withColumn("length", F.least(F.lit(block).cast("long"), F.col("goal") - F.col("rank") * block))
    slots = ranks.select("_src", "rank", "length", ((F.col("rank") * block + F.col("u") * F.col("length")) / F.col("goal")).alias("x"))
    order = ["x", "_src", "rank"]
    placed = slots.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.select("_src", "rank", "length", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    before = placed.groupBy("p").agg(F.count("*").alias("n")).select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    return placed.join(before, "p").select((F.col("before") + F.col("i")).alias("slot"), "_src", "rank", "length")


def running(rows: DataFrame, column: str, order: list) -> DataFrame:
    """``rows`` with ``before``: the sum of ``column`` over all rows that stand earlier in ``order``.

    Rows are dealt by ranges and added up in each; what other ranges hold comes from one row a
    range, so no task sees all rows or all of a hot key.
    """
    fields = [f for f in rows.schema.fields]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = np.asarray(batch.column(column), np.int64)
            upto = total + np.cumsum(own)
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), task)), pa.array(upto - own), pa.array(upto)], [*batch.schema.names, "_task", "_before", "_upto"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _task long, _before long, _upto long"
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, schema))
    tasks = placed.groupBy("_task").agg(F.max("_upto").alias("n")).select("_task", (F.sum("n").over(Window.orderBy("_task")) - F.col("n")).alias("_earlier"))
    return placed.join(tasks, "_task").select(*[f.name for f in fields], (F.col("_earlier") + F.col("_before")).alias("before"))


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, slots: int = SLOTS, row: str | None = None) -> Mix:
    """Sizes, targets, shuffled positions and ranked slots for ``docs``.

    ``documents`` has _row, _key, _src, size, source_size, target and start (the document's first
    word in its source's stream, in order of a hash of the key, then of ``row``).  ``row`` names a
    column of longs that tells rows apart (by default rows are numbered here); null sources are
    one source; null or empty texts have size 0 and are never taken; rows with a repeated or null
    key are documents of their own; no rows give an empty schedule.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    sizes = docs.select(number.alias("_row"), F.col(f"`{key}`").alias("_key"), source_key(source).alias("_src"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("_size"))
    sizes = materialize(sizes)
    sources, budget = plan_sources(sizes, weights, share, epochs)
    block = min(BLOCK, max(1, -(-int(budget) // slots)))
    ranked = materialize(rank_slots(sources, block))
    ordered = sizes.drop("source").withColumn("_h", F.xxhash64("_key", F.lit(20260101)))
    placed = materialize(running(ordered, "_size", ["_src", "_h", "_key", "_size", "_row"]))
    begins = placed.groupBy("_src").agg(F.min("before").alias("_begin")).join(sources.drop("source", "place"), "_src")
    documents = placed.join(begins, "_src").select("_row", "_key", "_src", F.col("_size").alias("size"), "source_size", "target", (F.col("before") - F.col("_begin")).alias("start"))
    mix = Mix(materialize(documents), sources, ranked, block)
    discard(sizes, placed)
    return mix


def schedule(mix: Mix, epochs: int = EPOCHS) -> DataFrame:
    """(slot, _row, _key, _src, start, size, epoch, from_word, words): the documents' pieces in each slot.

    A document stands in the blocks that its words fall into, once for each epoch; blocks and
    slots meet on (source, rank).  Documents without words are in no slot; an empty mix has none.
    """
    t = mix.block
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    stood = mix.documents.where("size > 0").select("*", epoch).withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size"))
    stood = stood.withColumn("b", F.col("a") + F.col("size"))
    blocks = stood.select("*", F.explode(F.sequence(F.floor(F.col("a") / t), F.floor((F.col("b") - 1) / t))).alias("rank"))
    from_word = F.greatest("a", F.col("rank") * t) - F.col("a")
    words = F.least("b", F.col("rank") * t + F.col("length")) - F.greatest("a", F.col("rank") * t)
    return blocks.join(mix.slots, ["_src", "rank"]).select("slot", "_row", "_key", "_src", "start", "size", "epoch", from_word.alias("from_word"), words.alias("words")).where("words > 0")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix as rows of ``docs``: one for each document and epoch in which the schedule takes words of it.

    A document is taken whole but for the one that a source's last block ends in: of that, the
    words taken are joined by one space.  Every row is a document of its own, whatever its key;
    documents not taken, or without words, are left out; all columns come back under their names.
    The rows are written once with a number each, and meet what is taken of them on it.
    """
    columns = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    own = materialize(docs.toDF(*at.values()).withColumn("row", F.monotonically_increasing_id()))
    mix = plan(own, at[key], at[source], at[text], row="row")
    taken = schedule(mix).groupBy("_row", "size", "epoch").agg(F.min("from_word").alias("from"), F.sum("words").alias("words"))
    taken = materialize(taken)
    discard(mix.documents, mix.slots)
    each = own.join(taken, own["row"] == taken["_row"])
    words = F.slice(F.regexp_extract_all(F.col(at[text]), F.lit(WORD), F.lit(0)), (F.col("from") + 1).cast("int"), F.col("words").cast("int"))
    left = F.when(F.col("words") == F.col("size"), F.col(at[text])).otherwise(F.array_join(words, " "))
    return each.select(*[(left if c == text else F.col(at[c])).alias(c) for c in columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: size, source_size, target and the words that the schedule takes."""
    mix = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = schedule(mix).groupBy("_row").agg(F.sum("words").alias("taken"))
    out = mix.documents.join(taken, "_row", "left")
    return out.select(F.col("_key").alias("doc_id"), F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
