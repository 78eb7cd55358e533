"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its word shingles.  All tokens (shingles) stand in one order, rare
before frequent; a document's prefix is so long that a similar document must share something
in it.  Tokens are counted where prefixes can reach them: in the first tokens by hash, twice as
many as a prefix has, and in all tokens of a document that finds too few rare ones there.  Rare
tokens are indexed alone.  Frequent tokens fall into classes and are indexed as pairs inside a
class, for documents of about one size; since one shared token of a class is then invisible, the
prefix is extended by one token for each class it touches.  Documents that share an index entry are
candidates.  A candidate pair is dropped when the parities of its tokens' hash buckets differ
in more places than two similar sets can differ in tokens; the others hold their documents
together as a group.  Entries first pair their documents with a few of them, then documents of
different groups with each other, so that large groups need few pairs and no candidate is
missed.  Each group is then verified on the whole sets, each of which is sent once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.shared import Bits, components, discard, materialize
from loanlens.llm.text import Hasher, Roller, Words, mix, pieces, signed

#: Words in a shingle; similarity (in hundredths) from which documents are linked.
SHINGLE, PERCENT = 5, 80
#: A token that more documents than this have where it is counted, in one round of counting, is frequent.
FREQUENT = 8
#: Rounds of counting at most; results don't depend on it, tokens not counted are taken for rare ones.
COUNTS = 5
#: Longs of parity bits that a document is sketched with, at least.
SKETCH = 16
#: A shorter sketch that the last round's join looks at: one long each.
FOLDS = tuple(f"f{i}" for i in range(8))
#: Entries of a document that its rows in that join carry, to tell a pair that an earlier entry makes; results don't depend on it.
SEEN = 64
#: Rounds in which the documents of an entry meet some of them, and with how many.
ROUNDS, CENTERS = 2, 2
#: Tokens that a verifying task holds of one side, about; larger groups are split.
BLOCK = 1 << 20
#: Prefix tokens of a class that one pair of frequent tokens is drawn from, about.
_CLASS = 8

_HASH, _SETS = Hasher(41), (Roller(43), Roller(47))


def shingles(column: pa.Array, size: int) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, sorted; fewer words than a shingle are one shingle, no words none."""
    words = Words(column, fold=True)
    one = _HASH.word(words.data, words.start, words.end)
    start, share = words.windows(size)
    every = _HASH.sequence(one, start, start + size)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    whole = _HASH.sequence(one, words.first[short], words.first[short] + words.count[short])
    out = [np.unique(every[a:z]) for a, z in zip(share[:-1].tolist(), share[1:].tolist())]
    for i, h in zip(short.tolist(), whole):
        out[i] = np.array([h], np.uint64)
    return out


def prefix_length(n: int, percent: int) -> int:
    """So many tokens that a similar document can't lack them all."""
    return n - -(-percent * n // 100) + 1


def classes(n: int, percent: int) -> list[int]:
    """Numbers of classes that a document of n tokens is indexed with.

    The number is fixed by the power of two below the smaller document's size, so a document
    that may be the larger one of a pair is indexed for the smaller one's power too.
    """
    powers = range((-(-percent * n // 100)).bit_length() - 1, n.bit_length())
    return sorted({max(1, (1 << p) * (100 - percent) // 100 // _CLASS) for p in powers})


def size_classes(n: int, percent: int) -> range:
    """Numbers of size classes that a set of n tokens is indexed for: similar sets have one in common."""
    at = math.log(n) / math.log(100 / percent) if percent < 100 else float(n)
    return range(math.floor(at - 1e-6) + 1, math.floor(at + 1e-6) + 3)


def reach(h: np.ndarray, percent: int, often: list) -> int:
    """How many of a set's tokens are counted: twice its prefix, or all if some round left it fewer rare ones than a prefix has."""
    want = prefix_length(len(h), percent) if len(h) else 0
    end = min(2 * want, len(h))
    for frequent in often:
        if end < len(h) and np.count_nonzero(~frequent.test(h[:end])) < want:
            return len(h)
    return end


def index_entries(h: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rare tokens of the prefix, and hashes of the pairs of its frequent tokens."""
    want = prefix_length(len(h), percent)
    rare = h[~frequent][:want]
    missing = want - len(rare)
    if not missing:
        return rare, h[:0]
    common, entries = h[frequent], []
    for k in classes(len(h), percent):
        kind = (mix(common) % np.uint64(k)).astype(np.int64)
        counted = np.ones(len(common), np.int64)
        counted[np.unique(kind, return_index=True)[1]] = 0  # the first token of a class forms no pair
        reach = np.searchsorted(np.cumsum(counted), missing) + 1
        taken, kinds = common[:reach], kind[:reach]
        for c in np.unique(kinds):
            own = taken[kinds == c]
            a, b = np.triu_indices(len(own), 1)
            pairs = mix(own[a] * np.uint64(0x9E3779B97F4A7C15) + own[b]) ^ np.uint64(k)
            entries += [mix(pairs + np.uint64(z)) for z in size_classes(len(h), percent)]
    return rare, np.concatenate(entries) if entries else h[:0]


def parities(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each document (n of the tokens in a row): whether each hash bucket holds an odd number of its tokens.

    A document has 64 * SKETCH buckets, or the next power of two above its tokens if that is more.
    """
    longs = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).clip(0).astype(np.int64))
    ends = np.cumsum(longs)
    bucket = np.repeat((ends - longs) * 64, n) + (mix(flat) % np.repeat(longs * 64, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bucket, minlength=ends[-1] * 64 if len(ends) else 0) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.packbits(odd).view(np.int64)))


def _each(docs: DataFrame, size: int, schema: str, emit, only=None) -> DataFrame:
    """Run ``emit(key, sets)`` -> arrays on pieces of (doc, text); ``only``: Bits of hashed keys to look at."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(only.value.test(np.asarray(batch.column("h"), np.int64).view(np.uint64))))
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(emit(np.asarray(part.column("doc"), np.int64), shingles(part.column("text"), size)), names)

    return docs.mapInArrow(run, schema)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """Every row's key, n_shingles and component_id (smallest key reachable by links, itself included).

    A-Z are lower-cased; documents link when 100 * intersection >= percent * union of their sets.
    Null, empty and blank texts have no shingles and link with nothing; equal sets are one
    document while others are compared; rows with a repeated key are one node, whatever their
    texts; a null key has no component and takes no part.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingles(part.column("text"), size)
                n = np.array([len(s) for s in sets], np.int64)
                ends = np.cumsum(n)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                a, b = (r.spans(flat, ends - n, ends) for r in _SETS)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n), pa.array(signed(a)), pa.array(signed(b)), parities(flat, n)], ["doc", "n", "a", "b", "sketch"])

    listed = materialize(rows.mapInArrow(keyed, "doc long, n long, a long, b long, sketch array<long>"))
    sets = listed.where("doc IS NOT NULL AND n > 0")
    firsts = materialize(sets.groupBy("n", "a", "b").agg(F.min("doc").alias("rep")))
    copies = sets.join(firsts, ["n", "a", "b"]).where("doc <> rep").select("doc", "rep")
    # one document for each set goes on (and a few copies, as Bits may take one for another)
    reps = spark.sparkContext.broadcast(Bits.build(firsts.select(F.xxhash64("rep").alias("h")), "h"))
    known = rows.where("doc IS NOT NULL").withColumn("h", F.xxhash64("doc"))
    links = similar(known, reps, listed.where("doc IS NOT NULL").select("doc", "n", "sketch"), size, percent, frequent)
    reps.destroy()
    parts = components(copies.unionByName(links.select(F.col("x").alias("doc"), F.col("y").alias("rep"))), "doc", "rep")
    discard(firsts, links)
    out = listed.join(parts, listed["doc"] == parts["node"], "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def similar(known: DataFrame, reps, sketches: DataFrame, size: int, percent: int, frequent: int) -> DataFrame:
    """Enough verified links (x, y) between documents that their components are those of all links."""
    spark = known.sparkSession

    def flat(doc: np.ndarray, parts: list[np.ndarray]) -> list[pa.Array]:
        n = [len(p) for p in parts]
        return [pa.array(np.repeat(doc, n)), pa.array(signed(np.concatenate([*parts, np.zeros(0, np.uint64)])))]

    # 1. how many documents have a token where it is counted; a round counts what the last one's frequent tokens uncover
    often, frequents, uncovered = [], [], []
    twice = None
    while len(often) < COUNTS:
        def tokens(doc, sets, before=often[:-1], now=often[:]):
            out = []
            for s in sets:
                end = reach(s, percent, [o.value for o in now])
                start = reach(s, percent, [o.value for o in before]) if now else 0
                out.append(s[start:end])
            return flat(doc, out)

        counts = _each(known, size, "doc long, token long", tokens, reps).groupBy("token").agg(F.count("*").alias("n"))
        if not often:
            counts = materialize(counts.where("n > 1"))
            twice = spark.sparkContext.broadcast(Bits.build(counts.select("token"), "token"))
        else:
            counts = materialize(counts)
            uncovered.append(counts)
        new = materialize(counts.where(F.col("n") > frequent).select("token"))
        if often and new.isEmpty():
            discard(new)
            break
        frequents.append(new)
        often.append(spark.sparkContext.broadcast(Bits.build(reduce(DataFrame.unionByName, frequents).distinct(), "token")))
        if len(often) == 1:
            discard(counts)
            if new.isEmpty():
                break
    more = spark.createDataFrame([], "token long")
    for counts in uncovered:
        more = more.unionByName(counts.select("token"))
    more = spark.sparkContext.broadcast(Bits.build(more.distinct(), "token"))
    discard(*frequents, *uncovered)

    # 2. index entries that can have two documents
    def entries(doc, sets):
        out = []
        for s in sets:
            if not len(s):
                out.append(s)
                continue
            end = reach(s, percent, [o.value for o in often])
            common = often[-1].value.test(s)
            rare, pairs = index_entries(s, common, percent)
            known_ = np.searchsorted(s, rare) < end
            out.append(np.unique(np.concatenate([rare[~known_ | twice.value.test(rare) | more.value.test(rare)], pairs])))
        return flat(doc, out)

    every = materialize(_each(known, size, "doc long, entry long", entries, reps))
    for b in (*often, twice, more):
        b.destroy()
    # of entries with the same documents (told by their number and two sums of hashes) one is enough
    same = [F.count("*").alias("c"), F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("total"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("odd")]
    shared = materialize(every.groupBy("entry").agg(*same).where("c > 1").groupBy("c", "total", "odd").agg(F.min("entry").alias("entry")).select("entry"))
    index = materialize(every.join(shared, "entry", "left_semi"))
    discard(every, shared)

    # 3. groups: components of the candidates that the sketches allow
    edges = materialize(spark.createDataFrame([], "x long, y long"))
    parts = materialize(spark.createDataFrame([], "node long, component long"))
    for round_ in range(ROUNDS + 1):
        now = index.join(parts.withColumnRenamed("node", "doc"), "doc", "left").select("entry", "doc", F.coalesce("component", "doc").alias("part"))
        # entries whose documents are not all in one group
        spread = [F.min("part").alias("p"), F.max("part").alias("q")]
        if round_ < ROUNDS:
            centers = F.array(*[F.min(F.struct(F.xxhash64("doc", F.lit(round_ * CENTERS + i)).alias("h"), F.col("doc").alias("y"), F.col("part").alias("y_part"))) for i in range(CENTERS)])
            open_ = materialize(now.groupBy("entry").agg(*spread, centers.alias("centers")).where("p < q").select("entry", "centers"))
            pairs = now.join(open_, "entry").select("doc", "part", F.explode("centers").alias("c")).select("doc", "part", "c.y", "c.y_part")
            used = [open_]
        else:  # all pairs of different groups: those outside an entry's main one with all others
            open_ = materialize(now.groupBy("entry").agg(*spread).where("p < q").select("entry"))
            now = materialize(numbered(now.join(open_, "entry", "left_semi")).join(folds(sketches), "doc"))
            mains = materialize(now.groupBy("entry", "part").agg(F.count("*").alias("c")).groupBy("entry").agg(F.max_by("part", F.struct("c", "part")).alias("main")))
            pairs = across(now, mains, percent)
            used = [open_, now, mains]
        pairs = pairs.where(F.col("part") != F.col("y_part")).select(F.least("doc", "y").alias("x"), F.greatest("doc", "y").alias("y")).distinct()
        more = materialize(edges.unionByName(possible(pairs, sketches, percent)))
        discard(edges, parts, *used)
        edges = more
        parts = materialize(components(edges, "x", "y"))
    discard(index, edges)
    links = verified(known, parts.join(sketches.select(F.col("doc").alias("node"), "n"), "node"), size, percent)
    discard(parts)
    return links


def numbered(rows: DataFrame) -> DataFrame:
    """(entry, doc, part) once each, with the smaller ones (``before``) of the document's SEEN smallest entries."""
    own = rows.groupBy("doc", "part").agg(F.array_sort(F.collect_set("entry")).alias("every"))
    own = own.select("doc", "part", F.slice("every", 1, SEEN).alias("seen"), F.explode("every").alias("entry"))
    return own.select("entry", "doc", "part", F.filter("seen", lambda x: x < F.col("entry")).alias("before"))


def across(rows: DataFrame, mains: DataFrame, percent: int) -> DataFrame:
    """Pairs (doc, part, y, y_part) of documents of different groups that share an entry and whose short sketches allow the similarity.

    ``rows``: those of ``numbered`` with the columns of ``folds``; ``mains``: each entry's largest
    group, outside which every document meets all others.  A pair comes from the first of the entries that its
    documents share (from some more if that is beyond SEEN), however many they are.
    """
    main = rows.join(mains, "entry")
    minor = main.where("part <> main").select("entry", *[F.col(c).alias(f"y_{c}" if c != "doc" else "y") for c in ("doc", "part", "n", "before", *FOLDS)])
    bits = reduce(lambda a, b: a + b, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"y_{c}"))) for c in FOLDS])
    fits = allowed(F.col("n"), F.col("y_n"), bits, percent) & (F.col("part") != F.col("y_part"))
    once = ((F.col("part") == F.col("main")) | (F.col("doc") < F.col("y"))) & ~F.arrays_overlap("before", "y_before")
    return main.join(minor, "entry").where(fits & once).select("doc", "part", "y", "y_part")


def folds(sketches: DataFrame) -> DataFrame:
    """(doc, n, the longs of FOLDS): sketches of as many buckets as FOLDS has bits, for a first look inside the join.

    A bucket of the short sketch holds the tokens of every so many of the long one, so their parities add up.
    """
    def fold(j: int):
        own = F.filter("sketch", lambda x, i: i % len(FOLDS) == j)
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, x: total.bitwiseXOR(x))

    return sketches.select("doc", "n", *[fold(j).alias(c) for j, c in enumerate(FOLDS)])


def allowed(n, other, bits, percent: int):
    """Whether sets of n and ``other`` tokens, whose sketches differ in ``bits``, can be similar: they differ in as many tokens at least."""
    sizes = (n * 100 >= other * percent) & (other * 100 >= n * percent)
    return sizes & (bits * (100 + percent) <= (n + other) * (100 - percent))


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow the similarity.

    Each token of one set alone flips one parity bit, so the sets differ in as many tokens as
    the sketches do in bits, at least.
    """
    for side in ("x", "y"):
        pairs = pairs.join(sketches.select(F.col("doc").alias(side), F.col("n").alias(f"{side}n"), F.col("sketch").alias(f"{side}s")), side)
    xor = lambda a, b: a.bitwiseXOR(b)

    def folded(own: str, other: str):
        """A sketch of twice the other's buckets, brought to as many: what shares a bucket then is added up."""
        half = (F.size(own) / 2).cast("int")
        return F.when(F.size(own) == 2 * F.size(other), F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), xor)).otherwise(F.col(own))

    pairs = pairs.withColumn("a", folded("xs", "ys")).withColumn("b", folded("ys", "xs"))
    differ = F.aggregate(F.zip_with("a", "b", lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda total, b: total + b)
    bits = F.when(F.size("a") == F.size("b"), differ).otherwise(0)
    return pairs.where(allowed(F.col("xn"), F.col("yn"), bits, percent)).select("x", "y").distinct()


def connect(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (x, y) that hold the similar documents of a group together: a star for each component.

    A document is compared with those that nothing has reached yet, by counting, so the work
    ends as soon as all are reached.
    """
    doc = group["doc"].to_numpy()
    sets = [np.frombuffer(t, np.uint64) for t in group["tokens"]]
    n = np.array([len(t) for t in sets])
    at = np.concatenate([[0], np.cumsum(n)])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(len(doc)), n)[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(token))])
    root = np.full(len(doc), -1)
    for seed in range(len(doc)):
        if root[seed] >= 0:
            continue
        root[seed], queue = seed, [seed]
        while queue and (root < 0).any():
            d = queue.pop()
            own = token[at[d]:at[d + 1]]
            size = start[own + 1] - start[own]
            ends = np.cumsum(size)
            shared = np.bincount(owner[np.arange(ends[-1]) + np.repeat(start[own] - (ends - size), size)], minlength=len(doc))
            near = np.flatnonzero((root < 0) & (shared * 100 >= (n[d] + n - shared) * percent))
            root[near] = seed
            queue += near.tolist()
    found = root != np.arange(len(doc))
    return pd.DataFrame({"x": doc[found], "y": doc[root[found]]})


def verified(known: DataFrame, parts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (x, y) inside groups (node, component, n) that connect what similar whole sets connect.

    A group whose sets are too large for one task is dealt into blocks, and each pair of blocks
    is a task.
    """
    spark = known.sparkSession
    blocks = materialize(parts.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")))
    dealt = parts.join(blocks, "component").select(F.col("node").alias("doc"), "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    dealt = materialize(dealt.distinct())
    discard(blocks)
    wanted = spark.sparkContext.broadcast(Bits.build(dealt.select(F.xxhash64("doc").alias("h")), "h"))

    def whole(doc, sets):
        return [pa.array(doc), pa.array([s.tobytes() for s in sets], pa.binary())]

    sets = _each(known, size, "doc long, tokens binary", whole, wanted).where(F.length("tokens") > 0)
    placed = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("doc", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = sets.join(placed, "doc").groupBy("component", "i", "j").applyInPandas(lambda g: connect(g, percent), "x long, y long").where("x <> y").distinct()
    links = materialize(links)
    wanted.destroy()
    discard(dealt)
    return links


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: 3-word shingles, similarity 0.9."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=90)


def oracle(size: int, percent: int) -> str:
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + {size - 1}], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {size - 2}, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= {percent} * (na.n + nb.n - p.c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(c.b, w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""


ORACLE = oracle(3, 90)
