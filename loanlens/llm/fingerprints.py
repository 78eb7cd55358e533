"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle is hashed once; the upper bits of the hash choose a bin, the lowest hash of a bin
stands for it.  A bin without shingles takes the value of a filled one, by optimal densification:
it probes bins at random, by hashes of its own number, until one is filled (after a few probes
the remaining bins follow in an order drawn by hashing).  So two sets agree in a densified bin
with the probability of their similarity.  Of each value the low bits are kept, packed into
longs; chance agreement of the bits that are kept is taken off an estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.shared import materialize

#: Words in a shingle, bins (a power of two), and bits kept of each bin's hash (whole hexadecimal digits).
SHINGLE, BINS, BITS = 5, 128, 8
#: What separates words, for Java's patterns.
SPACES = r"[\x20\x09-\x0D]+"
#: The end of a text that an edit replaces: one in so many code points.
EDITED = 4
#: Separates the hashes that draw orders of bins from those of shingles.
_DRAW = 77
#: Bins that an empty one tries before all others are drawn: most empty bins find a filled one, and need no draw over all.
PROBES = 6


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once: a lambda's variable is not computed again wherever it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, sorted; fewer words are one run, no words none."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda seed, x: F.xxhash64(seed, x)))
        every = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) == 0, none).when(F.size(h) < size, whole).otherwise(F.sort_array(every))

    return _let(hashed, runs)


def fingerprint(text: Column, size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> Column:
    """The text's fingerprint: the low ``bits`` of each bin, packed into longs; no words (or null): no longs.

    Equal texts have equal fingerprints, and so have texts with the same set of shingles.
    ``bits`` is 4, 8 or 16.
    """
    shift = 64 - (bins.bit_length() - 1)
    bin_of = lambda h: F.shiftrightunsigned(h, shift).cast("int")
    per_long, mask = 64 // bits, F.lit((1 << bits) - 1)

    def lowest(h: Column) -> Column:
        # sorted as signed numbers, so a bin's hashes stand side by side, the lowest first
        own = F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1))))
        return F.transform(own, lambda x: F.struct(bin_of(x).alias("bin"), x.alias("low")))

    def densify(filled: Column) -> Column:
        empty = F.array_except(F.sequence(F.lit(0), F.lit(bins - 1)), F.transform(filled, lambda x: x["bin"]))
        none = F.transform(empty, lambda b: F.struct(b.alias("bin"), F.lit(None).cast("long").alias("low")))

        def fill(every: Column) -> Column:
            # an empty bin tries bins at random, and then all others in an order drawn by hashing: one fixed order of all bins
            probe = lambda b, k: F.get(every, F.xxhash64(b, F.lit(k)).bitwiseAND(F.lit(bins - 1)).cast("int"))["low"]
            rest = lambda b: F.array_min(F.transform(filled, lambda x: F.struct(F.xxhash64(b, x["bin"], F.lit(_DRAW)).alias("at"), x["low"].alias("low"))))["low"]
            return F.transform(every, lambda x: F.coalesce(x["low"], *[probe(x["bin"], k) for k in range(PROBES)], rest(x["bin"])).bitwiseAND(mask))

        return _let(F.sort_array(F.concat(filled, none)), fill)

    def pack(low: Column) -> Column:
        def word(w: Column) -> Column:
            out = F.get(low, w * per_long)
            for k in range(1, per_long):
                out = F.shiftleft(out, bits).bitwiseOR(F.get(low, w * per_long + k))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(bins // per_long - 1)), word)

    none = F.array().cast("array<bigint>")
    some = lambda v: F.when(F.size(v) > 0, _let(densify(v), pack)).otherwise(none)
    return F.coalesce(_let(_let(shingle_hashes(text, size), lowest), some), none)


def as_text(print_: Column) -> Column:
    """A fingerprint as hexadecimal digits; one without longs as an empty string."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingles, 0 to 1.

    Of k bins m agree; bits that are kept agree by chance in 1 of 2**bits, so the estimate is
    (m / k - c) / (1 - c) with c = 2**-bits, held between 0 and 1.  Equal fingerprints (two
    empty ones too) give 1, an empty and another one 0.
    """
    chance = 2.0 ** -bits
    lowest = sum(1 << (bits * k) for k in range(64 // bits))  # the last bit of each bin

    def differ(x: Column, y: Column) -> Column:
        bit, half = x.bitwiseXOR(y), bits // 2
        while half:  # any bit of a bin comes down to its last one
            bit = bit.bitwiseOR(F.shiftrightunsigned(bit, half))
            half //= 2
        return F.bit_count(bit.bitwiseAND(F.lit(lowest)))

    agree = bins - F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda total, n: total + n)
    estimate = (agree / bins - chance) / (1 - chance)
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def following(ids: DataFrame, id_: str) -> DataFrame:
    """(id, next): each of the distinct ``ids`` and the one after it in their order; after the last, the first.

    Ids are numbered by a range partitioning and meet their next on the number, so no task sorts
    them all.  A single id follows itself.
    """
    ordered = ids.repartitionByRange(F.col(id_).asc()).sortWithinPartitions(F.col(id_).asc())
    placed = materialize(ordered.select(id_, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    sizes = placed.groupBy("p").agg(F.count("*").alias("c"))
    # one row a partition
    before = sizes.select("p", F.coalesce(F.expr("sum(c) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)).alias("before"))
    numbered = placed.join(before, "p").select(id_, (F.col("before") + F.col("i")).alias("n"))
    n = placed.count()
    after = numbered.select(F.col(id_).alias("next"), F.pmod(F.col("n") - 1 + n, F.lit(max(n, 1))).alias("n"))
    return numbered.join(after, "n").select(id_, "next")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(key, n_chars, text, fingerprint, edited, edited_fingerprint, next_fingerprint) of every row.

    An edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document, in ascending order of the key, after the last the first.  Null
    texts are empty ones; rows that agree in key and text are one document of the order, and each
    has its row; of other rows with a repeated key, a hash of the text decides, then its length;
    a null key stands before all others; a single document is its own next.  Texts are shuffled
    once, to meet what is asked of them, and again only the part that another text takes over.
    Other columns are not read.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole.alias("text"))
    rows = rows.select(F.struct("key", F.xxhash64("text").alias("hash"), F.length("text").alias("n")).alias("id"), "text", fingerprint(F.col("text"), size, bins, bits).alias("print"))
    ids = rows.select("id").distinct()
    pairs = materialize(following(ids, "id"))
    # what each text is asked for: its first code points, for the text before it
    asked = pairs.select(F.col("next").alias("id"), F.col("id").alias("to"), F.floor(F.col("id.n") / EDITED).cast("int").alias("need"))
    given = rows.join(asked, "id").select("to", F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("print").alias("next_print"))
    # repeated rows give the same, one of them is enough
    given = given.groupBy("to").agg(F.first("head").alias("head"), F.first("next_print").alias("next_print")).withColumnRenamed("to", "id")
    both = rows.join(given, "id", "left")
    left = F.substring("text", F.lit(1), F.col("id.n") - F.floor(F.col("id.n") / EDITED).cast("int"))
    both = both.select("id", "text", "print", "next_print", F.concat(left, "head").alias("edited"))
    return both.select(F.col("id.key").alias(key), F.col("id.n").cast("long").alias("n_chars"), "text", F.col("print").alias("fingerprint"), "edited", fingerprint(F.col("edited"), size, bins, bits).alias("edited_fingerprint"), F.col("next_print").alias("next_fingerprint"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    out = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own = F.col("fingerprint")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), likeness(own, F.col("edited_fingerprint")).alias("near_edited"), likeness(own, F.col("next_fingerprint")).alias("near_next"))
