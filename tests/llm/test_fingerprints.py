"""Fingerprints against plain Python, edits and their order on odd rows, accuracy of the estimate."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loanlens.llm import fingerprints as fp
from loanlens.llm.shared import materialize

BINS = 1 << 7


def long_hash(x, seed=42):
    return xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)


def int_hash(x, seed=42):
    return xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed)


def shingles(text, size=5):
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not hashed:
        return set()
    if len(hashed) < size:
        seed = 42
        for h in hashed:
            seed = long_hash(h, long_hash(seed))
        return {seed}
    out = set()
    for i in range(len(hashed) - size + 1):
        seed = 42
        for h in hashed[i:i + size]:
            seed = long_hash(h, seed)
        out.add(seed)
    return out


def brute(text, bins=BINS, bits=8, size=5):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    low = {}
    for h in shingles(text, size):
        b = h * bins >> 64
        low[b] = min(low.get(b, h), h, key=signed)
    if not low:
        return ""
    out = []
    for b in range(bins):
        probes = [int_hash(k, int_hash(b)) % bins for k in range(fp.PROBES)]
        drawn = lambda b=b: min(low, key=lambda f: signed(int_hash(fp._DRAW, int_hash(f, int_hash(b)))))
        found = [b] * (b in low) + [f for f in probes if f in low]
        at = found[0] if found else drawn()
        out.append(f"{low[at] % (1 << bits):0{bits // 4}x}")
    return "".join(out)


def like(a, b, bins=BINS, bits=8):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    d, chance = bits // 4, 2.0 ** -bits
    m = sum(a[i:i + d] == b[i:i + d] for i in range(0, bins * d, d))
    return max(0.0, min(1.0, (m / bins - chance) / (1 - chance)))


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def odd_texts():
    rng = random.Random(4)
    texts = [" ".join(words(rng, n)) for n in (1, 2, 4, 5, 6, 9, 20, 60, 200, 1000)]
    texts += [None, "", "  \t\n", "é ü 😀😀 ñandú", "😀" * 9, "a b c\x0bd\x0ce", texts[8], texts[8][:-3], "x" * 200_000 + " end", " ".join(words(rng, 40_000))]
    return texts


def test_fingerprints(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "i int, t string")
    for bins, bits, size in ((128, 8, 5), (32, 4, 3), (256, 16, 1)):
        got = {r.i: r.p for r in frame.select("i", fp.as_text(fp.fingerprint(F.col("t"), size, bins, bits)).alias("p")).collect()}
        assert got == {i: brute(t, bins, bits, size) for i, t in enumerate(odd_texts())}
        printed = materialize(frame.select("i", fp.fingerprint(F.col("t"), size, bins, bits).alias("p")))
        pairs = printed.alias("a").crossJoin(printed.alias("b")).select(F.col("a.i").alias("x"), F.col("b.i").alias("y"), fp.likeness(F.col("a.p"), F.col("b.p"), bins, bits).alias("like"))
        assert all(abs(r.like - like(got[r.x], got[r.y], bins, bits)) < 1e-12 for r in pairs.collect())


def test_estimate_is_unbiased(spark):
    rng, rows, true = random.Random(8), [], []
    for n in (12, 40, 150, 600):
        for share in (0.2, 0.5, 0.8, 0.95):
            for _ in range(30):
                a = words(rng, n)
                b = a[: int(n * share)] + words(rng, n - int(n * share))
                s, t = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a, b))
                true.append((n, share, len(s & t) / len(s | t)))
                rows.append((len(rows), " ".join(a), " ".join(b)))
    frame = spark.createDataFrame(rows, "i int, a string, b string").repartition(8)
    got = {r.i: r.like for r in frame.select("i", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("like")).collect()}
    error = np.array([got[i] - t for i, (_, _, t) in enumerate(true)])
    small = np.array([n < 100 for n, _, _ in true])
    assert abs(error.mean()) < 0.015 and np.sqrt((error[~small] ** 2).mean()) < 0.06
    assert abs(error[small].mean()) < 0.03 and np.sqrt((error[small] ** 2).mean()) < 0.15


def test_edits(spark):
    texts = odd_texts()
    rows = [(7 * i % 100, t, "z") for i, t in enumerate(texts)] + [(7, texts[9], "z"), (7, texts[1], "z"), (None, "no key but four words", "z"), (None, None, "z"), (None, None, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, edited string").repartition(3)
    got = fp.edited(frame).collect()
    assert len(got) == len(rows)
    h = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted({(k is not None, k or 0, h(t or ""), len(t or ""), t or "") for k, t, _ in rows})
    want = []
    for k, t, _ in rows:
        t = t or ""
        at = order.index((k is not None, k or 0, h(t), len(t), t))
        after, n = order[(at + 1) % len(order)][-1], len(t) // 4
        text = t[: len(t) - n] + after[:n]
        want.append((k, len(t), t, text, brute(t), brute(text), brute(after)))
    packed = lambda x: "".join(f"{v % (1 << 64):016x}" for v in x)
    got = [(r.doc_id, r.n_chars, r.text, r.edited, packed(r.fingerprint), packed(r.edited_fingerprint), packed(r.next_fingerprint)) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str)
    one = fp.edited(frame.where("text = 'x'").unionByName(spark.createDataFrame([(1, "a b c d e f g h", "")], frame.schema))).collect()
    assert [(r.edited, r.next_fingerprint == r.fingerprint) for r in one] == [("a b c d e f a b"[:12] + "a b", True)]
    assert fp.edited(frame.limit(0)).collect() == []


def test_query_over_the_table(spark):
    from loanlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op11_fingerprints"](spark, sf).collect()}
    assert len(got) == len(docs)
    for (k, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        n, r = len(t) // 4, got[k]
        text = t[: len(t) - n] + after[:n]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(text.encode()).hexdigest(), brute(t), brute(text))
        assert abs(r.near_edited - like(brute(t), brute(text))) < 1e-12 and abs(r.near_next - like(brute(t), brute(after))) < 1e-12


def test_no_python_in_the_plan(spark):
    from loanlens.llm.fingerprints import op11

    plan = op11(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
