"""Toxicity by a convolutional text classifier, trained in numpy.

A word and its beginnings are hashed to rows of an embedding table, which add up to the word's
embedding, so that forms of one stem share what is learnt; filters of several widths run over a
whole text, each keeps its largest response (max pooling), and a logistic layer turns them into a
score.  Labels come from a bounded sample of rows; the score is shifted so that the best cut
on rows kept apart from training is the given threshold, and each language gets a cut of its own
for flags.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.text import Hasher, Words, binaries, mix, pieces, signed

#: Hash space of embedding rows; size of an embedding; filter widths; filters of each width.
HASH_BITS, SIZE, WIDTHS, FILTERS = 24, 8, (1, 2, 3), 12
#: Besides itself, a word has rows for its first so many bytes, if it is longer.
BEGINNINGS = (3, 4, 5, 6)
#: Labelled rows used of each class, at most (those with the lowest hash of their key).
TOXIC, CLEAN = 2500, 4000
#: What stands in fewer documents of the sample has no row of its own.
MIN_DOCS = 4
#: A document is called toxic from this score on (a fixed value).
THRESHOLD = 0.3

_HASH = Hasher(23)
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = False


class Tokens:
    """Words (runs of letters, A-Z lower-cased) of a batch of texts: hash of each, and n + 1 offsets."""

    def __init__(self, column: pa.Array):
        self.words = Words(column, separator=_NOT_LETTER, fold=True)
        self.first = self.words.first.astype(np.int64)
        self.hash = _HASH.word(self.words.data, self.words.start, self.words.end)

    def features(self, at: np.ndarray) -> np.ndarray:
        """Hash rows of the given words: the word and its beginnings; -1 where it is not longer."""
        start, end = self.words.start[at], self.words.end[at]
        out = np.full((len(at), 1 + len(BEGINNINGS)), -1, np.int64)
        cut = np.uint64(64 - HASH_BITS)
        out[:, 0] = self.hash[at] >> cut
        for k, n in enumerate(BEGINNINGS):
            longer = end - start > n
            out[longer, k + 1] = mix(_HASH.word(self.words.data, start[longer], start[longer] + n) + np.uint64(n)) >> cut
        return out


@dataclass
class Network:
    """Embedding rows of the hash rows that have one (``known``, sorted); row 0 is any other and padding."""

    known: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, SIZE, FILTERS)
    offset: list[np.ndarray]
    out: np.ndarray
    bias: float
    shift: float = 0.0
    cuts: dict = field(default_factory=dict)  # language: score from which it is flagged; None: any other

    def rows(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(hashed.shape, np.int64)
        at = np.searchsorted(self.known, hashed)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == hashed, at + 1, 0)

    def responses(self, features: np.ndarray) -> list[list[np.ndarray]]:
        """What each word (row of features; the last one is padding) adds to each filter, at each place in it."""
        rows = np.concatenate([self.rows(features), np.zeros((1, features.shape[1]), np.int64)])
        embedded = self.table[rows].sum(1)
        return [[embedded @ w[o] for o in range(len(w))] for w in self.filters]

    def logits(self, rows: np.ndarray, first: np.ndarray, responses: list[list[np.ndarray]]) -> np.ndarray:
        """One logit for each text, any length, whose words are rows of ``responses``; no words: one padding word."""
        pad = max(len(w) for w in self.filters)
        count = np.diff(first)
        start = np.concatenate([[0], np.cumsum(count + pad)])
        padded = np.full(start[-1], len(responses[0][0]) - 1)
        padded[np.arange(len(rows)) + np.repeat(start[:-1] - first[:-1], count)] = rows
        ends = start[:-1] + np.maximum(count, 1)
        segments = np.stack([start[:-1], ends], 1).ravel()
        total = np.full(len(count), self.bias, np.float64)
        at = 0
        for places, b in zip(responses, self.offset):
            seen = places[0][padded]
            for o in range(1, len(places)):
                seen[:-o] += places[o][padded[o:]]
            pooled = np.maximum.reduceat(seen, segments, axis=0)[::2] + b
            total += np.maximum(pooled, 0) @ self.out[at: at + len(b)]
            at += len(b)
        return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[np.ndarray], features: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 5) -> Network:
    """Adagrad on the weighted logistic loss; the gradient of a filter goes to the words it kept.

    A text is a list of rows of ``features``, which has the hash rows of each word.
    """
    rng = np.random.default_rng(seed)
    every, place = np.unique(features, return_inverse=True)
    place = place.reshape(features.shape)
    docs = np.zeros(len(every), np.int64)
    for t in texts:
        docs[np.unique(place[np.unique(t)])] += 1
    known = every[(docs >= MIN_DOCS) & (every >= 0)]
    net = Network(known, rng.normal(0, 0.05, (len(known) + 1, SIZE)).astype(np.float32), [rng.normal(0, 0.4, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS), 0.0)
    net.table[0] = 0
    pad = max(WIDTHS)
    row_of = np.concatenate([net.rows(features), np.zeros((1, features.shape[1]), np.int64)]).astype(np.int32)
    rows = [np.concatenate([t, np.full(pad, len(features))]).astype(np.int32) for t in texts]
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    square = {"table": np.full(net.table.shape, 1e-3, np.float32), "out": np.full(net.out.shape, 1e-3), "bias": 1e-3, **{k: np.full(net.filters[k].shape, 1e-3) for k in range(len(WIDTHS))}, **{f"b{k}": np.full(FILTERS, 1e-3) for k in range(len(WIDTHS))}}

    def step(name, value, grad):
        square[name] += grad * grad
        return value - rate * grad / np.sqrt(square[name])

    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            ids = order[i:i + batch]
            kept = np.zeros((len(ids), len(WIDTHS), FILTERS), np.int64)
            pooled = np.zeros((len(ids), len(WIDTHS), FILTERS), np.float32)
            for j, d in enumerate(ids):
                r = rows[d]
                n = max(len(r) - pad, 1)
                e = net.table[row_of[r]].sum(1)
                for k, w in enumerate(net.filters):
                    seen = e[:n] @ w[0]
                    for o in range(1, len(w)):
                        seen += e[o:o + n] @ w[o]
                    kept[j, k] = seen.argmax(0)
                    pooled[j, k] = seen.max(0) + net.offset[k]
            active = np.maximum(pooled, 0).reshape(len(ids), -1)
            error = (_sigmoid(active @ net.out + net.bias) - labels[ids]) * weight[ids] / len(ids)
            back = ((error[:, None] * net.out[None]).reshape(pooled.shape) * (pooled > 0)).astype(np.float32)
            touched, table_grad = [], []
            for k, w in enumerate(net.filters):
                grad = np.zeros_like(w)
                for o in range(len(w)):
                    at = np.stack([rows[d][kept[j, k] + o] for j, d in enumerate(ids)])
                    into = row_of[at]
                    grad[o] = np.einsum("jf,jfs->sf", back[:, k], net.table[into].sum(2))
                    touched.append(into.ravel())
                    table_grad.append(np.repeat((back[:, k, :, None] * w[o].T[None]).reshape(-1, SIZE), into.shape[2], axis=0))
                net.filters[k] = step(k, w, grad).astype(np.float32)
                net.offset[k] = step(f"b{k}", net.offset[k], back[:, k].sum(0)).astype(np.float32)
            net.out = step("out", net.out, active.T @ error + 1e-4 * net.out)
            net.bias = float(step("bias", net.bias, error.sum()))
            where, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            grad = np.zeros((len(where), SIZE), np.float32)
            np.add.at(grad, inverse, np.concatenate(table_grad))
            grad += 1e-5 * net.table[where]
            grad[where == 0] = 0
            square["table"][where] += grad * grad
            net.table[where] -= rate * grad / np.sqrt(square["table"][where])
    return net


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float | None:
    """The cut with the highest F1, in the middle of its gap; None without both classes."""
    if labels.min(initial=1) == labels.max(initial=0):
        return None
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else s[i] - 1)) / 2)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str | None = "lang", toxic: int = TOXIC, clean: int = CLEAN, threshold: float = THRESHOLD) -> Network | None:
    """Train on the given labels' sample, four fifths of it; shift and cuts come from the rest.

    Of a key labelled twice the highest label counts; of a key in several rows the first text by
    order (and its first language) is learnt from, so no more rows than keys are gathered.  Without labels of both classes there is
    no network.
    """
    spark = docs.sparkSession
    one = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    chosen = [r for value, most in ((1, toxic), (0, clean)) for r in one.where(F.col("_label") == value).orderBy(F.xxhash64("_key"), "_key").limit(most).collect()]
    few = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], one.schema))  # toxic + clean rows at most
    language = F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string")
    known = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), language.alias("_lang")).join(few, "_key")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                t = Tokens(part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("_key").cast(pa.string()), part.column("_lang"), part.column("_label"), binaries(t.hash.view(np.uint8), t.first * 8)], ["k", "lang", "label", "words"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                t = Tokens(part.column("_text"))
                h, at = np.unique(t.hash, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), *[pa.array(c) for c in t.features(at).T]], ["word", *[f"f{k}" for k in range(1 + len(BEGINNINGS))]])

    known = known.groupBy("_key", "_label").agg(F.min(F.struct(F.col("_text").isNull().alias("none"), "_text", "_lang")).alias("row"))
    known = known.select("_key", "row._text", "row._lang", "_label")
    rows = sorted(known.mapInArrow(hashed, "k string, lang string, label int, words binary").collect(), key=lambda r: (r.k, bytes(r.words)))
    names = [f"f{k}" for k in range(1 + len(BEGINNINGS))]
    words = known.mapInArrow(distinct, "word long, " + ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*[F.min(n).alias(n) for n in names]).toArrow()
    word = words.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    word, features = word[order], np.stack([words.column(n).to_numpy() for n in names], 1)[order]
    texts = [np.searchsorted(word, np.frombuffer(bytes(r.words), np.uint64)) for r in rows]
    y, langs = np.array([r.label for r in rows], np.int64), [r.lang for r in rows]
    apart = np.arange(len(rows)) % 5 == 4
    if len(rows) < 10 or y[~apart].min() == y[~apart].max():
        return None
    net = train([t for t, a in zip(texts, apart) if not a], features, y[~apart])
    responses = net.responses(features)

    def logits(ids):
        own = [texts[i] for i in ids]
        return net.logits(np.concatenate([*own, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64), responses)

    check = np.flatnonzero(apart)
    raw = np.concatenate([logits(check[i:i + 200]) for i in range(0, len(check), 200)] or [np.zeros(0)])
    cut = best_cut(raw, y[check])
    net.shift = np.log(threshold / (1 - threshold)) - (0.0 if cut is None else cut)
    score = _sigmoid(raw + net.shift)
    net.cuts = {None: threshold}
    for name in {langs[i] for i in check}:
        own = np.array([langs[i] == name for i in check])
        found = best_cut(score[own], y[check][own]) if y[check][own].sum() >= 10 else None
        net.cuts[name] = threshold if found is None else min(max(found, 0.0), 1.0)
    return net


def score(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", lang: str | None = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """Every row's key, score, predicted (score >= threshold) and flagged (by its language's cut).

    The score depends on the text alone.  Null and empty texts are scored like a text of
    unknown words; repeated rows and null keys each get their row; without a network all scores are 0.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for part in pieces(batch, "text"):
                s = np.zeros(part.num_rows)
                if own:
                    t = Tokens(part.column("text"))
                    _, at, which = np.unique(t.hash, return_index=True, return_inverse=True)
                    s = _sigmoid(own.logits(which, t.first, own.responses(t.features(at))) + own.shift)
                cut = [own.cuts.get(x, threshold) if own else threshold for x in part.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(s >= np.array(cut, np.float64))], ["key", "score", "predicted", "flagged"])

    language = f"CAST(`{lang}` AS string)" if lang else "CAST(null AS string)"
    out = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text", f"{language} AS lang").mapInArrow(run, f"key {dict(docs.dtypes)[key]}, score double, predicted int, flagged boolean")
    return out.withColumnRenamed("key", key)


def held_out(key):
    """Rows whose labels are never learnt from: crc32 of the key as text leaves 2 by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a network that learns from labels of rows not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "flagged")
