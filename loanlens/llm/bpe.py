"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A merge joins two neighbours into one vocabulary token, so two bytes that stand side by side
in no token are never joined: between them a cut is certain.  The table of such pairs comes
from the vocabulary.  White space after a non-space byte is such a cut for every byte-level
vocabulary that is split before merging, and it also ends whatever the split pattern matches;
at those cuts whole batches of texts fall apart into chunks, in numpy.  A distinct chunk is
split by the vocabulary's pattern and at its other certain cuts, all chunks of a batch at once;
each distinct fragment is merged by itself, and the ids are put together; all other occurrences
only copy them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from loanlens.llm.text import SPACE, Hasher, Words, pieces

#: White space beyond ASCII right before ASCII white space: there a chunk would end inside what the pattern matches.
_WIDE_SPACE = re.compile(rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f])[ \t-\r]")
#: Distinct chunks and fragments that a task keeps, about 50 bytes each; beyond that it starts afresh.
KEEP = 1 << 18
KEEP_FRAGMENTS = 1 << 18


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or the next free code point from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file of the ``tokenizers`` library.

    ``joined[a, b]``: some token holds byte a right before byte b.  ``specials``: added tokens,
    which are cut out of a text before anything else.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        self._serves(raw)
        library = Tokenizer.from_file(path)
        self.model, self.pattern = library.model, library.pre_tokenizer
        back = {c: b for b, c in enumerate(byte_alphabet())}
        added = {t["content"]: t["id"] for t in raw["added_tokens"]}
        size = 1 + max([*raw["model"]["vocab"].values(), *added.values()])
        tokens = [b""] * size
        for text, i in raw["model"]["vocab"].items():
            tokens[i] = bytes(back[c] for c in text)
        for text, i in added.items():
            tokens[i] = text.encode()
        self.joined = np.zeros((256, 256), bool)
        for token in tokens:
            b = np.frombuffer(token, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        # white space after a word must be a cut; wide spaces, which end in one of the other bytes, are told apart by _WIDE_SPACE
        if self.joined[np.ix_(np.flatnonzero(~SPACE[:0x80] & (np.arange(0x80) > 0x1F)), np.flatnonzero(SPACE))].any():
            raise ValueError(f"{path}: a token joins a word to the white space after it")
        self.specials = added
        self.special_pattern = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        # the bytes of all tokens, one after another
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.codes = np.zeros(512, np.uint8)  # code point of the byte alphabet -> byte
        for c, b in back.items():
            self.codes[ord(c)] = b

    @staticmethod
    def _serves(raw: dict) -> None:
        """Refuse what the cuts don't hold for."""
        first, model = raw["pre_tokenizer"] or {}, raw["model"]
        faults = {
            "a normalizer": raw["normalizer"], "no byte-level pattern": first.get("type") != "ByteLevel" or not first.get("use_regex", True),
            "a space before the text": first.get("add_prefix_space"), "a model other than BPE": model["type"] != "BPE",
            "marks of word parts": model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"), "dropout": model.get("dropout"),
            "added tokens that take spaces or whole words": any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in raw["added_tokens"]),
        }
        if found := [name for name, fault in faults.items() if fault]:
            raise ValueError("this vocabulary has " + ", ".join(found))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where no token joins a byte to the one before it: positions 1 to the last."""
        return np.flatnonzero(~self.joined[data[:-1], data[1:]]) + 1

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens: pattern, certain cuts, merges."""
        out: list[int] = []
        for word, _ in self.pattern.pre_tokenize_str(text) if text else ():
            edge = [0, *self.cuts(self.codes[np.frombuffer(word.encode("utf-16-le"), np.uint16)]).tolist(), len(word)]
            for a, z in zip(edge, edge[1:]):
                out += [t.id for t in self.model.tokenize(word[a:z])]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of any text; special tokens first."""
        if not self.special_pattern:
            return self.plain(text)
        out, last = [], 0
        for m in self.special_pattern.finditer(text):
            out += [*self.plain(text[last:m.start()]), self.specials[m.group()]]
            last = m.end()
        return out + self.plain(text[last:])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - (ends - n), n)]


class Table:
    """Id sequences by 64-bit hash, in flat arrays."""

    def __init__(self):
        self.known = np.zeros(0, np.uint64)  # hashes, sorted
        self.row = np.zeros(0, np.int64)  # of each: its row below
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of those that are not here."""
        place = np.searchsorted(self.known, hashes)
        place[place == len(self.known)] = 0
        return np.flatnonzero(self.known[place] != hashes) if len(self.known) else np.arange(len(hashes))

    def add(self, hashes: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New hashes, how many ids each has, and the ids one after another."""
        self.row = np.concatenate([self.row, len(self.at) + np.arange(len(hashes))])
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        self.known = np.concatenate([self.known, hashes])
        order = np.argsort(self.known, kind="stable")
        self.known, self.row = self.known[order], self.row[order]

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all hashes, which are all here, one after another, and how many each has."""
        row = self.row[np.searchsorted(self.known, hashes)]
        count = self.count[row]
        ends = np.cumsum(count)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[row] - (ends - count), count)], count


class Encoder:
    """Encodes batches of texts; remembers the ids of the chunks and fragments it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.hash = Hasher(4)
        self.starts = [t.encode() for t in vocabulary.specials]
        self.forget()

    def forget(self) -> None:
        """Give back what chunks and fragments take up."""
        self.chunks, self.fragments = Table(), Table()

    def learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Ids of new chunks.

        Chunks of white space and a word stand in one string for the pattern, which ends its
        matches between them; what else there is goes to it one by one.  All pieces are cut in
        one array, and only fragments never met before are merged.
        """
        own = self.vocabulary
        joint = np.array([c[0] in b" \t\n\v\f\r" and c[-1] not in b" \t\n\v\f\r" for c in chunks], bool)
        order = np.concatenate([np.flatnonzero(joint), np.flatnonzero(~joint)])
        chunks = [chunks[i] for i in order.tolist()]
        n = int(joint.sum())
        words = [w for text in [b"".join(chunks[:n]), *chunks[n:]] for w, _ in own.pattern.pre_tokenize_str(text.decode())]
        letters = "".join(words)
        data = own.codes[np.frombuffer(letters.encode("utf-16-le"), np.uint16)]
        ends = np.cumsum([len(w) for w in words])
        start = np.union1d(own.cuts(data), np.concatenate([[0], ends[:-1]])).astype(np.int64)
        end = np.append(start[1:], len(data))
        h = self.hash.word(data, start, end)
        if len(self.fragments.known) > KEEP_FRAGMENTS:
            self.fragments = Table()
        distinct, first = np.unique(h, return_index=True)
        new = self.fragments.missing(distinct)
        merged = [[t.id for t in own.model.tokenize(letters[a:z])] for a, z in zip(start[first[new]].tolist(), end[first[new]].tolist())]
        self.fragments.add(distinct[new], np.array([len(m) for m in merged], np.int64), np.array([i for m in merged for i in m], np.uint32))
        ids, count = self.fragments.get(h)
        # a chunk's fragments stand side by side
        of = np.searchsorted(np.cumsum([len(c) for c in chunks]), start, "right")
        self.chunks.add(hashes[order], np.bincount(of, weights=count, minlength=len(chunks)).astype(np.int64), ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and n + 1 offsets."""
        words = Words(column)
        data, n = words.raw, len(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        raw = data.tobytes()
        alone = lambda x: any(s in x for s in self.starts) or _WIDE_SPACE.search(x)
        apart = {i for i in range(n) if alone(raw[words.offsets[i]:words.offsets[i + 1]])} if alone(raw) else set()
        # a chunk is white space and the word after it; what a document has after its last word is a chunk too
        docs = np.flatnonzero(np.diff(words.offsets) > 0)
        previous = np.concatenate([[0], words.end[:-1]])
        begin = np.maximum(previous, words.offsets[words.owner(words.count)])
        tail = np.where(words.count[docs] > 0, words.end[np.maximum(words.first[docs + 1] - 1, 0)] if len(words.end) else 0, words.offsets[docs])
        tail_end = words.offsets[docs + 1]
        rest = tail < tail_end
        begin, end = np.concatenate([begin, tail[rest]]), np.concatenate([words.end, tail_end[rest]])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        h = self.hash.word(data, begin, end)
        distinct, first = np.unique(h, return_index=True)
        if len(self.chunks.known) > KEEP:
            self.chunks = Table()
        missing = self.chunks.missing(distinct)
        if len(missing):
            spans = zip(begin[first[missing]].tolist(), end[first[missing]].tolist())
            self.learn(distinct[missing], [raw[a:z] for a, z in spans])
        ids, count = self.chunks.get(h)
        total = np.concatenate([[0], np.cumsum(count)])
        offsets = total[np.searchsorted(begin, words.offsets)]
        if apart:  # rare: these texts are encoded without the chunks
            parts, sizes = [], np.diff(offsets)
            for i in range(n):
                own = np.array(self.vocabulary.encode(raw[words.offsets[i]:words.offsets[i + 1]].decode()), np.uint32) if i in apart else ids[offsets[i]:offsets[i + 1]]
                parts.append(own)
                sizes[i] = len(own)
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        return ids, offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary file."""
    return Encoder(Vocabulary(path))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encode and decode every text: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``ids`` are little-endian unsigned 32-bit integers in one binary.  Each row is encoded by
    itself, whole: null and empty texts have no tokens, repeated rows and null keys stay as they
    are, other columns are not read.  ``path`` is a vocabulary file every executor can open.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, at = own.encode(part.column("text"))
                little = ids.astype("<u4")
                back = own.vocabulary.decode(ids)
                total = np.concatenate([[0], np.cumsum(own.vocabulary.length[ids])])[at]
                blobs = [little[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                decoded = [back[a:z].tobytes().decode("utf-8", "replace").encode() for a, z in zip(total[:-1].tolist(), total[1:].tolist())]
                columns = [part.column("key"), pa.array(np.diff(at), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in blobs], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * with_ids, [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        own.forget()  # the worker lives on, for other tasks and stages

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
