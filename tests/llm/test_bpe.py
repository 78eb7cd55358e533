"""BPE by forced-boundary splitting against the library's own encoder and decoder."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loanlens.llm import bpe

PATH = bpe.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Encoder(bpe.Vocabulary(PATH))

ODD = ["", " ", "\n", "a", "it's", "'s", "?'s x", "we'll  go\n\n now ", "a   b", "　\n x", "x    y", "tail  ", "  lead", "\x1c \x1d",
       "naïve Größe ñandú", "数据 处理", "🙂🙃 \U0001f469‍\U0001f4bb", "1234 56,78 9½", "<|endoftext|>", "a <|endoftext|>b<|endoftext|> ", "<|endoftext", "aaaa" * 500, "\t\tx\r\n\r\ny", "x" * 3000 + " " * 300]


def check(texts):
    ids, at = OWN.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        expect = LIBRARY.encode(text or "", add_special_tokens=False).ids
        got = ids[at[i]:at[i + 1]].tolist()
        assert got == expect, text
        assert OWN.vocabulary.decode(np.array(got, np.uint32)).tobytes().decode("utf-8", "replace") == LIBRARY.decode(expect, skip_special_tokens=False)


def test_odd_texts():
    check(ODD)
    check([None, None])
    check([])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'stZ9 .\n\t 　é数\x85\x1d!?")) | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_any_text(texts):
    check(texts)


def test_chunks_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 3)
    monkeypatch.setattr(bpe, "KEEP_FRAGMENTS", 3)
    for _ in range(2):
        check(["one two three four five", "six seven one two"])


@pytest.mark.parametrize("extra", [False, True])
def test_rows(spark, extra):
    rows = [(1, "some text"), (1, "some text"), (None, "no key"), (4, None), (5, "")]
    frame = spark.createDataFrame([r + (7,) for r in rows], "doc_id long, text string, n_tokens int")
    frame = frame if extra else frame.drop("n_tokens")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe(frame).collect())
    want = []
    for k, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((k or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.bpe(frame.limit(0)).count() == 0


@pytest.mark.parametrize("change", [
    lambda r: r.update(normalizer={"type": "Lowercase"}), lambda r: r["pre_tokenizer"].update(add_prefix_space=True), lambda r: r.update(pre_tokenizer={"type": "Whitespace"}),
    lambda r: r["added_tokens"][0].update(lstrip=True), lambda r: r["model"].update(dropout=0.1), lambda r: r["model"].update(continuing_subword_prefix="##"),
    lambda r: r["model"]["vocab"].update({"a\u0120": 60000})])
def test_vocabularies_that_the_cuts_do_not_hold_for(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        raw = json.load(f)
    change(raw)
    (tmp_path / "v.json").write_text(json.dumps(raw), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v.json"))


def test_long_text():
    check(["word " * 300_000 + "z" * 100_000 + "\n" * 50_000 + "end"])
