"""Span hashes on short and very long sequences, and what they keep."""

import numpy as np

from loanlens.llm import text


def test_spans_agree_wherever_they_stand_and_keep_bounded_tables():
    roller = text.Roller(3)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 3 * text.CHUNK_BYTES).astype(np.uint64)
    values[2_000_000 % len(values):][:50] = values[:50]
    at = 2_000_000 % len(values)
    both = roller.spans(values, np.array([0, at, 1]), np.array([50, at + 50, 50]))
    assert both[0] == both[1] != both[2]
    assert roller.spans(values[:50], np.array([0]), np.array([50]))[0] == both[0]
    assert len(roller.up) <= text.CHUNK_BYTES + 1 and len(roller.down) == len(roller.up)
    short = text.Roller(3)
    assert short.spans(values[:50], np.array([0]), np.array([50]))[0] == both[0] and len(short.up) < 200
