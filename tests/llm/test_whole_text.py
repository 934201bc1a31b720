"""Parts of texts that a narrower search would miss."""

import math

import numpy as np
import pytest

pytest.importorskip("weftline.llm")
from weftline.llm import packing, toxicity  # noqa: E402


def test_half_a_window_lies_whole_in_one():
    span, half = toxicity.SPAN, toxicity.SPAN // 2 + 1
    for n in (1, half, span, span + 1, 95, 96, 97, 128, 1000, 1023, 1024):
        starts = toxicity.starts_of(n)
        for at in range(max(n - half, 0) + 1):
            assert any(s <= at and min(at + half, n) <= s + span for s in starts), (n, at)


def test_neighbours_score_by_all_terms_of_the_seed():
    rng = np.random.default_rng(7)
    docs = [np.append(rng.integers(0, 60, rng.integers(20, 80)), 99).astype("<u4") for _ in range(12)]
    index, mean = packing.Index(docs), sum(map(len, docs)) / 12
    for seed in range(12):
        want = np.zeros(12)
        for t in set(docs[seed].tolist()):
            df = sum(t in d for d in docs)
            for i, d in enumerate(docs):
                tf = int((d == t).sum())
                norm = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
                want[i] += (df > 1) * math.log1p((12 - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + norm)
        assert np.allclose(index.scores(seed), want)
