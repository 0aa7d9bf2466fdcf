"""The sliding normalisation of a stream's frames against a loop."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tessera.streaming.jobs import window_scores


@pytest.mark.parametrize(("window", "known"), [(1, 0), (10, 0), (10, 4), (10, 9)])
def test_windows(window, known):
    x = np.random.default_rng(1).standard_normal((2100, 3)) * 50
    parts = [x[max(0, i - window + 1) : i + 1] for i in range(known, len(x))]
    want = [(p[-1] - p.mean(axis=0)) / np.sqrt(np.maximum(p.var(axis=0), 1e-10)) for p in parts]
    assert np.allclose(window_scores(x, len(x) - known, window), want, atol=1e-9)


def test_many_frames_take_little_time():
    x = np.random.default_rng(2).standard_normal((200_000, 1))
    began = time.process_time()
    window_scores(x, len(x), 10)
    assert time.process_time() - began < 1.5  # a loop over frames takes several seconds
