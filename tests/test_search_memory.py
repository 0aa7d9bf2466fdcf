"""What a task of the search holds beside its two blocks."""

from __future__ import annotations

import tracemalloc

import numpy as np

from tessera.operators.vectors import BLOCK, best_of


def test_products_of_a_full_block_stay_small():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((600, 16)), rng.standard_normal((BLOCK, 16))
    tracemalloc.start()
    r, _, _ = best_of(x, y, np.arange(600) + BLOCK, np.arange(BLOCK), 60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(r) == 600 * 60 and peak < 30e6  # 512 rows at a time take more
