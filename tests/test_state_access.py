"""How often a stream's front end goes to its state: each access is a message between processes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row

from tessera.streaming.frontend import Activity, OnlineBank
from tests.test_frontend import SMALL, activity, plain


class Held:
    """A value or map in memory that counts its accesses."""

    def __init__(self, handle):
        self.handle, self.rows = handle, {}

    def __getattribute__(self, name):
        if name not in ("handle", "rows", "_row") and not name.startswith("__"):
            self.handle.accesses += 1
        return object.__getattribute__(self, name)

    def get(self):
        return self.rows.get(None)

    def update(self, value):
        self.rows[None] = value

    def exists(self):
        return None in self.rows

    put = update

    def clear(self):
        self.rows.clear()

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


class Handle:
    def __init__(self):
        self.accesses, self.states = 0, {}

    def state(self, name, *_):
        return self.states.setdefault(name, Held(self))

    getValueState = getMapState = getListState = state


def run(processor, batches):
    handle, out, accesses = Handle(), [], []
    processor.init(handle)
    for rows in batches:
        handle.accesses = 0
        out += processor.handleInputRows(("u",), iter([Row(seq=s, samples=x, last=e, extra=r) for s, x, e, r in rows]), None)
        accesses.append(handle.accesses)
    assert not any(s.rows for s in handle.states.values())
    return pd.DataFrame([r.asDict() for r in out]), accesses


def cut(x, size):
    return [(i // size, x[i : i + size], i + size >= len(x), 8.0) for i in range(0, len(x), size)]


@pytest.mark.parametrize("bank", [False, True])
def test_a_batch_needs_few_accesses(bank):
    """Nine of ten chunks come early, then some more, then the first."""
    x = np.random.default_rng(6).normal(size=70).tolist()
    rows = cut(x, 7)
    got, accesses = run(OnlineBank(SMALL) if bank else Activity(widths={8: (6, 2)}), [rows[4:], rows[1:4], rows[:1]])
    want = plain(x, SMALL) if bank else activity(x, [8] * 70, {8: (6, 2)})
    assert np.allclose(np.array(got["values"].tolist()) if bank else got.probability, want, atol=1e-9)
    assert max(accesses) <= 2


def test_many_early_chunks():
    """Chunks in reverse, in no order, and twice: pages of early chunks fill, are read in order and go."""
    x = np.random.default_rng(7).normal(size=700).tolist()
    rows = cut(x, 7)
    want = activity(x, [8] * 700, {8: (6, 2)})
    shuffled = [rows[i] for i in np.random.default_rng(8).permutation(100)]
    for order in (rows[::-1], rows[1::2] + rows[::2], shuffled, rows[40:60] + rows[:50] + rows[30:70] + rows[60:]):
        got, accesses = run(Activity(widths={8: (6, 2)}), [order[i : i + 9] for i in range(0, len(order), 9)])
        assert list(got.window) == list(range(len(want))) and np.allclose(got.probability, want, atol=1e-9)
        assert max(accesses) <= 2 + 2 * 9
