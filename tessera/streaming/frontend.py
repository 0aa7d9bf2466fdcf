"""Streaming front ends with state for each signal: filterbank frames and voice activity from chunks that arrive in any order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.filterbank import FilterBank, sliding_normalised

#: What a chunk of a signal looks like; chunks of a signal are numbered from 0, the one marked `last` ends it.
CHUNK = "utt string, seq long, samples array<double>, last boolean"


def array(x: Any) -> np.ndarray:
    return np.asarray([] if x is None else x, float)


class InOrder(StatefulProcessor):
    """Hands the chunks of a signal to `advance` by number. Chunks that come early wait in a map; those that come twice are dropped.

    A signal ends with its chunk marked `last`, or, where `idle_ms` is set, when nothing has come for that long; its state is then
    cleared. Chunks after the end begin a new signal of that name.

    Each access to the state is a message between two processes and costs far more than what it carries. So a signal has one value with
    all that `advance` remembers (the columns `MEMORY`), and early chunks wait in pages of `PAGE` consecutive numbers: the page of the next
    chunk in the value itself, later ones, which the value lists, in the map.
    """

    MEMORY, PAGE = "", 16
    CHUNKS = "seq array<long>, samples array<array<double>>, last array<boolean>, extra array<double>"

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signal = handle.getValueState("signal", f"next long, at long, pages array<long>, {self.CHUNKS}, {self.MEMORY}")
        self.early = handle.getMapState("early", "page long", self.CHUNKS)

    def advance(self, key: str, at: int, memory: tuple | None, chunks: list[tuple[np.ndarray, float]], ended: bool) -> tuple[tuple | None, list[Row]]:
        """Takes the next chunks (samples, extra) after `at` rows, and gives what to remember (None before any chunk) and the new rows."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.signal.get()
        following, at, pages, memory = (known[0], known[1], set(known[2]), tuple(known[7:])) if known else (0, 0, set(), None)
        read = {following // self.PAGE: self._chunks(*known[3:7]) if known else {}}
        waiting: dict[int, tuple] = {}
        for row in rows:
            if row.seq >= following:
                waiting[row.seq] = (array(row.samples), bool(row.last), float(row.extra if "extra" in row else 0.0))
        ready, ended, changed = [], False, set()
        while not ended:
            if following not in waiting and following not in self._page(following // self.PAGE, pages, read):
                break
            changed |= {following // self.PAGE} & pages
            early = read.get(following // self.PAGE, {}).pop(following, None)
            samples, ended, more = waiting.pop(following, early)
            ready.append((array(samples), float(more)))
            following += 1
        if ready:
            memory, out = self.advance(key[0], at, memory, ready, ended)
            at += len(out)
            yield from out
        if ended:
            self._forget(known)
            return
        for seq, chunk in waiting.items():
            self._page(seq // self.PAGE, pages, read)[seq] = chunk
            changed.add(seq // self.PAGE)
        here = following // self.PAGE
        for page in changed - {here}:
            left = {seq: chunk for seq, chunk in self._page(page, pages, read).items() if seq >= following}
            if left:
                self.early.updateValue((page,), self._columns(left))
                pages.add(page)
            elif page in pages:
                self.early.removeKey((page,))
                pages.remove(page)
        left = {seq: chunk for seq, chunk in self._page(here, pages, read).items() if seq >= following}
        if here in pages:
            self.early.removeKey((here,))
            pages.remove(here)
        if ready or changed or not known:
            self.signal.update((following, at, sorted(pages), *self._columns(left), *(memory or [None] * len(self.MEMORY.split(", ")))))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t if isinstance(t, int) else t[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        known = self.signal.get()
        _, out = self.advance(key[0], known[1] if known else 0, tuple(known[7:]) if known else None, [], True)
        self._forget(known)
        yield from out

    def _page(self, page: int, pages: set[int], read: dict[int, dict]) -> dict[int, tuple]:
        """The chunks that wait in a page, fetched once."""
        if page not in read:
            read[page] = self._chunks(*self.early.getValue((page,))) if page in pages else {}
        return read[page]

    @staticmethod
    def _chunks(seq: list[int], *columns: list) -> dict[int, tuple]:
        return dict(zip(seq, zip(*columns, strict=True), strict=True))

    @staticmethod
    def _columns(chunks: dict[int, tuple]) -> tuple[list, ...]:
        return list(chunks), [array(x).tolist() for x, _, _ in chunks.values()], [last for _, last, _ in chunks.values()], [more for _, _, more in chunks.values()]

    def _forget(self, known: tuple | None) -> None:
        if known:
            self.signal.clear()
            if known[2]:
                self.early.clear()

    def close(self) -> None:
        pass


class OnlineBank(InOrder):
    """Frames of a filterbank from chunks: the state is the samples that later frames need and the frames of the normalisation's window."""

    def __init__(self, bank: FilterBank, normalise: int = 0, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.bank, self.normalise = bank, normalise

    MEMORY = "rest array<double>, held array<array<double>>"

    def advance(self, key: str, at: int, memory: tuple | None, chunks: list[tuple[np.ndarray, float]], ended: bool) -> tuple[tuple | None, list[Row]]:
        rest, held = memory or (None, None)
        x = np.concatenate([array(rest), *(c for c, _ in chunks)])
        frames, rest = self.bank.frames(x, False)
        if ended and (len(rest) or at + len(frames)):
            frames = np.concatenate([frames, self.bank.flushed(rest, at + len(frames))])
        out = self.bank.energies(frames)
        if self.normalise and len(out):
            out, kept = sliding_normalised(out, array(held).reshape(-1, self.bank.bands), self.normalise)
            held = kept.tolist()
        return (rest.tolist(), held), [Row(utt=key, frame=at + i, values=v) for i, v in enumerate(out.tolist())]


def online_bank(chunks: DataFrame, bank: FilterBank, normalise: int = 0, idle_ms: int | None = None) -> DataFrame:
    """(utt, frame, values) of a stream of CHUNK rows: the frames that `log_mel` gives for the whole signals, whatever the cut and the order.

    Memory for a signal is its left-over samples (less than a frame), normalise - 1 frames and the chunks that came early.
    """
    return chunks.groupBy("utt").transformWithState(OnlineBank(bank, normalise, idle_ms), "utt string, frame long, values array<double>", "Append", "None" if idle_ms is None else "ProcessingTime")


class Activity(InOrder):
    """Voice activity with composite state: a hidden vector, the samples before the next window, and the rate; a change of rate resets all.

    Each window of `window_ms`, joined to the `context` samples before it, gives its level in dB; the hidden vector holds leaky means of
    the level, one for each of `decays`; the probability of speech is a logistic function of how far the fastest lies above the slowest.
    """

    WIDTHS = {8_000: (256, 32), 16_000: (512, 64)}

    def __init__(self, decays: tuple[float, ...] = (0.5, 0.9, 0.99), margin: float = 6.0, slope: float = 0.5, widths: dict[int, tuple[int, int]] | None = None, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.decays, self.margin, self.slope, self.widths = np.array(decays), margin, slope, widths or self.WIDTHS

    MEMORY = "hidden array<double>, context array<double>, rest array<double>, rate long"

    def windows(self, x: np.ndarray, hidden: np.ndarray | None, context: np.ndarray, rate: int) -> tuple[list[float], np.ndarray | None, np.ndarray, np.ndarray]:
        """Probabilities of the whole windows of x, and hidden vector, context and left-over samples after them."""
        width, before = self.widths[rate]
        whole = len(x) // width
        joined = np.concatenate([context, x])
        rest = joined[whole * width : whole * width + before], x[whole * width :]
        if not whole:
            return [], hidden, *rest
        parts = np.lib.stride_tricks.sliding_window_view(joined, before + width)[: whole * width : width]
        levels = 10 * np.log10(np.maximum(np.mean(parts**2, axis=1), 1e-10))
        means = np.empty((whole, len(self.decays)))
        for i, level in enumerate(levels):
            hidden = means[i] = np.full(len(self.decays), level) if hidden is None else self.decays * hidden + (1 - self.decays) * level
        return (1 / (1 + np.exp(-self.slope * (means[:, 0] - means[:, -1] - self.margin)))).tolist(), hidden, *rest

    def advance(self, key: str, at: int, memory: tuple | None, chunks: list[tuple[np.ndarray, float]], ended: bool) -> tuple[tuple | None, list[Row]]:
        hidden, context, rest, rate = memory if memory and memory[3] else (None, None, None, 0)
        hidden = None if hidden is None else array(hidden)
        context, rest, out = array(context), array(rest), []
        alike = [list(g) for _, g in groupby(chunks, lambda c: int(c[1]))]
        for run in alike:
            if int(run[0][1]) != rate:
                rate, hidden, rest = int(run[0][1]), None, np.zeros(0)
                if rate not in self.widths:
                    raise ValueError(f"no window for rate {rate}")
                context = np.zeros(self.widths[rate][1])
            found, hidden, context, rest = self.windows(np.concatenate([rest, *(x for x, _ in run)]), hidden, context, rate)
            out += found
        if ended and len(rest):
            found, hidden, context, rest = self.windows(np.concatenate([rest, np.zeros(-len(rest) % self.widths[rate][0])]), hidden, context, rate)
            out += found
        memory = (None if hidden is None else hidden.tolist(), context.tolist(), rest.tolist(), rate) if rate else None
        return memory, [Row(utt=key, window=at + i, probability=p) for i, p in enumerate(out)]


def online_activity(chunks: DataFrame, idle_ms: int | None = None, **kw) -> DataFrame:
    """(utt, window, probability) of a stream of CHUNK rows with the rate in `extra`: the same windows whatever the cut and the order of chunks."""
    return chunks.groupBy("utt").transformWithState(Activity(idle_ms=idle_ms, **kw), "utt string, window long, probability double", "Append", "None" if idle_ms is None else "ProcessingTime")
