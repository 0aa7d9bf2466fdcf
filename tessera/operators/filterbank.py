"""Log mel filterbank: whole signals in Arrow batches, and the framing that lets a stream give the same frames from any cut of a signal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Frames that are transformed together.
SLICE = 4096
#: Least variance of the sliding normalisation.
LEAST_VARIANCE = 1e-5


@dataclass(frozen=True)
class FilterBank:
    """Frames of frame_ms every hop_ms, tapered, as log energies of `bands` triangles of equal width on the mel scale between low and high Hz.

    With pad_end the last frame is filled up with zeros, and a signal shorter than a frame has one; otherwise only whole frames count.
    """

    rate: int = 16_000
    bands: int = 80
    frame_ms: float = 25.0
    hop_ms: float = 10.0
    fft: int = 512
    window: str = "hann"
    low: float = 20.0
    high: float | None = None
    power: float = 2.0
    floor: float = 1e-6
    pad_end: bool = True

    def __post_init__(self) -> None:
        if min(self.rate, self.bands, self.frame_ms, self.hop_ms, self.power, self.floor) <= 0 or self.low < 0:
            raise ValueError("rate, bands, frame_ms, hop_ms, power and floor must be positive, low not negative")
        if self.fft < self.size or self.hop > self.size:
            raise ValueError("a frame must fit the transform and a hop the frame")
        if self.window not in ("hann", "hamming"):
            raise ValueError(f"unknown window {self.window!r}")
        if not self.low < self.top <= self.rate / 2:
            raise ValueError("high must lie above low, and not above half the rate")

    @property
    def size(self) -> int:
        return max(1, round(self.rate * self.frame_ms / 1000))

    @property
    def hop(self) -> int:
        return max(1, round(self.rate * self.hop_ms / 1000))

    @property
    def top(self) -> float:
        return self.rate / 2 if self.high is None else self.high

    def taper(self) -> np.ndarray:
        """The symmetric window of a frame."""
        return (np.hanning if self.window == "hann" else np.hamming)(self.size)

    def weights(self) -> np.ndarray:
        """(fft / 2 + 1, bands): how much of each frequency a band takes."""
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        corners = 700 * (10 ** (np.linspace(mel(self.low), mel(self.top), self.bands + 2) / 2595) - 1)
        at = np.linspace(0, self.rate // 2, self.fft // 2 + 1)[:, None]
        rise = (at - corners[:-2]) / np.diff(corners)[:-1]
        fall = (corners[2:] - at) / np.diff(corners)[1:]
        return np.maximum(0, np.minimum(rise, fall))

    def frames(self, x: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
        """Whole frames of x and the samples that later frames need; with `final` all frames, the last filled up, and nothing."""
        if final and self.pad_end:
            short = self.size - len(x) if len(x) < self.size else -(len(x) - self.size) % self.hop
            x = np.concatenate([x, np.zeros(short)])
        if len(x) < self.size:
            return np.zeros((0, self.size)), x[:0] if final else x
        out = np.lib.stride_tricks.sliding_window_view(x, self.size)[:: self.hop]
        return out, x[:0] if final else x[len(out) * self.hop :]

    def flushed(self, rest: np.ndarray, emitted: int) -> np.ndarray:
        """The frames that the end of a signal adds to `emitted` ones: none where the rest is only what the last frame overlaps."""
        if emitted and len(rest) <= self.size - self.hop:
            return np.zeros((0, self.size))
        return self.frames(rest, True)[0]

    def energies(self, frames: np.ndarray) -> np.ndarray:
        """(frames, bands) of log energies, transformed some thousand frames at a time."""
        taper, weights = self.taper(), self.weights()
        out = np.empty((len(frames), self.bands))
        for a in range(0, len(frames), SLICE):
            spectrum = np.abs(np.fft.rfft(frames[a : a + SLICE] * taper, self.fft)) ** self.power
            out[a : a + SLICE] = np.log(np.maximum(spectrum @ weights, self.floor))
        return out


def sliding_normalised(new: np.ndarray, held: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Each new frame less the mean, over the deviation, of the last `window` frames up to it; and the frames to hold for the next ones.

    `held` are at most window - 1 frames before the new ones; deviations are of the population.
    """
    x = np.concatenate([held, new])
    if not len(new):
        return new, held
    zero = np.zeros((1, x.shape[1]))
    shift = x[0]  # sums around a frame lose fewer digits
    total, square = (np.concatenate([zero, np.cumsum(v, axis=0)]) for v in (x - shift, (x - shift) ** 2))
    end = np.arange(len(held), len(x)) + 1
    start = np.maximum(end - window, 0)
    n = (end - start)[:, None]
    mean = (total[end] - total[start]) / n
    variance = (square[end] - square[start]) / n - mean**2
    return (new - shift - mean) / np.sqrt(np.maximum(variance, LEAST_VARIANCE)), x[max(0, len(x) - window + 1) :] if window > 1 else x[:0]


def nested(rows: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrays of equally long rows: counts[i] rows for the i-th value."""
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), inner)


def log_mel(bank: FilterBank, normalise: int = 0):
    """A kernel from an array of samples to its frames (array of arrays), all signals of a batch in one transform.

    With normalise > 0 each frame is normalised over so many frames up to it. A null or empty signal has no frames.
    """

    @F.arrow_udf("array<array<double>>")
    def frames(signal: pa.Array) -> pa.Array:
        cut = []
        for x in signal:
            x = np.asarray(x.values, float) if x.is_valid else np.zeros(0)
            cut.append(bank.frames(x, True)[0] if len(x) else np.zeros((0, bank.size)))
        counts = np.array([len(c) for c in cut])
        out = bank.energies(np.concatenate(cut)) if cut else np.zeros((0, bank.bands))
        if normalise:
            ends = np.cumsum(counts)
            out = np.concatenate([sliding_normalised(out[e - n : e], out[:0], normalise)[0] for e, n in zip(ends, counts, strict=True)]) if len(out) else out
        return nested(out, counts)

    return frames
