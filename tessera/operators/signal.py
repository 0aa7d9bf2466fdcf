"""Signal kernels: array columns where built-in functions suffice, Arrow kernels in tasks where they do not."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def chunk_starts(n: Column, length: int, hop: int) -> Column:
    """Starts of windows of `length`, one each hop; the last is aligned with the end. A shorter signal has one, at 0."""
    last = F.greatest(n - length, F.lit(0))
    return F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(hop).cast("long")), lambda s: s <= last), F.array(last.cast("long"))))


def chunks(df: DataFrame, key: str, n: str, length: int, hop: int) -> DataFrame:
    """(key, chunk, start, stop)."""
    e = df.select(key, F.col(n).alias("_n"), F.posexplode(chunk_starts(F.col(n), length, hop)).alias("chunk", "start"))
    return e.select(key, "chunk", "start", F.least(F.col("start") + length, F.col("_n")).alias("stop"))


def loudness(samples: Column) -> dict[str, Column]:
    """rms_dbfs, peak_dbfs, zero_crossings and clipped share of an array of samples in [-1, 1]."""
    n = F.greatest(F.size(samples), F.lit(1))
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / n
    peak = F.aggregate(samples, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    signs = F.aggregate(samples, F.struct(F.lit(0.0).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.cast("double").alias("last"), (a["n"] + F.when(a["last"] * x < 0, 1).otherwise(0)).alias("n")))["n"]
    db = lambda x: 20 * F.log10(F.greatest(x, F.lit(1e-8)))
    return {"rms_dbfs": db(F.sqrt(square)), "peak_dbfs": db(peak), "zero_crossings": signs, "clipping_frac": F.size(F.filter(samples, lambda x: F.abs(x) >= 0.999)) / n}


def bounded_gain(rms_dbfs: Column, peak_dbfs: Column, target: float, most: float, headroom: float = -1.0) -> Column:
    """Gain in dB that brings the level to target, within +-most and such that the peak keeps its headroom."""
    return F.least(F.greatest(F.lit(target) - rms_dbfs, F.lit(-most)), F.lit(most), F.lit(headroom) - peak_dbfs)


def crops(samples: Column, length: int, count: int) -> Column:
    """`count` crops of `length` samples: a shorter signal is repeated to the length; one crop is the middle, several start evenly from
    the first to the last place."""
    whole = F.when(F.size(samples) < length, F.flatten(F.array_repeat(samples, F.ceil(F.lit(length) / F.greatest(F.size(samples), F.lit(1))).cast("int")))).otherwise(samples)
    last = F.greatest(F.size(whole) - length, F.lit(0))
    last = F.when(F.size(samples) < length, 0).otherwise(last)
    at = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * last / F.lit(count - 1)).cast("int")) if count > 1 else F.array(F.floor(last / 2).cast("int"))
    return F.transform(at, lambda a: F.slice(whole, a + 1, length))


def guarded(original: Column, kept: Column, least: Column | float, share: float) -> Column:
    """What a voice activity policy does with a signal of which it would keep `kept` of `original` units: `trimmed`, or why it stays."""
    return F.when(kept <= 0, "no_speech").when(kept < least, "too_short").when(kept < share * original, "too_much_removed").when(kept >= original, "unchanged").otherwise("trimmed")


def clipped(samples: Column, at: float) -> Column:
    return F.transform(samples, lambda x: F.greatest(F.lit(-at), F.least(F.lit(at), x)))


def dropped_packets(samples: Column, size: int, seed: Column, one_in: int) -> Column:
    """Packets of `size` samples, one in so many (by a fixed rule of seed and place) replaced with silence."""
    return F.transform(samples, lambda x, i: F.when((seed * 31 + F.floor(i / size) * 17) % one_in == 0, F.lit(0.0)).otherwise(x))


def quantised(samples: Column, levels: int) -> Column:
    """A coarse codec: samples rounded to so many steps for each unit."""
    return F.transform(samples, lambda x: F.floor(x * levels + 0.5) / levels)


def noisy(samples: Column, seed: Column, amplitude: float) -> Column:
    """Samples with a reproducible disturbance in [-amplitude, amplitude)."""
    return F.transform(samples, lambda x, i: x + amplitude * (((seed * 7919 + i * 104729 + 13) % 1000) / 500.0 - 1))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, wherever and however often body names it: an expression in a lambda is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mean_row(rows: Column) -> Column:
    """The mean of equally long arrays, element by element."""
    total = lambda r: F.aggregate(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.element_at(r, 1), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return once(rows, lambda r: F.transform(total(r), lambda x: x / F.size(r)))


def downmixed(channels: Column) -> Column:
    """The mean of equally long channels."""
    return mean_row(channels)


def loaded(channels: Column, start: int, length: int, target: float, most: float) -> Column:
    """Window, downmix, and bounded gain: what a loader hands on."""

    def gained(mono: Column) -> Column:
        level = loudness(mono)
        gain = F.pow(F.lit(10.0), bounded_gain(level["rms_dbfs"], level["peak_dbfs"], target, most) / 20)
        return once(gain, lambda g: F.transform(mono, lambda x: x * g))

    return once(downmixed(F.transform(channels, lambda c: F.slice(c, start + 1, length))), gained)


def mean_normalised(frames: Column) -> Column:
    """Frames (an array of arrays) less the mean frame of the utterance."""
    return once(frames, lambda f: once(mean_row(f), lambda m: F.transform(f, lambda v: F.zip_with(v, m, lambda x, y: x - y))))


@F.pandas_udf(ArrayType(DoubleType()))
def convolved(signal: pd.Series, kernel: pd.Series) -> pd.Series:
    """Full linear convolution by FFT."""

    def one(a, b) -> list[float]:
        a, b = np.asarray(a, float), np.asarray(b, float)
        n = len(a) + len(b) - 1
        return np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n), n).tolist() if len(a) and len(b) else []

    return pd.Series([one(a, b) for a, b in zip(signal, kernel, strict=True)])


def trimmed(rate: int, below: float = 38.0, context: float = 0.15, least: float = 1.5):
    """A kernel that cuts leading and trailing frames `below` dB under the loudest, keeps context, and reverts if too little is left."""

    @F.pandas_udf("array<double>")
    def trim(signal: pd.Series) -> pd.Series:
        frame, hop, pad = int(0.025 * rate), int(0.010 * rate), int(context * rate)

        def one(x) -> list[float]:
            x = np.asarray(x, float)
            if len(x) < frame:
                return x.tolist()
            at = np.arange(0, len(x) - frame + 1, hop)
            power = np.array([10 * np.log10(max(float(np.mean(x[i : i + frame] ** 2)), 1e-12)) for i in at])
            loud = at[power >= power.max() - below]
            a, b = max(0, loud[0] - pad), min(len(x), loud[-1] + frame + pad)
            return (x[a:b] if b - a >= least * rate else x).tolist()

        return pd.Series([one(x) for x in signal])

    return trim
