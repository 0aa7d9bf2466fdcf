"""Kernels over arrays of samples, a batch at a time: resampling, distortions at measured levels, quality profiles."""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.batches import PRIME, key_of
from tessera.operators.profile import numbered

QUIET = 1e-8


def arrays(signal: pa.Array) -> list[np.ndarray]:
    """The rows of an array column; a null is empty."""
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), float) if x.is_valid else np.zeros(0) for x in signal]


def lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0), *rows])))


def phases(old: int, new: int, zeros: int = 48, rolloff: float = 0.94, beta: float = 10.0) -> tuple[np.ndarray, int, int, int]:
    """(taps, new) of a windowed sinc for each of the `new` phases, with old and new reduced, and how far the taps reach back.

    The sinc's cut-off is `rolloff` of the lower Nyquist frequency; `zeros` of its zero crossings on either side lie in a Kaiser window.
    """
    old, new = old // gcd(old, new), new // gcd(old, new)
    cutoff = min(old, new) * rolloff
    reach = int(np.ceil(zeros * old / cutoff))
    t = (np.arange(-reach, reach + old)[:, None] / old - np.arange(new)[None, :] / new) * cutoff
    window = np.where(np.abs(t) < zeros, np.i0(beta * np.sqrt(np.maximum(0, 1 - (t / zeros) ** 2))) / np.i0(beta), 0)
    return np.sinc(t) * window * cutoff / old, old, new, reach


def resample(x: np.ndarray, taps: np.ndarray, old: int, new: int, reach: int) -> np.ndarray:
    """x at new / old times its rate: ceil(len(x) * new / old) samples, each phase a product of strided windows and its taps."""
    n = -(-len(x) * new // old)
    if old == new or not n:
        return x
    blocks = -(-n // new)
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + blocks * old + len(taps) - len(x))])
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(taps))[::old][:blocks]
    return (windows @ taps).ravel()[:n]


def resampled(samples: Column, old: int, new: int) -> Column:
    """An array of samples at another rate; null and empty arrays give empty ones."""
    taps, a, b, reach = phases(old, new)

    @F.arrow_udf("array<double>")
    def run(signal: pa.Array) -> pa.Array:
        return lists([resample(x, taps, a, b, reach) for x in arrays(signal)])

    return run(samples)


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x)))) if len(x) else 0.0


def matched(x: np.ndarray, like: np.ndarray) -> np.ndarray:
    """x at the level of `like`; silence stays as it is."""
    a, b = rms(x), rms(like)
    return x * (b / a) if a > QUIET and b > QUIET else x


# How the power of a colour falls with frequency (amplitude by frequency to the power).
COLOURS = {"white": 0.0, "pink": -0.5, "brown": -1.0}


def noise(n: int, colour: str, rng: np.random.Generator) -> np.ndarray:
    """Noise of a colour: a white spectrum, shaped."""
    if not n:
        return np.zeros(0)
    spectrum = np.fft.rfft(rng.standard_normal(n))
    if len(spectrum) > 1:
        spectrum[1:] *= np.fft.rfftfreq(n)[1:] ** COLOURS[colour]
        spectrum[0] *= 0 if COLOURS[colour] else 1
    return np.fft.irfft(spectrum, n)


def with_noise(x: np.ndarray, snr_db: float, colour: str, rng: np.random.Generator) -> np.ndarray:
    """x with noise so many dB below its level; silence stays silent."""
    n = noise(len(x), colour, rng)
    level = rms(n)
    return x + n * (rms(x) / 10 ** (snr_db / 20) / level) if rms(x) > QUIET and level > QUIET else x


def impulse_response(rate: int, rt60: float, direct: float, rng: np.random.Generator) -> np.ndarray:
    """Noise that falls by 60 dB in rt60 seconds behind a direct sound and three early reflections; its peak is 1."""
    n = max(128, round(rate * min(max(1.25 * rt60, 0.12), 1.4)))
    h = rng.standard_normal(n) * 10 ** (-3 * np.arange(n) / rate / max(rt60, 1e-3))
    h[0] += direct
    for seconds, level in ((0.0075, 0.22), (0.015, 0.15), (0.0275, 0.10)):  # Fixed values.
        if round(seconds * rate) < n:
            h[round(seconds * rate)] += level
    return h / max(np.abs(h).max(), QUIET)


def convolve(x: np.ndarray, h: np.ndarray, block: int | None = None) -> np.ndarray:
    """Full convolution by overlapping and adding blocks of x, so that memory follows the response and not the signal."""
    if not len(x) or not len(h):
        return np.zeros(0)
    block = block or max(1024, len(h))
    size = 1 << (block + len(h) - 2).bit_length()
    spectrum, out = np.fft.rfft(h, size), np.zeros(len(x) + len(h) - 1)
    for a in range(0, len(x), block):
        part = np.fft.irfft(np.fft.rfft(x[a : a + block], size) * spectrum, size)
        end = min(len(out), a + size)
        out[a:end] += part[: end - a]
    return out


def reverberant(x: np.ndarray, rate: int, rt60: float, direct: float, rng: np.random.Generator) -> np.ndarray:
    return matched(convolve(x, impulse_response(rate, rt60, direct, rng))[: len(x)], x)


def band_limited(x: np.ndarray, rate: int, low: float, high: float) -> np.ndarray:
    if not len(x):
        return x
    hz = np.fft.rfftfreq(len(x), 1 / rate)
    return np.fft.irfft(np.where((hz >= max(0.0, low)) & (hz <= min(high, rate / 2)), np.fft.rfft(x), 0), len(x))


def coded(x: np.ndarray, rate: int, low: float, high: float, bits: int, heavy: bool, rng: np.random.Generator) -> np.ndarray:
    """A narrow, coarse channel at the level of x; a heavy one also saturates and nearly loses two stretches of 20 to 50 ms."""
    levels = float(1 << max(2, bits - 1))
    y = np.round(np.clip(band_limited(x, rate, low, high), -1, 1) * levels) / levels
    if heavy:
        y = np.tanh(1.18 * y)
        for _ in range(2):
            width = int(rng.integers(int(0.02 * rate), max(int(0.05 * rate), int(0.02 * rate) + 1)))
            if len(y) > width:
                at = int(rng.integers(0, len(y) - width))
                y[at : at + width] *= rng.uniform(0, 0.15)
    return matched(y, x)


def overdriven(x: np.ndarray, gain_db: float, limit: float) -> np.ndarray:
    return np.clip(x * 10 ** (gain_db / 20), -limit, limit) / max(limit, 1e-6)


def distorted(samples: Column, key: Column, seed: int, family: str, rate: int, **p) -> Column:
    """Samples under a condition: family additive_noise (snr_db, color), reverb (rt60_s, direct_gain), codec_bandwidth (low_hz, high_hz, bits,
    heavy) or level_clipping (gain_db, clip_threshold). The random part is fixed by seed and the row's key, whatever the batch."""
    one = {
        "additive_noise": lambda x, rng: with_noise(x, p["snr_db"], p["color"], rng),
        "reverb": lambda x, rng: reverberant(x, rate, p["rt60_s"], p["direct_gain"], rng),
        "codec_bandwidth": lambda x, rng: coded(x, rate, p["low_hz"], p["high_hz"], p["bits"], p.get("heavy", False), rng),
        "level_clipping": lambda x, rng: overdriven(x, p["gain_db"], p["clip_threshold"]),
    }
    if family not in one:
        raise ValueError(f"unknown distortion family {family!r}")

    @F.arrow_udf("array<double>")
    def run(signal: pa.Array, keys: pa.Array) -> pa.Array:
        return lists([one[family](x, np.random.default_rng([seed, i & 0xFFFFFFFFFFFFFFFF])) for x, i in zip(arrays(signal), keys.to_pylist(), strict=True)])

    return run(samples, F.coalesce(F.xxhash64(key), F.lit(0)))


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Whole frames of x, or x filled up with zeros as one."""
    if len(x) < size:
        return np.concatenate([x, np.zeros(size - len(x))])[None, :]
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def energy_trimmed(x: np.ndarray, rate: int, below: float = 38.0, context: float = 0.15, least: float = 0.0) -> np.ndarray:
    """x without leading and trailing frames (25 ms every 10 ms) that lie `below` dB under the loudest, but for some context."""
    size, hop, pad = max(1, int(0.025 * rate)), max(1, int(0.010 * rate)), int(context * rate)
    if len(x) < size:
        return x
    level = 10 * np.log10(np.maximum(np.mean(framed(x, size, hop) ** 2, axis=1), 1e-12))
    loud = np.flatnonzero(level >= level.max() - below) * hop
    a, b = max(0, loud[0] - pad), min(len(x), loud[-1] + size + pad)
    return x[a:b] if b - a >= least * rate else x


def loaded(channels: Column, old: int, new: int, start: float, seconds: float, target: float, most: float, headroom: float = -1.0, trim: bool = True) -> Column:
    """What a loader hands on, in its order: window of the source, downmix, resampling, energy trimming, loudness within bounds.

    channels is an array of equally long arrays; the window is in seconds of the source. The gain brings the level to `target` dBFS within
    `most` dB either way and keeps the peak `headroom` dB below full scale. An empty window gives an empty array.
    """
    taps, a, b, reach = phases(old, new)
    first, count = round(start * old), round(seconds * old)

    def one(rows: list[np.ndarray]) -> np.ndarray:
        x = np.mean([r[first : first + count] for r in rows], axis=0) if rows else np.zeros(0)
        x = resample(x, taps, a, b, reach)
        x = energy_trimmed(x, new) if trim else x
        if rms(x) <= QUIET:
            return x
        gain = min(float(np.clip(target - 20 * np.log10(rms(x)), -most, most)), headroom - 20 * np.log10(np.abs(x).max()))
        return x * 10 ** (gain / 20)

    @F.arrow_udf("array<double>")
    def run(signal: pa.Array) -> pa.Array:
        return lists([one(arrays(c.values)) if c.is_valid else np.zeros(0) for c in signal])

    return run(channels)


#: Names of a quality profile, in order. Fixed values.
PROFILE = (
    "analysis_duration_s", "rms_dbfs", "peak_dbfs", "crest_factor_db", "clipping_frac", "silence_ratio_40db", "leading_silence_s", "trailing_silence_s", "zcr",
    "spectral_centroid_hz", "rolloff95_hz", "spectral_bandwidth_hz", "spectral_flatness", "band_energy_0_300", "band_energy_300_3400", "band_energy_3400_8000", "narrowband_proxy",
)
#: Length of a level frame and of the analysed spectrum in seconds, and the level of silence in dBFS. Fixed values.
LEVEL_FRAME, SPECTRUM, SILENCE = 0.02, 10, -40.0
TINY = 1e-12


def decibels(x: np.ndarray | float) -> np.ndarray:
    return np.maximum(-120.0, 20 * np.log10(np.maximum(x, TINY)))


def spectrum_of(x: np.ndarray, rate: int) -> tuple[float, ...]:
    """Centroid, roll-off, bandwidth, flatness, three band shares and the narrow-band score of the first ten seconds; zeros for silence."""
    x = x - x.mean()
    if len(x) < 4 or np.abs(x).max() <= TINY:
        return (0.0,) * 8
    x = x[: SPECTRUM * rate]
    size = np.abs(np.fft.rfft(x * np.hanning(len(x))))
    hz, power = np.fft.rfftfreq(len(x), 1 / rate), size**2
    weight, total = size / (size.sum() + TINY), power.sum() + TINY
    centroid = weight @ hz
    rolloff = hz[min(np.searchsorted(np.cumsum(power), 0.95 * total), len(hz) - 1)]
    low, middle, high = (power[(hz >= a) & (hz < b)].sum() / total for a, b in ((0, 300), (300, 3400), (3400, 8000)))
    narrow = np.clip((4200 - rolloff) / 2200, 0, 1) * np.clip((0.08 - high) / 0.08, 0, 1)
    flat = np.exp(np.log(size + TINY).mean()) / (size.mean() + TINY)
    return tuple(map(float, (centroid, rolloff, np.sqrt(weight @ (hz - centroid) ** 2), flat, low, middle, high, narrow)))


def profile_of(x: np.ndarray, rate: int) -> tuple[float | None, ...]:
    """The values of PROFILE for a signal; levels over frames of 20 ms side by side, an unfinished last frame left out."""
    if not len(x):
        return (None,) * len(PROFILE)
    size = max(1, round(LEVEL_FRAME * rate))
    n = max(1, len(x) // size)
    quiet = decibels(np.sqrt(np.mean(x[: n * size].reshape(n, -1) ** 2, axis=1))) <= SILENCE
    edge = lambda q: LEVEL_FRAME * (len(q) if q.all() else int(np.argmin(q)))
    level, peak = float(decibels(rms(x))), float(decibels(np.abs(x).max()))
    crossings = float(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1]))) if len(x) > 1 else 0.0
    return (len(x) / rate, level, peak, max(0.0, peak - level), float(np.mean(np.abs(x) >= 0.999)), float(quiet.mean()), edge(quiet), edge(quiet[::-1]), crossings, *spectrum_of(x, rate))


def profile(samples: Column, rate: int) -> Column:
    """The quality profile of an array of samples as a struct of PROFILE; all null for null and empty arrays."""

    @F.arrow_udf(", ".join(f"{n} double" for n in PROFILE))
    def run(signal: pa.Array) -> pa.Array:
        rows = [profile_of(x, rate) for x in arrays(signal)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(len(PROFILE))], names=list(PROFILE))

    return run(samples)


def shift_plan(rows: DataFrame, key: str, public: DataFrame, public_key: str, seed: int, lead: str = "leading_silence_s", trail: str = "trailing_silence_s") -> DataFrame:
    """(key, lead_s, trail_s, band_limit, peak_limit) of rows: silence drawn from the public table's own values, flags at its own rates.

    The public table holds lead, trail, narrowband_proxy, rolloff95_hz and peak_dbfs. Its values of a kind are numbered in order (by
    ranges), and a row takes the value at a place that seed and key fix: one join for each kind, nothing is collected but two rates.
    """
    narrow = (F.coalesce("narrowband_proxy", F.lit(0.0)) >= 0.5) | F.coalesce(F.col("rolloff95_hz") <= 3800, F.lit(False))
    n, narrow_rate, peak_rate = public.agg(F.count("*"), F.avg(narrow.cast("double")), F.avg((F.col("peak_dbfs") >= -0.1).cast("double"))).first()
    if not n:
        raise ValueError("an empty public table has no distribution to draw from")
    unit = lambda salt: key_of(seed, salt, F.col(key)) / PRIME
    out = rows.select(key)
    for salt, (column, name) in enumerate(((lead, "lead_s"), (trail, "trail_s"))):
        placed = numbered(public.select(F.coalesce(column, F.lit(0.0)).alias(name), public_key), [F.asc(name), F.asc(public_key)], "_n").select(name, (F.col("_n") - 1).alias("_at"))
        out = out.withColumn("_at", key_of(seed, salt, F.col(key)) % n).join(placed, "_at").drop("_at")
    return out.select(key, "lead_s", "trail_s", (unit(2) < min(narrow_rate or 0.0, 0.5)).alias("band_limit"), (unit(3) < (peak_rate or 0.0)).alias("peak_limit"))


def halved_band(x: np.ndarray) -> np.ndarray:
    """Every second sample, with lines between: what is left of a telephone band; scaled down where it exceeds full scale."""
    if len(x) < 4:
        return x
    y = np.interp(np.arange(len(x)), np.arange(0, len(x), 2), x[::2])
    return y / max(1.0, np.abs(y).max())


def soft_limited(x: np.ndarray, peak: float = 0.98, drive: float = 1.6) -> np.ndarray:
    most = np.abs(x).max(initial=0.0)
    return np.tanh(drive * x * (peak / most)) / np.tanh(drive) if most > 1e-6 else x


def shifted(samples: Column, lead: Column, trail: Column, band: Column, limit: Column, rate: int) -> Column:
    """Samples with silence before and after (seconds), then, where the flags say so, a narrower band and a limited peak."""

    @F.arrow_udf("array<double>")
    def run(signal: pa.Array, lead: pa.Array, trail: pa.Array, band: pa.Array, limit: pa.Array) -> pa.Array:
        out = []
        for x, a, b, narrow, loud in zip(arrays(signal), lead.to_pylist(), trail.to_pylist(), band.to_pylist(), limit.to_pylist(), strict=True):
            x = np.concatenate([np.zeros(max(0, round(a * rate))), x, np.zeros(max(0, round(b * rate)))])
            x = halved_band(x) if narrow else x
            out.append(soft_limited(x) if loud else x)
        return lists(out)

    return run(samples, lead, trail, band, limit)
