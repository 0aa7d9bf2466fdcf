"""Resampling, distortions, profiles and channel shift: measured levels, spectra and plain loops."""

from __future__ import annotations

import cmath
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audio


def tone(hz, rate, n):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


@pytest.mark.parametrize("old, new", [(16_000, 8_000), (8_000, 16_000), (44_100, 16_000), (16_000, 16_000), (3, 7)])
def test_resampling_keeps_tones(old, new):
    taps = audio.phases(old, new)
    low = min(old, new)
    x = tone(0.2 * low, old, 6000)
    y = audio.resample(x, *taps)
    assert len(y) == -(-6000 * new // old)
    want = tone(0.2 * low, new, len(y))
    edge = len(y) // 4
    assert np.abs(y - want)[edge:-edge].max() < 1e-3
    assert np.abs(audio.resample(np.ones(6000), *taps)[edge:-edge] - 1).max() < 1e-3


def test_aliases_are_suppressed():
    taps = audio.phases(16_000, 8_000)
    for hz in (4100, 5000, 7900):
        y = audio.resample(tone(hz, 16_000, 16_000), *taps)
        assert 20 * math.log10(audio.rms(y[1000:-1000]) / audio.rms(tone(hz, 16_000, 16_000))) < -60, hz


def test_resampling_by_loop(spark):
    """Against the sum over taps written out, for short signals; nulls and empty ones."""
    rng = np.random.default_rng(2)
    rows = [(1, rng.normal(size=37).tolist()), (2, [1.0]), (3, []), (4, None)]
    got = {r.i: r.y for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", audio.resampled(F.col("x"), 4, 3).alias("y")).collect()}
    cut = 3 * 0.94
    for i, x in rows:
        x = x or []
        want = []
        for m in range(-(-len(x) * 3 // 4)):
            total = 0.0
            for j, v in enumerate(x):
                t = (m / 3 - j / 4) * cut
                if abs(t) < 48:
                    total += v * np.sinc(t) * np.i0(10 * math.sqrt(1 - (t / 48) ** 2)) / np.i0(10) * cut / 4
            want.append(total)
        assert np.allclose(got[i], want, atol=1e-9)


def test_noise_has_its_level_and_colour():
    rng = np.random.default_rng(3)
    x = tone(440, 16_000, 65_536)
    for colour, slope in (("white", 0), ("pink", -10), ("brown", -20)):
        y = audio.with_noise(x, 12.0, colour, rng)
        assert 20 * math.log10(audio.rms(x) / audio.rms(y - x)) == pytest.approx(12, abs=1e-6)
        power = np.abs(np.fft.rfft(audio.noise(1 << 18, colour, rng))) ** 2
        a, b = power[500:1000].mean(), power[5000:10_000].mean()
        assert 10 * math.log10(b / a) == pytest.approx(slope, abs=1.5)
    assert np.array_equal(audio.with_noise(np.zeros(50), 3.0, "pink", rng), np.zeros(50))


def test_reverberation():
    rng = np.random.default_rng(4)
    h = audio.impulse_response(16_000, 0.4, 1.0, rng)
    early, late = (20 * math.log10(audio.rms(h[a : a + 800])) for a in (1600, 4800))
    assert early - late == pytest.approx(60 * 0.2 / 0.4, abs=3) and np.abs(h).max() == pytest.approx(1)
    x = rng.normal(size=5000)
    assert np.allclose(audio.convolve(x, h[:300], 64), np.convolve(x, h[:300])) and np.allclose(audio.convolve(x[:10], h), np.convolve(x[:10], h))
    y = audio.reverberant(x, 16_000, 0.4, 1.0, rng)
    assert len(y) == len(x) and audio.rms(y) == pytest.approx(audio.rms(x))


def test_narrow_channels():
    rng = np.random.default_rng(5)
    x = rng.normal(size=16_000) * 0.1
    y = audio.coded(x, 16_000, 300, 3400, 16, False, rng)
    power, hz = np.abs(np.fft.rfft(y)) ** 2, np.fft.rfftfreq(16_000, 1 / 16_000)
    assert power[(hz < 299) | (hz > 3401)].sum() / power.sum() < 1e-4 and audio.rms(y) == pytest.approx(audio.rms(x))
    assert len(set(np.round(audio.coded(x, 16_000, 0, 8000, 4, False, rng), 9))) <= 16
    assert audio.rms(audio.coded(x, 16_000, 0, 8000, 8, True, rng)) == pytest.approx(audio.rms(x))
    z = audio.overdriven(x, 20.0, 0.4)
    assert np.abs(z).max() == 1 and np.mean(np.abs(z) == 1) > 0.3


def test_distortions_do_not_depend_on_the_batch(spark):
    df = spark.createDataFrame([(i, tone(50 + i, 1000, 200 + i).tolist()) for i in range(20)] + [(99, []), (100, None)], "i long, x array<double>")
    for family, p in (("additive_noise", {"snr_db": 3.0, "color": "pink"}), ("reverb", {"rt60_s": 0.2, "direct_gain": 1.0}), ("codec_bandwidth", {"low_hz": 0, "high_hz": 300, "bits": 6, "heavy": True}), ("level_clipping", {"gain_db": 6.0, "clip_threshold": 0.5})):
        a, b = ({r.i: r.y for r in x.select("i", audio.distorted(F.col("x"), F.col("i"), 1, family, 1000, **p).alias("y")).collect()} for x in (df.repartition(1), df.repartition(7)))
        assert a == b and a[99] == a[100] == [] and len(a[3]) == 203
    with pytest.raises(ValueError):
        audio.distorted(F.col("x"), F.col("i"), 1, "none", 1000)


def test_profile_by_loop(spark):
    """Every measure from its definition, with a written-out transform."""
    rng = np.random.default_rng(6)
    rate = 500
    rows = [(1, np.concatenate([np.zeros(25), rng.normal(size=60) * 0.4, np.zeros(17)]).clip(-1, 1).tolist()), (2, [0.0] * 30), (3, (tone(100, rate, 130) * 1.2).clip(-1, 1).tolist()), (4, [0.5]), (5, []), (6, None)]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", audio.profile(F.col("x"), rate).alias("p")).collect()}
    assert all(v is None for i in (5, 6) for v in got[i]) and list(got[1].asDict()) == list(audio.PROFILE)
    db = lambda v: max(-120.0, 20 * math.log10(max(v, 1e-12)))
    for i, x in rows[:4]:
        n = max(1, len(x) // 10)
        frames = [x[a * 10 : a * 10 + 10] for a in range(n)]
        quiet = [db(math.sqrt(sum(v * v for v in f) / len(f))) <= -40 for f in frames]
        lead = next((a for a, q in enumerate(quiet) if not q), n)
        trail = next((a for a, q in enumerate(reversed(quiet)) if not q), n)
        level, peak = db(math.sqrt(sum(v * v for v in x) / len(x))), db(max(map(abs, x)))
        want = [len(x) / rate, level, peak, max(0.0, peak - level), sum(abs(v) >= 0.999 for v in x) / len(x), sum(quiet) / n, lead * 0.02, trail * 0.02, sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1) if len(x) > 1 else 0.0]
        c = [v - sum(x) / len(x) for v in x]
        if len(x) < 4 or max(map(abs, c)) <= 1e-12:
            want += [0.0] * 8
        else:
            m = len(c)
            w = [v * (0.5 - 0.5 * math.cos(2 * math.pi * a / (m - 1))) for a, v in enumerate(c)]
            mag = [abs(sum(v * cmath.exp(-2j * math.pi * k * a / m) for a, v in enumerate(w))) for k in range(m // 2 + 1)]
            hz = [k * rate / m for k in range(m // 2 + 1)]
            power, total = [v * v for v in mag], sum(v * v for v in mag) + 1e-12
            centroid = sum(f * v for f, v in zip(hz, mag, strict=True)) / (sum(mag) + 1e-12)
            width = math.sqrt(sum((f - centroid) ** 2 * v for f, v in zip(hz, mag, strict=True)) / (sum(mag) + 1e-12))
            run, roll = 0.0, hz[-1]
            for f, v in zip(hz, power, strict=True):
                run += v
                if run >= 0.95 * total:
                    roll = f
                    break
            flat = math.exp(sum(math.log(v + 1e-12) for v in mag) / len(mag)) / (sum(mag) / len(mag) + 1e-12)
            bands = [sum(v for f, v in zip(hz, power, strict=True) if a <= f < b) / total for a, b in ((0, 300), (300, 3400), (3400, 8000))]
            want += [centroid, roll, width, flat, *bands, min(1, max(0, (4200 - roll) / 2200)) * min(1, max(0, (0.08 - bands[2]) / 0.08))]
        assert np.allclose(list(got[i]), want, atol=1e-7), i


def test_loader_order(spark):
    """Window in seconds of the source, mean of channels, new rate, silence cut, gain within bounds."""
    x = np.concatenate([np.zeros(2000), tone(50, 1000, 2000) * 0.05, np.zeros(2000)])
    df = spark.createDataFrame([(1, [x.tolist(), (x * 0.5).tolist()]), (2, [[], []]), (3, None)], "i int, c array<array<double>>")
    got = {r.i: np.array(r.y) for r in df.select("i", audio.loaded(F.col("c"), 1000, 800, 1.0, 4.0, -20.0, 12.0).alias("y")).collect()}
    assert len(got[2]) == len(got[3]) == 0 and 1600 <= len(got[1]) <= 1600 + 2 * (120 + 40)
    assert np.abs(got[1]).max() == pytest.approx(0.05 * 0.75 * 10 ** (12 / 20), rel=0.02)
    loud = spark.createDataFrame([(1, [(tone(50, 1000, 3000) * 0.9).tolist()])], "i int, c array<array<double>>")
    y = np.array(loud.select(audio.loaded(F.col("c"), 1000, 1000, 0.0, 3.0, -1.0, 12.0).alias("y")).first().y)
    assert 20 * math.log10(np.abs(y).max()) <= -1 + 1e-9


def test_shift_draws_from_the_table(spark):
    """Padding has the public table's distribution, flags its rates; both are fixed by seed and key."""
    public = spark.createDataFrame([(i, float(i % 4) / 10, float(i % 3), 0.6 if i < 30 else 0.0, 5000.0, 0.0 if i % 5 == 0 else -3.0) for i in range(100)], "k long, leading_silence_s double, trailing_silence_s double, narrowband_proxy double, rolloff95_hz double, peak_dbfs double")
    plan = audio.shift_plan(spark.range(4000).withColumnRenamed("id", "key"), "key", public, "k", 3).toPandas()
    assert len(plan) == 4000 and {round(v, 1): n // 150 for v, n in Counter(plan.lead_s).items()} == {0.0: 6, 0.1: 6, 0.2: 6, 0.3: 6}
    assert plan.band_limit.mean() == pytest.approx(0.3, abs=0.03) and plan.peak_limit.mean() == pytest.approx(0.2, abs=0.03)
    again = audio.shift_plan(spark.range(100).withColumnRenamed("id", "key"), "key", public, "k", 3).toPandas()
    both = again.merge(plan, on="key", suffixes=("", "_all"))
    assert (both.lead_s == both.lead_s_all).all() and (both.peak_limit == both.peak_limit_all).all()
    df = spark.createDataFrame([([0.1, -0.2, 0.3, 0.4, 0.2],)], "x array<double>")
    lit = F.lit
    y = df.select(audio.shifted(F.col("x"), lit(0.002), lit(0.001), lit(False), lit(False), 1000).alias("a"), audio.shifted(F.col("x"), lit(0.0), lit(0.0), lit(True), lit(True), 1000).alias("b")).first()
    assert y.a == [0.0, 0.0, 0.1, -0.2, 0.3, 0.4, 0.2, 0.0] and np.allclose(y.b, np.tanh(1.6 * np.array([0.1, 0.2, 0.3, 0.25, 0.2]) * 0.98 / 0.3) / np.tanh(1.6))
