"""The filterbank against a plain loop, and streams against whole signals: any cut, any order, any restart."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import filterbank
from tessera.operators.filterbank import FilterBank
from tessera.streaming import frontend, jobs

SMALL = FilterBank(rate=1000, bands=5, frame_ms=16, hop_ms=6, fft=32, low=20.0)


def plain(x, bank):
    """Frames and log energies by loops over samples, frequencies and bands."""
    x = list(x)
    if not x:
        return []
    n = 1 if len(x) <= bank.size else math.ceil((len(x) - bank.size) / bank.hop) + 1
    if not bank.pad_end:
        n = 0 if len(x) < bank.size else (len(x) - bank.size) // bank.hop + 1
    x += [0.0] * max(0, (n - 1) * bank.hop + bank.size - len(x))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    low, high = mel(bank.low), mel(bank.top)
    corner = [700 * (10 ** ((low + (high - low) * i / (bank.bands + 1)) / 2595) - 1) for i in range(bank.bands + 2)]
    a = 0.5 if bank.window == "hann" else 0.54
    out = []
    for f in range(n):
        part = [v * (a - (1 - a) * math.cos(2 * math.pi * i / (bank.size - 1))) for i, v in enumerate(x[f * bank.hop : f * bank.hop + bank.size])]
        power = []
        for k in range(bank.fft // 2 + 1):
            re, im = (sum(v * g(2 * math.pi * k * i / bank.fft) for i, v in enumerate(part)) for g in (math.cos, math.sin))
            power.append((re * re + im * im) ** (bank.power / 2))
        row = []
        for b in range(bank.bands):
            total = 0.0
            for k, p in enumerate(power):
                hz = bank.rate / bank.fft * k
                total += p * max(0.0, min((hz - corner[b]) / (corner[b + 1] - corner[b]), (corner[b + 2] - hz) / (corner[b + 2] - corner[b + 1])))
            row.append(math.log(max(total, bank.floor)))
        out.append(row)
    return out


def plain_normalised(rows, window):
    out = []
    for i in range(len(rows)):
        x = np.array(rows[max(0, i - window + 1) : i + 1])
        out.append(((x[-1] - x.mean(axis=0)) / np.sqrt(np.maximum(x.var(axis=0), 1e-5))).tolist())
    return out


def signals():
    rng = np.random.default_rng(3)
    return {f"s{n}": rng.normal(size=n).round(4).tolist() for n in (1, 5, 15, 16, 17, 21, 22, 23, 28, 100, 257)}


@pytest.mark.parametrize("bank", [SMALL, FilterBank(rate=1000, bands=4, frame_ms=16, hop_ms=16, fft=16, window="hamming", power=1.0, pad_end=False, high=400.0)])
@pytest.mark.parametrize("normalise", [0, 4])
def test_whole_signals(spark, bank, normalise):
    rows = [*signals().items(), ("none", None), ("empty", [])]
    got = spark.createDataFrame(rows, "utt string, x array<double>").select("utt", filterbank.log_mel(bank, normalise)("x").alias("m")).collect()
    for r in got:
        want = plain(dict(rows)[r.utt] or [], bank)
        want = plain_normalised(want, normalise) if normalise else want
        assert len(r.m) == len(want) and np.allclose(np.array(r.m), np.array(want), atol=1e-7) if want else r.m == []


def test_default_bank():
    bank = FilterBank()
    x = np.sin(np.arange(16_000) / 5)
    assert bank.energies(bank.frames(x, True)[0]).shape == (99, 80) and (bank.size, bank.hop) == (400, 160)
    assert np.allclose(bank.energies(bank.frames(x[:900], True)[0])[:2, :8], np.array(plain(x[:900], bank))[:2, :8], atol=1e-9)
    for wrong in ({"rate": 0}, {"fft": 256}, {"window": "box"}, {"high": 9000.0}, {"hop_ms": 30.0}):
        with pytest.raises(ValueError):
            FilterBank(**wrong)


def chunked(sizes, rate=None):
    rows = []
    for utt, x in signals().items():
        at, seq = 0, 0
        while at < len(x) or not seq:
            n = sizes[seq % len(sizes)]
            rows.append((utt, seq, x[at : at + n], at + n >= len(x)))
            at, seq = at + n, seq + 1
    return rows


@pytest.mark.parametrize("sizes, normalise", [((7, 0, 30), 4), ((1000,), 0)])
def test_stream_of_chunks(spark, tmp_path, sizes, normalise):
    """Frames of a stream equal those of the whole signals; chunks come shuffled over files, and some twice."""
    rows = chunked(sizes)
    df = spark.createDataFrame([*rows, *rows[::9]], frontend.CHUNK)
    df.repartition(3, F.xxhash64("utt", "seq")).write.parquet(f"{tmp_path}/in")
    got = jobs.replay(spark, f"{tmp_path}/in", lambda s: frontend.online_bank(s, SMALL, normalise), "append").collect()
    want = {utt: plain(x, SMALL) for utt, x in signals().items()}
    want = {u: plain_normalised(w, normalise) if normalise else w for u, w in want.items()}
    found = {u: {} for u in want}
    for r in got:
        assert r.frame not in found[r.utt]
        found[r.utt][r.frame] = r["values"]
    for u, w in want.items():
        assert sorted(found[u]) == list(range(len(w))), u
        assert np.allclose(np.array([found[u][i] for i in range(len(w))]), np.array(w), atol=1e-7), u


def test_restart(spark, tmp_path):
    """State survives the end of a query: a second run over new files goes on where the first stopped."""
    rows = chunked((5,))
    first, rest = [r for r in rows if r[1] < 3], [r for r in rows if r[1] >= 3]
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for part in (first, rest):
        spark.createDataFrame(part, frontend.CHUNK).write.mode("append").parquet(source)
        jobs.run_to_end(spark, source, lambda s: frontend.online_bank(s, SMALL, 3), out, state)
    got = sorted((r.utt, r.frame) for r in spark.read.parquet(out).collect())
    assert got == sorted((u, i) for u, x in signals().items() for i in range(len(plain(x, SMALL))))


def test_idle_signals_end(spark, tmp_path):
    """Without a last chunk a signal ends when nothing has come for a while: its padded frame is written by a timer."""
    x = signals()["s23"]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("u", 0, x, False)], frontend.CHUNK).write.parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    frames = frontend.online_bank(spark.readStream.schema(frontend.CHUNK).parquet(source), SMALL, idle_ms=100)
    query = frames.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start(out, "parquet", "append")
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        got, began = [], time.time()
        while len(got) < len(plain(x, SMALL)) and time.time() - began < 60:
            time.sleep(0.5)
            got = [r.frame for r in spark.read.schema("utt string, frame long, values array<double>").parquet(out).collect()] if query.recentProgress else []
    finally:
        query.stop()
    assert sorted(got) == list(range(len(plain(x, SMALL))))


def activity(x, rates, widths):
    """Windows of a signal by a loop; rates gives each sample's rate, a change of which begins anew."""
    out, i = [], 0
    while i < len(x):
        rate = rates[i]
        end = next((j for j in range(i, len(x)) if rates[j] != rate), len(x))
        width, before = widths[rate]
        context, hidden = [0.0] * before, None
        part = x[i:end]
        for a in range(0, len(part), width):
            w = part[a : a + width]
            if len(w) < width:
                if end < len(x):
                    break  # what is left over before a change of rate is dropped
                w = w + [0.0] * (width - len(w))
            level = 10 * math.log10(max(sum(v * v for v in context + w) / (before + width), 1e-10))
            hidden = [level] * 3 if hidden is None else [d * h + (1 - d) * level for d, h in zip((0.5, 0.9, 0.99), hidden, strict=True)]
            out.append(1 / (1 + math.exp(-0.5 * (hidden[0] - hidden[2] - 6))))
            context = (context + w)[-before:]
        i = end
    return out


@pytest.mark.parametrize("sizes", [(3,), (11, 40)])
def test_activity(spark, tmp_path, sizes):
    """Probabilities do not depend on the cut; a change of rate resets hidden vector, context and left-over samples."""
    widths = {8: (6, 2), 16: (10, 3)}
    rng = np.random.default_rng(4)
    x = (rng.normal(size=200) * np.repeat(rng.choice([0.01, 1.0], 20), 10)).tolist()
    rates = [8] * 77 + [16] * 65 + [8] * 58
    rows, at, seq = [], 0, 0
    while at < len(x):
        end = min(at + sizes[seq % len(sizes)], next((j for j in range(at, len(x)) if rates[j] != rates[at]), len(x)))
        rows.append(("u", seq, x[at:end], end == len(x), float(rates[at])))
        at, seq = end, seq + 1
    spark.createDataFrame(rows, frontend.CHUNK + ", extra double").repartition(3, "seq").write.parquet(f"{tmp_path}/in")
    got = jobs.replay(spark, f"{tmp_path}/in", lambda s: frontend.online_activity(s, widths=widths), "append").toPandas().sort_values("window")
    want = activity(x, rates, widths)
    assert list(got.window) == list(range(len(want))) and np.allclose(got.probability, want, atol=1e-9) and isinstance(got, pd.DataFrame)
