"""Column builders: bucket ladders, flags, recodes, hashes and vector arithmetic, all inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, edges: Sequence[float], labels: Sequence[str], null: str | None = None, upper_closed: bool = False) -> Column:
    """labels[i] for the first edge above value (or not below it, if upper_closed); the last label beyond all edges.

    A null takes the label `null`, or, where none is given, the last one, as comparisons with null never hold.
    """
    out = F.when(value.isNull(), null) if null is not None else None
    for edge, label in zip(edges, labels, strict=False):
        test = value <= edge if upper_closed else value < edge
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(labels[-1])


# Edges and names of the profiling buckets.
DURATION_EDGES = (1, 2, 4, 6, 10, 20, 40)
DURATION_LABELS = ("0-1s", "1-2s", "2-4s", "4-6s", "6-10s", "10-20s", "20-40s", "40s+")
LENGTH_EDGES = (2, 4, 6, 10, 20, 40)
LENGTH_LABELS = ("very_short", "short", "medium", "normal", "long", "very_long", "extra_long")
SILENCE_EDGES, SILENCE_LABELS = (0.1, 0.3, 0.5), ("0-10%", "10-30%", "30-50%", "50%+")
NARROW_EDGES, NARROW_LABELS = (0.25, 0.5, 0.75), ("low", "medium", "high", "very_high")
RMS_EDGES, RMS_LABELS = (-40, -30, -20), ("very_low", "low", "mid", "high")
EDGE_SILENCE_EDGES, EDGE_SILENCE_LABELS = (0.2, 1.0), ("none", "short", "long")


def duration_bucket(c: Column) -> Column:
    return ladder(c, DURATION_EDGES, DURATION_LABELS, "unknown")


def length_bucket(c: Column) -> Column:
    return ladder(c, LENGTH_EDGES, LENGTH_LABELS)


def silence_bucket(c: Column) -> Column:
    return ladder(c, SILENCE_EDGES, SILENCE_LABELS, "unknown")


def narrowband_bucket(c: Column) -> Column:
    return ladder(c, NARROW_EDGES, NARROW_LABELS, "unknown")


def rms_bucket(c: Column) -> Column:
    return ladder(c, RMS_EDGES, RMS_LABELS, upper_closed=True)


def edge_silence_bucket(c: Column) -> Column:
    return ladder(c, EDGE_SILENCE_EDGES, EDGE_SILENCE_LABELS)


def domain_cluster() -> Column:
    """The first diagnosis that holds, from a broken file to a clean one; unknown metrics hold none."""
    c = F.col
    rules = [
        ("read_error", c("error").isNotNull()),
        ("not_profiled", c("duration_s").isNull() & c("rms_dbfs").isNull()),
        ("short", c("duration_s") < 2.0),
        ("clipped", (c("clipping_frac") >= 0.01) | (c("peak_dbfs") >= -0.1)),
        ("silence_heavy", c("silence_ratio_40db") >= 0.5),
        ("low_volume", c("rms_dbfs") <= -40.0),
        ("narrowband_like", (c("narrowband_proxy") >= 0.5) | (c("rolloff95_hz") <= 3800.0)),
        ("noise_like", (c("spectral_flatness") >= 0.35) & (c("rms_dbfs") >= -35.0)),
    ]
    out = F
    for label, test in rules:
        out = out.when(test, label)
    return out.otherwise("cleanish")


def quality_flags() -> dict[str, Column]:
    c = F.col
    return {
        "peak_limited_flag": c("peak_dbfs") >= -0.1,
        "hard_clipped_flag": c("clipping_frac") > 0.01,
        "narrowband_like_flag": (c("narrowband_proxy") >= 0.5) | (c("rolloff95_hz") <= 3800.0),
        "silence_heavy_flag": c("silence_ratio_40db") >= 0.5,
        "low_rms_flag": c("rms_dbfs") <= -40.0,
    }


def count_bin(n: Column, edges: Sequence[int]) -> Column:
    """Names of count ranges: `<a`, `a-b`, ..., `z+`."""
    labels = [f"<{edges[0]}", *(f"{a}-{b - 1}" for a, b in zip(edges, edges[1:], strict=False)), f"{edges[-1]}+"]
    return ladder(n, edges, labels)


def bin_of(value: Column, edges: Column, right: bool) -> Column:
    """How many edges do not exceed the value (right), or lie below it: the place of a value among ascending edges."""
    return F.size(F.filter(edges, (lambda e: e <= value) if right else (lambda e: e < value)))


def weighted_distance(names: Sequence[str], centre: dict[str, float], scale: dict[str, float], weight: dict[str, float]) -> Column:
    """Sum of weight * ((x - centre) / scale) ** 2."""
    out = F.lit(0.0)
    for n in names:
        out = out + weight[n] * F.pow((F.col(n) - centre[n]) / scale[n], F.lit(2.0))
    return out


def recode(value: Column, table: dict[str, str], default: str) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(default))


def hash_order(seed: str, *key: Column) -> Column:
    """A reproducible shuffle key, the same in any engine: sha256 of seed|key."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]), 256)


def present(c: Column) -> Column:
    """The trimmed value, null where blank."""
    return F.nullif(F.trim(c), F.lit(""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a: Column, least: float = 1e-12) -> Column:
    length = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / length)


def normalised_entropy(p: Column) -> Column:
    """Entropy of clipped, renormalised probabilities over log(max(size, 2))."""
    clipped = F.transform(p, lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))
    total = F.greatest(F.aggregate(clipped, F.lit(0.0), lambda s, x: s + x), F.lit(1e-12))
    h = F.aggregate(clipped, F.lit(0.0), lambda s, x: s - (x / total) * F.ln(F.greatest(x / total, F.lit(1e-12))))
    return h / F.ln(F.greatest(F.size(p), F.lit(2)).cast("double"))
