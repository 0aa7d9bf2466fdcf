"""The cohort bank as one chain: alignment, filters, exclusions, limits, disjointness, unit vectors, files and a summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import unit_vector
from tessera.operators.profile import numbered
from tessera.operators.skew import with_count
from tessera.sources import arrays, schema
from tessera.sources.lineage import cut


@dataclass(frozen=True)
class Selection:
    """Which rows a bank takes: allowed values by column, how many rows of an owner, how many in all (None: no cap)."""

    filters: dict[str, list[str]] = field(default_factory=dict)
    least: int = 1
    most: int | None = None
    total: int | None = None
    fallback: bool = False
    strict: bool = True


def build_bank(metadata: DataFrame, vectors: DataFrame, path: str, key: str, owner: str, trial_keys: Column, trials: DataFrame, validation: DataFrame, selection: Selection) -> DataFrame:
    """Writes the bank to `path` (see arrays.write_bank; metadata with `place`, vectors of length one) and gives its summary, one row.

    metadata(key, owner, ...) and vectors(key, v) must hold the same keys, once each. Rows whose trial_keys (an array) meet trials(key) are
    left out; where that leaves nothing and the selection allows it, they stay and the summary says so. Owners of fewer than `least`
    rows go, others keep their first `most` by key, and of these `total` are taken, owners in turn. With `strict`, owners that
    validation(owner) also holds are an error, and so always are an empty bank and vectors without length or with non-finite parts.
    """
    source = cut(schema.one_to_one(metadata, vectors, key))
    filtered = cut(schema.metadata_filter(source, selection.filters))
    kept = schema.without_overlap(filtered, key, trial_keys, trials, False)
    n_source, n_filtered, n_kept = source.count(), filtered.count(), kept.count()
    fell_back = n_kept == 0 and n_filtered > 0 and selection.fallback
    after = cut(filtered if fell_back else kept)
    sized = with_count(after, owner, "_n")
    large = sized.where(F.col("_n") >= selection.least)
    turn = F.row_number().over(Window.partitionBy(owner).orderBy(F.asc(key)))
    limited = large.withColumn("_turn", turn)
    limited = cut(limited.where(F.col("_turn") <= selection.most) if selection.most is not None else limited)
    placed = numbered(limited, [F.asc("_turn"), F.asc(owner), F.asc(key)], "_number")
    final = cut((placed.where(F.col("_number") <= selection.total) if selection.total is not None else placed).withColumn("place", F.col("_number") - 1).drop("_n", "_turn", "_number"))
    n_final = final.count()
    if not n_final:
        raise ValueError("no rows are left for the bank")
    shared = final.select(owner).distinct().join(validation.select(owner).distinct(), owner, "left_semi")
    names = [r[0] for r in shared.orderBy(owner).limit(10).collect()]
    if names and selection.strict:
        raise ValueError(f"owners of the bank are in the validation set too: {', '.join(map(str, names))}")
    faults = schema.vector_faults(final.select(key, "v"), key, "v").limit(5).collect()
    if faults:
        raise ValueError(f"vectors without a direction: {[tuple(r) for r in faults]}")
    arrays.write_bank(final.withColumn("v", unit_vector(F.col("v"))), path, "place", "v")
    n_large, n_limited = after.count() - large.count(), limited.count()
    counts = {
        "source_rows": n_source, "after_filters": n_filtered, "after_trials": n_filtered if fell_back else n_kept, "selected_rows": n_final, "selected_owners": final.select(owner).distinct().count(),
        "excluded_by_filters": n_source - n_filtered, "excluded_by_trials": 0 if fell_back else n_filtered - n_kept, "excluded_by_least": n_large, "excluded_by_most": large.count() - n_limited, "excluded_by_total": n_limited - n_final,
        "shared_owners": shared.count(), "width": len(final.select("v").first()[0]),
    }
    return metadata.sparkSession.createDataFrame([(*counts.values(), fell_back)], ", ".join(f"{n} long" for n in counts) + ", fallback_used boolean")
