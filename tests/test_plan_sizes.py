"""What the driver plans stays small: tables that are read several times are written once."""

from __future__ import annotations

import pytest

from tessera import plans
from tessera.operators import graph, rerank, skew


@pytest.mark.parametrize("name, most", [("r6_cluster_first", 16_000), ("r5_propagation_rerank", 16_000), ("g8_split_oversized", 8_000)])
def test_plans_stay_small(spark, sf, name, most):
    """Label propagation, splitting and counting of clusters were planned anew wherever their labels were read."""
    size = lambda df: len(df._jdf.queryExecution().executedPlan().toString())
    seen, real = [], graph.cut
    for module in (graph, rerank, skew):
        module.cut = lambda df: (seen.append(size(df)), real(df))[1]
    try:
        seen.append(size(plans.QUERIES[name](spark, sf)))
    finally:
        for module in (graph, rerank, skew):
            module.cut = real
    print(name, seen)
    assert max(seen) <= most
