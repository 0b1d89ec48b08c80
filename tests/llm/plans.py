"""What the plan of a table does, before it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def joins_over(df: DataFrame, node: str) -> set[str]:
    """The names of the joins one side of which sorts, hashes or sends rows that come from such a node, with no join between."""
    found: set[str] = set()

    def inside(plan) -> bool:
        """Whether a node of the name is below, down to the next join."""
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "AdaptiveSparkPlan":
            below = [plan.inputPlan()]
        holds = any([inside(p) for p in below])
        if "Join" in plan.nodeName():
            if holds:
                found.add(plan.nodeName())
            return False
        return holds or plan.nodeName() == node

    inside(df._jdf.queryExecution().executedPlan())
    return found
