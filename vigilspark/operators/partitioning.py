"""Plan shapes for CPU-heavy per-row work (regex scans over text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def explode_computed(arr, alias: str):
    """``explode`` for an array computed in the same plan.  A plain explode
    makes the optimizer add ``size(arr) > 0`` below the projection, which
    evaluates the (expensive) array expression twice; ``explode_outer`` has no
    inferred filter, and callers drop its one NULL row per empty input."""
    return F.explode_outer(arr).alias(alias)


def posexplode_computed(arr, pos: str, alias: str):
    return F.posexplode_outer(arr).alias(pos, alias)


def observe_scan(df: DataFrame, kind: str, passed_col: str = "passed", observation=None) -> DataFrame:
    """Scan metrics (rows, threats) on a scan's output, via ``observe``.

    Pass a ``pyspark.sql.Observation`` to read them after an action; otherwise
    they are published under a unique name (query listeners, streaming
    progress).  The metrics node is also where filters on verdict columns
    stop: without it the optimizer pushes such filters below the scan's
    projections, substituting (and so evaluating twice) the whole regex
    pipeline inside the filter, and long chains grow the plan
    multiplicatively."""
    import uuid
    target = observation if observation is not None else f"vigilspark_{kind}_{uuid.uuid4().hex[:12]}"
    return df.observe(target, F.count(F.lit(1)).alias("rows"),
                      F.count_if(~F.col(passed_col)).alias("threats"))
