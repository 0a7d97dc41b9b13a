"""Fixed-window rate limit (H8): the n-th request of a client within a window
is allowed iff n <= limit; rejected requests still count.

A plain ``row_number() over (partition by client, window)`` sends a whole
(client, window) group to one task, and one client may hold a third of all
requests.  Instead the rank is computed in two exact steps:

1. salt each group into ``salts`` sub-groups by a hash of the row id and rank
   within each sub-group.  A row whose sub-group rank exceeds the limit cannot
   be within the group's first ``limit`` rows (every row ahead of it in its
   sub-group is also ahead of it in the group), so it is rejected right away;
2. the remaining candidates (at most ``limit * salts`` per group) are ranked
   again per group; their rank there equals their rank in the whole group.  The
   rejected rows pass through the same window in their sub-groups, so the whole
   is one scan and two exchanges, without a union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def window_start(ts: Column, unit: str = "minute") -> Column:
    """Fixed window start, TIMESTAMP_NTZ (``date_trunc`` returns a session-zone
    TIMESTAMP)."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def rate_limit(df: DataFrame, client_col: str, ts_col: str, id_col: str,
               limit: int = rules.MAX_REQUESTS_PER_MINUTE, unit: str = "minute",
               salts: int = 64) -> DataFrame:
    """Adds ``window_start``, ``allowed`` and ``rank_in_window`` (exact when the
    row is allowed; NULL for rows rejected in step 1)."""
    key = [F.col(client_col), F.col("window_start")]
    order = [F.col(ts_col), F.col(id_col)]
    base = df.withColumn("window_start", window_start(F.col(ts_col), unit)) \
        .withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)))
    sub = Window.partitionBy(*key, F.col("_salt")).orderBy(*order)
    ranked = base.withColumn("_sub_rank", F.row_number().over(sub))

    # candidates of a group meet in part -1, rejected rows stay spread by their salt
    candidate = F.col("_sub_rank") <= limit
    parted = ranked.withColumn("_part", F.when(candidate, F.lit(-1)).otherwise(F.col("_salt")))
    whole = Window.partitionBy(*key, F.col("_part")).orderBy(*order)
    done = parted.withColumn("_rank", F.row_number().over(whole))
    allowed = candidate & (F.col("_rank") <= limit)
    return done.withColumn("allowed", allowed) \
        .withColumn("rank_in_window", F.when(allowed, F.col("_rank")).cast("int")) \
        .drop("_salt", "_sub_rank", "_part", "_rank")


def rate_limit_exact_window(df: DataFrame, client_col: str, ts_col: str, id_col: str,
                            limit: int = rules.MAX_REQUESTS_PER_MINUTE, unit: str = "minute") -> DataFrame:
    """Reference formulation (one window per group); used by tests as the
    brute-force check of ``rate_limit``."""
    w = Window.partitionBy(F.col(client_col), window_start(F.col(ts_col), unit)).orderBy(F.col(ts_col), F.col(id_col))
    return df.withColumn("window_start", window_start(F.col(ts_col), unit)) \
        .withColumn("rank_in_window", F.row_number().over(w)) \
        .withColumn("allowed", F.col("rank_in_window") <= limit)
