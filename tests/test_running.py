"""Running sums over range partitions, deep pages, several ROC labels, retention in place."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from vigilspark.operators import dashboard as DB
from vigilspark.operators import events as EV
from vigilspark.operators import ml as ML
from vigilspark.operators.running import running_sums
from vigilspark.plans.registry import queries
from vigilspark.session import scratch_path
from vigilspark.sources import fixtures as FX

from .conftest import SF_ORACLE, SF_SMALL


def test_running_sums_equal_a_loop(spark):
    r = random.Random(3)
    rows = [(i, r.choice("aab"), r.randrange(1000), r.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, o long, v long")
    got = {x.id: x.s for x in running_sums(df, [F.col("o").desc(), F.col("id")], {"s": F.col("v")}, ["g"]).collect()}
    for g in "ab":
        total = 0
        for i, _, o, v in sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0])):
            total += v
            assert got[i] == total
    assert running_sums(df.limit(0), [F.col("o")], {"s": F.col("v")}).count() == 0


@pytest.mark.parametrize("num", [1, 7, 20, 21, 50])
def test_any_page_equals_offset_and_limit(spark, num):
    e = FX.security_events(spark, SF_SMALL)
    want = [x.id for x in DB.page(e, 50, num).collect()]
    assert [x.id for x in DB.page_at(e, 50, num).collect()] == want


def test_roc_of_several_labels(spark):
    r = random.Random(5)
    rows = [(n, r.choice([0, 1, None]), round(r.random(), 2)) for n in "xy" for _ in range(700)] + [("x", 1, None), ("z", 1, 0.5)]
    df = spark.createDataFrame(rows, "name string, label int, score double")
    got = {x.label_name: x for x in ML.roc_auc(df, name_col="name").collect()}
    for n in "xy":
        pos = [s for m, y, s in rows if m == n and y == 1 and s is not None]
        neg = [s for m, y, s in rows if m == n and y == 0]
        want = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
        assert abs(got[n].auc - want) < 1e-12 and (got[n].positives, got[n].negatives) == (len(pos), len(neg))
    assert got["z"].auc is None  # no negatives
    curve = ML.roc_points(df, name_col="name").where("label_name = 'x'").orderBy(F.col("score").desc_nulls_first()).collect()
    assert (curve[0].fpr, curve[0].tpr) == (0.0, 0.0) and (curve[-1].fpr, curve[-1].tpr) == (1.0, 1.0)


def test_retention_rewrites_one_day_and_drops_older_ones(spark):
    at = lambda d, h=0: dt.datetime(2024, 3, d, h)
    rows = [(k, t) for k, t in enumerate([at(1), at(1, 5), at(2), at(3, 1), at(3, 11), at(3, 12), at(3, 13), at(4), at(5), None])]
    e = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz")
    path = scratch_path(spark, "retention-test").removeprefix("file:")
    EV.append_events(e, path)

    def files():
        return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}

    before = files()
    assert EV.rewrite_retention(spark, path, "2024-03-13 12:00:00", 10) == 2
    after = files()
    assert sorted(x.id for x in EV.read_events(spark, path).collect()) == [5, 6, 7, 8, 9]
    untouched = {f for f in before if f.split("=")[1][:10] in ("2024-03-04", "2024-03-05", "__HIVE_DEF")}
    assert len(untouched) == 3 and untouched <= after
    assert not any("2024-03-01" in f or "2024-03-02" in f for f in after)
    assert EV.rewrite_retention(spark, path, "2024-03-13 12:00:00", 10) == 0
    assert EV.rewrite_retention(spark, path, "2024-03-13 23:00:00", 10) == 1  # nothing of the cutoff's day is left


def test_views_reach_every_outcome(spark):
    """Bursts of one client make rate-limited audit rows."""
    kinds = {r.event_type: r["count"] for r in queries()["event_assembly"](spark, SF_ORACLE).groupBy("event_type").count().collect()}
    assert kinds["rate_limit"] > 0 and len(kinds) >= 3
