"""Physical-plan properties that matter at scale."""

from vigilspark.plans import registry

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_stay_in_jvm(spark):
    q = registry.queries()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show codegen stages before execution
    try:
        for name in ("redact_documents", "inbound_scan", "event_assembly", "policy_match"):
            p = _plan(q[name](spark, SF_SMALL))
            assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p, name
            assert "*(" in p, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_time_filter_pushed_and_columns_pruned(spark):
    q = registry.queries()
    p = _plan(q["overview_kpis"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in p
    read = p[p.index("ReadSchema"):].split("\n")[0]
    assert "user_id" not in read and "event_id" not in read


def test_top_k_not_global_sort(spark):
    q = registry.queries()
    p = _plan(q["recent_events"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
    p = _plan(q["incident_page"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_rate_limit_salted(spark):
    q = registry.queries()
    p = _plan(q["rate_limit"](spark, SF_SMALL))
    assert "_salt" in p
    assert p.count("FileScan") == 1 and p.count("Exchange hashpartitioning") == 2 and "Union" not in p


def test_incident_list_reads_both_sides_in_the_time_range(spark):
    p = _plan(registry.queries()["incident_list"](spark, SF_SMALL))
    scans = [x for x in p.split("\n") if "FileScan" in x]
    assert len(scans) == 2 and all("GreaterThan(ts," in x for x in scans)


def test_policy_snapshot_is_one_aggregation(spark):
    from vigilspark.operators import policies as PL
    from vigilspark.sources import fixtures as FX
    tracker = spark.sparkContext.statusTracker()
    changes = FX.policy_changes(spark, SF_SMALL)
    spark.sparkContext.setJobGroup("snapshot_plan", "plan only")
    p = _plan(PL.policy_snapshot(changes))
    assert list(tracker.getJobIdsForGroup("snapshot_plan")) == []  # no job while the plan is built
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert p.count("FileScan") == 1 and p.count("Exchange hashpartitioning") == 1 and "Join" not in p


def test_verdict_filters_keep_plans_small(spark):
    # filters on verdict columns stop at the scan's metrics node instead of
    # inlining the whole regex pipeline (which grew plans to tens of MB)
    from pyspark.sql import functions as F
    from vigilspark.operators import dashboard as DB
    from vigilspark.operators import events as EV
    from vigilspark.operators import proxy as PX
    from vigilspark.sources import fixtures as FX
    q = registry.queries()
    assert len(q["label_actions"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    ev = PX.to_events(PX.process_requests(FX.prompts(spark, SF_SMALL)))
    lst = DB.incident_list(EV.incidents_from_events(ev), EV.requests_from_events(ev), FX.AS_OF, "All Time")
    assert len(lst._jdf.queryExecution().optimizedPlan().toString()) < 1_000_000
    assert lst.where(F.col("threat_type").isNotNull()).count() == lst.count()


def test_scan_metrics_observation(spark):
    from pyspark.sql import Observation
    from vigilspark.operators.outbound import outbound_scan
    from vigilspark.sources import fixtures as FX
    obs = Observation("outbound_metrics_test")
    s = outbound_scan(FX.responses(spark, SF_SMALL), "text", observation=obs)
    n = s.count()
    m = obs.get
    assert m["rows"] == n and 0 < m["threats"] <= n
