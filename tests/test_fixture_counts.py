"""The derived views reproduce the counts stated in FIXTURES.md §6 (sf0.01)."""

from pyspark.sql import functions as F

from vigilspark.operators import stats as ST
from vigilspark.plans.registry import queries
from vigilspark.sources import fixtures as FX

from .conftest import SF_ORACLE


def test_view_counts(spark):
    q = queries()
    ts = q["threat_summary"](spark, SF_ORACLE).first()
    assert (ts["total_events"], ts["blocked_requests"]) == (329, 195)
    e = FX.security_events(spark, SF_ORACLE)
    assert e.where(F.col("timestamp") >= ST.since_hours(FX.AS_OF, 24)).select("user_id").distinct().count() == 133
    assert ST.threat_summary(e, FX.AS_OF, 1).first()["total_events"] == 14
    assert q["retention"](spark, SF_ORACLE).first()["deleted"] == 5320
    assert q["rate_limit"](spark, SF_ORACLE).where(~F.col("allowed")).count() == 3097
    assert FX.prompts(spark, SF_ORACLE).count() == 279
    assert FX.pairs(spark, SF_ORACLE).count() == 233
    s = FX.scored(spark, SF_ORACLE).where("label_name = 'toxic'").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"),
                                        F.countDistinct("score").alias("d")).first()
    assert (s["n"], s["pos"], s["d"]) == (399, 51, 301)


def test_views_conform_to_schemas_and_domains(spark):
    from vigilspark import schemas as SC
    from vigilspark.operators import events as EV
    from .conftest import SF_SMALL
    ev = FX.security_events(spark, SF_SMALL)
    assert [f.name for f in ev.schema.fields] == [f.name for f in SC.SECURITY_EVENTS.fields]
    conformed = SC.conform(ev, SC.SECURITY_EVENTS).schema
    assert [(f.name, f.dataType) for f in conformed] == [(f.name, f.dataType) for f in SC.SECURITY_EVENTS]
    assert SC.domain_violations(ev, {"event_type": SC.EVENT_TYPES, "severity": SC.SEVERITIES}).count() == 0
    rq = EV.requests_from_events(ev)
    assert [f.name for f in rq.schema.fields] == [f.name for f in SC.REQUESTS.fields]
    assert SC.domain_violations(rq, {"status": SC.REQUEST_STATUSES}).count() == 0
    inc = EV.incidents_from_events(ev)
    assert [f.name for f in inc.schema.fields] == [f.name for f in SC.INCIDENTS.fields]


def test_rule_prompts_reach_every_rule_and_tangled_texts_overlap(spark):
    from vigilspark.functions import rules
    from vigilspark.operators.outbound import outbound_scan
    from vigilspark.plans.registry import queries
    from vigilspark.sources import fixtures as FX
    from .conftest import SF_ORACLE
    got = {(r["threat"], r["rule"]) for r in queries()["inbound_rules"](spark, SF_ORACLE).select("threat", "rule").distinct().collect()}
    assert got == {(t, p) for t, ps in rules.RULE_SETS.items() for p in ps}
    df = spark.createDataFrame(list(enumerate(FX.TANGLED_TEXTS)), "id int, text string")
    for r in outbound_scan(df, "text").collect():
        spans = sorted((f["start"], f["end"]) for f in r["findings"])
        assert any(b[0] < a[1] for a, b in zip(spans, spans[1:])), r["text"]
