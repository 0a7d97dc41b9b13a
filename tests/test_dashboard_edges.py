"""Dashboard edge cases and the audit-log -> dashboard round trip."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilspark.operators import dashboard as DB
from vigilspark.operators import events as EV
from vigilspark.operators import proxy as PX
from vigilspark.sources.fixtures import PINNED_PROMPTS

AS_OF = "2024-01-31 00:00:00"


def _log(spark):
    t = dt.datetime(2024, 1, 30, 12, 0)
    rows = [(i, t + dt.timedelta(minutes=i), f"c{i % 3}", p, "gpt-4")
            for i, p in enumerate(PINNED_PROMPTS + ["hello there", "what is the weather?"])]
    req = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, client_id string, prompt string, model string")
    # the proxy writes its log; dashboards read it (a lineage boundary)
    return EV.materialize_log(PX.to_events(PX.process_requests(req)))


def test_audit_rows_feed_the_dashboard(spark):
    ev = _log(spark)
    rq = EV.requests_from_events(ev)
    dist = {r["threat_type"]: r["count"] for r in DB.threat_distribution(rq, AS_OF, hours=48).collect()}
    # pinned verdicts: 5 injection, 1 jailbreak, 2 exfiltration are blocked
    assert dist == {"prompt_injection": 4, "jailbreak": 1, "data_exfiltration": 2}
    kpi = DB.overview_kpis(rq, AS_OF, hours=48).first()
    assert (kpi["total_requests"], kpi["blocked_requests"], kpi["unique_threats"]) == (25, 7, 3)
    served = rq.where(F.col("status") == "success").select("llm_provider").distinct().collect()
    assert [r[0] for r in served] == ["gpt-4"]


def test_empty_multiselect_gives_no_incidents(spark):
    ev = _log(spark)
    inc, rq = EV.incidents_from_events(ev), EV.requests_from_events(ev)
    assert DB.incident_list(inc, rq, AS_OF, "All Time", severities=[]).count() == 0
    assert DB.incident_list(inc, rq, AS_OF, "All Time", threats=()).count() == 0
    assert DB.incident_list(inc, rq, AS_OF, "All Time", severities=["critical", "high"]).count() == 7


def test_paging_and_search(spark):
    ev = _log(spark)
    lst = DB.incident_list(EV.incidents_from_events(ev), EV.requests_from_events(ev), AS_OF, "All Time")
    with pytest.raises(ValueError):
        DB.page(lst, page_size=7)
    pages = DB.page_count(lst, 10).first()
    assert (pages["n_rows"], pages["total_pages"]) == (7, 1)
    assert DB.page_count(lst.limit(0), 10).first()["total_pages"] == 1
    p1 = [r["id"] for r in DB.page(lst, 10, 1).collect()]
    assert p1 == sorted(p1, reverse=True) and len(p1) == 7
    assert DB.page(lst, 10, 2).count() == 0
    # search matches column values, never text spanning two columns
    assert DB.search(lst, "request blockedhigh").count() == 0
    assert DB.search(lst, "REQUEST BLOCKED").count() == 7
