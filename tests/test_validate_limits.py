"""Validation rows (FIXTURES.md §4) and the rate limiter."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vigilspark.operators.limits import rate_limit, rate_limit_exact_window
from vigilspark.operators.validate import validate_requests

SCHEMA = "request_id long, prompt string, model string, max_tokens int, temperature double, extra string"


def _v(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["request_id"]: r for r in validate_requests(df).collect()}


def test_validation_rows(spark):
    rows = [
        (1, "A" * 15000, "gpt-3.5-turbo", None, None, None),
        (2, "", "gpt-3.5-turbo", None, None, None),
        (3, "   ", "gpt-3.5-turbo", None, None, None),
        (4, "y" * 9999 + " ", "gpt-4", None, None, None),
        (5, "test", "invalid-model", None, None, None),
        (6, "test", "../../etc/passwd", None, None, None),
        (7, "test", "<script>alert(1)</script>", None, None, None),
        (8, "test", "gpt-4'; DROP TABLE users;--", None, None, None),
        (9, "test", None, None, None, None),
        (10, "test", "", None, None, None),
        (11, "test", "gpt-4", 0, None, None),
        (12, "test", "gpt-4", 4097, None, None),
        (13, "test", "gpt-4", None, 2.1, None),
        (14, "test", "gpt-3.5-turbo", None, None, "unknown field"),
    ]
    r = _v(spark, rows)
    assert list(r[1]["errors"]) == ["prompt: longer than 10000 characters"]
    assert list(r[2]["errors"]) == ["prompt: too short"]
    assert list(r[3]["errors"]) == ["prompt: empty or whitespace only"]
    assert r[4]["valid"] and len(r[4]["prompt"]) == 9999
    for i in (5, 6, 7, 8):
        assert not r[i]["valid"] and r[i]["errors"][0].startswith("model:"), i
    assert r[9]["valid"] and r[9]["model"] == "gpt-3.5-turbo"
    assert r[10]["valid"] and r[10]["model"] == ""
    for i in (11, 12, 13):
        assert not r[i]["valid"], i
    assert r[14]["valid"] and r[14]["max_tokens"] == 1000 and r[14]["temperature"] == 0.7


def test_client_fallback(spark):
    df = spark.createDataFrame([(1, "hi", "c1", "h1"), (2, "hi", None, "h2"), (3, "hi", None, None)],
                               "request_id long, prompt string, client_id string, host string")
    got = {r["request_id"]: r["client_id"] for r in validate_requests(df).collect()}
    assert got == {1: "c1", 2: "h2", 3: "unknown"}


def test_rate_limit_pinned(spark):
    base = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [(i, "a", base + dt.timedelta(milliseconds=i)) for i in range(70)]
    rows += [(100 + i, "a", base + dt.timedelta(minutes=1, seconds=i)) for i in range(5)]
    rows += [(200 + i, "b", base + dt.timedelta(milliseconds=i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, client string, ts timestamp")
    got = {r["id"]: r["allowed"] for r in rate_limit(df, "client", "ts", "id", limit=60, salts=4).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 70))
    assert all(got[100 + i] for i in range(5)) and all(got[200 + i] for i in range(10))


def test_rate_limit_salted_equals_single_window(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    # one hot client with most rows, ties on timestamp broken by id
    rows = [(i, "hot" if rnd.random() < 0.6 else f"c{rnd.randint(0, 20)}",
             base + dt.timedelta(seconds=rnd.randint(0, 600))) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, client string, ts timestamp")
    a = {r["id"]: r["allowed"] for r in rate_limit(df, "client", "ts", "id", limit=7, salts=16).collect()}
    b = {r["id"]: r["allowed"] for r in rate_limit_exact_window(df, "client", "ts", "id", limit=7).collect()}
    assert a == b


def test_error_events_and_request_ids(spark):
    import json
    from vigilspark.operators.proxy import error_events
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), "c", "p" * 1200, "boom", "ValueError"), (2, dt.datetime(2024, 1, 1), "c", "ok",
                                                                                 None, None)],
        "request_id long, ts timestamp_ntz, client_id string, prompt string, error string, error_type string")
    rows = error_events(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["event_type"], r["severity"], r["blocked"], r["action_taken"]) == ("system_error", "high", True,
                                                                                 "Internal error")
    assert len(r["prompt"]) == 1000 and json.loads(r["metadata"]) == {"error": "boom", "error_type": "ValueError"}
    no_id = spark.createDataFrame([("hi",), ("there",)], "prompt string")
    ids = [x["request_id"] for x in validate_requests(no_id).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 36 for i in ids)


def test_model_length_and_unicode_whitespace(spark):
    rows = [(1, "test", "m" * 101, None, None, None),
            (2, "  \t\n", "gpt-4", None, None, None),
            (3, "  hello 　", "gpt-4", None, None, None)]
    r = _v(spark, rows)
    assert list(r[1]["errors"]) == ["model: too long"]
    assert list(r[2]["errors"]) == ["prompt: empty or whitespace only"]
    assert r[3]["valid"] and r[3]["prompt"] == "hello"
