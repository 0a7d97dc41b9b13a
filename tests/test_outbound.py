"""Pinned outbound spans, verdicts and redaction (FIXTURES.md §3), plus a
differential test of span offsets against Python ``re``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import rules
from vigilspark.operators.outbound import outbound_scan

AWS = "AKIA" + "ABCDEFGHIJKLMNOP"

CASES = [
    ("My email is test@example.com and phone is 555-123-4567",
     [("email", 12, 28), ("phone", 42, 54)], ("pii_leak", "medium", 0.85),
     "My email is [REDACTED_EMAIL] and phone is [REDACTED_PHONE]", None),
    ("SSN: 123-45-6789, Credit Card: 4532-1234-5678-9010",
     [("ssn", 5, 16), ("credit_card", 31, 50)], ("pii_leak", "medium", 0.85),
     "SSN: [REDACTED_SSN], Credit Card: [REDACTED_CARD]", None),
    ("Contact John at john.doe@company.com or call 555-987-6543",
     [("email", 16, 36), ("phone", 45, 57)], ("pii_leak", "medium", 0.85),
     "Contact John at [REDACTED_EMAIL] or call [REDACTED_PHONE]", None),
    ("a@b.co c@d.org 10.0.0.1 10.0.0.2",
     [("email", 0, 6), ("email", 7, 14), ("ip_address", 15, 23), ("ip_address", 24, 32)],
     ("pii_leak", "high", 0.85), "[REDACTED_EMAIL] [REDACTED_EMAIL] [REDACTED_IP] [REDACTED_IP]", None),
    ("call +1 555-123-4567 or (555) 123-4567", [("phone", 8, 20), ("phone", 25, 38)],
     ("pii_leak", "medium", 0.85), "call +1 [REDACTED_PHONE] or ([REDACTED_PHONE]", None),
    ("host 999.999.999.999", [("ip_address", 5, 20)], ("pii_leak", "medium", 0.85), "host [REDACTED_IP]", None),
    ("password protected file", [("password", 0, 18)], ("api_key_leak", "critical", 0.95),
     "[REDACTED_PASSWORD] file", None),
    ("Bearer of news", [("bearer_token", 0, 9)], ("api_key_leak", "critical", 0.95), "[REDACTED_TOKEN] news", None),
    (AWS, [("aws_key", 0, 20)], ("api_key_leak", "critical", 0.95), "[REDACTED_AWS_KEY]", None),
    ("ghp_" + "a" * 36, [("github_token", 0, 40)], ("api_key_leak", "critical", 0.95),
     "[REDACTED_GITHUB_TOKEN]", None),
    ("api_key: " + "k" * 24, [("api_key", 0, 33)], ("api_key_leak", "critical", 0.95), "[REDACTED_API_KEY]", None),
    ("-----BEGIN RSA PRIVATE KEY-----", [("private_key", 0, 31)], ("api_key_leak", "critical", 0.95),
     "[REDACTED_PRIVATE_KEY]", None),
    ("see https://bob@example.com/x now", [("email", 12, 27), ("url", 4, 29)], ("pii_leak", "medium", 0.85),
     "see [REDACTED]x now", "see [REDACTED] now"),
    ("password: " + AWS + " tail", [("aws_key", 10, 30), ("password", 0, 30)], ("api_key_leak", "critical", 0.95),
     "[REDACTED_PASSWORD]ail", "[REDACTED_PASSWORD] tail"),
    ("nothing here", [], ("clean", "low", 1.0), "nothing here", None),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, text string")
    faithful = {r["id"]: r for r in outbound_scan(df, "text").collect()}
    merged = {r["id"]: r for r in outbound_scan(df, "text", merge_overlaps=True).collect()}
    return faithful, merged


def test_spans_verdicts_redaction(results):
    faithful, merged = results
    for i, (text, spans, verdict, red, red_merged) in enumerate(CASES):
        r = faithful[i]
        got = [(f["type"], f["start"], f["end"]) for f in r["findings"]]
        assert got == spans, text
        for f in r["findings"]:
            assert text[f["start"]:f["end"]] == f["text"]
        assert (r["threat_type"], r["severity"], r["confidence"]) == verdict, text
        assert r["final_text"] == red, text
        assert merged[i]["final_text"] == (red_merged or red), text


def test_details(results):
    faithful, _ = results
    r = faithful[3]
    assert r["message"] == "Detected 4 sensitive items"
    assert (r["pii_count"], r["secrets_count"], r["excessive_length"]) == (4, 0, False)
    assert list(r["matched_patterns"]) == ["email", "email", "ip_address", "ip_address"]
    assert list(r["details_findings"][0]["position"]) == [0, 6]
    clean = faithful[len(CASES) - 1]
    assert clean["message"] == "No sensitive data detected" and clean["sanitized_text"] == "nothing here"


def test_length_limit(spark):
    df = spark.createDataFrame([(1, "x" * 8001), (2, "x" * 8000)], "id int, text string")
    r = {x["id"]: x for x in outbound_scan(df, "text").collect()}
    assert (r[1]["threat_type"], r[1]["severity"], r[1]["confidence"]) == ("excessive_output", "medium", 0.7)
    assert r[1]["sanitized_text"] is None and r[1]["final_text"] == "x" * 8001
    assert r[2]["threat_type"] == "clean" and r[2]["final_text"] == "x" * 8000
    n = outbound_scan(df, "text", redact=False).where("id = 1").first()
    assert n["sanitized_text"] is None


def test_offsets_match_python_re(spark):
    rnd = random.Random(7)
    alphabet = list("ab 1234567890.-@+()é😀 ") + ["x@y.io", "555-123-4567", "10.1.2.3", "https://e.org/p"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: [(f["type"], f["start"], f["end"]) for f in r["findings"]]
           for r in outbound_scan(df, "text").collect()}
    for i, t in enumerate(texts):
        exp = []
        for name, p in rules.PII_PATTERNS:
            exp += [(name, m.start(), m.end()) for m in re.finditer(p, t)]
        for name, p, ic in rules.SECRET_PATTERNS:
            exp += [(name, m.start(), m.end()) for m in re.finditer(p, t, re.IGNORECASE if ic else 0)]
        assert got[i] == exp, t


def test_heavy_row_with_multibyte_text(spark):
    # thousands of findings interleaved with multi-byte characters: offsets are
    # code points, the byte-offset redaction path must cut on the same spans
    parts = [f"é{i}😀 u{i}@ex.org ☎ 555-{i % 1000:03d}-{i:04d} ü" for i in range(2000)]
    text = " ".join(parts)
    df = spark.createDataFrame([(1, text)], "id int, text string")
    r = outbound_scan(df, "text").first()
    exp = []
    for name, p in rules.PII_PATTERNS:
        exp += [(name, m.start(), m.end()) for m in re.finditer(p, text)]
    for name, p, ic in rules.SECRET_PATTERNS:
        exp += [(name, m.start(), m.end()) for m in re.finditer(p, text, re.IGNORECASE if ic else 0)]
    assert [(f["type"], f["start"], f["end"]) for f in r["findings"]] == exp
    red = text
    for name, s, e in sorted(exp, key=lambda x: x[1], reverse=True):
        red = red[:s] + rules.REDACTION_TEMPLATES.get(name, rules.DEFAULT_TEMPLATE) + red[e:]
    assert r["final_text"] == red
