"""Detection rules, templates and domains.

Everything between the FIXED VALUES markers must equal the behaviour being
reproduced: the regular expressions are the behavioural spec (Python ``re``
syntax, which java.util.regex accepts unchanged), listed in declaration order
because the order of matched patterns and of findings is part of the result.
Nothing else in the package hard-codes a pattern.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference behaviour; do not reorder)
# ---------------------------------------------------------------------------

# Inbound prompt-injection rules, matched ignoring case.
INJECTION_PATTERNS = [
    r"ignore\s+(previous|all|above)\s+(instructions|rules|prompts)",
    r"disregard\s+(previous|all|above)\s+(instructions|rules|prompts)",
    r"forget\s+(previous|all|above)\s+(instructions|rules|prompts)",
    r"you\s+are\s+now\s+(a|an)",
    r"new\s+instructions?:",
    r"system\s*:\s*",
    r"assistant\s*:\s*",
    r"</?(system|instruction|prompt)>",
    r"override\s+(previous|all)\s+(instructions|rules)",
    r"replace\s+your\s+(instructions|rules|programming)",
    r"act\s+as\s+if\s+you",
]

# Inbound jailbreak rules, matched ignoring case.
JAILBREAK_PATTERNS = [
    r"DAN\s+mode",
    r"developer\s+mode",
    r"evil\s+mode",
    r"you\s+have\s+no\s+restrictions",
    r"you\s+can\s+do\s+anything",
    r"you\s+must\s+(always\s+)?answer",
    r"you\s+are\s+free\s+from",
    r"break\s+your\s+programming",
    r"bypass\s+your\s+((rules|guidelines))",
    r"pretend\s+you\s+(have\s+no|don't\s+have)\s+(ethics|restrictions)",
    r"hypothetically",
    r"in\s+a\s+fictional\s+scenario",
    r"for\s+educational\s+purposes",
]

# Inbound data-exfiltration rules, matched ignoring case.
EXFILTRATION_PATTERNS = [
    r"show\s+me\s+(your|the)\s+(system|training|internal)",
    r"reveal\s+(your|the)\s+(prompt|instructions|rules)",
    r"what\s+(are|were)\s+you\s+told",
    r"repeat\s+(your|the)\s+(instructions|prompt)",
    r"tell\s+me\s+(your|the)\s+system\s+prompt",
    r"output\s+your\s+(instructions|configuration)",
]

# Confidence = min(base + step * n_matched, 1.0) when n_matched > 0, else 0.
RULE_CONFIDENCE = {
    "prompt_injection": (0.4, 0.3),
    "jailbreak": (0.5, 0.25),
    "data_exfiltration": (0.5, 0.3),
}

# Outbound personal-data patterns (case-sensitive), in scan order.
PII_PATTERNS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b(\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d{4}[- ]?){3}\d{4}\b"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("url", r"https?://[^\s]+"),
]

# Outbound secret patterns in scan order: (type, pattern, ignore_case).
# The whole match is the span, not the captured group.
SECRET_PATTERNS = [
    ("api_key", r"""\b(?:api[_-]?key|apikey)[:\s]*["']?([a-zA-Z0-9_\-]{20,})["']?""", True),
    ("bearer_token", r"\bBearer\s+[A-Za-z0-9\-._~+/]+", True),
    ("aws_key", r"\b(AKIA[0-9A-Z]{16})\b", False),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", False),
    ("password", r"""(?:password|passwd|pwd)[:\s]*["']?([^\s"']{8,})["']?""", True),
    ("private_key", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", False),
]

# Redaction template per finding type; anything else becomes DEFAULT_TEMPLATE.
REDACTION_TEMPLATES = {
    "PERSON": "[REDACTED_NAME]",
    "ORG": "[REDACTED_ORG]",
    "GPE": "[REDACTED_LOCATION]",
    "LOC": "[REDACTED_LOCATION]",
    "email": "[REDACTED_EMAIL]",
    "phone": "[REDACTED_PHONE]",
    "ssn": "[REDACTED_SSN]",
    "credit_card": "[REDACTED_CARD]",
    "ip_address": "[REDACTED_IP]",
    "api_key": "[REDACTED_API_KEY]",
    "bearer_token": "[REDACTED_TOKEN]",
    "aws_key": "[REDACTED_AWS_KEY]",
    "github_token": "[REDACTED_GITHUB_TOKEN]",
    "password": "[REDACTED_PASSWORD]",
    "private_key": "[REDACTED_PRIVATE_KEY]",
}
DEFAULT_TEMPLATE = "[REDACTED]"

# Named-entity labels kept as findings.
ENTITY_LABELS = ["PERSON", "ORG", "GPE", "LOC", "DATE", "TIME"]

# Request validation.
ALLOWED_MODELS = ["gpt-3.5-turbo", "gpt-4", "claude-2", "claude-3"]
DEFAULT_MODEL = "gpt-3.5-turbo"
DEFAULT_MAX_TOKENS = 1000
DEFAULT_TEMPERATURE = 0.7
PROMPT_MAX_CHARS = 10000
MODEL_MAX_CHARS = 100
MAX_TOKENS_RANGE = (1, 4096)
TEMPERATURE_RANGE = (0.0, 2.0)

# Policy / limits.
MAX_REQUESTS_PER_MINUTE = 60
MAX_RESPONSE_TOKENS = 2000
CHARS_PER_TOKEN = 4
ML_THREAT_MIN_CONFIDENCE = 0.6
ML_INJECTION_MIN_CONFIDENCE = 0.8
ML_MALICIOUS_MIN_CONFIDENCE = 0.65
ML_THRESHOLD_REPORTED = 0.7
ML_PATTERN_LABEL = "ml_classifier"

# Severity bands on confidence, highest first.
SEVERITY_BANDS = [(0.8, "critical"), (0.6, "high"), (0.4, "medium")]

# Threat type -> security event type, and severity -> event severity.
THREAT_EVENT_TYPE = {
    "prompt_injection": "prompt_injection",
    "jailbreak": "prompt_injection",
    "data_exfiltration": "prompt_injection",
}
SEVERITY_LEVELS = ["critical", "high", "medium", "low"]

# Default policies seeded into an empty policy table.
DEFAULT_POLICIES = [
    ("prompt_injection", "input",
     '{"patterns": ["ignore previous instructions", "system:", "you are now", "disregard"], "threshold": 0.7}'),
    ("pii_detection", "output",
     '{"patterns": ["SSN", "credit card", "API key", "password"], "redact": true}'),
    ("data_exfiltration", "output",
     '{"max_tokens": 2000, "check_secrets": true}'),
]

# Prediction label -> action.
LABEL_ACTIONS = {"prompt_injection": "block", "sensitive_data": "redact"}

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

THREAT_ORDER = ["prompt_injection", "jailbreak", "data_exfiltration"]
RULE_SETS = {
    "prompt_injection": INJECTION_PATTERNS,
    "jailbreak": JAILBREAK_PATTERNS,
    "data_exfiltration": EXFILTRATION_PATTERNS,
}


def java_regex(pattern: str, ignore_case: bool) -> str:
    """Python ``str`` patterns are Unicode-aware (``\\s``, ``\\b``, ``\\d`` and
    case folding); java.util.regex needs UNICODE_CHARACTER_CLASS for that."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def re2_regex(pattern: str, ignore_case: bool) -> str:
    """Same pattern for RE2-based engines (the DuckDB oracle)."""
    return ("(?i)" if ignore_case else "") + pattern
