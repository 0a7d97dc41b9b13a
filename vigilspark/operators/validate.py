"""Request validation (B1-B5): error list per row instead of an exception.

Field constraints are checked before the prompt/model validators, like the
reference's model: a prompt that is too long is not also reported as blank.
Absent (NULL) fields take their defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import py_strip


def validate_requests(df: DataFrame, max_prompt_chars: int = rules.PROMPT_MAX_CHARS,
                      use_ml_default: bool = False) -> DataFrame:
    """Input columns: request_id, ts, prompt, model?, max_tokens?, temperature?,
    client_id?, host?, use_ml?.  Adds ``errors`` (array<string>), ``valid`` and
    the normalised fields (stripped prompt, defaults, client fallback)."""
    cols = set(df.columns)

    def opt(name, typ):
        return F.col(name) if name in cols else F.lit(None).cast(typ)

    p = F.col("prompt")
    model = F.coalesce(opt("model", "string"), F.lit(rules.DEFAULT_MODEL))
    max_tokens = F.coalesce(opt("max_tokens", "int"), F.lit(rules.DEFAULT_MAX_TOKENS))
    temperature = F.coalesce(opt("temperature", "double"), F.lit(rules.DEFAULT_TEMPERATURE))
    lo_t, hi_t = rules.MAX_TOKENS_RANGE
    lo_temp, hi_temp = rules.TEMPERATURE_RANGE
    n = F.length(p)
    length_ok = (n >= 1) & (n <= max_prompt_chars)
    errors = F.array_compact(F.array(
        F.when(p.isNull(), F.lit("prompt: field required")),
        F.when(n < 1, F.lit("prompt: too short")),
        F.when(n > max_prompt_chars, F.lit(f"prompt: longer than {max_prompt_chars} characters")),
        F.when(length_ok & (py_strip(p) == ""), F.lit("prompt: empty or whitespace only")),
        F.when(F.length(model) > rules.MODEL_MAX_CHARS, F.lit("model: too long")),
        F.when((F.length(model) <= rules.MODEL_MAX_CHARS) & (model != "") & ~model.isin(rules.ALLOWED_MODELS),
               F.lit("model: must be one of " + ", ".join(rules.ALLOWED_MODELS))),
        F.when((max_tokens < lo_t) | (max_tokens > hi_t), F.lit(f"max_tokens: must be in [{lo_t}, {hi_t}]")),
        F.when((temperature < lo_temp) | (temperature > hi_temp),
               F.lit(f"temperature: must be in [{lo_temp}, {hi_temp}]")),
    ))
    client = F.coalesce(opt("client_id", "string"), opt("host", "string"), F.lit("unknown"))
    if "request_id" not in cols:
        # A fresh id per request; uuid() is non-deterministic, so callers
        # that reuse the frame should persist it (checkpoint / write) first.
        df = df.withColumn("request_id", F.expr("uuid()"))
    keep = [c for c in df.columns if c not in {"prompt", "model", "max_tokens", "temperature", "client_id", "use_ml"}]
    return df.select(
        *keep,
        client.alias("client_id"),
        F.coalesce(opt("use_ml", "boolean"), F.lit(use_ml_default)).alias("use_ml"),
        F.when(length_ok, py_strip(p)).otherwise(p).alias("prompt"),
        model.alias("model"),
        max_tokens.alias("max_tokens"),
        temperature.alias("temperature"),
        errors.alias("errors"),
        (F.size(errors) == 0).alias("valid"),
    )
