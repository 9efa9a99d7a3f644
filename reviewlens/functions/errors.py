"""Classifiers of error messages and of replies that carry an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOO_LONG = ("prompt is too long", "context length", "maximum context length", "too many tokens", "token limit", "input too long", "request too large", "context window")
QUOTA = ("insufficient_user_quota", "insufficient_quota", "billing", "plan_limit", "quota_exceeded")
STATUS_CODES = (400, 402, 429, 500, 502, 503, 504, 529)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def prompt_too_long(message: Column) -> Column:
    return _any(F.lower(message), TOO_LONG)


def quota_exceeded(message: Column) -> Column:
    return _any(F.lower(message), QUOTA)


def status_code(message: Column) -> Column:
    """The first known HTTP status in a message, else -1."""
    found = F.transform(F.regexp_extract_all(message, F.lit(r"\b([45]\d{2})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.get(F.filter(found, lambda x: x.isin(*STATUS_CODES)), F.lit(0)), F.lit(-1))


def error_class(message: Column) -> Column:
    """timeout, rate_limit, server or client: what decides on a retry."""
    m = F.lower(message)
    server = F.lit(False)
    for code in ("500", "502", "503", "504"):
        server = server | m.contains(code)
    return F.when(m.contains("timeout") | m.contains("timed out"), "timeout").when(m.contains("429") | m.contains("rate"), "rate_limit").when(server, "server").otherwise("client")


def retry_delay(attempt: Column, kind: Column, base: float = 2.0, most: float = 30.0, retries: int = 3) -> Column:
    """Seconds before the next attempt, without jitter; null where there is none."""
    grows = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
    return F.when((attempt >= retries) | (kind == "timeout"), F.lit(None)).when(kind.isin("rate_limit", "server"), grows).otherwise(F.lit(base))


def wrapped_error(reply: Column) -> Column:
    """The error that a reply of status 200 carries as JSON, else null."""
    text = F.trim(reply)
    j = F.when(text.startswith("{"), F.try_parse_json(text))
    get = lambda path: F.try_variant_get(j, path, "string")
    failed = F.try_variant_get(j, "$.success", "boolean") == F.lit(False)
    business = F.concat(F.lit("business error ("), F.coalesce(get("$.code"), F.lit("unknown")), F.lit("): "), F.left(F.coalesce(get("$.msg"), get("$.message"), F.lit("unknown")), F.lit(200)))
    plain = get("$.error").isNotNull() & get("$.choices").isNull() & get("$.content").isNull()
    return F.when(failed, business).when(plain, F.concat(F.lit("error: "), F.left(F.coalesce(get("$.error.message"), get("$.error")), F.lit(200))))
