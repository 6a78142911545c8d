"""Redaction by ordered rules, each a regex replacement on what the rules before it left.

Null texts stay null; rules are applied to whole texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.paths import col

_IP = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"

# Fixed values: (pattern, replacement) of the log rules.
LOG_RULES: list[tuple[str, str]] = [
    (r"""(?i)((?:api[-_]?key|apikey|x-api-key)\s*[=:]\s*["']?)([a-zA-Z0-9_-]{16,})(["']?)""", "$1[REDACTED]$3"),
    (r"(?i)(bearer\s+)([a-zA-Z0-9_\-.]+)", "$1[REDACTED]"),
    (r"""(?i)(authorization\s*[=:]\s*)["']?([^"'>\s]+)["']?""", "$1[REDACTED]"),
    (r"""(?i)(password|passwd|pwd|pass)\s*[=:]\s*["']?([^\s"'&]+)["']?""", "$1=[REDACTED]"),
    (r"""(?i)(secret|token|access_token|refresh_token|client_secret)\s*[=:]\s*["']?([a-zA-Z0-9_\-.]{8,})["']?""", "$1=[REDACTED]"),
    (r"\beyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*\b", "[JWT_REDACTED]"),
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\b(?:\d{4}[-\s]?){3,4}\d{1,4}\b", "[CARD_REDACTED]"),
    (r"-----BEGIN[A-Z\s]*PRIVATE KEY-----[\s\S]*?-----END[A-Z\s]*PRIVATE KEY-----", "[REDACTED]"),
    (r"""(?i)(aws_access_key_id|aws_secret_access_key)\s*[=:]\s*["']?([A-Za-z0-9/+=]{16,})["']?""", "$1=[REDACTED]"),
    (r"(?i)(mongodb|mysql|postgres|redis|amqp)://[^:]+:([^@]+)@", "$1://***:[REDACTED]@"),
]
#: The rule that applies only if addresses are to be redacted; it stands before the private-key rule.
LOG_IP_RULE = (_IP, "[IP_REDACTED]")
# Fixed values: (pattern, replacement) of the export rules.
EXPORT_RULES: list[tuple[str, str]] = [
    (r"sk-[A-Za-z0-9_-]{16,}", "[API_KEY]"),
    (r"(?i)X-API-Key\s*:\s*[^\s]+", "X-API-Key: [REDACTED]"),
    (r"(?i)Bearer\s+[A-Za-z0-9._-]+", "Bearer [REDACTED]"),
    (r"(?i)\btoken\b\s*[:=]\s*[^\s]+", "token=[REDACTED]"),
    (r"eyJ[A-Za-z0-9-_=]+\.eyJ[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]*", "[JWT_TOKEN]"),
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[EMAIL]"),
    (r"([?&][^=\s]+)=([^&\s]+)", "$1=[REDACTED]"),
    (r"""(?:[A-Za-z]:\\[^\s"']+|/(?:Users|home|var|private|etc|opt|Library|Volumes)/[^\s"']+)""", "[PATH]"),
    (r"(?i)\b(activity|summary|description)\b\s*[:=]\s*.+", "$1=[REDACTED]"),
    (r"\x{1F4DD} User Query:\s*.+", "\U0001f4dd User Query: [REDACTED]"),
    (r"Content:\s*.{50,}", "Content: [REDACTED]"),
    (_IP, "[IP_ADDR]"),
    (r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b", "[CARD_NUM]"),
    (r"(?i)\b(password|passwd|pwd)\b\s*[:=]\s*[^\s]+", "$1=[REDACTED]"),
]


def log_rules(addresses: bool = False) -> list[tuple[str, str]]:
    return [*LOG_RULES[:8], *([LOG_IP_RULE] if addresses else []), *LOG_RULES[8:]]


def redact(text: Column | str, rules: list[tuple[str, str]]) -> Column:
    out = col(text)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def redaction_counts(text: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Array of the replacements each rule makes, rule by rule on the text as the rules before left it."""
    out, counts = col(text), []
    for pattern, replacement in rules:
        counts.append(F.regexp_count(out, F.lit(pattern)).cast("long"))
        out = F.regexp_replace(out, pattern, replacement)
    return F.array(*counts)


def redacted(rows: DataFrame, text: str, rules: list[tuple[str, str]], counts: str) -> DataFrame:
    """``rows`` with the redacted ``text`` and the number of replacements as ``counts``; a projection a rule, so no rule is
    applied twice. A null text stays null and counts none."""
    out = rows.withColumn(counts, F.lit(0).cast("long"))
    for pattern, replacement in rules:
        found = F.coalesce(F.regexp_count(F.col(text), F.lit(pattern)), F.lit(0))
        out = out.withColumns({counts: F.col(counts) + found, text: F.regexp_replace(text, pattern, replacement)})
    return out


def redact_user(text: Column | str, user: str) -> Column:
    """Hide a user's name in home folder paths of three systems."""
    if not user:
        return col(text)
    name = re.escape(user)
    out = F.regexp_replace(col(text), f"/Users/{name}/", "/Users/[USER]/")
    out = F.regexp_replace(out, f"/home/{name}/", "/home/[USER]/")
    return F.regexp_replace(out, rf"(?i)[A-Z]:\\Users\\{name}\\", r"C:\\Users\\[USER]\\")


def oracle(text: str, rules: list[tuple[str, str]]) -> str:
    """The same redaction as a SQL expression of an engine whose replacements name groups as \\1."""
    out = text
    for pattern, replacement in rules:
        pattern, replacement = pattern.replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", replacement).replace("'", "''")
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out
