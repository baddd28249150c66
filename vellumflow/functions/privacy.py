"""Redaction as column expressions: masks, hashes, policies and the cascade of text patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumflow.functions.values import let

# Patterns in the order in which they apply; each sees the text that the ones before left.
TEXT_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ein": r"\b\d{2}-\d{7}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?){2}\d{4}\b",
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "credit_card": r"\b(?:\d[ -]*?){13,16}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "dob": r"\b(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4})\b",
    "address": r"(?i)\b\d{1,5}\s+[A-Za-z0-9.\-']+\s+(?:Ave|Avenue|St|Street|Rd|Road|Blvd|Lane|Ln|Dr|Drive)\b",
}
POLICIES = ("allow", "mask", "hash", "drop")
TEXT_KEEPS = 4  # text spans keep this many characters at least


def masked_string(value: Column, keep: int) -> Column:
    n = F.length(value)
    return F.when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - keep), F.right(value, F.lit(keep))))


def hashed(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def _masked_matches(text: Column, pattern: str, keep: int) -> Column:
    """The text with each match masked: what lies between matches, woven with the masked matches."""

    def woven(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        parts = F.zip_with(F.split(t, pattern, -1), hits, lambda part, hit: F.concat(part, F.coalesce(masked_string(hit, keep), F.lit(""))))
        # most texts have no match, and then nothing is woven
        return F.when(t.rlike(pattern), F.array_join(parts, "")).otherwise(t)

    return let(text, woven)


def redacted_text(text: Column, keep_last: int = TEXT_KEEPS) -> Column:
    return reduce(lambda t, p: _masked_matches(t, p, max(keep_last, TEXT_KEEPS)), TEXT_PATTERNS.values(), text)


def span_counts(text: Column) -> Column:
    """STRUCT with the matches of each pattern in the unredacted text."""
    return F.struct(*[F.size(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))).cast("long").alias(name) for name, p in TEXT_PATTERNS.items()])


def with_policy(value: Column, policy: str, keep_last: int = TEXT_KEEPS, salt: str = "") -> Column:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    return {"allow": lambda: value, "mask": lambda: masked_string(value.cast("string"), keep_last), "hash": lambda: hashed(value, salt), "drop": lambda: F.lit(None).cast("string")}[policy]()


def redacted_columns(columns: dict[str, str | None], default: str = "mask", keep_last: int = TEXT_KEEPS, salt: str = "") -> list[Column]:
    """Select list of top-level fields under their policies; dropped fields are left out."""
    resolved = {name: policy if policy in POLICIES else default for name, policy in columns.items()}
    return [with_policy(F.col(name), policy, keep_last, salt).alias(name) for name, policy in resolved.items() if policy != "drop"]
