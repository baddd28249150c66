"""Column builders that normalise extracted values: dates, phones, types, JSON replies, flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date patterns in order of priority.
DATE_PATTERNS = ("y-M-d", "y/M/d", "MMMM d, y", "MMM d, y", "d MMMM y", "d MMM y", "M/d/y", "M-d-y", "d/M/y", "d-M-y", "d.M.y", "M/d/yy", "d/M/yy", "y.M.d", "MMMM d y", "MMM d y")
# Parts of a field's name that make it a phone field.
PHONE_HINTS = ("phone", "telephone", "tel", "mobile", "cell")
PIVOT_YEAR = 2069  # a two-digit year from 69 on is in the last century


def date_shape(pattern: str) -> str:
    """What a value must look like for a pattern, since the parser alone takes years of any length."""
    parts = {"yy": r"\d{2}", "y": r"\d{4}", "MMMM": r"[A-Za-z]{3,}", "MMM": r"[A-Za-z]{3}", "M": r"\d{1,2}", "d": r"\d{1,2}"}
    out, i = "", 0
    while i < len(pattern):
        run = pattern[i]
        while run.isalpha() and i + len(run) < len(pattern) and pattern[i + len(run)] == run[0]:
            run += run[0]
        out += parts.get(run, "\\" + run if not run.isalnum() and run != " " else run)
        i += len(run)
    return f"^{out}$"


def parsed_date(value: Column) -> Column:
    """DATE by the first pattern that fits; null if none does."""
    text = F.trim(value)
    tries = []
    for p in DATE_PATTERNS:
        day = F.try_to_date(F.initcap(text) if "MMM" in p else text, p)
        if p.endswith("yy"):
            day = F.when(F.year(day) >= PIVOT_YEAR, F.add_months(day, -1200)).otherwise(day)
        tries.append(F.when(text.rlike(date_shape(p)), day))
    return F.coalesce(*tries)


def normalised_date(value: Column) -> Column:
    """ISO text: an ISO-shaped value is kept as it is, what can't be read comes back unchanged."""
    text = F.trim(value)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(F.coalesce(F.date_format(parsed_date(value), "yyyy-MM-dd"), value))


def normalised_phone(value: Column) -> Column:
    """E.164 as far as the digits allow; blank is null."""
    text = F.trim(value)
    digits = F.regexp_replace(text, r"\D", "")
    n = F.length(digits)
    return F.when(text == "", F.lit(None).cast("string")).when(n == 0, value).when(text.startswith("+"), F.concat(F.lit("+"), digits)).when(n == 10, F.concat(F.lit("+1"), digits)).when(n >= 11, F.concat(F.lit("+"), digits)).otherwise(value)


def is_phone_field(name: str) -> bool:
    return any(hint in name.lower() for hint in PHONE_HINTS)


def coerced(value: Column, kind: str) -> Column:
    """The typed value of a text; null where it doesn't fit, so that the caller keeps the original."""
    if kind == "integer":
        return F.trim(value).try_cast("double").try_cast("bigint")
    if kind == "number":
        return F.trim(value).try_cast("double")
    if kind == "boolean":
        return F.when(value.isNull(), F.lit(None).cast("boolean")).otherwise(F.lower(value).isin("true", "yes", "1"))
    if kind == "array":
        return F.array(value)
    return value.cast("string")


def default_of(kind: str) -> Column:
    return {"array": F.array().cast("array<string>"), "object": F.create_map().cast("map<string,string>")}.get(kind, F.lit(None))


def clamped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole_json(text: Column) -> Column:
    """VARIANT of a text that is one complete JSON value and nothing else; else null."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).try_cast("array<variant>")
    return let(wrapped, lambda w: F.when(F.size(w) == 1, F.get(w, F.lit(0))))


def tolerant_json(reply: Column) -> Column:
    """VARIANT of a reply: the whole text, else what stands between its first and last brace; else null."""
    return F.coalesce(whole_json(reply), whole_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))))


def choice(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """A whitelisted word in lower case, else the default."""
    word = F.lower(F.trim(value))
    return F.when(word.isin(*allowed), word).otherwise(default)


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))

