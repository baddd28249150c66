"""Mixed timestamp formats and zones to one UTC instant (problem 2).

Every value is parsed under every layout that it can match; day-first and month-first count as
two layouts. A source is a table, a locale and a time zone. Values of one source with the same
valid parses (layout and era, the five years in which the instant would lie) are one pattern, so
expectation-maximisation needs only pattern counts: these are summed map-side, and each source's
few dozen patterns go through EM in one small task. A source's model is a mixture of layouts, and
within it a distribution over eras; a value contributes to each valid parse by its posterior. The
posteriors then choose a parse for each pattern and mark what stays ambiguous.

The reading rule (order of day and month by locale) is the prior: a layout that contradicts it has
the prior weight `against_rule`. With the default it can win only where the rule leaves no valid
parse; such rows are marked and name no real date by the rule. With `against_rule=1` nothing is
said beforehand and the sources alone decide.

Nulls, blanks and unusable values give instant null and status 'unusable'. Empty tables give
empty results. Extra columns aren't read; rows delivered twice whole count once.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.session import checkpointed

#: Prior weight of a day-month order that the reading rule excludes.
AGAINST_RULE = 1e-9
#: Years of one era.
ERA_YEARS = 5
#: A posterior below this leaves the value marked as ambiguous.
SURE = 0.95
EM_ROUNDS = 30

MONTH_FIRST_LOCALES = ("en_US",)

# Month names by language, January to December; abbreviations are their prefixes of three letters or more.
_MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
}


@lru_cache(1)
def _months() -> dict[str, int]:
    found: dict[str, set[int]] = {}
    for names in _MONTHS.values():
        for number, name in enumerate(names.split(), 1):
            for end in range(3, len(name) + 1):
                found.setdefault(name[:end], set()).add(number)
    out = {k: next(iter(v)) for k, v in found.items() if len(v) == 1}
    for names in _MONTHS.values():
        out |= {name: number for number, name in enumerate(names.split(), 1)}
    return out


_CLOCK = r"(?P<h>\d{1,2})(?:[:.h](?P<mi>\d{1,2}))?(?:[:.m](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s*(?P<ap>[ap]\.?\s?m\.?)?(?:\s*(?:uhr|hrs?|h))?"
_ZONE = r"(?:\s*(?P<z>z|(?:utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?(?::?\d{2})?|[a-z]{2,5}|[a-z]+(?:/[a-z_]+)+)?\s*(?:\[(?P<zn>[a-z_/+-]+\d*)\]|\((?P<zc>[a-z ]+)\))?)"
_TAIL = rf"(?:(?:\s*,?\s*(?:at|à|um|a las|às|alle|o|t)\s*|[t,\s]\s*){_CLOCK})?{_ZONE}"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun|lun|mar|mer|jeu|ven|sam|dim|mo|di|mi|do|fr|sa|so|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|(?:mon|tues|wednes|thurs|fri|satur|sun)day)\.?,?\s+)?"
_NAME = r"(?P<mn>[^\W\d_]{3,})\.?"


def _layout(body: str) -> re.Pattern[str]:
    return re.compile(rf"{_WEEKDAY}{body}{_TAIL}\Z", re.IGNORECASE)


_Y4, _D, _M = r"(?P<y>\d{4})", r"(?P<d>\d{1,2})", r"(?P<m>\d{1,2})"
_ORD = r"(?:st|nd|rd|th|er|e|º|ª|\.)?"
#: Layouts in order of preference; a number pair of unknown order stands in two of them.
LAYOUTS: dict[str, re.Pattern[str]] = {
    "year_first": _layout(rf"{_Y4}(?P<q>[-/.]){_M}(?P=q){_D}"),
    "compact": re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:t?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?)?{_ZONE}\Z", re.IGNORECASE),
    "day_first": _layout(rf"{_D}\s?(?P<q>[-/.])\s?{_M}\s?(?P=q)\s?(?P<y>\d{{4}}|\d{{2}})"),
    "month_first": _layout(rf"{_M}\s?(?P<q>[-/.])\s?{_D}\s?(?P=q)\s?(?P<y>\d{{4}}|\d{{2}})"),
    "day_name_year": _layout(rf"(?:the\s+|den\s+|le\s+|el\s+)?{_D}{_ORD}(?:\s*[-/]\s*|\s*,?\s+)(?:(?:of|de|del|do)\s+)?{_NAME}(?:\s*[-/]\s*|,?\s+)(?:(?:de|del|of)\s+)?(?P<y>\d{{4}}|\d{{2}})"),
    "name_day_year": _layout(rf"{_NAME}\s*[-/]?\s*(?:the\s+)?{_D}{_ORD}(?:\s*[-/]\s*|,?\s+){_Y4}"),
    "year_name_day": _layout(rf"{_Y4}(?:[-/]|,?\s+){_NAME}(?:[-/]|\s+){_D}"),
    "epoch": re.compile(r"(?P<epoch>-?\d{9,10}(?:\.\d{1,6})?|-?\d{12,13}|-?\d{15,16}|-?\d{18,19})\Z"),
    "year_weekday_name": re.compile(rf"(?:[a-z]{{3}})\s+(?P<mn>[a-z]{{3}})\s+(?P<d>\d{{1,2}})\s+{_CLOCK}\s*(?P<z>[a-z]{{1,5}})?\s+(?P<y>\d{{4}})\Z", re.IGNORECASE),
}
RULED = {"day_first": "D", "month_first": "M"}
EPOCH = dt.datetime(1970, 1, 1)
_OFFSET = re.compile(r"(?:utc|gmt)?\s*([+-])(\d{1,2}):?(\d{2})?(?::?(\d{2}))?\Z", re.IGNORECASE)


@lru_cache(4096)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - unknown or malformed names alike
        return None


@lru_cache(65536)
def _abbreviation(zone: str, abbreviation: str, year: int) -> dt.timedelta | None:
    """The offset that an abbreviation names in a zone, in the year or those beside it."""
    tz = _zone(zone)
    if tz is None:
        return None
    for day in range(-366, 732, 12):
        at = dt.datetime(max(2, min(9997, year)), 1, 1) + dt.timedelta(days=day)
        if (at.replace(tzinfo=tz).tzname() or "").upper() == abbreviation:
            return at.replace(tzinfo=tz).utcoffset()
    return None


def _micros(delta: dt.timedelta) -> int:
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def _resolve(local: dt.datetime, zone: str | None, named: str | None, own: str | None) -> int | None:
    """UTC microseconds of a local time. fold=0 is the first of two, and the offset before a skip."""
    if zone:
        if zone.upper() in ("Z", "UTC", "GMT"):
            return _micros(local - EPOCH)
        if m := _OFFSET.match(zone):
            shift = dt.timedelta(hours=int(m[2]), minutes=int(m[3] or 0), seconds=int(m[4] or 0))
            if shift > dt.timedelta(hours=18):
                return None
            return _micros(local - EPOCH - (shift if m[1] == "+" else -shift))
        if tz := ("/" in zone and _zone(zone)):
            return _micros(local - EPOCH - tz.utcoffset(local))
        natural = _zone(own or "UTC")
        if natural is not None and (natural.tzname(local) or "").upper() == zone.upper():
            return _micros(local - EPOCH - natural.utcoffset(local))
        offset = _abbreviation(own or "UTC", zone.upper(), local.year)
        return None if offset is None else _micros(local - EPOCH - offset)
    tz = _zone(named or own or "UTC")
    return None if tz is None else _micros(local - EPOCH - tz.utcoffset(local))


def _read(m: re.Match[str], own: str | None) -> int | None:
    g = m.groupdict()
    if g.get("epoch"):
        whole = g["epoch"].split(".")[0].lstrip("-")
        scale = {9: 6, 10: 6, 12: 3, 13: 3, 15: 0, 16: 0, 18: -3, 19: -3}[len(whole)]
        if "." in g["epoch"]:
            sign = -1 if g["epoch"].startswith("-") else 1
            return sign * (int(whole) * 10**6 + int(g["epoch"].split(".")[1].ljust(6, "0")))
        return int(g["epoch"]) * 10**scale if scale >= 0 else int(g["epoch"]) // 1000
    year = int(g["y"])
    if len(g["y"]) == 2:
        year += 2000
    month = _months().get(g["mn"].lower()) if g.get("mn") else int(g["m"])
    hour, minute, second = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"][0] in "pP" else 0)
    days = 0
    if hour == 24 and minute == second == 0:
        hour, days = 0, 1
    if second == 60:
        return None
    micro = int((g.get("f") or "0").ljust(6, "0")[:6])
    try:
        local = dt.datetime(year, month or 0, int(g["d"]), hour, minute, second, micro) + dt.timedelta(days=days)
        return _resolve(local, (g.get("z") or "").strip() or None, g.get("zn"), own)
    except (ValueError, OverflowError):
        return None


@lru_cache(65536)
def candidates(value: str, own: str | None) -> tuple[tuple[str, int], ...]:
    """(layout, UTC microseconds) of every valid parse."""
    text = " ".join(value.split())
    found = []
    for name, pattern in LAYOUTS.items():
        if (m := pattern.match(text)) and (at := _read(m, own)) is not None:
            found.append((name, at))
    return tuple(found)


def prior(layout: str, locale: str | None, against_rule: float = AGAINST_RULE) -> float:
    order = RULED.get(layout)
    if order is None:
        return 1.0
    return 1.0 if (order == "M") == (locale in MONTH_FIRST_LOCALES) else against_rule


Parse = tuple[str, int]  # layout and era


def mixture_posteriors(patterns: list[tuple[Parse, ...]], counts: np.ndarray, locale: str | None, against_rule: float = AGAINST_RULE, rounds: int = EM_ROUNDS) -> list[np.ndarray]:
    """EM over one source: posteriors of each pattern's parses, in their order.

    Shares of layouts and of eras have a Dirichlet prior of one half each."""
    owner = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    flat = [x for p in patterns for x in p]
    if not flat:
        return [np.zeros(0) for _ in patterns]
    layouts, layout = np.unique([x[0] for x in flat], return_inverse=True)
    _, era = np.unique([x[1] for x in flat], return_inverse=True)
    weight = np.array([prior(x[0], locale, against_rule) for x in flat])
    share, spread = np.full(len(layouts), 1 / len(layouts)), np.full(era.max() + 1, 1 / (era.max() + 1))
    for step in range(rounds + 1):
        joint = weight * share[layout] * spread[era]
        posterior = joint / np.maximum(np.bincount(owner, joint, len(patterns)), 1e-300)[owner]
        if step == rounds:
            break
        share = np.bincount(layout, posterior * counts[owner], len(layouts)) + 0.5
        spread = np.bincount(era, posterior * counts[owner], era.max() + 1) + 0.5
        share, spread = share / share.sum(), spread / spread.sum()
    return np.split(posterior, np.cumsum([len(p) for p in patterns])[:-1])


_CANDIDATES = T.StructType([T.StructField("parses", T.StringType()), T.StructField("micros", T.ArrayType(T.LongType()))])


def _era(micros: int) -> int:
    return int((1970 + micros / 31_556_952_000_000) // ERA_YEARS)


@F.pandas_udf(_CANDIDATES)
def _parse(values: pd.Series, zones: pd.Series) -> pd.DataFrame:
    found = [() if v is None else candidates(v, z) for v, z in zip(values, zones, strict=True)]
    return pd.DataFrame({"parses": [" ".join(f"{n}:{_era(at)}" for n, at in c) for c in found], "micros": [[at for _, at in c] for c in found]})


def _chosen(pdf: pd.DataFrame, against_rule: float) -> pd.DataFrame:
    locale = pdf["locale"].iloc[0]
    locale = None if pd.isna(locale) else locale
    patterns = [tuple((x.split(":")[0], int(x.split(":")[1])) for x in p.split()) for p in pdf["parses"]]
    posterior = mixture_posteriors(patterns, pdf["n"].to_numpy(float), locale, against_rule)
    best = [int(p.argmax()) if len(p) else -1 for p in posterior]
    names = [p[b][0] if p else None for p, b in zip(patterns, best, strict=True)]
    return pd.DataFrame({
        "source": pdf["source"], "locale": pdf["locale"], "zone": pdf["zone"], "parses": pdf["parses"], "pick": best, "layout": names,
        "posterior": [float(p[b]) if len(p) else 0.0 for p, b in zip(posterior, best, strict=True)],
        "by_rule": [n is None or prior(n, locale, 0.0) == 1.0 for n in names],
    })


def normalise(rows: DataFrame, against_rule: float = AGAINST_RULE) -> DataFrame:
    """rows: source, record_id, entity, value, zone, locale -> with micros, layout, posterior, status.

    status: 'ok', 'ambiguous' (posterior below SURE), 'against_rule' (only readings that the rule
    excludes; not used where the rule has no weight) or 'unusable'; micros is the chosen UTC instant
    in microseconds, null if unusable."""
    parsed = rows.withColumn("_c", _parse("value", "zone")).select("*", F.col("_c.parses").alias("parses"), F.col("_c.micros").alias("all_micros")).drop("_c")
    parsed = checkpointed(parsed)  # parsed once, though counted, joined and paired
    keys = ["source", "locale", "zone"]
    counted = parsed.groupBy(*keys, "parses").agg(F.count("*").alias("n"))
    schema = "source string, locale string, zone string, parses string, pick int, layout string, posterior double, by_rule boolean"
    chosen = counted.groupBy(*keys).applyInPandas(lambda pdf: _chosen(pdf, against_rule), schema)
    # as many rows as sources have patterns: their number follows locales, zones and eras, not the data
    p, c = parsed.alias("p"), chosen.alias("c")
    joined = p.join(c, reduce(Column.__and__, [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "parses")]), "left")
    micros = F.when(F.col("c.pick") >= 0, F.get("p.all_micros", F.col("c.pick")))
    ruled_out = ~F.col("c.by_rule") & F.lit(against_rule < 1)
    status = F.when(micros.isNull(), "unusable").when(ruled_out, "against_rule").when((F.col("c.posterior") < SURE) & (F.size(F.array_distinct("p.all_micros")) > 1), "ambiguous").otherwise("ok")
    return joined.select("p.source", "p.record_id", "p.entity", "p.value", "p.zone", "p.locale", micros.alias("micros"), "c.layout", F.coalesce("c.posterior", F.lit(0.0)).alias("posterior"), status.alias("status"))


def dated_rows(signatures: DataFrame, employees: DataFrame) -> DataFrame:
    """The two tables' moments in one shape; employee rows delivered twice are one row."""
    a = signatures.select(F.lit("signatures").alias("source"), F.col("signature_id").alias("record_id"), F.col("doc_id").cast("string").alias("entity"), F.col("date_signed").alias("value"), F.col("site_tz").alias("zone"), "locale")
    b = employees.select(F.lit("employee_rows").alias("source"), F.col("row_id").alias("record_id"), F.col("employee_no").alias("entity"), F.col("start_date").alias("value"), F.col("office_tz").alias("zone"), "locale").distinct()
    return a.unionByName(b)


def same_instant_pairs(instants: DataFrame) -> DataFrame:
    """record_table, id_a, id_b of rows of one entity that name the same instant by the reading rule."""
    usable = instants.filter(F.col("micros").isNotNull() & F.col("entity").isNotNull() & F.col("status").isin("ok", "ambiguous")).select("source", "entity", "micros", "record_id")
    a, b = usable.alias("a"), usable.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("source", "entity", "micros")]
    return a.join(b, [*on, F.col("a.record_id") < F.col("b.record_id")]).select(F.col("a.source").alias("record_table"), F.col("a.record_id").alias("id_a"), F.col("b.record_id").alias("id_b"))
