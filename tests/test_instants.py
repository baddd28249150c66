import datetime as dt

import numpy as np
import pytest

from vellumflow.operators import instants as I


def utc(*args):
    return int((dt.datetime(*args) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


@pytest.mark.parametrize(
    ("value", "zone", "locale", "expected"),
    [
        ("2022-03-06T00:00:00+00:00", "Europe/London", "en_GB", utc(2022, 3, 6)),
        ("20220306000000", "Europe/London", "en_GB", utc(2022, 3, 6)),
        ("14 August 2024, 02:51\n", "Asia/Kolkata", "en_GB", utc(2024, 8, 13, 21, 21)),
        ("2023-02-27 07:50 UTC+01:00", "Europe/Berlin", "de_DE", utc(2023, 2, 27, 6, 50)),
        ("1662828300000", "America/New_York", "en_US", utc(2022, 9, 10, 16, 45)),
        ("1565062071", None, None, utc(2019, 8, 6, 3, 27, 51)),
        ("Sun, 29 Sep 2019 00:00:00 -0400", "America/New_York", "en_US", utc(2019, 9, 29, 4)),
        ("2022-01-04T14:54:29-06:00[America/Chicago]", "America/Chicago", "en_US", utc(2022, 1, 4, 20, 54, 29)),
        ("2022-01-04 14:54:29 CST", "America/Chicago", "en_US", utc(2022, 1, 4, 20, 54, 29)),
        ("  2020-07-03 12:52:00 CDT", "America/Chicago", "en_US", utc(2020, 7, 3, 17, 52)),
        ("Feb 20 2024 12:00 AM UTC", None, "en_GB", utc(2024, 2, 20)),
        ("December 6, 2022 at 12:00 am", "America/Los_Angeles", "en_US", utc(2022, 12, 6, 8)),
        ("07/06/2024 9:28 PM", "America/Phoenix", "en_US", utc(2024, 7, 7, 4, 28)),
        ("07/06/2024", "UTC", "en_GB", utc(2024, 6, 7)),
        ("15/05/21", "Australia/Sydney", None, utc(2021, 5, 14, 14)),
        ("5. April 2019, 00:00 Uhr", "Europe/Berlin", "de_DE", utc(2019, 4, 4, 22)),
        ("6 février 2020 à 8h20", "Europe/Paris", "fr_FR", utc(2020, 2, 6, 7, 20)),
        ("1er mai 2023", "Europe/Paris", "fr_FR", utc(2023, 4, 30, 22)),
        ("the 5th of January 2021", "UTC", "en_GB", utc(2021, 1, 5)),
        ("2021-11-07 01:30", "America/New_York", "en_US", utc(2021, 11, 7, 5, 30)),  # twice: the first
        ("2022-03-13 02:30", "America/Los_Angeles", "en_US", utc(2022, 3, 13, 10, 30)),  # skipped: offset before
        ("2021-02-26T09:00:00.123456Z", None, None, utc(2021, 2, 26, 9, 0, 0, 123456)),
    ],
)
def test_readings(value, zone, locale, expected):
    found = [at for name, at in I.candidates(value, zone) if I.prior(name, locale) == 1.0]
    assert found == [expected]


@pytest.mark.parametrize("value", ["", "--", "n/d", "31/02/2023", "2023-13-05", "00.00.0000", "Spring 2024", "2022-02-30T10:00:00Z", "see page 2", "2024-01-01 25:00", "x" * 100_000])
def test_unusable(value):
    assert I.candidates(value, "UTC") == ()


def test_mixture_follows_the_source_where_no_rule_decides():
    day, month = ("day_first", 404), ("month_first", 404)
    patterns = [(day,), (month,), (day, month)]
    assert I.mixture_posteriors(patterns, np.array([900.0, 10.0, 500.0]), None, against_rule=1.0)[2][0] > 0.95
    assert max(I.mixture_posteriors(patterns, np.array([100.0, 100.0, 50.0]), None, against_rule=1.0)[2]) < I.SURE
    assert I.mixture_posteriors(patterns, np.array([900.0, 10.0, 500.0]), "en_US")[2][1] > 0.99  # the rule outweighs the source
    assert I.mixture_posteriors([()], np.array([3.0]), None)[0].size == 0


def test_eras_carry_likelihood():
    old, new = ("compact", 380), ("day_first", 404)
    patterns = [(("year_first", 404),), (old, new)]
    assert I.mixture_posteriors(patterns, np.array([500.0, 1.0]), None)[1][1] > 0.95


def test_sources_decide_and_ambiguity_is_marked(spark):
    """Planted: the same text in three sources without a locale; expectation-maximisation, not a prior, picks its reading."""
    rows, n = [], 0
    for zone, told in (("America/Chicago", ["04/25/2024"] * 30), ("Europe/Paris", ["25/04/2024"] * 30), ("Asia/Tokyo", ["2024-04-25"] * 30)):
        for text in [*told, "03/04/2024"]:
            rows.append((n := n + 1, n, text, zone, None, "c"))
    s, e = spark.createDataFrame(rows, SIGNATURES), spark.createDataFrame([], EMPLOYEES)
    at = lambda weight: {r["zone"]: (r["layout"], r["status"]) for r in I.normalise(I.dated_rows(s, e), weight).filter("value = '03/04/2024'").collect()}
    free = at(1.0)
    assert free["America/Chicago"] == ("month_first", "ok") and free["Europe/Paris"] == ("day_first", "ok") and free["Asia/Tokyo"][1] == "ambiguous"
    assert set(at(I.AGAINST_RULE).values()) == {("day_first", "ok")}


SIGNATURES = "signature_id long, doc_id long, date_signed string, site_tz string, locale string, status string"
EMPLOYEES = "row_id long, employee_no string, start_date string, office_tz string, locale string"


def test_pairs(spark):
    s = spark.createDataFrame([(1, 1, "2024-01-02", "UTC", "en_GB", "c"), (2, 1, "02/01/2024", "UTC", "en_GB", "c"), (3, 1, "01/02/2024", "UTC", "en_US", "c"), (4, 2, "2024-01-02", "UTC", "en_GB", "c"), (5, 1, "2024-01-02", "Nowhere/Else", None, "c"), (6, 1, None, None, None, "c"), (7, None, "2024-01-02", None, None, "c")], SIGNATURES)
    e = spark.createDataFrame([(1, "E1", "1704153600", None, None), (1, "E1", "1704153600", None, None), (2, "E1", "2024-01-02", None, None), (3, None, "2024-01-02", None, None)], EMPLOYEES)
    result = I.normalise(I.dated_rows(s, e))
    got = {tuple(r) for r in I.same_instant_pairs(result).collect()}
    assert got == {("signatures", 1, 2), ("signatures", 1, 3), ("signatures", 2, 3), ("employee_rows", 1, 2)}
    status = {(r["source"], r["record_id"]): r["status"] for r in result.collect()}
    assert status["signatures", 6] == "unusable" and status["signatures", 2] == "ok" and len(status) == 10


def test_against_the_rule_is_marked(spark):
    s = spark.createDataFrame([(1, 1, "25/01/2024", "UTC", "en_US", "c"), (2, 1, "2024-01-25", "UTC", "en_US", "c")], SIGNATURES)
    result = I.normalise(I.dated_rows(s, spark.createDataFrame([], EMPLOYEES)))
    assert {r["record_id"]: r["status"] for r in result.collect()} == {1: "against_rule", 2: "ok"}
    assert I.same_instant_pairs(result).count() == 0


def test_empty(spark):
    result = I.normalise(I.dated_rows(spark.createDataFrame([], SIGNATURES), spark.createDataFrame([], EMPLOYEES)))
    assert result.count() == 0 and I.same_instant_pairs(result).count() == 0
