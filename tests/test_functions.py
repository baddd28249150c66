import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumflow.functions import boxes as B
from vellumflow.functions import formats, privacy, text, values


def column(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_dates(spark):
    given_ = ["2024-02-15", " 2024-99-99 ", "February 15, 2024", "feb 15, 2024", "15 February 2024", "02/15/2024", "15/02/2024", "03-04-2024", "15.02.2024", "02/15/85", "2024.02.15", "Feb 15 2024", "soon", None]
    assert column(spark, given_, values.normalised_date) == ["2024-02-15", "2024-99-99", "2024-02-15", "2024-02-15", "2024-02-15", "2024-02-15", "2024-02-15", "2024-03-04", "2024-02-15", "1985-02-15", "2024-02-15", "2024-02-15", "soon", None]


def test_phones(spark):
    assert column(spark, ["(555) 123-4567", "+44 20 7946 0958", "1-800-555-1234", "12345", "  ", "none", None, "004420794609"], values.normalised_phone) == ["+15551234567", "+442079460958", "+18005551234", "12345", None, "none", None, "+004420794609"]
    assert values.is_phone_field("hotel_name") and not values.is_phone_field("address")


def test_coercion(spark):
    assert column(spark, ["3.9", "x", None], lambda v: values.coerced(v, "integer")) == [3, None, None]
    assert column(spark, ["Yes", "0", None], lambda v: values.coerced(v, "boolean")) == [True, False, None]
    assert column(spark, ['say {"a": {"b": 1}} done', '{"a":2}', "nothing", None], lambda v: F.try_variant_get(values.tolerant_json(v), "$.a", "string")) == ['{"b":1}', "2", None, None]


def test_lines_and_encodings(spark):
    assert column(spark, ["", "a", "a\n", "a\r\nb\rc", None], text.line_count)[:4] == [0, 1, 1, 3]
    assert column(spark, ["UTF-8", "Windows 1252", "latin1", "KOI8_R", None], text.canonical_encoding) == ["utf-8", "cp1252", "latin-1", "koi8-r", None]
    assert column(spark, ["é".encode(), b"\xe9", b"a", b""], lambda c: text.detected_encoding(c)["encoding"], "binary") == ["utf-8", "latin-1", "ascii", "utf-8"]
    assert column(spark, [b"\xe9t\xe9", "été".encode()], text.decoded, "binary") == ["été", "été"]
    assert column(spark, [b"\xef\xbb\xbfa", b"a", None], text.has_bom, "binary") == [True, False, False]


def test_formats(spark):
    pick = lambda name, mime=None: column(spark, [name], lambda v: formats.format_info(v, F.lit(mime).cast("string")))[0]
    assert pick("a.CSV", "text/plain")["mime_type"] == "text/csv"
    assert pick("a.png", "image/jpeg")["original_extension"] == ".png"
    assert pick("a.exe")["status"] == "unsupported" and pick("a.xlsx", "application/zip")["processing_category"] == "structured"
    assert column(spark, [b"%PDF-1", b"\x89PNG\r\n\x1a\n", b"plain", b"", b"RIFF0000WEBP"], formats.mime_of_content, "binary") == ["application/pdf", "image/png", "text/plain", None, "image/webp"]
    assert len(formats.supported_extensions()) == 19


def _masked(t: str) -> str:
    for p in privacy.TEXT_PATTERNS.values():
        t = re.sub(p, lambda m: "*" * len(m[0]) if len(m[0]) <= 4 else "*" * (len(m[0]) - 4) + m[0][-4:], t)
    return t


def test_redaction(spark):
    given_ = ["SSN 123-45-6789 and a@b.com", "card 4111 1111 1111 1111.", "none", "", "12 Long Street, 2024-01-02", "(555) 123-4567 (555) 123-4567"]
    assert column(spark, given_, privacy.redacted_text) == [_masked(x) for x in given_]
    assert column(spark, ["abc", "abcdef", ""], lambda v: privacy.masked_string(v, 4)) == ["***", "**cdef", ""]
    with pytest.raises(ValueError):
        privacy.with_policy(F.col("x"), "shred")


def test_redaction_of_any_ascii_text(spark):
    texts: list[str] = []

    @settings(max_examples=150, database=None)
    @given(st.text(alphabet="0123456789-.@ ()aZ/St", max_size=40))
    def gather(t):
        texts.append(t)

    gather()
    assert column(spark, texts, privacy.redacted_text) == [_masked(t) for t in texts]


def test_boxes(spark):
    df = spark.range(1).select(B.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("a"), B.box(F.lit(5), F.lit(5), F.lit(25), F.lit(15)).alias("b"), B.box(F.lit(10), F.lit(0), F.lit(12), F.lit(1)).alias("c"))
    row = df.select(B.intersection_area(F.col("a"), F.col("b")), B.intersects(F.col("a"), F.col("c")), B.contains(F.col("a"), F.lit(10.0), F.lit(10.0)), B.scaled(F.col("b"), F.lit(10.0), F.lit(2000.0)), B.crop(F.col("b"), F.lit(20), F.lit(20), 7), B.position_label(F.col("b"), F.lit(100.0), F.lit(20.0))).first()
    assert row[0] == 25.0 and row[1] and row[2]
    assert tuple(row[3]) == (500, 2, 1000, 8) and tuple(row[4]) == (0, 0, 20, 20) and row[5] == "middle-left"


def test_expiry(spark):
    from vellumflow.streaming import jobs

    assert column(spark, ["scheduled", "running", "completed", "lost", None], jobs.job_status) == ["pending", "processing", "completed", "failed", "failed"]
    now = dt.datetime(2024, 1, 2)
    row = spark.range(1).select(jobs.lookup_status(F.lit(None).cast("timestamp"), F.lit(now)), jobs.lookup_status(F.lit(now), F.lit(now)), jobs.lookup_status(F.lit(now - dt.timedelta(seconds=1)), F.lit(now))).first()
    assert tuple(row) == (404, 200, 410)
