import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.operators import rejects as R

LINES = "line_id long, file_id long, account_id string, line_no long, raw_line string, reason string, dialect string"
FILES = "file_id long, delimiter string, has_header boolean, column_count long, column_names array<string>, column_types array<string>"


def brute(line: str, mark: str) -> list[str] | None:
    """Character by character, as the rules are written."""
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, value = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + line[i], i + 1
            if i < len(line) and line[i] != mark:
                return None
        else:
            end = line.find(mark, i)
            end = len(line) if end < 0 else end
            value, i = line[i:end], end
            if '"' in value:
                return None
        fields.append(value)
        if i >= len(line):
            return fields
        i += 1


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 512])
def test_tokenizer_equals_brute_force_whatever_the_chunk(chunk):
    pick = random.Random(chunk)
    lines = ["".join(pick.choice('a",;\n é"') for _ in range(pick.randint(0, 40))) for _ in range(600)]
    marks = [pick.choice(",;") for _ in lines]
    assert R.tokenize(lines, marks, chunk) == [brute(x, m) for x, m in zip(lines, marks, strict=True)]


def test_sound_records_equal_the_csv_module():
    pick = random.Random(1)
    rows = [["".join(pick.choice('ab",\n') for _ in range(pick.randint(0, 6))) for _ in range(4)] for _ in range(200)]
    for row in rows:
        import io

        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(row)
        assert R.tokenize([out.getvalue()], [","], 5) == [row]


def test_composition_is_associative_with_the_plain_walk():
    grid = np.random.default_rng(0).integers(0, 3, (6, 4)).astype(np.int8)
    record, place = np.zeros(6, int), np.arange(6)
    state, walked = 0, []
    for row in grid:
        walked.append(state)
        for k in row:
            state = R.STEP[state, k]
    assert R.compose(R.transition_vectors(grid), record, place).tolist() == walked


def _tables(spark):
    names, kinds = ["a", "b", "c"], ["string", "integer", "date"]
    files = spark.createDataFrame([(1, ",", True, 3, names, kinds), (2, ",", None, 9, names, kinds), (3, None, None, None, names, kinds)], FILES)
    raw = {
        1: ["a,b,c", 'x,1,2024-02-29', '"x, y",-2,', "x,1", 'x"y,1,2024-01-01', '"open,1,2024-01-01', "x,1.0,2024-01-01", "x,1,2024-02-30", "", "  ", "\r", "x,+3,2024-01-01\r", " a , b , c ", "x,٣,2024-01-01", None, "x,1,2024-1-1", '""x"",1,'],
        2: ["a;b;c", "x;1;2024-01-01", "x;y;2024-01-01", "x;1;2024-01-01;", "x,y;1;"],
        3: ["x|1|2024-01-01", "y|2|"],
    }
    rows, i = [], 0
    for f, lines in raw.items():
        for n, line in enumerate(lines):
            i += 1
            rows.append((i, f, "acc", n, line, "clash", "clash"))
    rows.append(rows[3])
    rows.append((99, 404, "acc", 1, "x,1,2024-01-01", "clash", "clash"))
    return spark.createDataFrame(rows, LINES), files


def test_rejects_and_rows(spark):
    lines, files = _tables(spark)
    got = {r["line_id"]: r["reason"] for r in R.rejected(lines, files).collect()}
    assert got == {4: "column_count", 5: "quoting", 6: "quoting", 7: "invalid_value", 8: "invalid_value", 14: "invalid_value", 16: "invalid_value", 17: "quoting", 20: "invalid_value", 21: "column_count"}
    rows = {r["line_id"]: r["cells"] for r in R.typed_rows(lines, files).collect()}
    assert sorted(rows) == [2, 3, 12, 19, 22, 23, 24]
    assert rows[3][0]["text"] == "x, y" and rows[3][1]["integer_value"] == -2 and rows[3][2]["date_value"] is None
    assert rows[22][0]["text"] == "x,y"


def test_lines_decide_the_delimiter(spark):
    lines, files = _tables(spark)
    assert {r["file_id"]: r["dialect"] for r in R.file_dialects(lines.filter("file_id < 4"), files).collect()} == {1: ",", 2: ";", 3: "|"}


def test_empty_tables(spark):
    lines, files = _tables(spark)
    assert R.rejected(lines.limit(0), files).count() == 0
    assert R.typed_rows(lines, files.limit(0)).count() == 0


def test_hot_file_and_very_long_record(spark):
    names, kinds = ["a", "b"], ["string", "integer"]
    files = spark.createDataFrame([(1, ",", True, 2, names, kinds)], FILES)
    lines = spark.range(2000).select(F.col("id").alias("line_id"), F.lit(1).cast("long").alias("file_id"), F.col("id").alias("line_no"), F.when(F.col("id") == 7, F.concat(F.lit('"'), F.repeat(F.lit('x,""'), 50_000), F.lit('",1'))).when(F.col("id") % 10 == 0, F.lit("x,y")).otherwise(F.lit("x,1")).alias("raw_line"))
    assert R.rejected(lines, files).count() == 200
    assert R.typed_rows(lines, files).count() == 1800
    assert {(r["is_row"], r["reason"]) for r in R.parse_records(lines, files.limit(0)).collect()} == {(False, None)}  # an unknown file's records are neither


def test_columns_without_types(spark):
    files = spark.createDataFrame([(1, ",", True, 2, ["a", "b"], None)], FILES)
    lines = spark.createDataFrame([(1, 1, "x", 1, "p,q", "c", "c"), (2, 1, "x", 2, "p", "c", "c"), (3, None, "x", 2, "p,q", "c", "c")], LINES)
    assert {r["line_id"] for r in R.rejected(lines, files).collect()} == {2}
    assert [(c["text"], c["kind"]) for c in R.typed_rows(lines, files).first()["cells"]] == [("p", "string"), ("q", "string")]
