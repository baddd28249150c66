"""Records that fail to parse: a quote-aware finite-state tokenizer (problem 6).

A record is cut into chunks of `CHUNK` code points. A chunk's effect is a transition vector,
the end state for each possible start state; vectors compose left to right, so the true start
state of each chunk follows without walking the record as a whole, and all chunks of a batch
step through the automaton together in numpy. A second step with known states marks breaks.

Rows with a null raw_line or without metadata have reason null and no fields (neither row nor
case); columns without a stated type take any value; empty tables give empty results; other columns are carried along untouched.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.session import checkpointed, salted_lookup

CHUNK = 512
DELIMITERS = (",", ";", "\t", "|")

# States: a field begins; in an unquoted field; in a quoted one; behind its closing quote; broken.
START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
# Classes of characters: any other, delimiter, quote, padding.
OTHER, DELIM, QUOTE, PAD = range(4)
STEP = np.array(
    [
        [PLAIN, START, QUOTED, START],
        [PLAIN, START, BROKEN, PLAIN],
        [QUOTED, QUOTED, CLOSED, QUOTED],
        [BROKEN, START, QUOTED, CLOSED],
        [BROKEN, BROKEN, BROKEN, BROKEN],
    ],
    dtype=np.int8,
)

_INTEGER = re.compile(r"[+-]?[0-9]+\Z")
_NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?\Z")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}\Z")


def _classes(lines: Sequence[str], delimiters: Sequence[str], chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character classes as chunk rows; each chunk's record and place within it."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    per_line = np.maximum(1, -(-lengths // chunk))
    record = np.repeat(np.arange(len(lines)), per_line)
    place = np.arange(len(record)) - np.repeat(np.cumsum(per_line) - per_line, per_line)
    kinds = np.where(codes == 34, QUOTE, OTHER).astype(np.int8)
    marks = np.fromiter(map(ord, delimiters), np.uint32, len(lines))
    kinds[(codes == np.repeat(marks, lengths)) & (codes != 34)] = DELIM
    starts = (np.cumsum(lengths) - lengths)[record] + place * chunk
    sizes = np.minimum(chunk, lengths[record] - place * chunk)
    grid = np.full((len(record), max(1, int(sizes.max(initial=0)))), PAD, np.int8)
    inside = np.arange(grid.shape[1]) < sizes[:, None]
    grid[inside] = kinds[np.repeat(starts, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))]
    return grid, record, place


def transition_vectors(grid: np.ndarray) -> np.ndarray:
    """For each chunk the end state by start state: shape (chunks, 5)."""
    state = np.tile(np.arange(5, dtype=np.int8), (len(grid), 1))
    for kind in grid.T:
        state = STEP[state, kind[:, None]]
    return state


def compose(vectors: np.ndarray, record: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The start state of each chunk: exclusive prefix composition of the vectors within a record.

    Doubling scan: after step k a row holds the composition of its 2**k predecessors."""
    scan, reach = vectors.copy(), 1
    while reach <= int(place.max(initial=0)):
        rows = np.flatnonzero(place >= reach)
        scan[rows] = np.take_along_axis(scan[rows], scan[rows - reach].astype(np.int64), axis=1)
        reach *= 2
    first = np.zeros(len(record), np.int8)
    later = np.flatnonzero(place > 0)
    first[later] = scan[later - 1, START]
    return first


def tokenize(lines: Sequence[str], delimiters: Sequence[str], chunk: int = CHUNK) -> list[list[str] | None]:
    """Fields of each record, quotes resolved; None where the quoting is broken."""
    if not len(lines):
        return []
    grid, record, place = _classes(lines, delimiters, chunk)
    state = np.zeros(len(grid), np.int8)
    if place.any():
        long = np.flatnonzero(np.isin(record, record[place > 0]))
        state[long] = compose(transition_vectors(grid[long]), record[long], place[long])
    breaks = np.zeros(grid.shape, bool)
    for at in range(grid.shape[1]):
        kind = grid[:, at]
        breaks[:, at] = (kind == DELIM) & (state != QUOTED) & (state != BROKEN)
        state = STEP[state, kind]
    ends = np.zeros(len(lines), np.int8)
    ends[record] = state  # the last chunk of a record comes last
    row, column = np.nonzero(breaks)
    cut_record, cut_at = record[row], place[row] * chunk + column
    bounds = np.searchsorted(cut_record, np.arange(len(lines) + 1))
    out: list[list[str] | None] = []
    for i, line in enumerate(lines):
        if ends[i] in (QUOTED, BROKEN):
            out.append(None)
            continue
        fields, begin = [], 0
        for end in [*cut_at[bounds[i] : bounds[i + 1]].tolist(), len(line)]:
            field = line[begin:end]
            fields.append(field[1:-1].replace('""', '"') if field[:1] == '"' else field)
            begin = end + 1
        out.append(fields)
    return out


def _fits(value: str, kind: str | None) -> bool:
    if value == "" or kind in (None, "string"):
        return True
    if kind == "integer":
        return bool(_INTEGER.match(value))
    if kind == "number":
        return bool(_NUMBER.match(value))
    if kind == "date":
        if not _DATE.match(value):
            return False
        try:
            dt.date.fromisoformat(value)
        except ValueError:
            return False
    return True


def judge(fields: list[str] | None, names: Sequence[str], kinds: Sequence[str]) -> tuple[str | None, list[str] | None, bool]:
    """(reason, trimmed fields, is data row)."""
    if fields is None:
        return "quoting", None, False
    trimmed = [f.strip() for f in fields]
    if trimmed == [n.strip() for n in names]:
        return None, None, False
    if len(fields) != len(names):
        return "column_count", None, False
    if not all(_fits(v, k) for v, k in zip(trimmed, kinds, strict=False)):
        return "invalid_value", None, False
    return None, trimmed, True


def _is_blank(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[ \t\r\n ]+", "") == ""


def file_dialects(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row a file of the lines: file_id, dialect (its delimiter), n (its lines).

    Every line votes for the delimiters under which it has as many fields as column_names. Lines
    are first counted map-side by file and field counts, so only those few rows a file are
    shuffled. Ties keep the stated delimiter, then the order of `DELIMITERS`."""
    bare = F.regexp_replace("raw_line", '"[^"]*"', "")
    sizes = [(F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) + 1).alias(f"_n{i}") for i, d in enumerate(DELIMITERS)]
    counted = lines.select("file_id", *sizes).groupBy("file_id", *[f"_n{i}" for i in range(len(DELIMITERS))]).agg(F.count("*").alias("_c"))
    wanted = files.select("file_id", F.size("column_names").alias("_n"), F.col("delimiter").alias("_said"))
    votes = [F.sum(F.when(F.col(f"_n{i}") == F.col("_n"), F.col("_c")).otherwise(0)).alias(f"_v{i}") for i in range(len(DELIMITERS))]
    tallied = counted.join(wanted, "file_id", "left").groupBy("file_id").agg(*votes, F.first("_said").alias("_said"), F.sum("_c").alias("n"))
    best = F.array_max(F.array(*[F.struct(F.coalesce(F.col(f"_v{i}"), F.lit(0)).alias("n"), F.coalesce((F.col("_said") == d).cast("int"), F.lit(0)).alias("said"), F.lit(-i).alias("pos"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]))
    return tallied.select("file_id", best["d"].alias("dialect"), "n")


@lru_cache(4096)
def _spec(text: str) -> tuple[str, list[str], list[str]]:
    read = json.loads(text)
    return read["d"], read["n"], read["k"]


_OUTCOME = T.StructType([T.StructField("reason", T.StringType()), T.StructField("is_row", T.BooleanType()), T.StructField("fields", T.ArrayType(T.StringType()))])


@F.pandas_udf(_OUTCOME)
def _outcome(raw: pd.Series, spec: pd.Series) -> pd.DataFrame:
    known = [None if s is None or r is None else _spec(s) for r, s in zip(raw, spec, strict=True)]
    at = [i for i, k in enumerate(known) if k is not None]
    out: list[tuple[str | None, bool, list[str] | None]] = [(None, False, None)] * len(known)
    parsed = tokenize([raw.iat[i] for i in at], [known[i][0] for i in at])
    for i, f in zip(at, parsed, strict=True):
        reason, fields, is_row = judge(f, known[i][1], known[i][2])
        out[i] = reason, is_row, fields
    return pd.DataFrame(out, columns=["reason", "is_row", "fields"])


def parse_records(lines: DataFrame, files: DataFrame, distinct: bool = False) -> DataFrame:
    """Every record that isn't blank with its outcome: reason, is_row, trimmed fields, and its file's column_names and column_types.

    Records of unknown files have neither reason nor fields. distinct: copies of a record count once."""
    dialects = checkpointed(file_dialects(lines, files))  # one row a file
    typed = files.select("file_id", "column_names", F.coalesce("column_types", F.transform("column_names", lambda _: F.lit("string"))).alias("column_types"))
    spec = F.when(F.col("column_names").isNotNull(), F.to_json(F.struct(F.col("dialect").alias("d"), F.col("column_names").alias("n"), F.col("column_types").alias("k")), {"ignoreNullFields": "false"}))
    meta = typed.join(dialects, "file_id").select("file_id", "column_names", "column_types", spec.alias("_spec"))
    records = lines.select("line_id", "file_id", "line_no", F.regexp_replace("raw_line", r"\r\z", "").alias("raw_line")).filter(~_is_blank(F.col("raw_line")))
    joined = salted_lookup(records, meta, "file_id", "line_id", dialects.select("file_id", "n"), distinct)
    once = _outcome.asNondeterministic()  # or a filter behind it would have it evaluated a second time
    return joined.withColumn("_o", once("raw_line", "_spec")).select("line_id", "file_id", "line_no", "column_names", "column_types", "_o.*")


def rejected(lines: DataFrame, files: DataFrame) -> DataFrame:
    """line_id, reason of failing records, each line once; only the rejects are shuffled for that."""
    return parse_records(lines, files).filter(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def typed_rows(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Valid records, each line once: file_id, line_id, line_no, cells.

    cells has one struct a column: name, kind, text, and the value under its type (integer_value
    as decimal(38,0), null for more digits than that, which text holds; number_value double;
    date_value); an empty value is null under any type."""
    rows = parse_records(lines, files, distinct=True).filter("is_row")

    def cell(x: Column) -> Column:
        name, kind, raw = x["column_names"], x["column_types"], F.nullif(x["fields"], F.lit(""))
        return F.struct(
            name.alias("name"),
            kind.alias("kind"),
            raw.alias("text"),
            F.when(kind == "integer", raw.try_cast("decimal(38,0)")).alias("integer_value"),
            F.when(kind == "number", raw.try_cast("double")).alias("number_value"),
            F.when(kind == "date", raw.try_cast("date")).alias("date_value"),
        )

    zipped = F.arrays_zip("column_names", "column_types", "fields")
    return rows.select("file_id", "line_id", "line_no", F.transform(zipped, cell).alias("cells"))
