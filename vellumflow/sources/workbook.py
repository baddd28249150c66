"""Spreadsheet files as a Spark data source of cells, read with the standard library alone.

spark.dataSource.register(WorkbookSource); spark.read.format("workbook").load(path) gives path,
sheet, sheet_no, row_idx, col_idx, value, data_type, formula, is_merged; one partition a sheet. Options: sheet,
max_rows, max_columns, formulas (true keeps a formula's text where no value is cached).
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "path string, sheet string, sheet_no int, row_idx int, col_idx int, value string, data_type string, formula string, is_merged boolean"
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def column_letters(index: int) -> str:
    """1 -> A, 27 -> AA."""
    out = ""
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_index(letters: str) -> int:
    value = 0
    for c in letters.upper():
        value = value * 26 + ord(c) - 64
    return value


def _place(reference: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)", reference)
    return int(m[2]), column_index(m[1])


class _Sheet(InputPartition):
    def __init__(self, path: str, name: str, part: str, number: int) -> None:
        self.path, self.name, self.part, self.number = path, name, part, number


def _sheets(path: str) -> list[tuple[str, str]]:
    with zipfile.ZipFile(path) as z:
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        return [(s.get("name"), "xl/" + rels[s.get(_REL)].removeprefix("/xl/")) for s in book.iter(_MAIN + "sheet")]


def _streamed(z: zipfile.ZipFile, part: str, tag: str) -> Iterator[ET.Element]:
    """Elements of one kind in document order; rows are dropped as soon as they are read."""
    with z.open(part) as f:
        for _, e in ET.iterparse(f):
            if e.tag == _MAIN + tag:
                yield e
            if e.tag in (_MAIN + "row", _MAIN + "mergeCell"):
                e.clear()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        root = self.options["path"]
        paths = sorted(glob.glob(os.path.join(root, "*.xlsx"))) if os.path.isdir(root) else sorted(glob.glob(root))
        wanted = self.options.get("sheet")
        found = [_Sheet(p, name, part, i) for p in paths for i, (name, part) in enumerate(_sheets(p)) if wanted in (None, name)]
        if wanted and not found:
            raise ValueError(f"unknown sheet {wanted!r}")
        return found

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        most_rows, most_columns = int(self.options.get("max_rows", 1 << 30)), int(self.options.get("max_columns", 1 << 30))
        keep_formulas = self.options.get("formulas", "true").lower() == "true"
        with zipfile.ZipFile(partition.path) as z:
            names = set(z.namelist())
            strings = ["".join(t.text or "" for t in s.iter(_MAIN + "t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
            dates: list[bool] = []
            if "xl/styles.xml" in names:
                styles = ET.fromstring(z.read("xl/styles.xml"))
                own = {int(f.get("numFmtId")) for f in styles.iter(_MAIN + "numFmt") if re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")))}
                xfs = styles.find(_MAIN + "cellXfs")
                dates = [int(x.get("numFmtId", 0)) in _DATE_FORMATS | own for x in (xfs if xfs is not None else [])]
            # merged ranges stand behind the cells, so the sheet is streamed twice and never held as a tree
            merged = []
            for m in _streamed(z, partition.part, "mergeCell"):
                a, _, b = m.get("ref").partition(":")
                merged.append((*_place(a), *_place(b or a)))
            for c in _streamed(z, partition.part, "c"):
                row, column = _place(c.get("r"))
                if row > most_rows or column > most_columns:
                    continue
                kind, v, f = c.get("t", "n"), c.find(_MAIN + "v"), c.find(_MAIN + "f")
                text, formula = (v.text if v is not None else None), ("=" + (f.text or "") if f is not None else None)
                style = int(c.get("s", 0))
                if kind == "s" and text is not None:
                    text = strings[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
                elif kind == "b" and text is not None:
                    text = "true" if text == "1" else "false"
                is_date = kind == "n" and text is not None and style < len(dates) and dates[style]
                if is_date:
                    text = (dt.datetime(1899, 12, 30) + dt.timedelta(days=float(text))).isoformat(sep=" ")
                # precedence: formula, date, boolean, number, null, string
                data_type = "formula" if formula else "date" if is_date else "boolean" if kind == "b" else "null" if text is None else "number" if kind == "n" else "string"
                if formula and text is None and keep_formulas:
                    text = formula
                inside = any(r0 <= row <= r1 and c0 <= column <= c1 for r0, c0, r1, c1 in merged)
                yield (partition.path, partition.name, partition.number, row, column, text, data_type, formula, inside)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(dict(self.options))


def row_range(text: str | None, most: int) -> tuple[int, int]:
    """`start:end`, the end capped; all rows for none."""
    if not text:
        return 1, most
    m = re.fullmatch(r"\s*(\d+)\s*:\s*(\d+)\s*", text)
    if not m or not 1 <= int(m[1]) <= int(m[2]):
        raise ValueError(f"invalid row range {text!r}")
    return int(m[1]), min(int(m[2]), most)


def rows_of(cells: DataFrame, rows: tuple[int, int], columns: list[str] | None = None) -> DataFrame:
    """sheet, row_idx, values: a map from column letters to values; rows without values fall out."""
    kept = cells.filter(F.col("row_idx").between(*rows) & F.col("value").isNotNull())
    if columns:
        kept = kept.filter(F.col("col_idx").isin([column_index(c) for c in columns]))
    return kept.groupBy("sheet", "row_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(letters(F.col("col_idx")).alias("c"), "value")))).alias("values"))


def letters(index):  # noqa: ANN001, ANN201
    """Column letters as an expression, up to ZZ."""
    high, low = F.floor((index - 1) / 26), F.pmod(index - 1, F.lit(26))
    return F.concat(F.when(high > 0, F.char(64 + high)).otherwise(F.lit("")), F.char(65 + low))


def sheet_preview(cells: DataFrame, most_rows: int = 30) -> DataFrame:
    """sheet, preview: lines of `A1=value(type)` joined by bars, cut after `most_rows` with a mark: a report."""
    shown = F.concat(letters(F.col("col_idx")), F.col("row_idx").cast("string"), F.lit("="), F.col("value"), F.lit("("), F.col("data_type"), F.lit(")"))
    lines = cells.filter((F.col("row_idx") <= most_rows) & F.col("value").isNotNull()).groupBy("sheet", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", shown.alias("l")))), lambda x: x["l"]), " | ").alias("line"))
    whole = lines.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n").alias("body"))
    sizes = cells.groupBy("sheet").agg(F.max("row_idx").alias("rows"))
    return whole.join(sizes, "sheet").select("sheet", F.concat("body", F.when(F.col("rows") > most_rows, "\n... (truncated)").otherwise("")).alias("preview"))


def sheet_names(cells: DataFrame) -> DataFrame:
    """path, names in the order of the workbook."""
    named = cells.select("path", "sheet", "sheet_no").distinct()
    return named.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("sheet_no", "sheet"))).alias("_n")).select("path", F.transform("_n", lambda x: x["sheet"]).alias("names"))


def chosen_sheet(cells: DataFrame, sheet: str | None = None) -> DataFrame:
    """The cells of one sheet: the named one, else each workbook's first."""
    if sheet is not None:
        return cells.filter(F.col("sheet") == sheet)
    return cells.filter("sheet_no = 0")


def sheet_sizes(cells: DataFrame, most_rows: int = 1 << 30, most_columns: int = 1 << 30) -> DataFrame:
    """path, sheet, row_count, column_count (within the limits), has_formulas, headers.

    headers are col_1 to col_n where the first row says anything, else null: names are made, not read."""
    said = F.count_if((F.col("row_idx") == 1) & F.col("value").isNotNull())
    sizes = cells.groupBy("path", "sheet").agg(F.max("row_idx").alias("_r"), F.max("col_idx").alias("_c"), F.bool_or(F.col("data_type") == "formula").alias("has_formulas"), said.alias("_h"), F.max(F.when(F.col("row_idx") == 1, F.col("col_idx"))).alias("_n"))
    named = F.when(F.col("_h") > 0, F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.concat(F.lit("col_"), i.cast("string"))))
    return sizes.select("path", "sheet", F.least("_r", F.lit(most_rows)).alias("row_count"), F.least("_c", F.lit(most_columns)).alias("column_count"), "has_formulas", named.alias("headers"))


def sheet_table(cells: DataFrame) -> DataFrame:
    """A worksheet as a table: the first row names the columns; rows in order of row_idx. One sheet's cells; its header is read on the driver."""
    header = {r["col_idx"]: r["value"] for r in cells.filter((F.col("row_idx") == 1) & F.col("value").isNotNull()).select("col_idx", "value").collect()}  # a sheet has at most 16,384 columns
    picked = [F.max(F.when(F.col("col_idx") == i, F.col("value"))).alias(n) for i, n in sorted(header.items())]
    body = cells.filter("row_idx > 1").groupBy("row_idx")
    return body.agg(*picked) if picked else body.count().drop("count")


def cell_json(value: Column, data_type: Column) -> Column:
    """A cell as JSON text: numbers and flags as they are, dates and other text quoted, nulls null."""
    return F.when(value.isNull(), "null").when(data_type.isin("number", "boolean"), value).otherwise(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))
