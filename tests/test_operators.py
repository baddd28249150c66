import time
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumflow.functions import boxes as B
from vellumflow.operators import chunk_merge, layout, providers, quality, render
from vellumflow.plans import schema
from vellumflow.session import salted_lookup
from vellumflow.sources import delimited, workbook
from vellumflow.streaming import jobs

REGION = "doc_id long, page int, region_id string, region_type string, pos int, x0 double, y0 double, x1 double, y1 double"


def regions(spark, rows):
    df = spark.createDataFrame([(1, 1, f"r{i}", kind, i, *map(float, box)) for i, (kind, *box) in enumerate(rows)], REGION)
    return df.select("doc_id", "page", "region_id", "region_type", "pos", B.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"), F.lit(1000.0).alias("page_width"), F.lit(1200.0).alias("page_height"))


def test_nesting_takes_the_first_parent(spark):
    r = regions(spark, [("picture", 0, 0, 100, 100), ("table", 0, 0, 100, 90), ("caption", 10, 10, 20, 20), ("text", 95, 95, 200, 200), ("title", 10, 10, 20, 20)])
    got = {x["region_id"]: x["parent_region_id"] for x in layout.nested(r).collect()}
    assert got == {"r0": None, "r1": None, "r2": "r0", "r3": None, "r4": None}


def test_two_columns_read_left_first(spark):
    r = regions(spark, [("text", 600, 0, 900, 90), ("text", 0, 0, 300, 90), ("text", 600, 300, 900, 400), ("text", 0, 300, 300, 400), ("page_footer", 0, 1100, 900, 1150)])
    got = layout.reading_order(r).orderBy("order_index").collect()
    assert [x["region_id"] for x in got] == ["r1", "r3", "r4", "r0", "r2"] and got[0]["layout_type"] == "multi_column" and got[2]["skip"]
    assert layout.reading_order(r.limit(0)).count() == 0


def test_elements_find_their_region(spark):
    r = regions(spark, [("text", 0, 0, 300, 90), ("table", 0, 0, 900, 900)])
    e = spark.createDataFrame([(1, 1, "e1", 10.0), (1, 1, "e2", 500.0), (1, 1, "e3", 950.0)], "doc_id long, page int, element_id string, at double").select("doc_id", "page", "element_id", B.box(F.col("at"), F.col("at"), F.col("at") + 2, F.col("at") + 2).alias("element_box"))
    assert {x["element_id"]: x["region_id"] for x in layout.elements_to_regions(e, r).collect()} == {"e1": "r0", "e2": "r1"}


FIELDS = "doc_id long, field_path string, value string, required boolean, confidence double"


def test_report_and_best_pass(spark):
    f = spark.createDataFrame([(1, "a", "x", True, 0.9), (1, "b", None, False, None), (2, "a", None, True, None), (2, "b", "y", False, 0.2), (3, "a", "[ ]", True, 0.8)], FIELDS)
    got = {r["doc_id"]: r for r in quality.report(f).collect()}
    assert (got[1]["status"], got[2]["status"]) == ("passed", "failed") and got[1]["completeness"] == 0.7
    assert got[2]["critical_issues"] == 1 and got[2]["high_issues"] == 1 and got[3]["high_issues"] == 1
    p = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.5), (1, 3, 0.1)], "doc_id long, iteration int, score double")
    assert quality.best_pass(p).first()["iteration"] == 1
    with pytest.raises(ValueError):
        quality.Thresholds(min_confidence=2)


def test_refined_confidence_and_issue_union(spark):
    now = spark.createDataFrame([(1, "same", "a"), (1, "found", "b"), (1, "changed", "c"), (1, "new", "d"), (1, "none", None)], "doc_id long, field_path string, value string")
    was = spark.createDataFrame([(1, "same", "a", 0.9), (1, "found", None, None), (1, "changed", "x", 0.9)], "doc_id long, field_path string, value string, confidence double")
    assert {r["field_path"]: r["confidence"] for r in quality.carried_confidence(now.withColumn("confidence", F.lit(0.0)), was).collect()} == {"same": 0.9, "found": 0.65, "changed": 0.7, "new": 0.6, "none": None}
    i = spark.createDataFrame([(1, "t", "p", "high")], "doc_id long, issue_type string, field_path string, severity string")
    assert quality.merged_issues(i, i.unionByName(i.withColumn("field_path", F.lit("q")))).count() == 2


def test_chunks_merge_by_type(spark):
    c = spark.createDataFrame([(1, 2, "late", ["b", "a"], (None, ["n2"])), (1, 1, None, ["a"], (5, None)), (1, 3, "later", None, (6, ["n3"]))], "doc_id long, chunk_idx int, s string, l array<string>, o struct<n:int,m:array<string>>")
    r = chunk_merge.merge_chunks(c).first()
    assert (r["s"], r["l"], r["o"]["n"], r["o"]["m"]) == ("late", ["a", "b"], 5, ["n2"])


INVOICE = {"type": "object", "required": ["number"], "properties": {"number": {"type": "string", "pii": "mask"}, "total": {"type": ["number", "null"]}, "vendor": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}}}, "items": {"type": "array", "items": {"type": "object", "properties": {"q": {"type": "integer"}}}}}}


def test_schema_compiler(spark):
    tree = schema.validated(INVOICE)
    assert [f.path for f in schema.flat(tree)] == ["number", "total", "vendor", "vendor.name", "items", "items[].q"]
    assert schema.spark_type(INVOICE).simpleString() == "struct<number:string,total:double,vendor:struct<name:string>,items:array<struct<q:bigint>>>"
    assert schema.complexity(INVOICE) == "complex" and schema.complexity({"properties": {"a": {"type": "string"}}}) == "simple"
    with pytest.raises(schema.SchemaError):
        schema.validated({"properties": {"a": {"type": "text"}}})
    df = spark.createDataFrame([('{"number":"1","total":2,"vendor":{"name":"x"}}',), ('{"total":"2","vendor":{}}',), ('{"number":null,"items":{}}',)], "j string").select(F.parse_json("j").alias("v"))
    got = [sorted(x["path"] for x in r[0]) for r in df.select(schema.rules(tree, "v")).collect()]
    assert got == [[], ["number", "total", "vendor.name"], ["items", "number"]]
    assert schema.fields_table(spark, tree).filter("required").count() == 2


def test_markdown(spark):
    f = spark.createDataFrame([(1, "T", 1, "a", "x", 0.125), (1, "T", 0, "b", None, None)], "doc_id long, title string, field_order int, field_path string, value string, confidence double")
    assert render.documents_markdown(f).first()["markdown"] == "# T\n\n## Extracted Data\n\n- **b:** *Not found*\n- **a:** x (12%)"


def _xlsx(path):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c></row><row><c r="A2" t="b"><v>1</v></c><c r="B2" s="1"><v>45292</v></c><c r="C2"><f>SUM(B1,B1)</f><v>5</v></c><c r="D2"><f>X()</f></c></row></sheetData><mergeCells><mergeCell ref="A2:B2"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')


def test_workbook(spark, tmp_path):
    _xlsx(tmp_path / "a.xlsx")
    spark.dataSource.register(workbook.WorkbookSource)
    cells = spark.read.format("workbook").load(str(tmp_path))
    got = {(c["row_idx"], c["col_idx"]): (c["value"], c["data_type"], c["is_merged"]) for c in cells.collect()}
    assert got[1, 1] == ("name", "string", False) and got[1, 2] == ("2.5", "number", False) and got[2, 1] == ("true", "boolean", True)
    assert got[2, 2] == ("2024-01-01 00:00:00", "date", True) and got[2, 3] == ("5", "formula", False) and got[2, 4][0] == "=X()"
    assert workbook.sheet_preview(cells, 1).first()["preview"] == "A1=name(string) | B1=2.5(number)\n... (truncated)"
    assert workbook.rows_of(cells, (2, 2), ["A"]).first()["values"] == {"A": "true"}
    assert workbook.row_range("2:99", 10) == (2, 10) and workbook.column_letters(28) == "AB" and workbook.column_index("AB") == 28
    with pytest.raises(ValueError):
        workbook.row_range("5:2", 10)


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n;v\r\nx;\r\n\"a;b\";2\r\n".encode())
    (tmp_path / "b.csv").write_bytes(b"")
    files = delimited.text_documents(delimited.binary_files(spark, str(tmp_path)))
    rows = delimited.delimited_rows(files)
    assert [(r["row"], r["delimiter"]) for r in rows.orderBy("row_no").collect()] == [(["x", ""], ";"), (["a;b", "2"], ";")]
    assert delimited.tab_text(rows).first()["text"] == "n\tv\nx\t\na;b\t2" and delimited.csv_metadata(rows).first()["row_count"] == 2


def test_providers_keep_errors_as_rows_and_refine(spark):
    def failing():
        def f(text, names):
            raise RuntimeError("down")

        return f

    providers.register("failing", failing)
    docs = spark.createDataFrame([(1, "Number: 7\nTotal = 3"), (2, "nothing"), (3, None)], "doc_id long, text string")
    assert providers.extract(docs, ["number"], "failing").filter("error like 'E4001%'").count() == 3
    best = {r["doc_id"]: r["status"] for r in quality.best_pass(providers.refine(docs, ["rules", "rules"], ["number"], ["total"])).collect()}
    assert best == {1: "passed", 2: "failed", 3: "failed"}


def test_job_state_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "events")
    spark.createDataFrame([("a", "running", 1), ("a", "completed", 2), ("b", "queued", 1)], "job_id string, state string, at long").write.parquet(src)
    stream = spark.readStream.schema("job_id string, state string, at long").parquet(src)
    q = jobs.live_status(stream).writeStream.outputMode("update").format("memory").queryName("job_state").option("checkpointLocation", str(tmp_path / "cp")).start()
    # a stream with a time to live goes on with batches without data, so it is ended when its rows are there
    end = time.time() + 90
    while time.time() < end and spark.table("job_state").count() < 2:
        time.sleep(0.3)
    q.stop()
    assert {(r["job_id"], r["status"], r["n_events"]) for r in spark.table("job_state").collect()} == {("a", "completed", 2), ("b", "pending", 1)}


def test_salted_lookup_keeps_every_row(spark):
    rows = spark.range(1000).select(F.col("id"), F.lit(1).alias("k"))
    joined = salted_lookup(rows, spark.createDataFrame([(1, "x")], "k int, v string"), "k", "id", rows.groupBy("k").agg(F.count("*").alias("n")))
    assert joined.count() == 1000 and joined.filter("v = 'x'").count() == 1000


def test_results(spark):
    from vellumflow.operators import results

    r = regions(spark, [("picture", 0, 0, 9, 9), ("text", 1, 1, 2, 2)]).withColumn("parent_region_id", F.when(F.col("region_id") == "r1", "r0"))
    images = spark.createDataFrame([(1, "r1", b"x")], "doc_id long, region_id string, image binary")
    ocr = spark.createDataFrame([(1, "r1", "hello")], "doc_id long, region_id string, ocr_text string")
    inputs, failures = results.region_inputs(r, images, ocr)
    assert [(x["parent_type"], x["ocr_text"]) for x in inputs.collect()] == [("picture", "hello")] and failures.first()["region_id"] == "r0"
    old = spark.createDataFrame([("a", "running", 1), ("b", "running", 1)], "job_id string, state string, updated_at long")
    new = spark.createDataFrame([("a", "completed", 2), ("b", None, 2), ("c", "queued", 1)], old.schema)
    assert {tuple(x) for x in results.upserted(old, new).collect()} == {("a", "completed", 2), ("c", "queued", 1)}
