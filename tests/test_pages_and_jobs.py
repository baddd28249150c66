import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumflow.functions import boxes as B
from vellumflow.operators import layout, loops, outputs, providers, quality, results, tools, visual
from vellumflow.plans import schema as S
from vellumflow.sources import delimited, workbook
from vellumflow.streaming import lifecycle

PAGE = "doc_id long, page int, output string"


def test_ocr_forms(spark):
    new = json.dumps([{"rec_texts": ["a", "", "b"], "rec_scores": [0.5, 0.9], "rec_polys": [[[1, 2], [5, 2], [5, 9], [1, 9]], None, [[1, 1]]]}])
    old = json.dumps([[[[0, 0], [4, 0], [4, 3], [0, 3]], ["x", 0.25]], [[[0, 0]], ["", 1]], "odd"])
    rows = [(1, 1, new), (1, 2, old), (1, 3, f"[{old}]"), (2, 1, "[]"), (2, 2, None), (2, 3, "no json")]
    got = {(r["doc_id"], r["page"]): r for r in visual.ocr_pages(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[1, 1]["text"] == "a\nb" and got[1, 1]["confidence"] == 0.25 and tuple(got[1, 1]["elements"][0]["bbox"]) == (1, 2, 5, 9) and tuple(got[1, 1]["elements"][1]["bbox"]) == (0, 0, 0, 0)
    assert got[1, 2]["text"] == got[1, 3]["text"] == "x" and got[1, 2]["confidence"] == 0.25 and tuple(got[1, 2]["elements"][0]["bbox"]) == (0, 0, 4, 3)
    assert all(got[2, p]["text"] == "" and got[2, p]["confidence"] == 0.0 for p in (1, 2, 3))
    pages = visual.ocr_pages(spark.createDataFrame(rows, PAGE))
    assert visual.text_elements(pages).count() == 4
    docs = {r["doc_id"]: r for r in visual.visual_documents(pages).collect()}
    assert docs[1]["full_text"] == "a\nb\n\nx\n\nx" and docs[1]["method"] == "ocr" and docs[1]["confidence"] == 0.25 and docs[2]["full_text"] == "" and docs[2]["total_pages"] == 3


def test_pages_are_routed(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    native = spark.createDataFrame([(1, 1, "hello", [("hello", (0.0, 0.0, 1.0, 1.0))]), (1, 2, "  ", [("x", (0.0, 0.0, 1.0, 1.0))]), (1, 3, "words", [])], f"doc_id long, page int, text string, words array<struct<text:string,bbox:{box}>>")
    ocr = spark.createDataFrame([(1, p, json.dumps([{"rec_texts": [f"o{p}"], "rec_scores": [0.5]}])) for p in (1, 2, 3, 4)], PAGE)
    pages = visual.routed_pages(native, ocr)
    assert {r["page"]: (r["method"], r["text"]) for r in pages.collect()} == {1: ("pdf_native", "hello"), 2: ("ocr", "o2"), 3: ("ocr", "o3"), 4: ("ocr", "o4")}
    doc = visual.visual_documents(pages).first()
    assert doc["method"] == "hybrid" and abs(doc["confidence"] - 0.6) < 1e-9
    assert outputs.combined_text(pages).first()["text"] == "hello\n\no2\n\no3\n\no4"


def test_layout_items_and_ids(spark):
    items = [{"boxes": [[1, 2], [10, 20, 30, 40]], "labels": ["text", "FIGURE"], "scores": [0.9, 0]}, [{"bbox": [[1, 1, 2, 2]], "label": "list", "score": 0.7}], {"boxes": []}, {"bbox": [1, 1, 2, 2], "label": "text"}, 5]
    r = visual.item_regions(spark.createDataFrame([(1, 1, json.dumps(items)), (1, 2, None)], PAGE)).orderBy("pos").collect()
    assert [(x["region_id"], x["region_type"], x["confidence"], x["pos"]) for x in r] == [("item_p1_2", "list_item", 0.7, 1), ("item_p1_1", "picture", 0.5, 2)]
    found = spark.createDataFrame([(1, 1, 1, 6, 0.9, 0.0), (1, 1, 2, 0, 0.8, 1.0), (1, 1, 3, 9, 0.4, 2.0), (1, 1, 4, 77, 0.5, 3.0)], "doc_id long, page int, pos int, label int, score double, at double").select("doc_id", "page", "pos", "label", "score", B.box(F.col("at"), F.col("at"), F.lit(9.0), F.lit(9.0)).alias("bbox"))
    got = {x["region_id"]: (x["region_type"], x["parent_region_id"]) for x in visual.detected_regions(found).collect()}
    assert got == {"region_p1_1": ("picture", None), "region_p1_2": ("caption", "region_p1_1"), "region_p1_3": ("unknown", None)}
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    failed = spark.createDataFrame([(3, "E4001: down")], "doc_id long, error string")
    assert {x["doc_id"]: (x["total_regions"], x["error"]) for x in visual.document_layouts(docs, visual.detected_regions(found), failed).collect()} == {1: (3, None), 2: (0, None), 3: (0, "E4001: down")}
    kinds = spark.createDataFrame([(".PDF",), (".webp",), (".docx",), (None,)], "e string").select(visual.visual_kind(F.col("e"))).collect()
    assert [k[0] for k in kinds] == ["pdf", "image", None, None]


def _settled_by_rounds(scores):
    """Everybody takes the best place left; of those at one place all but the highest try their next, until nobody clashes."""
    wishes = [sorted(range(len(row)), key=lambda p: (row[p], p)) for row in scores]
    at = [w.pop() for w in wishes]
    while True:
        clashes = [p for p in set(at) if at.count(p) > 1]
        if not clashes:
            return at
        for p in clashes:
            held = sorted((i for i in range(len(at)) if at[i] == p), key=lambda i: -scores[i][p])
            for i in held[1:]:
                at[i] = wishes[i].pop()


def test_orders_settle_like_rounds():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 20):
        for _ in range(20):
            scores = rng.permutation(n * n).reshape(n, n).astype(float)
            assert layout.settled_orders(scores).tolist() == _settled_by_rounds(scores.tolist())
    assert sorted(layout.settled_orders(np.zeros((6, 6))).tolist()) == list(range(6))


def test_model_order_falls_back(spark, monkeypatch):
    rows = [(d, 1, f"r{i}", "text", i, 1000.0, h, [0.0, 2.0, 1.0] if s else None) for d, h, s in ((1, 1200.0, True), (2, 0.0, True), (3, 1200.0, False)) for i in range(3)]
    r = spark.createDataFrame(rows, "doc_id long, page int, region_id string, region_type string, pos int, page_width double, page_height double, scores array<double>").withColumn("bbox", B.box(F.lit(0.0), F.col("pos").cast("double"), F.lit(5.0), F.col("pos") + 1.0))
    got = layout.model_order(r).collect()
    assert {(x["doc_id"], x["source"]) for x in got} == {(1, "model"), (2, "rule"), (3, "rule")}
    one = sorted((x for x in got if x["doc_id"] == 1), key=lambda x: x["pos"])
    assert [x["order_index"] for x in one] == [1, 2, 0] and abs(one[0]["order_confidence"] - 0.66524) < 1e-4
    monkeypatch.setattr(layout, "MODEL_REGIONS", 2)
    assert {x["source"] for x in layout.model_order(r).collect()} == {"rule"} and layout.model_order(r.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, 1), (9, 1)], "doc_id long, page int")
    assert {x["doc_id"]: (x["layout_type"], x["overall_confidence"]) for x in layout.page_orders(pages, layout.reading_order(r)).collect()} == {1: ("single_column", 0.6), 9: ("empty", 1.0)}


LETTER = {"type": "object", "required": ["Vendor"], "properties": {"Vendor": {"type": "string", "minLength": 3}, "Terms": {"type": "string"}}}


def test_retries_read_the_feedback(spark):
    def eager():
        return lambda text, names: {"Vendor": "Acme", "Terms": "30"} if text and "[IMPORTANT: Validation errors" in text else {"Vendor": "A", "Terms": "30"}

    providers.register("eager", eager)
    docs = spark.createDataFrame([(1, "x"), (2, "[IMPORTANT: Validation errors"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (json.loads(r["data"])["Vendor"], r["validity"]["is_valid"], r["retry_count"]) for r in loops.extract_valid(docs, LETTER, "eager").collect()}
    assert got == {1: ("Acme", True, 1), 2: ("Acme", True, 0), 3: ("A", False, 3)}


def test_the_loop_keeps_the_best_and_counts(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        def f(text, names):
            calls.add(1)
            return dict.fromkeys(names)

        return f

    providers.register("counting", counting)
    docs = spark.createDataFrame([(1, "Vendor: Acme\nTerms: 30"), (2, "of Vendor - Acme  and more"), (3, "none")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in loops.agentic_loop(docs, LETTER, ["counting", "rules", "loose_rules"]).collect()}
    assert calls.value == 3  # one call a document, however often its pass is used
    assert (got[1]["best_iteration"], got[1]["iterations"], got[1]["converged"]) == (2, 2, True)
    assert json.loads(got[3]["data"]) == {"Vendor": None, "Terms": None} and got[3]["strategy"] == "text_comprehensive_search" and not got[3]["converged"] and got[3]["best_iteration"] == 1
    given = spark.createDataFrame([(i, '{"Vendor":"Acme","Terms":"1"}') for i in (1, 2, 3)], "doc_id long, data string")
    begun = loops.agentic_loop(docs, LETTER, ["rules"], initial=given, category="visual").collect()
    assert all(r["iterations"] == 1 and r["converged"] and r["strategy"] == "visual_targeted_refinement" for r in begun)
    assert loops.plan_of(LETTER)["needs_model"] is False and loops.plan_of(LETTER, category="visual")["needs_model"]


def test_chunks_that_fail(spark):
    def picky():
        def f(text, names):
            if "bad" in text:
                raise RuntimeError("no")
            return {"a": text}

        return f

    providers.register("picky", picky)
    c = spark.createDataFrame([(1, 0, "x"), (1, 1, "bad"), (2, 0, "bad"), (2, 1, "bad too")], "doc_id long, chunk_idx long, text string")
    got = {(r["doc_id"], r["chunk_idx"]): (r["data"], r["error"]) for r in providers.extract_chunks(c, ["a"], "picky").collect()}
    assert got == {(1, 0): ('{"a": "x"}', None), (2, None): (None, "E4002: all chunks failed: E4001: no")}


def test_tools(spark):
    def mocked():
        def f(prompt, image):
            if image == b"down":
                raise RuntimeError("down")
            return 'ok {"transcribed_text":" hi ","notes":"n","nodes":[{"id":1}],"form_title":"T","fields":[{"value":"x","field_type":"checkbox"}]}' if image == b"img" else "no object here"

        return f

    tools.register("mocked", mocked)
    r = spark.createDataFrame([(1, "a", "text", 1, b"img", False), (1, "a", "table", 2, b"img", False), (1, "b", "table", 3, None, False), (1, "c", "table", 4, b"down", True), (1, "d", "table", 5, b"odd", True)], "doc_id long, region_id string, region_type string, pos int, image binary, spans_pages boolean")
    wanted = spark.createDataFrame([(1, x) for x in "abcdz"], "doc_id long, region_id string")
    run = lambda kind: {x["region_id"]: x for x in tools.analysed(wanted, r, kind, "mocked").collect()}
    t = run("table")
    assert t["a"]["notes"] == "n Region type is text; expected table." and t["b"]["error"] == "Region image not provided for region_id: b" and t["z"]["error"] == "Unknown region_id: z" and t["c"]["error"] == "E4001: down"
    assert json.loads(t["d"]["result"]) == {"raw_response": "no object here"} and t["d"]["notes"].startswith("Table spans")
    assert json.loads(run("handwriting")["a"]["result"])["transcribed_text"] == "hi" and json.loads(run("diagram")["a"]["result"])["nodes"][0]["id"] == "1"
    assert json.loads(run("form")["a"]["result"])["fields"][0]["checked"] is True and json.loads(run("signature")["d"]["result"])["signature_present"] is False
    with pytest.raises(ValueError):
        tools.dispatch("shred")


def test_model_steps(spark):
    tools.register("verifier", lambda: lambda p, i: '{"consistency_score":0.25,"issues":[{"issue_type":"null_value","field_path":"a"},{"issue_type":"missing_required_field","field_path":"a"}]}' if p else "x")
    f = spark.createDataFrame([(1, "a", None, True, None), (2, "a", "x", True, 0.9)], "doc_id long, field_path string, value string, required boolean, confidence double")
    reports, found = tools.verified(quality.report(f), quality.issues(f), spark.createDataFrame([(1, "{}"), (2, None)], "doc_id long, data string"), "verifier")
    assert {r["doc_id"]: r["consistency"] for r in reports.collect()} == {1: 0.25, 2: 1.0}
    assert sorted((r["doc_id"], r["issue_type"]) for r in found.collect()) == [(1, "missing_required_field"), (1, "null_value")]
    tools.register("synth", lambda: lambda p, i: '{"extracted_data":{"Vendor":"A"},"overall_confidence":2}')
    s = {r["doc_id"]: r for r in tools.synthesised(spark.createDataFrame([(1, "text"), (2, " "), (3, None)], "doc_id long, content string"), LETTER, "synth").collect()}
    assert json.loads(s[1]["data"]) == {"Vendor": "A"} and s[1]["overall_confidence"] == 1.0 and json.loads(s[2]["data"]) == {"Vendor": None, "Terms": None} and s[3]["overall_confidence"] == 0.0
    p = tools.planned(spark.createDataFrame([(1, "t")], "doc_id long, text string")).first()
    assert p["steps"] == [] and p["thresholds"]["max_iterations"] == 3 and p["error"] is None
    inputs = spark.createDataFrame([(1, "r", "text", "picture", "hi")], "doc_id long, region_id string, region_type string, parent_type string, ocr_text string")
    assert tools.read_regions(inputs).first()["confidence"] == 0.5


def test_outputs(spark):
    fields = [("b.c", "1", 0.125, "x" * 120, "why"), ("none", None, None, None, None)]
    row = spark.createDataFrame([(1, '{"a":null,"b":{"c":1},"l":[1,{"k":"v","n":null}],"t":true}', "m", 0.125, 3, 4, 2, True, fields)], f"doc_id long, data string, model_used string, processing_time_seconds double, prompt_tokens long, completion_tokens long, chunks_processed long, is_chunked boolean, fields {outputs.FIELDS}")
    text = row.select(outputs.summary_markdown()).first()[0]
    assert "- **Processing Time:** 0.12s\n- **Total Tokens:** 7\n- **Chunks Processed:** 2\n\n## Extracted Data\n\n- **a:** *Not found*\n### b\n\n  - **c:** 1 *(confidence: 12%)*\n- **l:**\n  - 1\n  - k: v\n- **t:** True\n\n## Source References\n\n1. **b.c**: \"" + "x" * 100 + '..."\n\n---' in text
    assert "Source References" not in row.select(outputs.summary_markdown(with_sources=False)).first()[0]
    assert row.select(outputs.field_details(F.col("fields"))).first()[0] == '- b.c: 1 (confidence: 12%)\n  Source: "' + "x" * 100 + '..."\n  Reasoning: why\n- none: None'
    assert row.select(outputs.field_previews(F.col("fields"))).first()[0] == "- b.c: confidence=0.12, value=1\n- none: confidence=N/A, value=None"
    out = outputs.combined(row, {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}}})
    api = outputs.api_response(out).first()
    assert api["missing_required_fields"] == ["a"] and not api["is_valid"] and api["metadata"]["total_tokens"] == 7
    assert json.loads(outputs.json_output(out).first()["output"])["source_references"][0]["field"] == "b.c"
    prompt = row.select(outputs.refinement_prompt(outputs.extraction_prompt(F.lit("t" * 13000), {}, F.lit("")), F.array(F.lit("i1")), F.col("data"))).first()[0]
    assert "... [text truncated] ...\n\n## Target Schema\n{}\n\n## Issues to Fix\n- i1\n\n## Previous Extraction\n{" in prompt
    assert row.select(outputs.summary_markdown()).limit(0).count() == 0
    m = tools.summarised(row, "silent").first()
    assert m["generated_by_model"] and m["markdown"] == "{}"


def test_passed_checks_and_feedback(spark):
    f = spark.createDataFrame([(1, "a", "x", True, 0.9), (1, "b", None, False, None), (2, "a", None, True, None), (2, "b", "y", False, 0.2)], "doc_id long, field_path string, value string, required boolean, confidence double")
    got = {r["doc_id"]: r["c"] for r in quality.report(f).select("doc_id", results.passed_checks().alias("c")).collect()}
    assert got[1] == ["Required field coverage (100%) meets threshold (90%)", "Overall confidence (0.90) meets threshold (0.70)", "Schema validation passed", "All required fields present"] and got[2] == ["Schema validation passed"]
    fb = results.refinement_feedback(quality.issues(f)).first()
    assert fb["strategy"] == "text_comprehensive_search" and fb["focus_fields"] == ["a", "b"] and fb["issues"].startswith("[CRITICAL] a: Required field 'a' is missing\n   Suggestion: Re-extract with focus on finding a\n\n[HIGH] b: Field 'b' has low confidence (0.20 < 0.50)")
    issues = quality.issues(f).withColumn("current_value", F.lit(None).cast("string"))
    assert {r["field_path"]: r["current_value"] for r in quality.refreshed(issues, f).collect()} == {"a": None, "b": "y"}
    assert quality.concerned_fields(f, quality.issues(f)).count() == 2


def _xlsx(path):
    rel, main = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    row = lambda n, *cells: f'<row r="{n}">' + "".join(f'<c r="{c}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in cells) + "</row>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Z" r:id="r1"/><sheet name="A" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData>{row(1, ("A", "name"), ("B", "n"))}{row(2, ("A", "x"), ("B", "1"))}{row(3, ("B", "2"))}</sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData>{row(2, ("A", "only"))}</sheetData></worksheet>')


def test_sheets(spark, tmp_path):
    _xlsx(tmp_path / "b.xlsx")
    spark.dataSource.register(workbook.WorkbookSource)
    cells = spark.read.format("workbook").load(str(tmp_path))
    assert workbook.sheet_names(cells).first()["names"] == ["Z", "A"]
    first = workbook.chosen_sheet(cells)
    assert {c["sheet"] for c in first.collect()} == {"Z"} and workbook.chosen_sheet(cells, "A").count() == 1
    sizes = {r["sheet"]: (r["row_count"], r["column_count"], r["has_formulas"], r["headers"]) for r in workbook.sheet_sizes(cells, most_rows=2).collect()}
    assert sizes == {"Z": (2, 2, False, ["col_1", "col_2"]), "A": (2, 1, False, None)}
    assert [tuple(r) for r in workbook.sheet_table(first).orderBy("row_idx").collect()] == [(2, "x", "1"), (3, None, "2")]
    assert outputs.sheet_overview(cells).first()["section"] == "## Spreadsheet Overview\nSheets available:\n- Z (3 rows x 2 cols)\n- A (2 rows x 1 cols)\nActive sheet: Z\n"
    assert [c["is_merged"] for c in first.orderBy("row_idx", "col_idx").collect()] == [False, False, True, False, False]
    j = spark.createDataFrame([("1.5", "number"), ('a"b', "string"), (None, "null"), ("2024-01-01", "date")], "v string, k string").select(workbook.cell_json(F.col("v"), F.col("k"))).collect()
    assert [x[0] for x in j] == ["1.5", '"a\\"b"', "null", '"2024-01-01"']


def test_text_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"n,v\nx,1\ny,\n")
    (tmp_path / "b.TXT").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    texts, rejects = delimited.text_scan(delimited.binary_files(spark, str(tmp_path)))
    assert [r["error"] for r in rejects.collect()] == ["Unsupported text format: .pdf"]
    docs = delimited.row_documents(delimited.delimited_rows(texts.filter("path like '%.csv'"), batch=1), texts).orderBy("row_no").collect()
    assert [d["page_content"] for d in docs] == ["n: x\nv: 1", "n: y\nv: "] and docs[1]["metadata"]["row"] == "1" and docs[0]["metadata"]["delimiter"] == ","
    assert {d["page_content"]: d["metadata"]["encoding"] for d in delimited.page_documents(texts).filter("path like '%TXT'").collect()} == {"é": "latin-1"}


def test_lifecycle(spark, tmp_path):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    up = spark.createDataFrame([("a.pdf", 5, '{"type":"object"}', None, True), ("", 5, "{}", None, False), ("a", 5, None, None, False), ("b.TXT", 5, None, '{"properties":{"x":{"type":"odd"}}}', False)], "name string, length long, schema_text string, schema_file_text string, redact_output boolean")
    s = lifecycle.submissions(up)
    assert [(r["code"], r["error_code"]) for r in s.collect()] == [(202, None), (400, "E1001"), (400, "E2002"), (400, "E2001")]
    job = lifecycle.created(s, now).collect()[0]
    assert job["file_path"].endswith(".pdf") and (job["expires_at"] - job["created_at"]).total_seconds() == 86400
    table = spark.createDataFrame([("a", "2024-01-01 12:00:00"), ("b", "2024-01-03 00:00:00")], "job_id string, e string").select("job_id", F.col("e").cast("timestamp").alias("expires_at"))
    answers, left = lifecycle.point_reads(spark.createDataFrame([("a",), ("b",), ("z",)], "job_id string"), table, now)
    assert {r["job_id"]: r["code"] for r in answers.collect()} == {"a": 410, "b": 200, "z": 404} and [r["job_id"] for r in left.collect()] == ["b"]
    got = lifecycle.result_answers(spark.createDataFrame([("a", "pending"), ("b", "completed"), ("c", "failed")], "job_id string, status string"), spark.createDataFrame([("b", "{}"), ("a", "{}")], "job_id string, result string"))
    assert {r["job_id"]: (r["code"], r["result"]) for r in got.collect()} == {"a": (425, None), "b": (200, "{}"), "c": (500, None)}
    for n in ("old", "new"):
        (tmp_path / n).write_text("x")
    files = spark.createDataFrame([(str(tmp_path / "old"), "2023-01-01 00:00:00"), (str(tmp_path / "gone"), "2023-01-01 00:00:00"), (str(tmp_path / "new"), "2024-01-01 12:00:00")], "path string, m string").select("path", F.col("m").cast("timestamp").alias("modificationTime"))
    assert lifecycle.purged(spark, files, now, 30) == {"scanned": 3, "removed": 1, "skipped": 1, "errors": 1}
    assert not (tmp_path / "old").exists() and (tmp_path / "new").exists()


def test_reports_of_a_run():
    assert lifecycle.log_line("done", a=1, b="x") == "done | a=1, b=x" and lifecycle.log_line("done") == "done"
    with lifecycle.timed("step") as m:
        m.add("rows", 5)
        m.add("rows")
    assert m.succeeded and m.counts == {"rows": 6} and m.seconds >= 0
    with pytest.raises(KeyError), lifecycle.timed("step") as failed:
        raise KeyError
    assert failed.succeeded is False
    p = lifecycle.Progress(4)
    assert p.step("read") == "read | done=1, total=4, percent=25.0" and p.step(n=9).endswith("percent=100.0")


def test_plan_of_schema():
    assert S.complexity(LETTER) == "simple"


def test_chunks_follow_the_ladder(spark):
    import random

    from vellumflow.operators import text_extraction as X

    pick = random.Random(3)
    for _ in range(30):
        text = "".join(pick.choice(["word ", "Sentence. ", "\n", "\n\n", "x" * pick.randint(1, 60), "é"]) for _ in range(pick.randint(0, 300)))
        cut = X.chunks(text, 50, 10)
        assert all(0 < len(c) <= 50 for c in cut) and all(c in text for c in cut)
        whole = X.chunks(text, 50, 0)
        assert "".join("".join(whole).split()) == "".join(text.split())
    assert X.chunks("aa bb. cc\n\ndd", 8, 0) == ["aa bb", ". cc", "dd"] and X.chunks("y" * 9, 4, 0) == ["yyyy", "yyyy", "y"] and X.chunks("yyyyy", 4, 2) == ["yyyy", "yyy"] and X.chunks("a b c d e f", 5, 2) == ["a b c", "c d", "d e", "e f"]
    docs = spark.createDataFrame([(1, "line of text\n\n" * 2000), (2, "short"), (3, None), (4, "  "), (5, "Vendor: A\n" + "x " * 9000 + "\nTerms: B")], "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in X.text_chunks(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got[2] == 1 and got[1] > 6 and set(got) == {1, 2, 5}
    done = {r["doc_id"]: r for r in X.extract_text(docs, ["Vendor", "Terms"]).collect()}
    assert json.loads(done[5]["data"]) == {"Vendor": "A", "Terms": "B"} and done[5]["is_chunked"] and done[5]["chunks_processed"] == got[5]
    assert done[3]["data"] is None and done[3]["chunks_processed"] == 0 and len(done) == 5 and not done[2]["is_chunked"]


def test_chunk_records_merge():
    from vellumflow.operators.text_extraction import merged

    assert merged([None, None]) is None and merged([None, 0, 5]) == 0
    assert merged([[1, {"a": 1}], "odd", [{"a": 1}, 2]]) == [1, {"a": 1}, 2]
    assert merged([{"a": None, "l": [1]}, {"a": 2, "l": [3], "b": 4}]) == {"a": 2, "l": [1], "b": 4}


def test_scans_through_providers(spark):
    def seeing():
        def f(prompt, image):
            if image == b"down":
                raise RuntimeError("down")
            return json.dumps([{"rec_texts": [image.decode()], "rec_scores": [0.5], "rec_polys": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}]) if prompt == "ocr" else json.dumps([{"boxes": [[0, 0, 9, 9]], "labels": ["table"], "scores": [0.9]}])

        return f

    tools.register("seeing", seeing)
    images = visual.frames(spark.createDataFrame([(1, [b"a", b"b"]), (2, [b"down"])], "doc_id long, frames array<binary>"))
    docs, elements, layouts = visual.visual_scan(images, "seeing", "seeing")
    assert {d["doc_id"]: d["full_text"] for d in docs.collect()} == {1: "a\n\nb", 2: ""}
    assert {(e["page"], e["text"], e["region_id"]) for e in elements.collect()} == {(1, "a", "item_p1_1"), (2, "b", "item_p2_2")}
    assert {x["doc_id"]: (x["total_regions"], x["error"]) for x in layouts.collect()} == {1: (2, None), 2: (0, "E4001: down")}
    assert images.select(visual.encoded(F.col("image"))).first()[0] == "YQ=="
    prompts = spark.createDataFrame([("table",), ("odd",)], "t string").select(layout.strategy_prompt(F.col("t"), {"table_specialized": "read the table"}, "look")).collect()
    assert [p[0] for p in prompts] == ["read the table", "look"]
