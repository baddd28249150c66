import json

from vellumflow.operators import nested as N

RESULTS = "result_id long, extracted_data string, node_path string"
FORMS = "form_id long, fields array<struct<label:string,value:string,field_type:string>>, position string"


def paths(spark, records, forms=()):
    r = spark.createDataFrame([(i, x, "clash") for i, x in records], RESULTS)
    f = spark.createDataFrame(list(forms), FORMS)
    return {(x["record_table"], x["record_id"], x["node_path"]) for x in N.child_links(r, f).collect()}


def test_paths_of_uneven_records(spark):
    deep = {"Line Items": [{"allocations": {"approvals": [None, {"Comments": json.dumps([{"by": "x"}])}]}}, 5, {"a": 1}], "vendor": {"CONTACTS": [{"r": 1}]}, "total": [{"x": 1}]}
    got = paths(spark, [(1, json.dumps(deep)), (2, "```json\n" + json.dumps({"employees": json.dumps([{"assignments": [{}]}])}) + "\n```"), (3, '{"gdp": [{"year": 1}'), (4, None), (5, ""), (6, "[]"), (7, '{"gdp": "plain", "years": null, "education": []}'), (8, '{"gdp":[{}]} tail')])
    assert got == {
        ("extraction_results", 1, "line_items[0]"), ("extraction_results", 1, "line_items[2]"), ("extraction_results", 1, "line_items[0].allocations[0]"), ("extraction_results", 1, "line_items[0].allocations[0].approvals[1]"),
        ("extraction_results", 1, "line_items[0].allocations[0].approvals[1].comments[0]"), ("extraction_results", 1, "vendor.contacts[0]"), ("extraction_results", 2, "employees[0]"), ("extraction_results", 2, "employees[0].assignments[0]"),
    }


def test_forms_and_repeated_results(spark):
    option = json.dumps([{"option": "a", "notes": [{"by": "x"}]}, None, {"option": "b"}])
    forms = [(1, [("l", option, "radio"), None, ("m", "{unreadable}", "text"), ("n", None, None)], "p"), (2, None, "p"), (3, [], "p")]
    got = paths(spark, [(1, '{"gdp":[{"y":1}]}'), (1, '{"gdp":[{"y":1}]}')], forms)
    assert got == {("extraction_results", 1, "gdp[0]"), *(("form_analyses", 1, p) for p in ("fields[0]", "fields[2]", "fields[3]", "fields[0].value[0]", "fields[0].value[2]", "fields[0].value[0].notes[0]"))}


def test_links_and_tables(spark):
    r = spark.createDataFrame([(1, '{"experience":[{"Company":"A","projects":[{"name":"n","Tools":["x","y"]},null,{"NAME":null,"name":"m","tools":7}]}]}', "c")], RESULTS)
    rows = N.child_table(r, "projects").orderBy("position").collect()
    assert [tuple(x) for x in rows] == [(1, "experience[0].projects[0]", "experience[0]", 0, "n", ["x", "y"]), (1, "experience[0].projects[2]", "experience[0]", 2, "m", None)]
    assert [x["company"] for x in N.child_table(r, "experience").collect()] == ["A"]
    assert N.child_links(r.limit(0), spark.createDataFrame([], FORMS)).count() == 0


def test_typed_columns(spark):
    items = [{"quantity": "1,234.50", "Unit Price": 2, "total": "n/a", "description": 5}, {"unit price": None, "unit_price": "3"}]
    r = spark.createDataFrame([(1, json.dumps({"line_items": items}), "c")], RESULTS)
    rows = N.child_table(r, "line_items").orderBy("position").collect()
    assert [(x["quantity"], x["unit_price"], x["total"], x["description"]) for x in rows] == [(1234.5, 2.0, None, "5"), (None, 3.0, None, None)]
    assert N.child_table(r.limit(0), "years").columns[:5] == ["record_id", "node_path", "parent_path", "position", "year"]


def test_plan_of_links_builds_no_objects(spark):
    r = spark.createDataFrame([(1, "{}", "c")], RESULTS)
    df, _ = N._extracted(r)
    assert "StructsToJson" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_very_long_record(spark):
    big = json.dumps({"line_items": [{"n": i, "t": "x" * 50} for i in range(5000)]})
    assert len(paths(spark, [(1, big)])) == 5000
