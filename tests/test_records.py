import json

import pytest
from pyspark.sql import functions as F

from vellumflow.functions import records as R
from vellumflow.functions import replies as A
from vellumflow.plans.schema import fields

INVOICE = {
    "type": "object", "required": ["number", "items"],
    "properties": {
        "number": {"type": "string", "pii": "mask"}, "date": {"type": "string", "format": "date"}, "total": {"type": "number", "minimum": 0}, "paid": {"type": "boolean"}, "pages": {"type": "integer"},
        "vendor": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "pii": "drop"}, "phone": {"type": "string"}}},
        "items": {"type": "array", "items": {"type": "object", "required": ["q"], "properties": {"q": {"type": "integer"}, "note": {"type": "string"}}}},
    },
}


def outs(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_paths(spark):
    records = ['{"a":{"b":1},"l":[{"x":1},{"y":2},{"x":null}]}', '{"a":5,"l":[]}', "{}", None]
    asked = lambda get, path: outs(spark, records, lambda v: F.to_json(get(F.try_parse_json(v), path)))
    assert asked(R.at_path, "a.b") == ["1", None, None, None]
    assert asked(R.fanned, "l[].x") == ["[1,null,null]", "[]", None, None]
    assert asked(R.first_of, "l[].x") == ["1", None, None, None]
    assert json.loads(outs(spark, [[("a.b", "1"), ("a.c", None), ("d", "x"), ("d.e", "y")]], R.assembled, "array<struct<field_path:string,value:string>>")[0]) == {"a": {"b": "1", "c": None}, "d": {"e": "y"}}
    assert outs(spark, ["x"], lambda _: R.skeleton(INVOICE))[0] == '{"number": null, "date": null, "total": null, "paid": null, "pages": null, "vendor": null, "items": null}'


def test_field_rows(spark):
    rows = outs(spark, ['{"number":"n","vendor":{"name":"v"},"items":[{"q":1}]}', "{}"], lambda v: R.field_rows(F.try_parse_json(v), fields(INVOICE), R.stated(found=0.85)))
    assert [(r["field_path"], r["value"], r["confidence"]) for r in rows[0] if r["value"]] == [("number", "n", 0.85), ("vendor", '{"name":"v"}', 0.85), ("vendor.name", "v", 0.85), ("items", '[{"q":1}]', 0.85)]
    assert len(rows[0]) == 9 and len(rows[1]) == 7
    by_path = outs(spark, ['{"number":"n"}'], lambda v: R.field_rows(F.try_parse_json(v), fields(INVOICE), R.stated(by_path=F.create_map(F.lit("number"), F.lit(0.9)), default=0.5), nested=False))[0]
    assert [r["confidence"] for r in by_path][:2] == [0.9, 0.5]


def test_cleaning(spark):
    given = ['{"z":{"cell":["(555) 123-4567"]},"number":7,"date":"March 5, 2024","total":"1.5","paid":"Yes","pages":"3.9","vendor":{"phone":"(555) 123-4567","hotel":"x"},"items":{"q":1}}', '{"total":"n/a"}', "[1]", "{", None]
    got = [x and json.loads(x) for x in outs(spark, given, R.cleaned_record(INVOICE))]
    assert got[0] == {"number": "7", "date": "2024-03-05", "total": 1.5, "paid": True, "pages": 3, "vendor": {"phone": "+15551234567", "hotel": "x"}, "items": [{"q": 1}], "z": {"cell": ["+15551234567"]}}
    assert list(got[0])[-1] == "z"
    assert got[1] == {"number": None, "date": None, "total": "n/a", "paid": None, "pages": None, "vendor": {}, "items": []} and got[2:] == [None, None, None]
    assert json.loads(outs(spark, ["{}"], R.cleaned_record(INVOICE, defaults=False))[0])["items"] is None


def test_null_stripping_and_validity(spark):
    record = {"number": None, "date": None, "vendor": {"name": None, "phone": None}, "items": [{"q": 1, "note": None}, {"q": "2"}], "extra": None}
    assert json.loads(outs(spark, [json.dumps(record)], R.stripped_record(INVOICE))[0]) == {"number": None, "vendor": {"name": None}, "items": [{"q": 1}, {"q": "2"}], "extra": None}
    v = outs(spark, [json.dumps(record), '{"number":"1","items":[]}', '{"number":"1","items":[],"total":-1}', None], R.validity(INVOICE))
    assert v[0]["errors"] == ["number: None is not of type 'string'", "date: None is not of type 'string'", "vendor.name: None is not of type 'string'", "vendor.phone: None is not of type 'string'", "items.0.note: None is not of type 'string'", "items.1.q: '2' is not of type 'integer'"]
    assert v[0]["missing_required"] == ["number"] and v[0]["violation"]["field_path"] == "number" and not v[0]["is_valid"]
    assert v[1]["is_valid"] and v[1]["violation"] is None
    assert v[2]["errors"] == ["total: -1 is less than the minimum of 0"] and v[3]["is_valid"] is None
    told = outs(spark, ["{}", '{"number":"1","items":[]}'], lambda x: R.feedback(R.validity(INVOICE)(x)))
    assert told[0].startswith("Missing required fields: number, items. Please extract") and "\n\nValidation errors:\n- root: 'number' is a required property\n- root: 'items'" in told[0] and told[1] == ""


@pytest.mark.parametrize(
    ("value", "rules", "keyword"),
    [
        ("x", {"enum": ["y"]}, "enum"), (True, {"const": 1}, "const"), ([1, 1], {"uniqueItems": True}, "uniqueItems"), ("a", {"pattern": "^b"}, "pattern"), ({"a": 1}, {"properties": {}, "additionalProperties": False}, "additionalProperties"),
        ("", {"minLength": 1}, "minLength"), (3, {"multipleOf": 2}, "multipleOf"), (1, {"anyOf": [{"type": "string"}, {"minimum": 2}]}, "anyOf"), (3, {"oneOf": [{"type": "integer"}, {"minimum": 2}]}, "oneOf"), (1, {"not": {"type": "integer"}}, "not"), (2.0, {"type": "integer"}, None), (True, {"type": "integer"}, "type"), ([1, "a"], {"items": [{"type": "integer"}, {"type": "integer"}]}, "type"),
    ],
)
def test_keywords(value, rules, keyword):
    assert [k for _, k, _ in R.violations(value, rules)] == ([keyword] if keyword else [])


def test_redaction(spark):
    record = {"number": 12345678, "vendor": {"name": "Acme", "phone": "call 555-123-4567"}, "items": [{"note": "mail a@b.com"}], "extra": ["secret", {"k": True}], "flag": None}
    data, markdown, metrics = outs(spark, [json.dumps(record)], lambda v: R.redacted_record(INVOICE, default="mask")(v, F.lit("SSN 123-45-6789")))[0]
    got = json.loads(data)
    assert got["number"] == "****5678" and got["extra"] == ["**cret", {"k": "True"[:0] + "****"}] and got["flag"] is None
    assert got["vendor"] == {"name": "****", "phone": "*************4567"} and got["items"] == [{"note": "********.com"}]
    assert markdown == "SSN *******6789" and metrics["fields_processed"] == 7
    open_ = {"type": "object", "properties": {"a": {"type": "string", "pii": "hash"}, "b": {"type": "string", "pii": "drop"}, "c": {"type": "string", "pii": "allow"}}}
    plain = outs(spark, ['{"a":"x","b":"y","c":"call 555-123-4567","d":1}', None, "[]"], lambda v: R.redacted_record(open_, default="allow", salt="s", detector=lambda t: ["call"])(v, F.lit(None).cast("string")))
    assert json.loads(plain[0]["data"]) == {"a": R.hashlib.sha256(b"sx").hexdigest(), "c": "**** ********4567", "d": 1} and plain[0]["markdown"] is None
    assert plain[0]["metrics"]["text_spans_redacted"] == 2 and plain[1]["data"] is None and plain[2]["data"] is None
    off = outs(spark, ['{"a":1}'], lambda v: R.redacted_record(open_, enabled=False)(v, F.lit("123-45-6789")))[0]
    assert off["data"] == '{"a":1}' and off["markdown"] == "123-45-6789" and sum(off["metrics"]) == 0
    nested = R.Redaction([], "allow")
    assert nested.along({"l": [{"a": "abcdef"}, 5]}, "l[].a", "mask") == {"l": [{"a": "**cdef"}, 5]} and nested.counts["masked"] == 1


def test_descriptions():
    assert R.described({"type": "object", "required": ["a"], "properties": {"a": {"type": "string", "description": "the a"}, "b": {"type": "array"}}}) == "Schema type: object\n\nRequired fields:\n- a (string) - the a\n\nOptional fields:\n- b (array)"
    assert R.listed(fields(INVOICE)[:1]) == "- number: string" and R.listed([]) == "None"


# ---- replies ------------------------------------------------------------------------------
def shaped(spark, shape, replies):
    return outs(spark, replies, lambda v: A.shaped(F.try_parse_json(v), A.SHAPES[shape]))


def test_shapes(spark):
    s = shaped(spark, "signature", ['{"signature_present":"no","signer_name":"  Ann ","stamp_type":"NOTARY","certification_marks":[""," a ",0,null,5],"missing_elements":[],"notes":0}', "{}"])
    assert s[0]["signature_present"] and s[0]["signer_name"] == "Ann" and s[0]["stamp_type"] == "notary" and s[0]["certification_marks"] == ["a", "5"] and s[0]["missing_elements"] is None and s[0]["notes"] is None
    assert not s[1]["signature_present"] and s[1]["stamp_type"] is None
    h = shaped(spark, "handwriting", ['{"transcribed_text":" hi ","confidence":"HIGH","annotation_type":"x","is_legible":1,"style":"Print"}', "[]"])
    assert tuple(h[0])[:6] == ("hi", "high", None, None, True, None) and h[0]["style"] == "print" and h[1]["transcribed_text"] == "" and h[1]["confidence"] == "low"
    i = shaped(spark, "image", ['{"objects":[{"object_type":"Vehicle","count":"3","attributes":{"a":1,"b":null,"":2}},7,{"count":"3.5","confidence":"medium"}],"total_items":2.9,"condition_assessment":"GOOD"}', '{"objects":"x","total_items":true}'])
    assert i[0]["objects"][0]["attributes"] == {"a": "1"} and i[0]["objects"][0]["count"] == 3 and i[0]["objects"][1]["count"] is None and len(i[0]["objects"]) == 2 and i[0]["total_items"] == 2 and i[0]["condition_assessment"] == "good"
    assert i[1]["objects"] == [] and i[1]["total_items"] == 1
    assert shaped(spark, "logo", ['{"logo_type":"x","organization_name":"A"}'])[0]["logo_type"] == "brand_mark"
    m = shaped(spark, "math", ['{"content_type":"MATRIX","latex":" x ","variables":{" a ":" b ","c":null,"d":" "},"notes":5}', '{"content_type":null}'])
    assert m[0]["content_type"] == "matrix" and m[0]["latex"] == "x" and m[0]["variables"] == {"a": "b"} and m[0]["notes"] is None and m[1]["content_type"] == "equation"
    d = shaped(spark, "diagram", ['{"nodes":[{"id":1,"node_type":"START"},{"label":"x"},{"id":"b","node_type":"?","description":5}],"connections":[{"from_node":1,"to_node":"b","connection_type":"x"},{"from_node":1}]}', "{}"])
    assert [(n["id"], n["node_type"], n["description"]) for n in d[0]["nodes"]] == [("1", "start", None), ("b", "other", None)] and [tuple(e) for e in d[0]["connections"]] == [("1", "b", None, "directed")] and d[1]["nodes"] == []


def test_form_fields(spark):
    f = outs(spark, ['[{"label":"A","value":"☑","field_type":"Checkbox"},{"value":"option b","field_type":"radio"},{"value":true,"field_type":"checkbox"},{"value":"5","field_type":"number"},3]', '"x"'], lambda v: A.form_fields(F.try_parse_json(v)))
    assert [(x["label"], x["value"], x["checked"], x["field_type"]) for x in f[0]] == [("A", None, True, "checkbox"), ("Unknown", "option b", None, "radio"), ("Unknown", "true", None, "checkbox"), ("Unknown", "5", None, "text")] and f[1] == []


def test_whole_replies(spark):
    r = outs(spark, ['{"extracted_content":{"a":1},"confidence":7}', 'say {"confidence":7} ok', "none", '[{"a":1}]', None], A.region_reply)
    assert [(x["confidence"], x["status"]) for x in r] == [(1.0, "ok"), (7.0, "ok"), (None, "parse_error"), (None, "parse_error"), (None, "parse_error")]
    s = outs(spark, ['{"x":1}', 'a {"x":1} b', '{"extracted_data":{"y":2},"overall_confidence":"0.25","field_confidence":{"y":0.5}}'], lambda v: F.struct(F.to_json(A.synthesis_reply(v)["data"]).alias("data"), A.synthesis_reply(v)["overall_confidence"].alias("c"), A.synthesis_reply(v)["field_confidence"].alias("f")))
    assert [tuple(x) for x in s] == [(None, 0.5, None), ('{"x":1}', 0.5, None), ('{"y":2}', 0.25, {"y": 0.5})]
    v = outs(spark, ['{"issues":[{"issue_type":"odd","severity":"HIGH","field_path":"p"},{"issue_type":"null_value","severity":"?"}],"passed_checks":["a"]}'], A.verification_reply)[0]
    assert [(i["issue_type"], i["severity"], i["field_path"], i["message"]) for i in v["issues"]] == [("format_error", "high", "p", "Unknown issue"), ("null_value", "medium", "unknown", "Unknown issue")] and v["passed_checks"] == ["a"] and v["consistency_score"] == 0.5
    p = outs(spark, ['{"steps":[{"action":"x","depends_on":1},{"step_number":"9","depends_on":[1,2]}],"region_priorities":[{"region_type":"table"}],"challenges":["Tables","multi_column","Multi_Column","?"],"quality_thresholds":{"max_iterations":5}}'], A.plan_reply)[0]
    assert [(x["step_number"], x["strategy"], x["depends_on"]) for x in p["steps"]] == [(1, "default", ["1"]), (9, "default", ["1", "2"])] and p["region_priorities"][0]["priority"] == 5
    assert p["challenges"] == ["complex_table", "multi_column", "multi_column"] and p["thresholds"]["max_iterations"] == 5 and p["thresholds"]["min_field_confidence"] == 0.6
    a = outs(spark, [["no", 'x {"a":1} y', '{"b":2}', " "], ["none"], []], lambda m: F.to_json(A.agent_reply(F.lit(None).cast("variant"), m)), "array<string>")
    assert a == ['{"b":2}', "{}", "{}"]
    assert tuple(outs(spark, [[(5, 2), None, (None, 3)]], A.token_usage, "array<struct<input_tokens:int,output_tokens:int>>")[0]) == (10, 5, 5)


def test_notes(spark):
    got = outs(spark, ["table", "text"], lambda t: A.region_notes(F.lit("seen"), t, "table", "table", F.lit(True)))
    assert got == ["seen Table spans multiple pages; extraction may be partial.", "seen Region type is text; expected table. Table spans multiple pages; extraction may be partial."]
