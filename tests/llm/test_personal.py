import pytest

from vellumflow.llm import personal as P
from vellumflow.llm.pii_examples import labelled_table


@pytest.fixture(scope="module")
def field():
    return P.train()


def test_held_out_examples(field):
    rows = labelled_table(copies=2, seed=123)
    hits = wanted = found = 0
    for text, spans, context in rows:
        got = {(s, k) for s, _, k in P.find([text], field, context)[0]}
        gold = {(s, k) for s, _, k in spans}
        hits, wanted, found = hits + len(got & gold), wanted + len(gold), found + len(got)
    assert hits / wanted > 0.95 and hits / found > 0.95


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Dear Ms Anna Holm, call (212) 555-0147 after nine.", [(8, "name"), (24, "phone")]),
        ("SSN: 912-34-5678", [(5, "id_number")]),
        ("Order no. 912-34-5678 was split.", []),
        ("mailto:anna.holm AT example DOT org", [(7, "email")]),
        ("Deliver to 12 Mill Lane, Larkham by noon.", [(11, "address")]),
        ("The Brightfield Lane Trust and Old Mill Partners both replied.", []),
        ("IBAN: DE36 1314 0000 3334 6798 75", [(6, "id_number")]),
    ],
)
def test_sentences(field, text, expected):
    assert [(s, k) for s, _, k in P.find([text], field)[0]] == expected


def test_viterbi_equals_brute_force(field):
    import itertools

    import numpy as np

    e = np.random.default_rng(1).normal(size=(7, len(P.LABELS))).astype(np.float32)
    starts, lengths = np.array([0, 3, 4]), np.array([3, 1, 3])
    got = field.viterbi(e, starts, lengths)
    for s, n in zip(starts, lengths, strict=True):
        best = max(itertools.product(range(len(P.LABELS)), repeat=int(n)), key=lambda p: field.start[p[0]] + sum(e[s + i, x] for i, x in enumerate(p)) + sum(field.transitions[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[s : s + n]) == best


def test_masks_keep_the_rest(spark, field):
    w = spark.sparkContext.broadcast(field)
    text = "Tel. (212) 555-0147\nDear Anna Holm,\nend"
    df = spark.createDataFrame([(1, text, "c"), (2, None, "c"), (3, "", "c"), (4, "nothing here", "c"), (5, "Tel. 2125550147 " + "word " * 100_000, "c")], "extraction_id long, text string, spans string")
    spans = P.spans_of(df, "text_extractions", "extraction_id", "text", w)
    got = {r["record_id"]: r["masked_text"] for r in P.masked(spans).collect()}
    assert got[1] == "Tel. [PHONE]\nDear [NAME],\nend" and got[2] is None and got[3] == "" and got[4] == "nothing here"
    assert got[5].startswith("Tel. [PHONE] word") and len(got[5]) == 500_000 + len("Tel. [PHONE] ")
    assert P.occurrences(spans).count() == 3
    assert P.occurrences(P.spans_of(df.limit(0), "text_extractions", "extraction_id", "text", w)).count() == 0
