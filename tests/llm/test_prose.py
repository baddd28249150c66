import random

import numpy as np
import pytest

from vellumflow.llm import prose as P

COMMON = {"en": set("the of to and a in is was that for it with as on by at be this are from or an not have has which its but were he his they you we our all one if no so will can".split())}
PROSE = "The auditor was asked to return the report, and it was not in the file. We have sent it to the office at noon. "




def prose(n: int, seed: int) -> str:
    pick = random.Random(seed)
    who, what, when = ("auditor", "buyer", "insurer", "clerk", "carrier"), ("report", "letter", "form", "survey", "invoice"), ("noon", "the gate", "the office", "once", "the end of the week")
    return " ".join(f"The {pick.choice(who)} was asked to return the {pick.choice(what)} to the {pick.choice(who)}, and it was not in the {pick.choice(what)} of {pick.randint(1, 99999)} at {pick.choice(when)}." for _ in range(n))


@pytest.mark.parametrize(
    ("text", "low", "statistic"),
    [
        (PROSE, False, None),
        ("\n".join(f"- item {c}" for c in "abcdefgh"), True, "entry_share"),
        ("a;b;c\n" + "\n".join(f"{i};{i * 7};x y" for i in range(9)), True, "row_share"),
        ("\n".join(f"name {i}      {i * 37 % 100:5d}      x" for i in range(9)), True, "row_share"),
        ("....................\n" * 6, True, "noise_share"),
        ("Page left blank " * 40, True, "repeat_share"),
        ("QzBUbcBQ7JpfURfYadakruLsDPBYH5WoE1F0KINzFwKXCu9qq6IgfcznZ5LxHaKp3ktb2fJrLVj7\n" * 3, True, "noise_share"),
        ("\n".join(f"Label {i}: value {i}" for i in range(8)), True, "entry_share"),
    ],
)
def test_statistics_tell_kinds_apart(text, low, statistic):
    _, stats = P.Statistics(COMMON).of(text)
    assert (stats[P.STATISTICS.index("sentence_share")] < 0.5 or stats[P.STATISTICS.index("repeat_share")] > 0.5) == low
    if statistic:
        assert stats[P.STATISTICS.index(statistic)] > 0.5


def test_contributions_sum_to_the_distance():
    x = np.random.default_rng(0).normal(size=(20, len(P.STATISTICS)))
    model = P.estimate({"en": (20.0, x.sum(0), x.T @ x)})
    total, parts = P.distances(x, ["en"] * 20, model)
    assert np.allclose(parts.sum(1), total)


def test_small_groups_are_drawn_to_the_model_of_all():
    rng = np.random.default_rng(1)
    big, small = rng.normal(size=(5000, len(P.STATISTICS))), rng.normal(5, 1, size=(2, len(P.STATISTICS)))
    model = P.estimate({g: (len(x), x.sum(0), x.T @ x) for g, x in (("en", big), ("xx", small))})
    assert np.abs(model["xx"][0] - model["*"][0]).max() < 0.5 < np.abs(small.mean(0) - model["*"][0]).max()
    assert P.estimate({})["*"][0].shape == (len(P.STATISTICS),)


def test_cut_outvotes_wrong_labels():
    squared, strange = np.array([1.0, 2, 3, 50, 60, 200, 300, 400, 1.5]), np.array([0, 0, 0, 0, 0, 1, 1, 1, 1], bool)
    assert 60 < P.dividing_cut(squared, strange) < 200
    assert P.dividing_cut(squared, np.zeros(9, bool)) == P.CUT and P.dividing_cut(squared[:0], strange[:0]) == P.CUT


def _tables(spark):
    rows = [(i, prose(3 + i % 4, i), "x") for i in range(60)]
    odd = [(100, "\n".join(f"* item {i}" for i in range(20))), (101, "a\tb\n" + "\n".join(f"{i}\t{i}" for i in range(20))), (102, "=+" * 400), (103, None), (104, ""), (105, " \n "), (106, prose(3000, 1)), (107, "x"), (108, "Page left blank " * 40)]
    docs = spark.createDataFrame(rows + [(i, t, "x") for i, t in odd], "doc_id long, text string, distance string")
    common = spark.createDataFrame([("en", w) for w in COMMON["en"]] + [(None, None)], "lang string, word string")
    labels = spark.createDataFrame([(i, "Prose" if i % 9 else "junk") for i in range(40)] + [(1, "prose"), (1, "prose"), (100, "list"), (101, "table"), (102, "junk"), (None, "list"), (3, None), (5, "?")], "doc_id long, label string")
    return docs, common, labels


def test_table(spark):
    docs, common, labels = _tables(spark)
    for given in (labels, labels.limit(0)):
        got = {r["doc_id"]: r["text_class"] for r in P.judged(docs, common, given).collect()}
        assert (got[100], got[101], got[102], got[108]) == ("list", "table", "junk", "junk")
        assert all(got[i] == "prose" for i in (*range(60), 106))
        assert not {103, 104, 105} & set(got)
    assert P.judged(docs.limit(0), common, labels).count() == 0


def test_the_distance_decides(spark):
    """With the distance taken out (a cut that nothing passes, or that all pass) the classes change: no rule stands behind it."""
    docs, common, labels = _tables(spark)
    stats = P.document_statistics(docs, common).cache()
    fitted = P.fit(stats, labels)
    count = lambda cut: P.classify(stats, P.Fitted(fitted.model, cut, fitted.profiles)).filter("text_class <> 'prose'").count()
    assert count(np.inf) == 0 and count(-1.0) == stats.count() and 4 <= count(fitted.cut) <= 6
    flat = {"*": (np.zeros(len(P.STATISTICS)), np.eye(len(P.STATISTICS)))}
    assert P.classify(stats, P.Fitted(flat, fitted.cut, fitted.profiles)).filter("text_class <> 'prose'").count() != count(fitted.cut)


def test_labels_come_from_a_bounded_sample(spark):
    docs, common, labels = _tables(spark)
    assert len(P.labelled_sample(P.document_statistics(docs, common), labels, 7)) == 7


def test_language_is_read_off_the_whole_text():
    latin, japanese = "The report was sent to the office in the morning. " * 90, "先月、倉庫から報告書が届きました。" * 600
    statistics = P.Statistics({"en": {"the", "was", "to", "in"}})
    assert len(latin) > 4000 and statistics.of(latin + japanese)[0] == statistics.of(japanese + latin)[0] == "cjk"
    assert statistics.of(japanese[:900] + latin * 4)[0] != "cjk"
