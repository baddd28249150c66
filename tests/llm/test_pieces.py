import random
from collections import Counter

import pytest

from vellumflow.llm import pieces as P

SMALL = P.PieceOptions(threshold=300, limit=120, overlap=20, slack=30, range_chars=210)


def check(rows, originals, o):
    for item, text in originals.items():
        own = sorted((r for r in rows if r["item"] == item), key=lambda r: r["piece_no"])
        if text is None or len(text) <= o.threshold:
            assert not own
            continue
        assert [r["piece_no"] for r in own] == list(range(len(own)))
        assert "".join(r["text"][r["fresh_start"] - r["start"] :] for r in own) == text
        for r in own:
            assert r["text"] == text[r["start"] : r["end"]] and len(r["text"]) <= o.limit and r["fresh_start"] - r["start"] <= o.overlap


def test_pieces_join_to_the_text(spark):
    pick = random.Random(5)
    texts = {i: "".join(pick.choice(["word ", "Sentence. ", "\n", "\n\n", "x", "é🙂", "。"]) for _ in range(pick.randint(0, 400))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "y" * 5000, 103: "a" * 300, 104: "a" * 301}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "extraction_id long, text string, offset long")
    ranges = P.ranges_of_texts(df, "extraction_id", "text", SMALL)
    rows = P.pieces(ranges, SMALL).collect()
    check(rows, texts, SMALL)
    assert {r["item"]: r["n_pieces"] for r in P.piece_counts(ranges, SMALL).collect()} == Counter(r["item"] for r in rows)
    assert "Exchange" not in P.pieces(ranges, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_files_by_byte_ranges(spark, tmp_path):
    pick = random.Random(6)
    originals, listed = {}, []
    for i in range(3):
        text = "".join(pick.choice(["word ", "é🙂ß. ", "\n\n", "あ。"]) for _ in range(900))
        path = tmp_path / f"{i}.txt"
        path.write_text(text, newline="", encoding="utf-8")
        originals[str(path)] = text
        listed.append((str(path), path.stat().st_size))
    check(P.pieces(P.ranges_of_files(spark, listed, SMALL, range_bytes=700), SMALL).collect(), originals, SMALL)


@pytest.mark.parametrize(("text", "kind"), [("aa bb. cc\ndd\n\nee ff", 0), ("aa bb. cc\ndd ee", 1), ("aa bb. cc dd", 2), ("aa bb cc", 3), ("aabbcc", 4)])
def test_best_boundary_wins(text, kind):
    assert P.best_cut(text, 0, len(text) - 1)[1] == kind


def test_chunk_columns(spark):
    e = spark.createDataFrame([(1, "a" * 301), (2, "b"), (3, None), (4, "")], "extraction_id long, text string")
    r = spark.createDataFrame([(10, 1, 9, False), (10, 1, 9, False), (11, 2, None, True), (12, 3, 1, True), (13, 4, 1, None), (14, 99, 5, True)], "result_id long, extraction_id long, chunks_processed long, is_chunked boolean")
    counted = P.piece_counts(P.ranges_of_texts(e, "extraction_id", "text", SMALL), SMALL)
    got = {x["result_id"]: (x["chunks_processed"], x["is_chunked"]) for x in P.with_chunk_columns(r, e, counted, SMALL).collect()}
    assert got == {10: (5, True), 11: (1, False), 12: (0, False), 13: (0, False), 14: (None, None)}


def test_options_are_checked():
    with pytest.raises(ValueError):
        P.PieceOptions(limit=300, overlap=200, slack=100)


def test_window_without_a_boundary_is_widened(spark):
    pick = random.Random(7)
    texts = {0: "x" * 75 + " " + "x" * 300, 1: "x" * 35 + " " + "x" * 94 + " " + "x" * 300} | {i: "".join(pick.choice("xy") * pick.randint(1, 90) + pick.choice([" ", ". ", "\n\n", ""]) for _ in range(30)) for i in range(2, 80)}
    df = spark.createDataFrame(list(texts.items()), "extraction_id long, text string")
    one = P.PieceOptions(**{**SMALL.__dict__, "range_chars": 100_000})
    rows, whole = (sorted(P.pieces(P.ranges_of_texts(df, "extraction_id", "text", o), o).collect()) for o in (SMALL, one))
    check(rows, texts, SMALL)
    assert rows == whole  # however the text is cut into ranges
    assert [r["end"] for r in rows if r["item"] in (0, 1)][0] == 76 and [r["end"] for r in rows if r["item"] == 1][0] == 36
