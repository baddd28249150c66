import random
from pathlib import Path

import pytest

from vellumflow.llm import tokens as T

pytestmark = pytest.mark.skipif(not Path(T.VOCABULARY).exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return T.BacktrackingEncoder(Path(T.VOCABULARY).read_bytes())


def test_ids_equal_the_merge_loop(encoder):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(T.VOCABULARY)
    reference.encode_special_tokens = True
    pick = random.Random(3)
    texts = ["".join(pick.choice("abcdeit .,\n\t0123éßжあ🙂<|endoftext|>ABC\x00") for _ in range(pick.randint(0, 300))) for _ in range(500)] + ["", "a" * 3000, "ab" * 2000, "🙂" * 500, "don't we'll I'M", " " * 999]
    assert [encoder.encode(t) for t in texts] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(encoder):
    from tokenizers import Tokenizer

    text = "La pièce n° 7 – “twice”… Эта 🙂"
    assert Tokenizer.from_file(T.VOCABULARY).decode(encoder.encode(text)) == text


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(T, "MEMO_SIZE", 10)
    encoder.encode(" ".join(f"w{i}x" for i in range(100)))
    assert len(encoder.memo) <= 10


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello"), (3, "hello")], "doc_id long, text string")
    rows = [(r["doc_id"], r["ids"], r["n"]) for r in df.select("doc_id", T.token_ids(spark, "text").alias("ids"), T.token_count(spark, "text").alias("n")).collect()]
    assert rows == [(1, [], 0), (2, [], 0), (3, [31373], 1), (3, [31373], 1)]
    assert df.limit(0).select(T.token_ids(spark, "text")).count() == 0
