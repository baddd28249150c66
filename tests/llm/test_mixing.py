import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vellumflow.llm import mixing as M

TARGETS = pd.DataFrame({"source": ["a", "b", "gone"], "target_share": [0.5, 0.3, 0.2], "max_repeats": [1, 3, 2]})


def documents(spark):
    return spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "rock stone hill").otherwise("sea wave shore").alias("text"),
        F.when(F.col("id") < 2000, F.when(F.col("id") % 3 == 0, " A ").otherwise("b")).when(F.col("id") < 2500, "other_site").alias("source"),
        F.when(F.col("id") % 97 == 0, 0).otherwise(F.col("id") % 50 + 1).cast("long").alias("tokens"), F.lit("x").alias("label"),
    )


def test_spelling(spark):
    df = spark.createDataFrame([("Upload-Portal ",), ("upload portal",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(M.plain_source(F.col("s"))).collect()] == ["upload_portal", "upload_portal", None, None]


def test_shares_and_caps(spark):
    used = M.mixture(M.memberships(documents(spark), TARGETS["source"].tolist()), TARGETS)
    targets = spark.createDataFrame(TARGETS)
    got = {r["source"]: r for r in M.shares(used, targets).collect()}
    assert abs(got["a"]["actual_share"] - 0.625) < 0.005 and abs(got["b"]["actual_share"] - 0.375) < 0.005 and got["gone"]["actual_share"] == 0
    assert got["a"]["most_repeats"] <= 1 and got["b"]["most_repeats"] <= 3
    assert used.count() == used.select("doc_id").distinct().count()
    assert used.filter("doc_id >= 2000 AND doc_id < 2500").count() == 0


def test_gradient_meets_targets_with_soft_members():
    rng = np.random.default_rng(0)
    p, tokens = rng.dirichlet([0.3, 0.3, 0.3], 200), rng.integers(1, 100, 200)
    shares, caps = np.array([0.5, 0.5]), np.array([2.0, 2.0])
    sums = p[:, :2] * tokens[:, None]
    rate, total = M.fit_rates(sums, caps[sums.argmax(1)], shares)
    assert rate.min() >= 0 and rate.max() <= 2
    assert np.abs(rate @ sums - total / 2).max() < 1e-4 * total
    assert M.fit_rates(sums[:0], caps[:0], shares)[1] == 0 and M.fit_rates(sums * 0, caps[sums.argmax(1)], shares)[1] == 0


def test_gradient_with_unequal_cells_and_caps():
    sums = np.array([[1e9, 0, 0], [0, 1e5, 0], [0, 0, 3e6], [40.0, 30, 30], [0, 5e4, 5e4]])
    shares, limit = np.array([0.6, 0.1, 0.3]), np.array([1.0, 4, 2, 1, 3])
    rate, total = M.fit_rates(sums, limit, shares)
    assert (rate >= 0).all() and (rate <= limit).all() and np.abs(rate @ sums / (total * shares) - 1).max() < 1e-4


def test_cells_are_bounded_and_sums_exact(spark):
    p = np.random.default_rng(3).dirichlet([1, 1, 1], 500).round(4)
    df = spark.createDataFrame([(x.tolist(), i + 1, int(x[:2].argmax())) for i, x in enumerate(p)], "posterior array<double>, tokens int, at int").withColumn("cell", M.cell(F.col("posterior")))
    cells, at, sums = M.cell_sums(df, 2)
    assert len(cells) <= 2 * 165 and np.allclose(sums.sum(0), (p[:, :2] * np.arange(1, 501)[:, None]).sum(0))


def test_empty(spark):
    docs = documents(spark).limit(0)
    assert M.mixture(M.memberships(docs, TARGETS["source"].tolist()), TARGETS).count() == 0


def test_junk_does_not_reach_a_target_without_documents(spark):
    noise = spark.range(3000, 3003).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.translate(F.sha2(F.concat_ws("-", i, "id"), 256), "0123456789", "ghijklmnop")), " ").alias("text"), F.lit(None).cast("string").alias("source"), F.lit(40).cast("long").alias("tokens"), F.lit("x").alias("label"))
    empty = spark.createDataFrame([(4000, "", "gone", 0, "x")], "doc_id long, text string, source string, tokens long, label string")
    members = M.memberships(documents(spark).unionByName(noise).unionByName(empty), TARGETS["source"].tolist())
    assert members.filter("doc_id >= 3000 AND doc_id < 4000 AND posterior[2] > 0").count() == 0
    used = M.mixture(members, TARGETS)
    got = {r["source"]: r for r in M.shares(used, spark.createDataFrame(TARGETS)).collect()}
    assert got["gone"]["tokens"] == 0 and got["a"]["tokens"] > 15000
    assert abs(got["a"]["actual_share"] - 0.625) < 0.005 and abs(got["b"]["actual_share"] - 0.375) < 0.005


def test_documents_of_several_sources_are_used_by_their_posteriors(spark):
    own = [(i, 20 + i % 13, [1.0, 0.0, 0.0, 0.0] if i % 2 else [0.0, 1.0, 0.0, 0.0]) for i in range(400)]
    soft = [(i, 20 + i % 17, [0.3, 0.35, 0.0, 0.35] if i % 2 else [0.45, 0.1, 0.0, 0.45]) for i in range(400, 1000)]
    members = spark.createDataFrame(own + soft, "doc_id long, tokens long, posterior array<double>")
    used = {r["doc_id"]: r for r in M.mixture(members, TARGETS).collect()}
    assert sum(i >= 400 for i in used) > 100
    assert all(r["repeats"] <= {"a": 1, "b": 3}[r["source"]] for r in used.values())
    a, b = (sum(r["posterior"][s] * r["tokens"] * r["repeats"] for r in used.values()) for s in ("a", "b"))
    assert abs(a - (a + b) * 0.625) < 40
    assert a > sum(t for _, t, p in own if p[0]) * 1.3  # soft members add to what a source can give
    got = {r["source"]: r for r in M.shares(M.mixture(members, TARGETS), spark.createDataFrame(TARGETS)).collect()}
    assert abs(got["a"]["tokens"] - a) <= 1 and abs(got["b"]["tokens"] - b) <= 1 and got["gone"]["tokens"] == 0
