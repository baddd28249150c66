"""Mixing sources to target shares of all tokens by soft membership (problem 8).

Each document has posteriors over the sources: one for its own source if that is written in any
spelling of a known one, else what a naive Bayes classifier says, whose counts come from all
documents with a source. Documents whose posteriors round to the same multiples of 1 / `GRID` are a
cell. Spark sums each cell's tokens and its expected tokens by target, and since these sums are of
the posteriors themselves, the expected totals at any rates of the cells are exact. Rates (how often
a document is used) minimise the squared distance of each target's expected tokens from its share
by projected gradient over the cells, which are bounded in number; the projection keeps a rate
between 0 and the cap of the cell's likeliest target. Rates then become whole numbers. A document
that belongs to several sources is used once more if its hash is below the fractional part. The
documents of one source alone take what these leave of the source's target: they are put in hash
order, and those within the fractional part's share of the tokens are used once more, so a
source's expected tokens miss its target by less than one document.

The mixture is as large as the caps allow while all reachable targets hold. A target without
documents of its own that have tokens is no class of the classifier and can't be reached; its
share goes to the others in proportion and is reported as 0. A document without a source counts for
each target by its posterior, however small. Sources without a target, and documents without tokens
(null and empty texts), aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.session import checkpointed

#: Posteriors of one cell round to the same multiples of 1 / GRID: at most C(GRID + k + 1, k + 1) cells for k targets and the rest, 43,758 for nine.
GRID = 8
FEATURES = 2048
#: Words that say half of what a document of endless length would say about its source.
EVIDENCE = 20
BUCKETS = 1024
OTHER = "(other)"


def plain_source(source: Column) -> Column:
    """One spelling of a source's name; null for blank ones."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-.]+", "_"), F.lit(""))


def _word_features(text: Column) -> Column:
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))


def _log_odds(labelled: DataFrame, sources: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(places in sources of the classes, log prior by class, log likelihood by class and feature): counts of all labelled documents, a bounded table.

    Only a source whose own documents have text and so tokens is a class: the likelihood of an untrained one is flat and wins on noise."""
    found = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n"), F.max("filled").alias("filled")).filter("filled").collect()}
    classes = [i for i, s in enumerate(sources) if s in found]
    at = {sources[i]: c for c, i in enumerate(classes)}
    prior = np.array([1.0 + found[s] for s in at])
    like = np.full((len(classes), FEATURES), 0.5)
    for r in labelled.filter(F.col("label").isin(list(at))).select("label", F.explode("features").alias("f")).groupBy("label", "f").agg(F.count("*").alias("n")).collect():
        like[at[r["label"]], r["f"]] += r["n"]
    return classes, np.log(prior / prior.sum()), np.log(like / like.sum(1, keepdims=True))


def memberships(documents: DataFrame, targets: list[str]) -> DataFrame:
    """doc_id, tokens, posterior (array over targets and the rest) of documents with doc_id, text, source, tokens."""
    sources = [*targets, OTHER]
    known = F.col("_source")
    label = F.when(known.isin(targets), known).when(known.isNotNull(), F.lit(OTHER))
    named = documents.withColumn("_source", plain_source(F.col("source"))).withColumn("label", label).withColumn("features", _word_features(F.col("text"))).withColumn("filled", F.coalesce(F.length("text") > 0, F.lit(False))).select("doc_id", "tokens", "label", "features", "filled")
    classes, prior, like = _log_odds(named.filter("label IS NOT NULL"), sources)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for features in part["features"]:
                posterior = np.zeros(len(sources))
                if classes:
                    scores = prior + like[:, features].sum(1) * (EVIDENCE / (EVIDENCE + len(features)))
                    p = np.exp(scores - scores.max())
                    posterior[classes] = (p / p.sum()).round(4)
                rows.append(posterior.tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"], "tokens": part["tokens"], "posterior": rows})

    one_hot = F.array(*[F.when(F.col("label") == s, 1.0).otherwise(0.0) for s in sources])
    sure = named.filter("label IS NOT NULL").select("doc_id", "tokens", one_hot.alias("posterior"))
    guessed = named.filter("label IS NULL").select("doc_id", "tokens", "features").mapInPandas(predict, "doc_id long, tokens long, posterior array<double>")
    return sure.unionByName(guessed)


def cell(posterior: Column) -> Column:
    """The cell of a posterior as text: multiples of 1 / GRID, rounded down."""
    return F.concat_ws(",", F.transform(posterior, lambda p: F.floor(p * GRID + 1e-9).cast("string")))


def cell_sums(usable: DataFrame, k: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(cells, their likeliest target, expected tokens by cell and target); the one aggregate that the fit needs."""
    sums = usable.groupBy("cell", "at").agg(*[F.sum(F.col("posterior")[j] * F.col("tokens")).alias(f"s{j}") for j in range(k)])
    rows = sums.orderBy("cell", "at").collect()  # bounded, see GRID: a cell has at most k likeliest targets
    return [r["cell"] for r in rows], np.array([r["at"] for r in rows], int), np.array([[r[f"s{j}"] for j in range(k)] for r in rows], float).reshape(len(rows), k)


def fit_rates(sums: np.ndarray, limit: np.ndarray, shares: np.ndarray, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """(rate of each cell, total tokens aimed at) for expected tokens by cell and target, and the cap of each cell.

    Accelerated projected gradient, each target's distance in units of its goal, until no target is
    further from it than `tolerance` or the distance no longer falls."""
    reachable = (sums.sum(0) > 0) & (shares > 0)
    if not reachable.any():
        return np.zeros(len(sums)), 0.0
    wanted = shares[reachable] / shares[reachable].sum()
    total = float((limit @ sums[:, reachable] / wanted).min())
    gains = sums[:, reachable] / (total * wanted)  # a cell's share of each goal at rate 1
    scale = 1 / np.maximum(gains.sum(1), 1e-300)  # a diagonal metric, or few large cells set the step for all
    step = 1 / np.linalg.eigvalsh((gains * scale[:, None]).T @ gains).max()
    rate, ahead, pace, loss = np.zeros(len(sums)), np.zeros(len(sums)), 1.0, np.inf
    while True:
        new = np.clip(ahead - step * scale * (gains @ (ahead @ gains - 1)), 0, limit)
        off = new @ gains - 1
        now = float(off @ off)
        if np.abs(off).max() < tolerance or (now >= loss * (1 - 1e-12) and pace == 1.0):
            return new, total
        if now >= loss:  # overshot: begin again without the momentum
            ahead, pace = rate, 1.0
            continue
        following = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, rate, pace, loss = new + (pace - 1) / following * (new - rate), new, following, now


def mixture(members: DataFrame, targets: pd.DataFrame) -> DataFrame:
    """doc_id, source (the likeliest target), tokens, repeats, posterior (by target) of the documents used at least once.

    members: doc_id, tokens, posterior; targets: source, target_share, max_repeats (a fixed table)."""
    names, shares, caps = targets["source"].tolist(), targets["target_share"].to_numpy(float), targets["max_repeats"].to_numpy(float)
    k = len(names)
    ours = F.slice("posterior", 1, k)
    placed = members.filter((F.col("tokens") > 0) & (F.array_max(ours) > 0))
    usable = checkpointed(placed.withColumn("at", (F.array_position(ours, F.array_max(ours)) - 1).cast("int")).withColumn("cell", cell(F.col("posterior"))))
    cells, at, sums = cell_sums(usable, k)
    rate, total = fit_rates(sums, caps[at] if len(at) else np.zeros(0), shares)
    by_target = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("at"))
    alone = F.array_max("posterior") == 1

    spot = F.xxhash64("doc_id", F.lit(20))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 20)) / (1 << 20)
    rated = usable.sparkSession.createDataFrame([(c, int(a), float(r)) for c, a, r in zip(cells, at, rate, strict=True)], "cell string, at int, rate double")
    several = usable.filter(~alone).join(F.broadcast(rated), ["cell", "at"])
    several = several.withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("repeats", F.least(by_target(caps), F.col("base") + F.when(draw < F.col("rate") - F.col("base") - 1e-9, 1).otherwise(0)).cast("long"))
    several = checkpointed(several.select("doc_id", "tokens", "posterior", "at", "repeats").filter("repeats > 0"))

    # what documents of several sources give to each target; those of one source bring it to its share
    given, own = np.zeros(k), np.zeros(k)
    sums = several.agg(*[F.sum(F.col("posterior")[j] * F.col("tokens") * F.col("repeats")).alias(f"s{j}") for j in range(k)]).first()
    given[:] = [sums[j] or 0 for j in range(k)]
    for r in usable.filter(alone).groupBy("at").agg(F.sum("tokens").alias("n")).collect():
        own[r["at"]] = r["n"]
    reachable = (own > 0) & (shares > 0)
    wanted = np.where((own + given > 0) & (shares > 0), shares, 0)
    wanted = wanted / max(wanted.sum(), 1e-300)
    if reachable.any():
        total = min(total, float(((given + own * caps)[reachable] / wanted[reachable]).min()))
    last = np.where(reachable, np.clip((total * wanted - given) / np.maximum(own, 1), 0, caps), 0)

    # prefix sums of tokens in hash order, per source, by buckets so that no source is one task
    placed = usable.filter(alone).withColumn("rate", by_target(last)).withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("base"))).withColumn("bucket", F.pmod(spot, F.lit(BUCKETS))).withColumn("spot", spot)
    sums = placed.groupBy("at", "bucket").agg(F.sum("tokens").alias("_b"))
    before = sums.withColumn("before", F.sum("_b").over(W.partitionBy("at").orderBy("bucket")) - F.col("_b")).withColumn("all", F.sum("_b").over(W.partitionBy("at")))
    inner = placed.withColumn("_in", F.sum("tokens").over(W.partitionBy("at", "bucket").orderBy("spot", "doc_id")))
    joined = inner.join(before.drop("_b"), ["at", "bucket"])
    middle = F.col("before") + F.col("_in") - F.col("tokens") / 2
    repeats = F.least(by_target(caps), F.col("base") + F.when(middle <= F.col("part") * F.col("all"), 1).otherwise(0)).cast("long")
    used = joined.select("doc_id", "tokens", "posterior", "at", repeats.alias("repeats")).filter("repeats > 0").unionByName(several)
    return used.select("doc_id", F.get(F.array(*[F.lit(n) for n in names]), F.col("at")).alias("source"), "tokens", "repeats", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), ours).alias("posterior"))


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, n_documents, most_repeats, max_repeats, likeliest_share, of every target.

    actual_share and tokens are expected ones: a document's tokens count for each target by its posterior. What falls
    to sources without a target counts for none. The other figures count a document for its likeliest target alone."""
    names = [r["source"] for r in targets.select("source").distinct().collect()]  # a fixed table
    used = used.withColumn("_t", F.col("tokens") * F.col("repeats"))
    by_source = used.groupBy("source").agg(F.sum("_t").alias("_likeliest"), F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"))
    expected = used.agg(*[F.sum(F.col("posterior")[n] * F.col("_t")).alias(f"s{j}") for j, n in enumerate(names)]).select(F.inline(F.array(*[F.struct(F.lit(n).alias("source"), F.round(f"s{j}").cast("long").alias("tokens")) for j, n in enumerate(names)])))
    joined = targets.join(expected, "source", "left").join(by_source, "source", "left").na.fill(0, ["tokens", "_likeliest", "n_documents", "most_repeats"])
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(W.partitionBy())), F.lit(0.0))  # noqa: E731  # as many rows as targets
    return joined.select("source", "target_share", share("tokens").alias("actual_share"), "tokens", "n_documents", "most_repeats", "max_repeats", share("_likeliest").alias("likeliest_share"))
