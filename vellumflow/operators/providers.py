"""Model-backed steps behind one interface, with a rule-based default that needs no model.

A provider maps (text, field names) to values. Any step of extraction, region reading, tables,
forms or signatures is a name in the registry; a provider is built once a Python worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.operators import quality
from vellumflow.session import checkpointed

Provider = Callable[[str, Sequence[str]], dict[str, str | None]]
_registry: dict[str, Callable[[], Provider]] = {}


def register(name: str, factory: Callable[[], Provider]) -> None:
    _registry[name] = factory


def label_rules() -> Provider:
    """`Label: value` lines of a text by field name, whatever the label's case and separators."""
    line = re.compile(r"^\s*([^:\n]{1,60})\s*[:=]\s*(\S.*?)\s*$", re.MULTILINE)

    def extract(text: str, names: Sequence[str]) -> dict[str, str | None]:
        found: dict[str, str] = {}
        for label, value in line.findall(text or ""):
            found.setdefault(re.sub(r"[\W_]+", "", label).lower(), value)
        return {n: found.get(re.sub(r"[\W_]+", "", n).lower()) for n in names}

    return extract


def loose_rules() -> Provider:
    """The same where a label may stand within a line and before a dash or a gap; the value ends with the line, or before two blanks."""
    signs = r"\s*(?:[:=–-]|\s{2,}|\t)\s*(\S[^\n]*?)(?=\s{2,}|\n|$)"

    def extract(text: str, names: Sequence[str]) -> dict[str, str | None]:
        found = {n: re.search(rf"(?i)(?<!\w){re.escape(n)}" + signs, text or "") for n in names}
        return {n: m[1] if m else None for n, m in found.items()}

    return extract


register("rules", label_rules)
register("loose_rules", loose_rules)


def extract(documents: DataFrame, names: Sequence[str], provider: str = "rules") -> DataFrame:
    """doc_id, data (JSON text), error of doc_id, text: a failing row is a row with an error, not a failed task."""
    factory = _registry[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = factory()
        for part in batches:
            out = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                try:
                    out.append((doc_id, json.dumps(own(text, names), ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001 - a provider may raise anything
                    out.append((doc_id, None, f"E4001: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "data", "error"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, data string, error string")


def field_rows(extracted: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """The long field table of JSON results: a value has the confidence 0.85, a missing one none."""
    parsed = extracted.select("doc_id", F.try_parse_json("data").alias("v"))
    rows = F.array(*[F.struct(F.lit(n).alias("field_path"), F.try_variant_get("v", f"$.{n}", "string").alias("value"), F.lit(n in required).alias("required")) for n in (*required, *optional)])
    return parsed.select("doc_id", F.inline(rows)).withColumn("confidence", F.when(F.col("value").isNotNull(), 0.85))


def refine(documents: DataFrame, passes: Sequence[str], required: Sequence[str], optional: Sequence[str], t: quality.Thresholds = quality.Thresholds(), initial: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Extraction in passes: each runs on the documents that no pass before brought to 'passed'; all passes are kept.

    initial: doc_id, data of a result that counts as the first pass. doc_id, iteration, data, error, score,
    status, issues (the types that were found); quality.best_pass picks the best of each document. A
    pass is checkpointed, so that its provider is called once a document."""
    left, done = documents.select("doc_id", "text"), []
    steps = ([None] if initial is not None else []) + list(passes)
    for i, provider in enumerate(steps[: t.max_iterations], 1):
        found = extract(left, [*required, *optional], provider) if provider is not None else initial.select("doc_id", "data", F.lit(None).cast("string").alias("error"))
        result = checkpointed(found)
        fields = field_rows(result, required, optional)
        kinds = quality.issues(fields, t).groupBy("doc_id").agg(F.collect_set("issue_type").alias("issues"))
        judged = quality.report(fields, t).select("doc_id", F.lit(i).alias("iteration"), "score", "status").join(result, "doc_id").join(kinds, "doc_id", "left")
        done.append(judged)
        left = left.join(judged.filter("status = 'passed'").select("doc_id"), "doc_id", "left_anti")
    return reduce(DataFrame.unionByName, done)


def extract_chunks(chunks: DataFrame, names: Sequence[str], provider: str = "rules") -> DataFrame:
    """doc_id, chunk_idx, data of doc_id, chunk_idx, text: chunks that fail are left out; a document all of whose chunks fail has one row with an error."""
    named = chunks.withColumn("_key", F.struct("doc_id", "chunk_idx"))
    found = checkpointed(extract(named.select(F.to_json("_key").alias("doc_id"), "text"), names, provider))
    key = F.from_json("doc_id", "doc_id long, chunk_idx long")
    rows = found.select(key.alias("k"), "data", "error").select("k.*", "data", "error")
    failed = rows.groupBy("doc_id").agg(F.count_if(F.col("error").isNull()).alias("_ok"), F.first("error").alias("error")).filter("_ok = 0").select("doc_id", F.lit(None).cast("long").alias("chunk_idx"), F.lit(None).cast("string").alias("data"), F.concat(F.lit("E4002: all chunks failed: "), F.col("error")).alias("error"))
    return rows.filter("error IS NULL").unionByName(failed)
