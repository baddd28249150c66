"""Extraction from text of any length: one call for a short text, chunks and a merge for a long one.

Chunks follow a ladder of separators: a text is cut before the coarsest separator that it holds, and
neighbouring parts are packed together again up to the limit, each chunk beginning with up to
`overlap` characters of the one before; a part that is still too long is cut by itself at the next
separator. A chunk is part of
one document's text, so this is per-row work; the calls are spread over all chunks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions.text import needs_chunking
from vellumflow.operators import providers
from vellumflow.session import checkpointed

# The limits of a chunk and the separators from coarse to fine.
CHUNK_CHARS, CHUNK_OVERLAP = 4000, 200
SEPARATORS = ("\n\n", "\n", ". ", " ")


def packed(parts: Sequence[str], limit: int, overlap: int) -> Iterator[str]:
    """Parts joined up to the limit; the whole parts at a chunk's end that fit into the overlap begin the next one."""
    held: list[str] = []
    size = 0
    for part in parts:
        if held and size + len(part) > limit:
            yield "".join(held)
            while held and (size > overlap or size + len(part) > limit):
                size -= len(held.pop(0))
        held.append(part)
        size += len(part)
    if held:
        yield "".join(held)


def _cut(text: str, limit: int, overlap: int, separators: Sequence[str]) -> Iterator[str]:
    if len(text) <= limit:
        yield text
        return
    here = next((i for i, s in enumerate(separators) if s in text), None)
    if here is None:
        yield from packed(text, limit, overlap)
        return
    mark = separators[here]
    first, *rest = text.split(mark)
    for short, group in groupby((first, *(mark + x for x in rest)), lambda p: len(p) <= limit):
        if short:
            yield from packed([*group], limit, overlap)
        else:
            for part in group:
                yield from _cut(part, limit, overlap, separators[here + 1 :])


def chunks(text: str, limit: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    return [c for x in _cut(text, limit, overlap, separators) if (c := x.strip())]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else chunks(t))


def text_chunks(documents: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, text: the chunks of long texts, a short text as its only chunk; a null or blank one has none."""
    cut = F.when(needs_chunking(F.col("text")), _chunks("text")).when(F.length(F.trim("text")) > 0, F.array("text"))
    return documents.select("doc_id", F.posexplode(cut).alias("chunk_idx", "text")).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "text")


def merged(values: Sequence[Any], top: bool = True) -> Any:
    """One value of what the chunks gave for a key: the first that isn't null; at the top lists are joined and equal items dropped, objects merged key by key."""
    known = [v for v in values if v is not None]
    if len(known) < 2:
        return known[0] if known else None
    if isinstance(known[0], list) and top:
        items = {json.dumps(x, sort_keys=True): x for v in reversed(known) if isinstance(v, list) for x in reversed(v)}
        order = dict.fromkeys(json.dumps(x, sort_keys=True) for v in known if isinstance(v, list) for x in v)
        return [items[k] for k in order]
    if isinstance(known[0], dict):
        objects = [v for v in known if isinstance(v, dict)]
        return {k: merged([o.get(k) for o in objects], top=False) for k in dict.fromkeys(k for o in objects for k in o)}
    return known[0]


@F.pandas_udf(T.StringType())
def merged_records(records: pd.Series) -> pd.Series:
    """JSON text of one record from the JSON texts of a document's chunks, in order; what is no object counts for nothing."""

    def one(texts: Sequence[str] | None) -> str | None:
        found = [r for t in (texts if texts is not None else ()) if t is not None and isinstance(r := json.loads(t), dict)]
        if not found:
            return None
        return json.dumps(found[0] if len(found) == 1 else {k: merged([r.get(k) for r in found]) for k in dict.fromkeys(k for r in found for k in r)}, ensure_ascii=False)

    return records.map(one)


def extract_text(documents: DataFrame, names: Sequence[str], provider: str = "rules") -> DataFrame:
    """doc_id, data, chunks_processed, is_chunked, error: chunks that fail are left out of the merge, a document all of whose chunks fail has an error.

    Documents without text have null data and no chunk."""
    found = checkpointed(providers.extract_chunks(text_chunks(documents), names, provider))
    sound = F.when(F.col("error").isNull(), F.struct("chunk_idx", "data"))
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(sound)).alias("_c"), F.count_if(F.col("error").isNull()).alias("chunks_processed"), F.max("error").alias("error"))
    joined = documents.select("doc_id", needs_chunking(F.col("text")).alias("is_chunked")).join(per, "doc_id", "left").na.fill(0, ["chunks_processed"])
    return joined.select("doc_id", merged_records(F.transform("_c", lambda x: x["data"])).alias("data"), "chunks_processed", "is_chunked", "error")
