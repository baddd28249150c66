"""Merging what was extracted from the chunks of one document.

By key: scalars take the first value that isn't null, arrays of all chunks are joined and
de-duplicated in order, objects merge by key (their own arrays are not joined but taken from
the first chunk that has them). Chunks come in chunk_idx order, ties by value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _first(value: Column, order: str) -> Column:
    """First that isn't null in chunk order; min_by over non-null rows combines map-side."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def _joined(value: Column, order: str) -> Column:
    listed = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))))
    merged = F.array_distinct(F.flatten(F.transform(listed, lambda x: x["v"])))
    return F.when(F.size(listed) > 0, merged)


def _merged(value: Column, kind: T.DataType, order: str, top: bool) -> Column:
    if isinstance(kind, T.ArrayType) and top:
        return _joined(value, order)
    if isinstance(kind, T.StructType):
        parts = [_merged(value[f.name], f.dataType, order, False).alias(f.name) for f in kind.fields]
        return F.when(F.count(value) > 0, F.struct(*parts))
    return _first(value, order)


def merge_chunks(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_idx") -> DataFrame:
    """One row a document with every other column merged by its type."""
    kinds: Mapping[str, T.DataType] = {f.name: f.dataType for f in chunks.schema.fields if f.name not in (key, order)}
    return chunks.groupBy(key).agg(*[_merged(F.col(n), k, order, True).alias(n) for n, k in kinds.items()])


def key_union(chunks: DataFrame, maps: str, key: str = "doc_id") -> DataFrame:
    """Sorted union of the map keys of all chunks."""
    return chunks.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(maps))))).alias("keys"))
