"""Splitting oversized texts at natural boundaries, in ranges (problem 4).

Nothing ever holds a whole item. An item is a row of ranges: of characters for a text column, of
bytes for a giant file. A file's ranges first count their characters, and prefix sums over the
range table give each range its place. Then each range, with a halo of the characters before it,
finds the boundaries around the places where cuts fall due: cut k falls into the `slack`
characters up to k * `stride`, so cuts need no order of work and two cuts are never more than
`stride` + `slack` apart. The best boundary there wins (paragraph, line, sentence, word end; the
last of equals). Where there is none, the window is widened to what the limit allows with the
cuts before and behind where they are: first for even k, then for odd k, so a cut depends on the
text of two windows before and behind only. A text without a boundary even there is cut at
k * stride. A cut's number is its address, so the boundary tables of two ranges meet without a
join or a sort: the halo reaches back far enough for a range to find the cut before its first one as
the range before it does, and to emit every piece that it ends by offset.

Pieces are at most `limit` characters with the overlap, which begins at a word start within the
last `overlap` characters of the piece before. Without the overlaps they join to the exact text.
Null, empty and short texts (up to `threshold`) have no pieces. Equal ids count as one item: the
caller passes unique ids. Empty tables give empty results; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PieceOptions:
    threshold: int = 16_000
    limit: int = 4_000
    overlap: int = 200
    slack: int = 800
    range_chars: int = 48_000

    def __post_init__(self) -> None:
        if self.stride <= self.slack or self.overlap < 0 or self.range_chars < 1:
            raise ValueError("limit must leave room for slack and overlap, a range must hold something")

    @property
    def stride(self) -> int:
        return self.limit - self.overlap - self.slack

    @property
    def halo(self) -> int:
        return 6 * self.stride + self.slack + self.overlap + 64


#: Boundaries from best to worst; a cut stands behind the match.
BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*"),
    re.compile(r"\s+"),
)
#: Ranges of a file whose prefix sums are one task.
BLOCK = 4096
#: Characters that a boundary may be read ahead of and behind its window.
LOOK = 8
_WORD_START = re.compile(r"(?<=\s)\S")


def best_cut(text: str, low: int, high: int) -> tuple[int, int]:
    """(place, kind) of the cut in text[low:high]; kind is the boundary's rank, 4 where there is none."""
    for kind, boundary in enumerate(BOUNDARIES):
        last = -1
        for m in boundary.finditer(text, max(0, low - LOOK), high + LOOK):
            if m.end() > high:
                break
            if m.end() > low:
                last = m.end()
        if last > 0:
            return last, kind
    return high, len(BOUNDARIES)


def _overlap_start(text: str, cut: int, overlap: int) -> int:
    low = max(0, cut - overlap)
    m = _WORD_START.search(text, low, cut)
    return m.start() if m else low


def range_pieces(text: str, halo: int, offset: int, last: bool, options: PieceOptions) -> list[tuple[int, int, int, int, int]]:
    """(piece_no, start, fresh_start, end, kind) in item offsets, of the pieces whose second next window ends in a range (in the last, of all that are left).

    text is the range behind `halo` characters of the range before; offset is where the range begins."""
    base, end, stride, reach = offset - halo, offset - halo + len(text), options.stride, options.stride + options.slack
    first = max(1, (offset - LOOK) // stride - 1)
    stop = -(-end // stride) if last else (end - LOOK) // stride - 1
    known = range(max(1, first - 4), stop if last else stop + 2)
    cuts = {0: (0, -1)} | ({stop: (end, -1)} if last else {})
    for k in known:
        cut, kind = best_cut(text, k * stride - options.slack - base, k * stride - base)
        cuts[k] = base + cut, kind
    for parity in (0, 1):
        for k in known:
            if k % 2 == parity and cuts[k][1] == len(BOUNDARIES) and k - 1 in cuts and k + 1 in cuts:
                before, behind = cuts[k - 1][0], cuts[k + 1][0]
                cut, kind = best_cut(text, max(behind - reach - 1, before) - base, min(before + reach, behind - 1) - base)
                if kind < len(BOUNDARIES):
                    cuts[k] = base + cut, kind
    out = []
    for k in range(first, stop + last):
        fresh = cuts[k - 1][0]
        start = base + _overlap_start(text, fresh - base, options.overlap) if k > 1 else 0
        out.append((k - 1, start, fresh, *cuts[k]))
    return out


def ranges_of_texts(df: DataFrame, id_column: str, text: str, options: PieceOptions) -> DataFrame:
    """item, range_no, offset, halo, length, last, body: the ranges of each text beyond the threshold."""
    size, halo = options.range_chars, options.halo
    # one pass over a text cuts it into ranges; a range's halo is what ends the few ranges before it
    parts = F.regexp_extract_all("_t", F.lit(rf"(?s)(.{{1,{size}}}+)"), F.lit(1))
    long = df.select(F.col(id_column).alias("item"), F.col(text).alias("_t"), F.length(text).cast("long").alias("length")).filter(F.col("length") > options.threshold)
    behind = -(-halo // size)

    def with_halo(body: Column, i: Column) -> Column:
        before = F.least(i * size, F.lit(halo)).cast("int")
        lead = F.right(F.array_join(F.slice("_parts", F.greatest(F.lit(1), i - behind + 1), F.least(i, F.lit(behind))), ""), before)
        return F.struct(i.cast("long").alias("range_no"), (i.cast("long") * size).alias("offset"), before.alias("halo"), F.when(i == 0, body).otherwise(F.concat(lead, body)).alias("body"))

    ranges = long.select("item", "length", parts.alias("_parts")).select("item", "length", F.inline(F.transform("_parts", with_halo)))
    return ranges.select("item", "range_no", "offset", "halo", "length", (F.col("offset") + size >= F.col("length")).alias("last"), "body")


def _aligned(path: str, start: int, size: int, before: int) -> tuple[str, str]:
    """(halo, body) of a UTF-8 byte range: it begins with the first character that starts in it."""
    with open(path, "rb") as f:
        f.seek(max(0, start - before))
        head = f.read(start - max(0, start - before))
        body = f.read(size + 4)
    shift = 0
    while start and shift < len(body) and body[shift] & 0xC0 == 0x80:
        shift += 1
    end = min(size, len(body))
    while end < len(body) and body[end] & 0xC0 == 0x80:
        end += 1
    lead = (head + body[:shift]).decode("utf-8", "ignore")
    return lead, body[shift:end].decode("utf-8", "replace")


def ranges_of_files(spark: SparkSession, paths: Sequence[tuple[str, int]], options: PieceOptions, range_bytes: int = 1 << 20) -> DataFrame:
    """The same of UTF-8 files on a file system that all executors share: (path, size in bytes) each.

    First pass: characters by range, prefix sums to offsets. Second pass: read again with halo."""
    listed = spark.createDataFrame([(p, int(n)) for p, n in paths], "item string, size long").filter("size > 0")
    plan = listed.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / range_bytes))))
    plan = plan.repartition("item", "range_no")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part[["item", "range_no"]].assign(n=[len(_aligned(p, int(r) * range_bytes, range_bytes, 0)[1]) for p, r in zip(part["item"], part["range_no"], strict=True)])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            bodies, halos = [], []
            for p, r in zip(part["item"], part["range_no"], strict=True):
                lead, body = _aligned(p, int(r) * range_bytes, range_bytes, 4 * options.halo if r else 0)
                lead = lead[-options.halo :]
                halos.append(len(lead))
                bodies.append(lead + body)
            yield part.assign(halo=halos, body=bodies)

    sized = plan.mapInPandas(count, "item string, range_no long, n long")
    sized = sized.withColumn("block", F.floor(F.col("range_no") / BLOCK))
    # prefix sums in blocks, so that a giant file's ranges are never one task
    blocks = sized.groupBy("item", "block").agg(F.sum("n").alias("_b"))
    before = blocks.withColumn("_before", F.sum("_b").over(W.partitionBy("item").orderBy("block")) - F.col("_b")).withColumn("length", F.sum("_b").over(W.partitionBy("item"))).drop("_b")
    inner = sized.withColumn("_in", F.sum("n").over(W.partitionBy("item", "block").orderBy("range_no")))
    placed = inner.join(before, ["item", "block"]).withColumn("upto", F.col("_before") + F.col("_in"))
    placed = placed.filter(F.col("length") > options.threshold).select("item", "range_no", (F.col("upto") - F.col("n")).alias("offset"), "length", (F.col("upto") == F.col("length")).alias("last"))
    return placed.mapInPandas(read, "item string, range_no long, offset long, length long, last boolean, halo int, body string").select("item", "range_no", "offset", "halo", "length", "last", "body")


def pieces(ranges: DataFrame, options: PieceOptions) -> DataFrame:
    """item, piece_no, start, fresh_start, end, kind, text; text[start:fresh_start] repeats the piece before."""

    @F.pandas_udf("array<struct<piece_no:long,start:long,fresh_start:long,end:long,kind:int,text:string>>")
    def emitted(body: pd.Series, halo: pd.Series, offset: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for b, h, f, x in zip(body, halo, offset, last, strict=True):
            base = int(f) - int(h)
            out.append([{"piece_no": n, "start": s, "fresh_start": c, "end": e, "kind": k, "text": b[s - base : e - base]} for n, s, c, e, k in range_pieces(b, int(h), int(f), bool(x), options)])
        return pd.Series(out)

    return ranges.select("item", F.inline(emitted("body", "halo", "offset", "last")))


def piece_counts(ranges: DataFrame, options: PieceOptions) -> DataFrame:
    """item, n_pieces: a cut falls due at each multiple of the stride before the end."""
    return ranges.filter("last").select("item", F.ceil(F.col("length") / options.stride).cast("long").alias("n_pieces"))


def with_chunk_columns(results: DataFrame, extractions: DataFrame, counted: DataFrame, options: PieceOptions) -> DataFrame:
    """extraction_results with chunks_processed and is_chunked as the texts demand.

    counted: item, n_pieces. A text within the threshold is one chunk, a null or empty text none;
    results without an extraction keep null. A result delivered twice whole stays one row."""
    sizes = extractions.select("extraction_id", F.coalesce(F.length("text"), F.lit(0)).alias("_n"))
    kept = results.dropDuplicates(["result_id"]).drop("chunks_processed", "is_chunked").join(sizes, "extraction_id", "left").join(counted.withColumnRenamed("item", "extraction_id"), "extraction_id", "left")
    chunked = F.col("_n") > options.threshold
    processed = F.when(chunked, F.col("n_pieces")).when(F.col("_n") > 0, F.lit(1)).when(F.col("_n") == 0, F.lit(0)).cast("long")
    return kept.withColumn("chunks_processed", processed).withColumn("is_chunked", chunked).drop("_n", "n_pieces")
