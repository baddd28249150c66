"""Regions of page layouts: nesting, reading order, neighbours, columns, densities.

A regions table has doc_id, page, region_id, region_type, pos (arrival order) and bbox. All
windows and joins are partitioned by page or document, whose size a page bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions import boxes as B
from vellumflow.functions.text import literal_map

# Region types by what is done with them.
NESTABLE, PARENTS = ("caption", "text"), ("picture", "table")
SKIPPED = ("page_header", "page_footer", "footnote")
DENSE_TYPES = ("text", "list_item", "section_header")
STRATEGIES = {**dict.fromkeys(("text", "title", "section_header", "list_item", "caption", "footnote", "page_header", "page_footer"), "ocr_enhanced"), "table": "table_specialized", "picture": "figure_analysis", "formula": "figure_analysis", "unknown": "vlm_only"}
CONTENT_TYPES = {"text": "text", "title": "title", "section_header": "section_header", "list_item": "list_item", "table": "table_data", "picture": "figure_description", "caption": "caption", "formula": "formula", "footnote": "footnote", "page_header": "page_header", "page_footer": "page_footer"}
PAGE = ("doc_id", "page")


def strategy(region_type: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(STRATEGIES), region_type), F.lit("vlm_only"))


def content_type(region_type: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(CONTENT_TYPES), region_type), F.lit("other"))


def strategy_prompt(region_type: Column, prompts: dict[str, str], default: str = "") -> Column:
    """The prompt of a region's strategy."""
    return F.coalesce(F.element_at(literal_map(prompts), strategy(region_type)), F.lit(default)) if prompts else F.lit(default)


def position_context(ordered: DataFrame) -> DataFrame:
    """Adds position_text: where a region stands on its page, its place in the order, and what is before and behind it.

    Of neighbours' output: `middle-left of page; Reading order: 2 of 5; Preceding: title; Following: text, table`."""
    where = F.concat(B.position_label(F.col("bbox"), F.col("page_width"), F.col("page_height")), F.lit(" of page"))
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")))
    place = F.concat(F.lit("Reading order: "), (F.col("order_index") + 1).cast("string"), F.lit(" of "), F.col("regions_on_page").cast("string"))
    return ordered.withColumn("position_text", F.concat_ws("; ", where, place, listed("Preceding", "types_before"), listed("Following", "types_after")))


def nested(regions: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds parent_region_id: the first (by y0, x0) picture or table that covers `share` of a caption or text."""
    rank = F.row_number().over(W.partitionBy(*PAGE).orderBy("bbox.y0", "bbox.x0", "pos", "region_id"))
    parents = regions.withColumn("rank", rank).filter(F.col("region_type").isin(*PARENTS)).select(*PAGE, F.col("region_id").alias("parent_id"), F.col("bbox").alias("outer_box"), "rank")
    children = regions.filter(F.col("region_type").isin(*NESTABLE))
    covered = B.intersection_area(F.col("bbox"), F.col("outer_box")) >= share * B.area(F.col("bbox"))
    hits = children.join(parents, list(PAGE)).filter(covered & (B.area(F.col("bbox")) > 0) & (F.col("region_id") != F.col("parent_id")))
    first = hits.groupBy(*PAGE, "region_id").agg(F.min_by("parent_id", "rank").alias("parent_region_id"))
    return regions.join(first, [*PAGE, "region_id"], "left")


def reading_order(regions: DataFrame) -> DataFrame:
    """Adds layout_type, order_index, skip and order_confidence; regions need page_width.

    The layout type is found over the page's own windows, so a page is shuffled and sorted once."""
    page = W.partitionBy(*PAGE)
    content, xc = ~F.col("region_type").isin(*SKIPPED), B.x_center(F.col("bbox"))
    by_row = page.orderBy(content, "_yc")
    gaps = regions.withColumn("_yc", B.y_center(F.col("bbox"))).withColumn("_content", content)
    fresh = F.col("_content") & F.lag("_content").over(by_row) & (F.col("_yc") - F.lag("_yc").over(by_row) > 0.1 * F.col("page_width"))
    marked = gaps.withColumn("_fresh", F.coalesce(fresh.cast("int"), F.lit(0)))
    span = F.max(F.when(content, xc)).over(page) - F.min(F.when(content, xc)).over(page)
    multi = (F.count("*").over(page) >= 2) & (F.count_if("_content").over(page) > 3) & (span > 0.4 * F.col("page_width")) & (F.sum("_fresh").over(page) > 0)
    typed = marked.withColumn("layout_type", F.when(multi, "multi_column").otherwise("single_column"))
    right = (F.col("layout_type") == "multi_column") & (xc >= F.col("page_width") / 2)
    order = page.orderBy(right, "bbox.y0", "bbox.x0", "pos", "region_id")
    ordered = typed.withColumn("order_index", (F.row_number().over(order) - 1).cast("long")).withColumn("skip", F.col("region_type").isin(*SKIPPED))
    return ordered.withColumn("order_confidence", F.when(F.col("layout_type") == "multi_column", 0.5).otherwise(0.7)).drop("_yc", "_content", "_fresh")


def page_orders(pages: DataFrame, ordered: DataFrame) -> DataFrame:
    """doc_id, page, layout_type, overall_confidence, n_regions of every page; a page without regions is 'empty' and sure."""
    per = ordered.groupBy(*PAGE).agg(F.first("layout_type").alias("layout_type"), F.count("*").alias("n_regions"))
    joined = pages.select(*PAGE).join(per, list(PAGE), "left").na.fill(0, ["n_regions"])
    return joined.select(*PAGE, F.coalesce("layout_type", F.lit("empty")).alias("layout_type"), F.when(F.col("layout_type").isNull(), 1.0).when(F.col("layout_type") == "single_column", 0.6).otherwise(0.4).alias("overall_confidence"), "n_regions")


#: Regions of a page that the order model takes; larger pages are ordered by rule.
MODEL_REGIONS = 510


def settled_orders(scores: np.ndarray) -> np.ndarray:
    """A place for each region, no place twice: each asks for its best place left, and a place keeps whoever scores highest there.

    scores: regions x places. Of equal scores the earlier region keeps the place."""
    wishes = np.argsort(scores, axis=1, kind="stable")[:, ::-1]
    holder, asked = np.full(scores.shape[1], -1), np.zeros(len(scores), int)
    waiting = list(range(len(scores)))[::-1]
    while waiting:
        region = waiting.pop()
        place = wishes[region, asked[region]]
        asked[region] += 1
        held = holder[place]
        if held < 0 or (scores[region, place], -region) > (scores[held, place], -held):
            holder[place] = region
            region = held
        if region >= 0:
            waiting.append(region)
    out = np.empty(len(scores), int)
    out[holder[holder >= 0]] = np.flatnonzero(holder >= 0)
    return out


_PLACES = T.StructType([T.StructField("order_index", T.ArrayType(T.LongType())), T.StructField("confidence", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_PLACES)
def _settled(pages: pd.Series) -> pd.DataFrame:
    out = []
    for page in pages:
        scores = np.stack([np.asarray(x, float)[: len(page)] for x in page])
        order = settled_orders(scores)
        shifted = np.exp(scores - scores.max(1, keepdims=True))
        out.append((order, (shifted / shifted.sum(1, keepdims=True))[np.arange(len(page)), order]))
    return pd.DataFrame(out, columns=_PLACES.names)


def model_order(regions: DataFrame) -> DataFrame:
    """Reading order from an order model's scores: regions need pos and scores (array<double>, one for each place of the page).

    Adds order_index, skip, order_confidence (the softmax of the place taken) and source ('model'). Pages
    without a size, with more than `MODEL_REGIONS` regions or without usable scores are ordered by rule
    (source 'rule'). A page's scores are at most `MODEL_REGIONS` squared, so one page is a task's work."""
    page = W.partitionBy(*PAGE)
    n = F.count("*").over(page)
    usable = (F.col("page_width") > 0) & (F.col("page_height") > 0) & (n <= MODEL_REGIONS) & (F.min(F.coalesce(F.size("scores"), F.lit(0))).over(page) >= n)
    marked = regions.withColumn("_usable", usable)

    listed = F.array_sort(F.collect_list(F.struct("pos", "region_id", "scores")))
    pages_ = marked.filter("_usable").groupBy(*PAGE).agg(listed.alias("r"))
    places = pages_.select(*PAGE, F.col("r.region_id").alias("region_id"), _settled(F.col("r.scores")).alias("s"))
    settled = places.select(*PAGE, F.inline(F.arrays_zip("region_id", F.col("s.order_index").alias("order_index"), F.col("s.confidence").alias("order_confidence"))))
    by_model = regions.join(settled, [*PAGE, "region_id"]).withColumn("skip", F.col("region_type").isin(*SKIPPED)).withColumn("source", F.lit("model"))
    by_rule = reading_order(marked.filter(~F.col("_usable")).drop("_usable")).withColumn("source", F.lit("rule"))
    return by_model.unionByName(by_rule.select(*by_model.columns))


def neighbours(ordered: DataFrame, reach: int = 3) -> DataFrame:
    """Adds the types of up to three regions before and after in reading order, the place and the page's count."""
    w = W.partitionBy(*PAGE).orderBy("order_index")
    return ordered.withColumn("types_before", F.collect_list("region_type").over(w.rowsBetween(-reach, -1))).withColumn("types_after", F.collect_list("region_type").over(w.rowsBetween(1, reach))).withColumn("regions_on_page", F.count("*").over(W.partitionBy(*PAGE)))


def ordered_content(ordered: DataFrame, extracted: DataFrame) -> DataFrame:
    """Reading order with extracted content by region: skipped, unmatched and empty ones fall out; numbered by document."""
    joined = ordered.filter(~F.col("skip")).join(extracted, ["doc_id", "region_id"]).filter(F.length("content") > 0)
    return joined.withColumn("position", (F.row_number().over(W.partitionBy("doc_id").orderBy("page", "order_index")) - 1).cast("long")).withColumn("content_type", content_type(F.col("region_type")))


def has_columns(regions: DataFrame, band: int = 50) -> DataFrame:
    """doc_id, is_multi_column: in a band of centres, a text that ends before the next one begins."""
    texts = regions.filter(F.col("region_type").isin("text", "title")).withColumn("band", (B.y_center(F.col("bbox")) / band).cast("int"))
    following = F.lead("bbox.x0").over(W.partitionBy("doc_id", "band").orderBy("bbox.x0", "pos", "region_id"))
    return texts.withColumn("apart", F.coalesce(F.col("bbox.x1") < following, F.lit(False))).groupBy("doc_id").agg(F.bool_or("apart").alias("is_multi_column"))


def characteristics(regions: DataFrame) -> DataFrame:
    """doc_id with type counts, text density, column test and the complexity ladder of a visual document."""
    dense = F.sum(F.when(F.col("region_type").isin(*DENSE_TYPES), B.area(F.col("bbox"))).otherwise(0.0))
    hull = (F.max("bbox.x1") - F.min("bbox.x0")) * (F.max("bbox.y1") - F.min("bbox.y0"))
    per = regions.groupBy("doc_id").agg(
        F.count("*").alias("region_count"), F.array_sort(F.collect_set("region_type")).alias("region_types"), F.bool_or(F.col("region_type") == "table").alias("has_tables"), F.bool_or(F.col("region_type") == "picture").alias("has_images"), F.coalesce(F.try_divide(dense, hull), F.lit(0.0)).alias("density")
    )
    full = per.join(has_columns(regions), "doc_id", "left").na.fill(False, ["is_multi_column"])
    level = F.when(F.col("has_tables") | F.col("has_images") | F.col("is_multi_column"), "complex").when(F.size("region_types") > 3, "moderate").otherwise("simple")
    return full.withColumn("text_density", F.when(F.col("density") < 0.3, "sparse").when(F.col("density") > 0.7, "dense").otherwise("normal")).withColumn("complexity", level)


def type_counts(regions: DataFrame) -> DataFrame:
    """doc_id, counts: a map from region type to its number."""
    counted = regions.groupBy("doc_id", "region_type").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region_type", "n")))).alias("counts"))


def elements_to_regions(elements: DataFrame, regions: DataFrame, cell: int = 64) -> DataFrame:
    """Text elements with the first region whose box holds their centre: an equi-join on page and grid cell."""
    grid = lambda v: F.floor(v / cell)
    placed = elements.withColumn("xc", B.x_center(F.col("element_box"))).withColumn("yc", B.y_center(F.col("element_box"))).withColumn("gx", grid(F.col("xc"))).withColumn("gy", grid(F.col("yc")))
    spread = regions.withColumn("gx", F.explode(F.sequence(grid(F.col("bbox.x0")), grid(F.col("bbox.x1"))))).withColumn("gy", F.explode(F.sequence(grid(F.col("bbox.y0")), grid(F.col("bbox.y1")))))
    hits = placed.join(spread.select(*PAGE, "gx", "gy", "region_id", "bbox", "pos"), [*PAGE, "gx", "gy"]).filter(B.contains(F.col("bbox"), F.col("xc"), F.col("yc")))
    return hits.groupBy(*PAGE, "element_id").agg(F.min_by("region_id", "pos").alias("region_id"))
