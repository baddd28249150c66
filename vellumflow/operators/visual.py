"""Pages, text elements and layout regions from what OCR and layout providers give back.

Providers return JSON; what they mean is read by column expressions over VARIANT. Pages have doc_id
and page; a document without a usable page, and one whose provider failed, stays a row. Documents
are put together by aggregates over their pages, regions by windows over a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.functions import boxes as B
from vellumflow.functions.replies import counts, field, is_text
from vellumflow.functions.text import literal_map
from vellumflow.operators import layout
from vellumflow.operators.tools import asked

# File kinds, labels of layout providers, and the confidence of native text.
IMAGE_EXTENSIONS = (".jpeg", ".jpg", ".png", ".bmp", ".tiff", ".tif", ".gif", ".webp")
LABELS = {
    "text": "text", "title": "title", "table": "table", "figure": "picture", "picture": "picture", "list": "list_item", "formula": "formula", "header": "page_header", "footer": "page_footer",
    "caption": "caption", "footnote": "footnote", "reference": "text", "equation": "formula", "seal": "picture",
}
CLASSES = ("caption", "footnote", "formula", "list_item", "page_footer", "page_header", "picture", "section_header", "table", "text", "title")
NATIVE_CONFIDENCE = 0.9
LEAST_SCORE = 0.5


def visual_kind(extension: Column) -> Column:
    """'pdf', 'image', or null for what the visual scan doesn't take."""
    e = F.lower(extension)
    return F.when(e == ".pdf", "pdf").when(e.isin(*IMAGE_EXTENSIONS), "image")


# ---- OCR ----------------------------------------------------------------------------------
def _around(points: Column) -> Column:
    """The box around array<array<double>> points; zeros for none."""
    side = lambda i: F.transform(points, lambda p: F.get(p, F.lit(i)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return B.box(zero(F.array_min(side(0))), zero(F.array_min(side(1))), zero(F.array_max(side(0))), zero(F.array_max(side(1))))


def _element(text: Column, confidence: Column, points: Column) -> Column:
    return F.struct(text.alias("text"), _around(points).alias("bbox"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))


def _points(v: Column) -> Column:
    return v.try_cast("array<array<double>>")


def _pair(line: Column) -> Column:
    return F.try_variant_get(line, "$[1]", "array<variant>")


def _is_line(line: Column) -> Column:
    text = F.get(_pair(line), F.lit(0))
    return F.coalesce((F.size(line.try_cast("array<variant>")) == 2) & (F.size(_pair(line)) == 2) & is_text(text) & F.try_variant_get(line, "$[0]", "array<variant>").isNotNull(), F.lit(False))


def _from_lists(z: Column) -> Column:
    p = _points(z["outline"])
    return _element(z["text"], z["score"], F.when(F.size(p) >= 4, p))


def _from_line(line: Column) -> Column:
    return _element(F.get(_pair(line), F.lit(0)).try_cast("string"), F.get(_pair(line), F.lit(1)).try_cast("double"), _points(F.try_variant_get(line, "$[0]", "variant")))


def ocr_pages(outputs: DataFrame) -> DataFrame:
    """doc_id, page, elements (array<struct<text, bbox, confidence>>), text, confidence of doc_id, page, output (JSON text).

    An output has one of two forms: an object with rec_texts, rec_scores and rec_polys, or lines of
    [points, [text, score]], bare or in a list of their own. Blank texts are left out, a missing score
    counts 0, a missing outline gives an empty box; confidence is the elements' mean, 0 for none. The
    steps are projections of their own, so that no output is parsed twice."""
    parsed = outputs.select("doc_id", "page", F.try_parse_json("output").alias("v"))
    begun = parsed.select("*", F.try_variant_get("v", "$[0]", "variant").alias("f"))
    lists = F.arrays_zip(field(F.col("f"), "rec_texts").try_cast("array<string>").alias("text"), F.coalesce(field(F.col("f"), "rec_scores").try_cast("array<double>"), F.array().cast("array<double>")).alias("score"), F.coalesce(field(F.col("f"), "rec_polys").try_cast("array<variant>"), F.array().cast("array<variant>")).alias("outline"))
    lines = F.when(_is_line(F.col("f")), F.col("v").try_cast("array<variant>")).otherwise(F.coalesce(F.col("f").try_cast("array<variant>"), F.col("v").try_cast("array<variant>")))
    split = begun.select("doc_id", "page", lists.alias("lists"), F.when(lists.isNull(), lines).alias("lines"))
    found = F.coalesce(F.transform("lists", _from_lists), F.transform(F.filter("lines", _is_line), _from_line))
    read = split.select("doc_id", "page", F.coalesce(F.filter(found, lambda e: F.length(e["text"]) > 0), F.array()).alias("elements"))
    mean = F.aggregate("elements", F.lit(0.0), lambda a, e: a + e["confidence"]) / F.size("elements")
    return read.select("doc_id", "page", "elements", F.array_join(F.transform("elements", lambda e: e["text"]), "\n").alias("text"), F.when(F.size("elements") > 0, mean).otherwise(0.0).alias("confidence"), F.lit("ocr").alias("method"))


def native_pages(words: DataFrame) -> DataFrame:
    """The same of native text: doc_id, page, text, words (array<struct<text, bbox>>), each word with the fixed confidence."""
    elements = F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox"), F.lit(NATIVE_CONFIDENCE).alias("confidence")))
    return words.select("doc_id", "page", elements.alias("elements"), "text", F.lit(NATIVE_CONFIDENCE).alias("confidence"), F.lit("pdf_native").alias("method"))


def routed_pages(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """One row a page: native text where it isn't blank and has a word, else what OCR read."""
    usable = native_pages(native).filter((F.length(F.trim("text")) > 0) & (F.size("elements") > 0))
    return usable.unionByName(ocr_pages(ocr).join(usable.select("doc_id", "page"), ["doc_id", "page"], "left_anti"))


def text_elements(pages: DataFrame) -> DataFrame:
    """All pages' elements, one row each: doc_id, page, element_no, text, bbox, confidence."""
    return pages.select("doc_id", "page", F.posexplode("elements").alias("element_no", "e")).select("doc_id", "page", "element_no", "e.*")


def visual_documents(pages: DataFrame) -> DataFrame:
    """doc_id, total_pages, full_text, method, confidence: pages in order, blank ones left out of the text; confidence is the pages' mean."""
    parts = F.array_sort(F.collect_list(F.when(F.length(F.trim("text")) > 0, F.struct("page", "text"))))
    methods = F.array_sort(F.collect_set("method"))
    per = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), parts.alias("_p"), methods.alias("_m"), F.avg("confidence").alias("confidence"))
    has = lambda m: F.array_contains("_m", m)
    method = F.when(F.size("_m") == 1, F.get("_m", F.lit(0))).when(has("ocr") & has("pdf_native"), "hybrid").when(has("ocr"), "ocr").otherwise("pdf_native")
    return per.select("doc_id", "total_pages", F.array_join(F.transform("_p", lambda x: x["text"]), "\n\n").alias("full_text"), method.alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


# ---- layout -------------------------------------------------------------------------------
def layout_item(item: Column) -> Column:
    """STRUCT<region_type, bbox, confidence> of a provider's item (VARIANT): its first usable box; null if it has none.

    Boxes stand in a list; those with fewer than four numbers, and a lone box outside a list, are passed over. Unknown labels are 'unknown', a missing or zero score 0.5."""
    either = lambda many, one: F.coalesce(field(item, many), field(item, one))
    raw = either("boxes", "bbox")
    boxes = raw.try_cast("array<array<double>>")
    at = lambda v, i: F.coalesce(F.get(v.try_cast("array<variant>"), i), F.when(v.try_cast("array<variant>").isNull(), v))
    labels, scores = either("labels", "label"), either("scores", "score")

    def made(b: Column, i: Column) -> Column:
        side = lambda k: F.get(b, F.lit(k))
        label = F.lower(at(labels, i).try_cast("string"))
        kind = F.coalesce(F.try_element_at(literal_map(LABELS), label), F.lit("unknown"))
        return F.struct((F.size(b) >= 4).alias("usable"), kind.alias("region_type"), B.box(side(0), side(1), side(2), side(3)).alias("bbox"), F.when(counts(at(scores, i)), at(scores, i).try_cast("double")).otherwise(LEAST_SCORE).alias("confidence"))

    first = F.get(F.filter(F.transform(boxes, made), lambda x: x["usable"]), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["region_type"].alias("region_type"), first["bbox"].alias("bbox"), first["confidence"].alias("confidence")))


def numbered(regions: DataFrame, prefix: str) -> DataFrame:
    """Adds region_id `<prefix>_p<page>_<n>` by arrival (pos) in a document, and sorts pos by the upper left corner."""
    arrival = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "pos"))
    place = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("bbox.y0", "bbox.x0", "pos"))
    return regions.withColumn("region_id", F.format_string(f"{prefix}_p%d_%d", "page", arrival)).withColumn("pos", place)


def item_regions(pages: DataFrame, prefix: str = "item") -> DataFrame:
    """Regions of doc_id, page, output (a JSON list of items, lists within it flattened)."""
    outer = F.coalesce(F.try_parse_json("output").try_cast("array<variant>"), F.array().cast("array<variant>"))
    items = F.flatten(F.transform(outer, lambda x: F.coalesce(x.try_cast("array<variant>"), F.array(x))))
    read = pages.select("doc_id", "page", F.posexplode(F.filter(F.transform(items, layout_item), lambda x: x.isNotNull())).alias("pos", "r"))
    return numbered(read.select("doc_id", "page", "pos", "r.*"), prefix)


def detected_regions(detections: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Regions of an object detector: doc_id, page, pos, label (a class number), score, bbox; nested ones get their parent."""
    kind = F.coalesce(F.try_element_at(F.array(*map(F.lit, CLASSES)), F.col("label") + 1), F.lit("unknown"))
    kept = detections.filter(F.col("score") >= least).select("doc_id", "page", "pos", F.when(F.col("label") >= 0, kind).otherwise("unknown").alias("region_type"), "bbox", F.col("score").alias("confidence"))
    return layout.nested(numbered(kept, "region"))


def document_layouts(documents: DataFrame, regions: DataFrame, failures: DataFrame) -> DataFrame:
    """doc_id, total_regions, error: every document, without regions where its provider failed or found none."""
    counted = regions.groupBy("doc_id").agg(F.count("*").alias("total_regions"))
    return documents.select("doc_id").join(counted, "doc_id", "left").join(failures.select("doc_id", "error"), "doc_id", "left").na.fill(0, ["total_regions"])


def with_layout(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """Text elements beside the region that holds their centre; those of no region keep null."""
    named = elements.withColumn("element_id", F.concat_ws("-", "page", "element_no")).withColumnRenamed("bbox", "element_box")
    hits = layout.elements_to_regions(named, regions)
    return named.join(hits, ["doc_id", "page", "element_id"], "left")


def of_type(rows: DataFrame, *region_types: str) -> DataFrame:
    return rows.filter(F.col("region_type").isin(*region_types))


def segments(regions: DataFrame, padding: int = 0) -> DataFrame:
    """doc_id, region_type, members: ids and crop boxes of a document's regions by type, in order."""
    crop = B.crop(F.col("bbox"), F.col("page_width"), F.col("page_height"), padding)
    return regions.select("doc_id", "region_type", F.struct("page", "pos", "region_id", crop.alias("crop")).alias("m")).groupBy("doc_id", "region_type").agg(F.array_sort(F.collect_list("m")).alias("members"))


def region_images(wanted: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions asked for by id with their crop; error says why one can't be had."""
    known = regions.select("doc_id", "region_id", "page", "page_count", B.crop(F.col("bbox"), F.col("page_width"), F.col("page_height"), 0).alias("crop"))
    joined = wanted.join(known, ["doc_id", "region_id"], "left")
    error = F.when(F.col("page").isNull(), F.concat(F.lit("Unknown region_id: "), F.col("region_id"))).when((F.col("page") < 1) | (F.col("page") > F.col("page_count")), F.concat(F.lit("Invalid page for region_id: "), F.col("region_id")))
    return joined.select("doc_id", "region_id", "page", F.when(error.isNull(), F.col("crop")).alias("crop"), error.alias("error"))


def extraction_totals(results: DataFrame) -> DataFrame:
    """Document totals of region results: doc_id, n_regions, successful, failed, tokens, seconds, pages, and the provenance sentence."""
    per = results.groupBy("doc_id").agg(
        F.count("*").alias("n_regions"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
        F.sum(F.coalesce("seconds", F.lit(0.0))).alias("seconds"), F.count_distinct("page").alias("pages"),
    )
    return per.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("provenance", F.format_string("Synthesized from %d regions across %d page(s)", "n_regions", "pages"))


def synthesised_result(totals: DataFrame, data: DataFrame) -> DataFrame:
    """Extraction results of synthesised documents: a page is a chunk."""
    return data.join(totals, "doc_id").withColumn("chunks_processed", F.col("pages")).withColumn("is_chunked", F.col("pages") > 1)


# ---- scans through providers --------------------------------------------------------------
def frames(images: DataFrame) -> DataFrame:
    """doc_id, page, image of doc_id, frames (array of binaries): each frame of a file is a page, from 1."""
    return images.select("doc_id", F.posexplode("frames").alias("_i", "image")).select("doc_id", (F.col("_i") + 1).alias("page"), "image")


def scanned_pages(images: DataFrame, provider: str) -> DataFrame:
    """Pages of doc_id, page, image through an OCR provider; a page whose call fails has no text, and its error."""
    done = asked(images.select("doc_id", "page", "image"), provider, F.lit("ocr"), F.col("image")).drop("image")
    read = ocr_pages(done.withColumnRenamed("reply", "output"))
    return read.join(done.select("doc_id", "page", F.col("call_error").alias("error")), ["doc_id", "page"])


def scanned_layouts(images: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """(regions, failures) of page images through a layout provider: a failing page leaves its document without regions of it, and never raises."""
    done = asked(images.select("doc_id", "page", "image"), provider, F.lit("layout"), F.col("image")).drop("image")
    failures = done.filter(F.col("call_error").isNotNull()).groupBy("doc_id").agg(F.min("call_error").alias("error"))
    return item_regions(done.withColumnRenamed("reply", "output")), failures


def visual_scan(images: DataFrame, ocr_provider: str, layout_provider: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, elements beside their regions, layouts): text and layout of page images in one go."""
    pages = scanned_pages(images, ocr_provider)
    regions, failures = scanned_layouts(images, layout_provider)
    documents = visual_documents(pages)
    return documents, with_layout(text_elements(pages), regions), document_layouts(documents, regions, failures)


def encoded(image: Column) -> Column:
    return F.base64(image)
