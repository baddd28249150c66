"""File formats: extension and content signatures to MIME type, family and processing category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions.text import literal_map

_OFFICE = "application/vnd.openxmlformats-officedocument."
# Extension, MIME type, family, category.
FORMATS = (
    (".txt", "text/plain", "plain_text", "text_based"),
    (".csv", "text/csv", "spreadsheet", "text_based"),
    (".pdf", "application/pdf", "pdf", "visual"),
    (".doc", "application/msword", "document", "visual"),
    (".docx", _OFFICE + "wordprocessingml.document", "document", "visual"),
    (".odt", "application/vnd.oasis.opendocument.text", "document", "visual"),
    (".ppt", "application/vnd.ms-powerpoint", "presentation", "visual"),
    (".pptx", _OFFICE + "presentationml.presentation", "presentation", "visual"),
    (".odp", "application/vnd.oasis.opendocument.presentation", "presentation", "visual"),
    (".xlsx", _OFFICE + "spreadsheetml.sheet", "spreadsheet", "structured"),
    (".jpeg", "image/jpeg", "image", "visual"),
    (".jpg", "image/jpeg", "image", "visual"),
    (".png", "image/png", "image", "visual"),
    (".bmp", "image/bmp", "image", "visual"),
    (".psd", "image/vnd.adobe.photoshop", "image", "visual"),
    (".tiff", "image/tiff", "image", "visual"),
    (".tif", "image/tiff", "image", "visual"),
    (".gif", "image/gif", "image", "visual"),
    (".webp", "image/webp", "image", "visual"),
)
# Other names of MIME types.
ALIASES = {"text/x-csv": "text/csv", "application/csv": "text/csv", "image/x-ms-bmp": "image/bmp", "image/x-bmp": "image/bmp", "image/x-tiff": "image/tiff"}
# First bytes in hexadecimal.
SIGNATURES = (("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("38425053", "image/vnd.adobe.photoshop"), ("504B0304", "application/zip"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"))
UPLOAD_LIMIT_MB = 10


def supported_extensions() -> list[str]:
    return sorted(f[0] for f in FORMATS)


def supported_mime_types() -> list[str]:
    return sorted({f[1] for f in FORMATS})


def extension(name: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1)), F.lit(""))


def mime_of_extension(ext: Column) -> Column:
    return F.element_at(literal_map({f[0]: f[1] for f in FORMATS}), ext)


def canonical_mime(mime: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(ALIASES), mime), mime)


def mime_of_content(content: Column) -> Column:
    """By signature; text where the bytes are valid UTF-8 without zeros; null for empty or unknown content."""
    head = F.hex(F.substring(content, 1, 16))
    tests = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, F.lit(None).cast("string"))
    for signature, mime in SIGNATURES:
        tests = tests.when(head.startswith(signature), mime)
    tests = tests.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    return tests.when(F.is_valid_utf8(content.cast("string")) & ~F.contains(content.cast("string"), F.lit("\x00")), "text/plain")


def format_info(name: Column, content_mime: Column) -> Column:
    """STRUCT of the decision: a supported content type wins, then a supported extension, else status 'unsupported'.

    Plain text and containers say less than the extension, so an extension of their kind refines them."""
    ext = extension(name)
    by_ext = mime_of_extension(ext)
    found = canonical_mime(content_mime)
    family = literal_map({f[1]: f[2] for f in FORMATS})
    category = literal_map({f[1]: f[3] for f in FORMATS})
    refined = F.when((found == "text/plain") & (by_ext == "text/csv"), by_ext).when(F.element_at(family, found).isNotNull(), found)
    mime = F.coalesce(refined, by_ext)
    return F.struct(
        mime.alias("mime_type"), ext.alias("extension"), F.element_at(family, mime).alias("format_family"), F.element_at(category, mime).alias("processing_category"), refined.isNotNull().alias("detected_from_content"), F.when(refined.isNotNull() & (by_ext != refined), ext).alias("original_extension"), F.when(mime.isNull(), "unsupported").otherwise("ok").alias("status")
    )


def accepted_size(length: Column, limit_mb: int = UPLOAD_LIMIT_MB) -> Column:
    return length <= limit_mb * 1024 * 1024


def file_formats(files: DataFrame) -> DataFrame:
    """path and the format decision of path, content: what the bytes say, then the name."""
    return files.select("path", format_info(F.col("path"), mime_of_content(F.col("content"))).alias("f")).select("path", "f.*")
