"""Column builders over decoded and raw text: line ends, counts, byte-order marks, decoding, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROMPT_CHARS = 12_000
CHUNKING_CHARS = 16_000

# Canonical names of encodings by their normal form.
ENCODING_NAMES = {"utf_8": "utf-8", "utf_16": "utf-16", "utf_32": "utf-32", "ascii": "ascii", "iso_8859_1": "iso-8859-1", "iso8859_1": "iso-8859-1", "latin_1": "latin-1", "latin1": "latin-1", "cp1252": "cp1252", "windows_1252": "cp1252"}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def line_count(text: Column) -> Column:
    """Lines after line-end normalisation; an empty last line isn't one."""
    t = unix_lines(text)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(F.length(t) == 0, 0).otherwise(breaks + F.when(F.endswith(t, F.lit("\n")), 0).otherwise(1)).cast("long")


def has_bom(content: Column) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.lit(False))


def canonical_encoding(name: Column) -> Column:
    key = F.replace(F.replace(F.lower(name), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return F.coalesce(F.element_at(literal_map(ENCODING_NAMES), key), F.replace(key, F.lit("_"), F.lit("-")))


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1, which takes any byte: code pages behind it in a list of fallbacks are never reached."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "iso-8859-1"))


def decoded_as(content: Column, encoding: Column) -> Column:
    """The text under a stated encoding where the JVM knows it and the bytes fit, else as `decoded`."""
    known = canonical_encoding(encoding)
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(known.isin("latin-1", "iso-8859-1"), F.decode(content, "iso-8859-1")).when(known.isin("utf-16", "utf-16-le", "utf-16-be") & (F.length(content) % 2 == 0), F.decode(content, "utf-16")).when(known.isin("ascii", "utf-8") & valid, content.cast("string")).otherwise(decoded(content))


def detected_encoding(content: Column) -> Column:
    """STRUCT<encoding, confidence>: empty content is UTF-8 for sure; a byte-order mark, ASCII and valid UTF-8 are found
    by the bytes; what is none of these is Latin-1, the first fallback that takes it (0.5)."""
    pair = lambda e, c: F.struct(F.lit(e).alias("encoding"), F.lit(c).alias("confidence"))
    valid = F.is_valid_utf8(content.cast("string"))
    ascii_only = valid & (F.length(content) == F.length(content.cast("string")))
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    return F.when(F.length(content) == 0, pair("utf-8", 1.0)).when(ascii_only, pair("ascii", 1.0)).when(valid, pair("utf-8", 0.99)).when(marked, pair("utf-16", 1.0)).otherwise(pair("latin-1", 0.5))


def needs_chunking(text: Column) -> Column:
    return F.coalesce(F.length(text) > CHUNKING_CHARS, F.lit(False))


def truncated(text: Column, limit: int = PROMPT_CHARS, marker: str = "\n... [text truncated] ...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def fixed_two(value: Column) -> Column:
    """Two decimals, ties to even, as document text shows numbers."""
    return F.format_string("%.2f", F.bround(value, 2))
