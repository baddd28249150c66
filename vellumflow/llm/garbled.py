"""Text decoded with the wrong character encoding: find it, and restore it where possible (problem 1).

Each character is mapped back to the byte that a legacy code page gives it. An automaton of the
well-formed UTF-8 byte sequences then marks the maximal multibyte spans, and only those spans
are decoded; everything else stays. The code page whose spans explain most characters goes
first, and rounds repeat until nothing more is found, so text garbled twice or by two code pages
in different passages is restored as well.

Characters may be written as HTML entities (`&Atilde;&copy;`); spans of such are decoded in the same
way, and entities outside of spans stay as they are.

Three kinds have no multibyte structure and follow the same idea of mapping back to bytes:
UTF-16 read byte by byte (zero bytes at every other place), one code page read as another
(words that no language writes, mended by a pair of code pages), and characters that were lost
to U+FFFD, which are found but can't be restored.

A garbled sequence that stands alone between quotation marks is an example in a sound text.
Null and empty texts are no cases. An extraction is judged by its own text only, so equal texts
are judged alike; the stated encoding and its confidence aren't used.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code pages that UTF-8 bytes may have been read with, in order of preference.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "iso8859-2", "cp1250", "koi8-r", "cp866", "iso8859-15")
#: (read with, written in) of single-byte text.
SWAPS = tuple((wrong, right) for right, wrongs in {
    "cp1252": ("mac_roman", "cp850", "cp437", "cp1251", "koi8-r", "iso8859-2"), "mac_roman": ("cp1252", "latin-1"), "cp850": ("cp1252", "latin-1"), "cp437": ("cp1252",),
    "cp1251": ("cp1252", "latin-1", "koi8-r", "mac_roman", "cp866", "cp850"), "koi8-r": ("cp1251", "cp1252", "latin-1", "cp866"), "cp866": ("cp1251", "cp1252", "koi8-r", "latin-1"),
    "cp1250": ("cp1252", "latin-1", "cp1251", "cp850"), "iso8859-2": ("cp1252", "latin-1"), "mac_cyrillic": ("cp1251", "cp1252"),
}.items() for wrong in wrongs)

# The automaton of well-formed multibyte sequences, over bytes written as Latin-1 characters.
_TAIL = "[\x80-\xbf]"
_SPAN = re.compile(
    f"(?:[\xc2-\xdf]{_TAIL}|\xe0[\xa0-\xbf]{_TAIL}|[\xe1-\xec\xee\xef]{_TAIL}{{2}}|\xed[\x80-\x9f]{_TAIL}"
    f"|\xf0[\x90-\xbf]{_TAIL}{{2}}|[\xf1-\xf3]{_TAIL}{{3}}|\xf4[\x80-\x8f]{_TAIL}{{2}})+"
)
_SUSPECT = re.compile("[^\x01-\x7f]")
_OPEN, _CLOSE = "“\"'‘«„‚‹`(", "”\"'’»“‘›`)"


@lru_cache(None)
def _to_bytes(codec: str) -> dict[int, int]:
    """str.translate table from characters to bytes; what the code page lacks becomes 0xFF, never well-formed."""
    table = {o: o if o < 0xA0 else 0xFF for o in range(0x80, 0x100)}  # control characters come from mixed readings
    for byte in range(0x80, 0x100):
        try:
            table[ord(bytes([byte]).decode(codec))] = byte
        except UnicodeDecodeError:
            table[byte] = byte  # an unassigned byte is usually read as the control character
    return table


def _plausible(c: str) -> bool:
    """Would a reader expect the character in a document? The blocks that garbling hits in practice."""
    o = ord(c)
    if o < 0xA0:
        return False
    if o < 0x180 or 0x2010 <= o <= 0x2044 or 0x20A0 <= o <= 0x20BF or 0x2100 <= o <= 0x22FF or 0x2500 <= o <= 0x27BF:
        return True
    if o in (0x401, 0x451) or 0x410 <= o <= 0x44F or o in (0x404, 0x406, 0x407, 0x454, 0x456, 0x457, 0x490, 0x491, 0x218, 0x219, 0x21A, 0x21B, 0x2C6, 0x2DC, 0xFEFF, 0x2007, 0x2009, 0x200B, 0x202F):
        return True
    if 0x386 <= o <= 0x3CE or 0x5D0 <= o <= 0x5EA or 0x621 <= o <= 0x652 or 0x1E00 <= o <= 0x1EFF or 0xFE0F == o:
        return True
    return 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0xF900 <= o <= 0xFAFF or 0xFF00 <= o <= 0xFFEF or 0x1F000 <= o <= 0x1FAFF


def _quoted(text: str, start: int, end: int) -> bool:
    return 0 < start and end < len(text) and text[start - 1] in _OPEN and text[end] in _CLOSE


def _latin_beside(text: str, start: int, end: int) -> bool:
    return any("a" <= c.lower() <= "z" for c in (text[start - 1 : start] + text[end : end + 1]))


_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_SOUND_AFTER_CAPITAL = set("»«–—“”’‘…№ёЁ°\xa0")


def multibyte_spans(text: str, codec: str, runs: list[tuple[int, str]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of maximal well-formed spans with plausible characters.

    Only runs of two or more characters beyond ASCII can hold one, so only those are mapped."""
    if runs is None:
        runs = [(m.start(), m.group()) for m in _RUN.finditer(text)]
    found = []
    as_bytes = " ".join(r for _, r in runs).translate(_to_bytes(codec))
    ends = list(accumulate(len(r) + 1 for _, r in runs))
    for m in _SPAN.finditer(as_bytes):
        k = bisect_right(ends, m.start())
        start = runs[k][0] + m.start() - (ends[k - 1] if k else 0)
        end = start + len(m.group())
        decoded = m.group().encode("latin-1").decode("utf-8")
        if not all(map(_plausible, decoded)) or _quoted(text, start, end):
            continue
        if any("\u3000" <= c <= "\ud7ff" for c in decoded) and (len(decoded) == 1 or codec in ("cp1251", "koi8-r", "cp866")):
            continue  # an ideograph by chance
        # Cyrillic code pages: a capital before a mark can be sound writing
        if codec in ("cp1251", "koi8-r", "cp866") and end - start < 3 and text[end - 1] in _SOUND_AFTER_CAPITAL and not _latin_beside(text, start, end):
            continue
        found.append((start, end, decoded))
    return found


def _undo_multibyte(text: str) -> tuple[str, str] | None:
    best: tuple[int, str, list[tuple[int, int, str]]] | None = None
    runs = [(m.start(), m.group()) for m in _RUN.finditer(text)]
    for codec in READ_AS if runs else ():
        spans = multibyte_spans(text, codec, runs)
        gain = sum(end - start for start, end, _ in spans)
        if gain and (best is None or gain > best[0]):
            best = gain, codec, spans
    if best is None:
        return None
    parts, at = [], 0
    for start, end, decoded in best[2]:
        parts += [text[at:start], decoded]
        at = end
    return "".join([*parts, text[at:]]), f"utf-8 as {best[1]}"


_ENTITY = re.compile(r"&(?:#[0-9]{2,7}|#[xX][0-9A-Fa-f]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});")


def _undo_entities(text: str) -> tuple[str, str] | None:
    """The same where the misread characters stand as entities: spans over the text with those written out."""
    flat, places, at = [], [], 0
    for m in _ENTITY.finditer(text):
        char = html.unescape(m.group())
        if len(char) != 1 or char < "\x80":
            continue
        flat += [text[at : m.start()], char]
        places.append((sum(map(len, flat[-2:])) + (places[-1][0] if places else 0), m.end()))
        at = m.end()
    if not places:
        return None
    plain = "".join([*flat, text[at:]])
    runs = [(m.start(), m.group()) for m in _RUN.finditer(plain)]
    found = [(codec, multibyte_spans(plain, codec, runs)) for codec in READ_AS] if runs else []
    codec, spans = max(found, key=lambda x: sum(e - s for s, e, _ in x[1]), default=("", []))
    if not spans:
        return None
    flat_ends = [p for p, _ in places]

    def source(i: int) -> int:
        """Where the flat text's place i stands in the text: behind the last entity that ends at or before it."""
        k = bisect_right(flat_ends, i) - 1
        return i if k < 0 else places[k][1] + i - flat_ends[k]

    parts, at = [], 0
    for start, end, decoded in spans:
        # a span may begin with an entity, which is longer than its one character
        begin = source(start)
        parts += [text[at:begin], decoded]
        at = source(end)
    return "".join([*parts, text[at:]]), f"utf-8 as {codec} in entities"


_ZEROS = re.compile(r"(?:[\x00-\xff]\x00){4,}|(?:\x00[\x00-\xff]){4,}|(?:[\x00-\xff]\x04){4,}|(?:\x04[\x00-\xff]){4,}")
_NEAR = re.compile(r"[\x00\x04]")


def _undo_utf16(text: str) -> tuple[str, str] | None:
    m = _ZEROS.search(text) if "\x00" in text or "\x04" in text else None
    if not m:
        return None
    start = end = m.start()
    while start >= 2 and text[start - 1] in "\x00\x04 " and "\x00" in text[max(0, start - 8) : start]:
        start -= 2
    for z in _NEAR.finditer(text, m.start()):
        if z.start() - end > 6:
            break
        end = z.end()
    for order in ("utf-16-le", "utf-16-be"):
        for shift in (0, 1, -1):
            for stop in (0, 1):
                part = text[max(0, start + shift) : end + stop]
                if len(part) % 2 or any(ord(c) > 255 for c in part):
                    continue
                try:
                    decoded = part.encode("latin-1").decode(order)
                except UnicodeDecodeError:
                    continue
                if all(c.isprintable() or c in "\n\r\t" for c in decoded):
                    return text[: max(0, start + shift)] + decoded + text[end + stop :], f"{order} by bytes"
    return None


# ---- one code page read as another --------------------------------------------------------
#: Words with a character beyond ASCII; the separators beyond ASCII are left out of the class.
_BEYOND = "[^\x00-\x7f“”„…–—•\u2000-\u200a\u3000]"
_WORD = re.compile(f"(?<![0-9A-Za-z\x7f])[0-9A-Za-z\x7f]*+{_BEYOND}(?:[0-9A-Za-z\x7f]|{_BEYOND})*+")
_USUAL = set("áéíóúàèìòùâêîôûäëïöüãõñçåøæœßÿýąćęłńśźżščřžůěďťňőűğışăîșțđ")
_ORDINARY_SIGNS = set("’‘'°²³½¼¾º¹ª€£¥§©®™«»¿¡·µ‰±×№†‡‹›\xa0\xad  ​﻿")


def _letters(word: str) -> int:
    return sum(c.isalpha() for c in word)


@lru_cache(200_000)
def odd_word(word: str) -> bool:
    """Is this a word that no language writes?"""
    bare = word.strip("’‘'«»‹›¿¡")
    if _letters(bare) < 2 and not (bare[1:] and bare[1:].islower()):
        return False
    inner = bare[1:-1]
    lower = sum(c.islower() for c in bare)
    for i, c in enumerate(bare):
        o = ord(c)
        if o < 0x80 or c == "’" or c == "‘":
            continue
        left, right = bare[i - 1 : i], bare[i + 1 : i + 2]
        if not c.isalpha() or c in "ªºµˆ˜ˇ":
            if o > 0x259F:
                continue
            beside = left.isalpha() and right.isalpha() and (left < "\x80" or right < "\x80")
            if c in "°²³½¼¾º¹ªµ‰" and not (left.isalpha() and right.isalpha() and right.islower()):
                continue
            if c in "\xad\xa0" and not ("Ѐ" <= left <= "ӿ" or "Ѐ" <= right <= "ӿ"):
                continue
            if beside or (0x2500 <= o <= 0x259F and (left.isalpha() or right.isalpha())) or (c not in "€£¥§©®™·±×№«»" and i == 0 and right.islower() and len(bare) > 2 and not c.isspace() and o < 0x2190):
                return True
        elif c in "þðÞÐﬂﬁÝý" and lower and not c.isascii():
            return c != "ý"
        elif c.isupper() and i and left.islower() and (not right or right.islower()) and o < 0x180:
            return True
        elif c.isupper() and i == 0 and o < 0x100 and right.islower() and c.lower() not in _USUAL:
            return True
    if re.fullmatch(r"[À-ÿ]{3,}", bare) and bare not in ("ÉTÉ", "été"):
        return True
    cyrillic = [c for c in bare if "Ѐ" <= c <= "ӿ"]
    if len(cyrillic) >= 3:
        if bare[0].islower() and sum(c.isupper() for c in cyrillic) >= len(cyrillic) - 1 >= 2:
            return True
        if any(c in "ЂЃЉЊЌЋЏђѓљњќћџЎўЄєҐґЇїІіЈјЅѕ" or c in "¤¦¨®­«»¬¶" for c in inner):
            return True
    return len(cyrillic) >= 1 and any("a" <= c.lower() <= "z" for c in bare) and len(bare) > 3 and any(c in "ГВРСЃЎў" for c in bare)


def _natural(word: str) -> bool:
    if not word or odd_word(word):
        return False
    letters = [c for c in word if c.isalpha()]
    if not letters:
        return False
    scripts = {"c" if "Ѐ" <= c <= "ӿ" else "l" for c in letters}
    if len(scripts) > 1:
        return False
    for c in word:
        if ord(c) >= 0x80 and not ("А" <= c <= "я" or c in "ёЁ" or c.lower() in _USUAL or c in "’‘“”«»…–—„€£°ºª¿¡"):
            return False
    body = "".join(letters)
    return body.islower() or body.isupper() or body[1:].islower() or (len(body) > 2 and word.count("’") > 0)


@lru_cache(None)
def _swap_table(wrong: str, right: str) -> dict[int, str | None]:
    """Each character of the wrong code page to the right one's under the same byte."""
    out: dict[int, str | None] = {}
    for byte in range(0x80, 0x100):
        try:
            out[ord(bytes([byte]).decode(wrong))] = bytes([byte]).decode(right)
        except UnicodeDecodeError:
            continue
    return out


@lru_cache(200_000)
def _swapped(word: str, wrong: str, right: str) -> str | None:
    table = _swap_table(wrong, right)
    if any(ord(c) >= 0x80 and ord(c) not in table for c in word):
        return None
    out = word.translate(table)
    return out if out != word and _natural(out) else None


def _words(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]


def _odd(text: str, words: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return [(s, e, w) for s, e, w in words if odd_word(w) and not _quoted(text, s, e)]


def _undo_swap(text: str, beside: bool = False) -> tuple[str, str] | None:
    """beside: sound words change only in an unbroken row of words with an odd one, for other passages are mended already."""
    words = _words(text)
    odd = _odd(text, words)
    if not odd:
        return None
    best: tuple[int, str, str] | None = None
    for wrong, right in SWAPS:
        mended = sum(_swapped(w, wrong, right) is not None for _, _, w in odd)
        if mended and (best is None or mended > best[0]):
            best = mended, wrong, right
    if best is None or best[0] * 3 < len(odd):
        return None
    _, wrong, right = best
    mended_words = [_swapped(w, wrong, right) for _, _, w in words]
    inside = [not beside] * len(words)
    if beside:
        starts = {s for s, _, _ in odd}
        for way in (range(len(words)), reversed(range(len(words)))):
            near = False
            for i in way:
                near = mended_words[i] is not None and (near or words[i][0] in starts)
                inside[i] |= near
    parts, at = [], 0
    for (s, e, _), new, ours in zip(words, mended_words, inside, strict=True):
        if new is not None and ours:
            parts += [text[at:s], new]
            at = e
    return "".join([*parts, text[at:]]), f"{right} as {wrong}"


@lru_cache(None)
def _quote_letters() -> tuple[tuple[str, str, str, str, re.Pattern[str]], ...]:
    """(wrong, right, letters, pattern): pairs of code pages under which the quotation marks of one are letters of the other."""
    out = []
    for wrong, right in SWAPS:
        try:
            first, last = ("“".encode(right).decode(wrong), "”".encode(right).decode(wrong))
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
        if first.isalpha() and last.isalpha():
            out.append((wrong, right, first, last, re.compile(rf"(?<!\w){first}(?=[A-Za-z])([^{first}{last}\n]*)(?<=[A-Za-z.,!?]){last}(?!\w)")))
    return tuple(out)


def _undo_quotes(text: str) -> tuple[str, str] | None:
    """Quotations whose marks became letters glued to the first and the last word."""
    for wrong, right, first, last, pattern in _quote_letters():
        if first in text and last in text and (mended := pattern.sub(r"“\1”", text)) != text:
            return mended, f"{right} as {wrong}"
    return None


def _lost(text: str) -> bool:
    return any(not _quoted(text, m.start(), m.end()) for m in re.finditer("�+", text))


def restore(text: str | None) -> tuple[bool, str | None, list[str], bool]:
    """(affected, text as far as it can be had, steps taken, whole)."""
    if not text or not (_SUSPECT.search(text) or _ENTITY.search(text)):
        return False, text, [], True
    steps: list[str] = []
    now = text
    seen = {now}
    while (done := _undo_utf16(now) or _undo_entities(now) or _undo_multibyte(now) or _undo_swap(now, bool(steps)) or _undo_quotes(now)) is not None and done[0] not in seen:
        now, step = done
        seen.add(now)
        steps.append(step)
    lost = _lost(now)
    left = lost or bool(("\x00" in now or "\x04" in now) and _ZEROS.search(now) or _odd(now, _words(now)))
    return bool(steps) or lost, unicodedata.normalize("NFC", now) if steps else now, [*steps, "lost"] if lost else steps, not left


_RESULT = T.StructType([T.StructField("affected", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("steps", T.StringType()), T.StructField("whole", T.BooleanType())])


@F.pandas_udf(_RESULT)
def _restore(texts: pd.Series) -> pd.DataFrame:
    out = [restore(t) for t in texts]
    return pd.DataFrame({"affected": [o[0] for o in out], "restored": [o[1] if o[0] else None for o in out], "steps": ["; ".join(o[2]) for o in out], "whole": [o[3] for o in out]})


def garbled(extractions: DataFrame, id_column: str = "extraction_id", text: str = "text") -> DataFrame:
    """Affected rows: id, steps, restorable, restored_text (null where characters are lost or a passage stays garbled).

    Texts of ASCII characters alone, without entities, are set aside by the JVM before Python sees them."""
    suspect = extractions.select(id_column, text).filter(F.col(text).rlike(r"[^\x01-\x7f]|&(?:#[0-9]{2,7}|#[xX][0-9A-Fa-f]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});"))
    once = _restore.asNondeterministic()  # or the filter behind it would have it evaluated a second time
    judged = suspect.withColumn("_r", once(text)).filter("_r.affected")
    return judged.select(id_column, F.col("_r.steps").alias("steps"), F.col("_r.whole").alias("restorable"), F.when(F.col("_r.whole"), F.col("_r.restored")).alias("restored_text"))
