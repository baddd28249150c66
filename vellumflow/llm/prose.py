"""Per-document text statistics and the class that tells running prose from the rest (problem 9).

Statistics come from one pass over each whole text. Prose of each language group gets a robust
mean and covariance of all statistics: a first estimate from the documents labelled as prose, then
again from all documents within the bulk of those labelled ones, with floors under the variances;
a language group with few documents is drawn towards the model of all. Sums for it are taken in
Spark; only one small matrix a language group reaches the driver. The squared Mahalanobis distance
of a document is the sum of one contribution a statistic, and the contributions are reported. The
distance alone decides whether a document is prose: the cut is where it best divides the labelled
documents. Beyond it the profile of contributions decides between 'list', 'table' and 'junk': the
nearest median profile of labelled documents of one kind. Kinds are those of `PROFILES`.

Labels are read from a bounded sample of documents (`LABELLED_ROWS`, by hash); wrong ones are
outvoted by medians and the cut's count. Without labels the first estimate is of
the medians of all documents, the cut is `CUT`, and the profiles are those expected. Null, empty and blank texts
have no statistics and no class. Repeated texts are judged alike. Language is read off the text by
the frequent words of each language and the script; the stated language isn't trusted. Empty tables
give empty results; extra columns aren't read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.session import checkpointed

STATISTICS = (
    "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_punctuation", "common_word_share", "words_per_unit",
    "entry_share", "row_share", "noise_share", "sentence_share", "repeat_share", "disorder", "entropy", "upper_ratio",
)
#: Smallest standard deviation of each, so that a statistic that hardly varies in prose doesn't rule alone.
FLOORS = (3.0, 0.8, 0.04, 0.05, 0.35, 0.12, 6.0, 0.12, 0.12, 0.12, 0.12, 0.06, 0.06, 0.5, 0.2)
#: Labelled documents that calibrate the cut and the profiles: a sample by hash, so much and no more reaches the driver.
LABELLED_ROWS = 20_000
#: Rows of the model of all documents that each language group's own is mixed with.
PRIOR_ROWS = 50
#: Share of the labelled prose that the model is estimated again from, and how often.
BULK, ROUNDS = 0.9, 3
#: Squared distance of the cut where no label says better.
CUT = 70.0
#: What the kinds of each class are expected to differ in; each counts as much as `PROFILE_ROWS` labelled documents.
PROFILES = (("list", ("entry_share", "sentence_share")), ("table", ("row_share", "sentence_share")), ("junk", ("noise_share", "sentence_share")), ("junk", ("repeat_share",)), ("junk", ("disorder",)))
CLASSES = np.array([name for name, _ in PROFILES], dtype=object)
PROFILE_ROWS = 3
#: Lift below which two frequent words don't belong together.
RARE_PAIR = 0.25
#: Ordered pairs that are taken for granted, so that a few rare ones in a short text say little.
PAIRS_BEFORE = 6

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BULLET = re.compile(r"\s*(?:[-*•▪◦‣·–—+>☐☑✓✔→o○●■□]|\(?(?:\d{1,3}(?:\.\d{1,3})*|[a-zA-Z]|[ivxIVX]{1,5})[.)\]:]|\[\s?[\dxX ]{0,3}\]|\d{1,3}(?:\.\d{1,3})+)(?=\s|$)\s*")
_LABEL = re.compile(r"\s*[^\W\d_][^:=\n.!?]{0,38}?\s*(?::|=|\.{3,}|…+|\t)\s*(?P<value>.*)$")
_TERMINAL = re.compile(r"[.!?…。！？:;]+[\"'”’»)\]」』）]*\s*$")
_ENDS = re.compile(r"[^\W\d_]{2,}[.!?…][\"'”’»)]*(?:\s|$)|[。！？]")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=[^\W\d_a-zа-яà-ÿ]|[\"'“‘«¿¡(])|(?<=[。！？])[”’」』）]*")
_DUMP = re.compile(r"(?:\b[0-9a-fA-F]{2}\s){6}|(?:\b[0-9a-fA-F]{4}\s){6}|[A-Za-z0-9+/=]{45,}")
_DIGIT = re.compile(r"[0-9]")
_SOUND_TOKEN = re.compile(r"[^\w\s]*(?:[^\W\d_]+(?:[-'’./&@][^\W\d_]+)*|[+-]?[\d.,:/%-]+[^\W\d_]{0,3}|[A-Z]{1,4}[\d-]+)[^\w\s]*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_VOWEL = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœąęóıаеёиоуыэюяіїєαεηιουωάέήίόύώ]", re.IGNORECASE)
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzß]{5,}", re.IGNORECASE)
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")


@lru_cache(1 << 16)
def _plausible_word(w: str) -> bool:
    if not w.isascii() and not _VOWEL.search(w):
        return ord(w[0]) > 0x530
    if len(w) > 24 or (len(w) > 2 and not _VOWEL.search(w) and not w.isupper()):
        return False
    if _CLUSTER.search(w) and not w.isupper() and len(_CLUSTER.search(w).group()) > 5:
        return False
    body = w[1:]
    return body.islower() or w.isupper() or w.islower() or "'" in w or "’" in w or len(w) < 3


@lru_cache(1 << 16)
def _sound(token: str) -> bool:
    return bool(_SOUND_TOKEN.fullmatch(token)) and all(map(_plausible_word, _WORD.findall(token)))


def _columns(lines: list[str]) -> np.ndarray:
    """Which lines are rows of columns: a delimiter as often as in most lines, or cells that begin below each other."""
    n = len(lines)
    is_row = np.zeros(n, bool)
    if n < 2:
        return is_row
    for mark, least in (("\t", 1), ("|", 1), (";", 1), (",", 1), ("¦", 1), ("│", 1)):
        counts = np.array([x.strip(" ").count(mark) if mark not in ",;" else len(re.findall(rf"{mark}(?=\S|$)(?![0-9]{{2}}(?:\D|$))" if mark == "," else rf"{mark}(?! )", x)) for x in lines])
        have = counts[counts >= least]
        if len(have) < 2:
            continue
        mode, times = Counter(have.tolist()).most_common(1)[0]
        loose = 2 if mark in ",;" and mode < 2 else 1
        if times >= max(2, 0.6 * len(have)) and len(have) >= 0.4 * n and mode >= loose:
            is_row |= counts == mode
            is_row |= (counts >= least) & (np.abs(counts - mode) <= 1) & (mode >= 3)
    starts = [[0, *[m.end() for m in _GAP.finditer(x.rstrip())]] for x in lines]
    many = [s for s in starts if len(s) > 1]
    if len(many) >= 2:
        common = Counter(p for s in many for p in set(s[1:]))
        kept = {p for p, c in common.items() if c >= max(2, 0.45 * len(many))}
        aligned = np.array([len(s) > 1 and sum(p in kept for p in s[1:]) >= 0.6 * (len(s) - 1) for s in starts])
        # right-aligned columns end below each other instead
        ends = [[m.start() for m in _GAP.finditer(x.rstrip())] + [len(x.rstrip())] for x in lines]
        common = Counter(p for s in ends if len(s) > 1 for p in set(s))
        kept = {p for p, c in common.items() if c >= max(2, 0.45 * len(many))}
        aligned |= np.array([len(s) > 1 and sum(p in kept for p in s) >= 0.6 * len(s) for s in ends])
        if aligned.sum() >= max(2, 0.4 * n):
            is_row |= aligned
    return is_row


class Statistics:
    def __init__(self, common: dict[str, set[str]], lift: dict[str, dict[tuple[str, str], float]] | None = None) -> None:
        self.common = common
        self.lift = lift or {}

    def language(self, words: list[str], text: str) -> tuple[str, float]:
        """(language group, share of its frequent words)."""
        if not words:
            return "none", 0.0
        times = Counter(words)
        shares = {lang: sum(times[w] for w in times.keys() & own) / len(words) for lang, own in self.common.items()}
        lang, share = max(shares.items(), key=lambda x: x[1], default=("none", 0.0))
        if len(_CJK.findall(text)) > 0.2 * len(text):
            return "cjk", 0.3
        if share >= 0.2:
            return lang, share
        cyrillic = sum("Ѐ" <= w[0] <= "ӿ" for w in words) > len(words) / 2
        return ("cyrillic" if cyrillic else "latin"), share

    def of(self, text: str) -> tuple[str, list[float]] | None:
        """(language group, statistics)."""
        if text is None or not text.strip():
            return None
        text = unicodedata.normalize("NFC", text)
        lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ").replace("\x0c", "\n").split("\n") if x.strip()]
        words = _WORD.findall(text)
        lower = [w.lower() for w in words]
        group, share = self.language(lower, text)
        cjk = group == "cjk"
        solid = sum(len(x.strip()) for x in lines)
        rows = _columns(lines)
        weights = {"sentence": 0.0, "entry": 0.0, "row": 0.0, "noise": 0.0}
        units, unit_words = 0, 0
        for kind, unit, alone in self._units(lines, rows, cjk):
            size = len(unit)
            if kind is None:
                kind = self._kind(unit, group, cjk, alone)
            weights[kind] += size
            units += 1
            unit_words += len(unit.split()) if not cjk else size / 2
        total = sum(weights.values()) or 1.0
        repeated = self.repeats(text, lower, cjk)
        disorder = self.disorder(lower, group)
        chars = Counter(text)
        letters = sum(c for x, c in chars.items() if x.isalpha()) or 1
        blank = sum(c for x, c in chars.items() if x.isspace())
        visible = max(1, len(text) - blank)
        digits = sum(c for x, c in chars.items() if x.isdigit())
        symbols = visible - digits - sum(c for x, c in chars.items() if x.isalpha())
        probabilities = np.fromiter(chars.values(), float) / len(text)
        stats = [
            math.log1p(len(words) if not cjk else solid / 2), sum(map(len, words)) / len(words) if words and not cjk else 5.0 if cjk else 0.0, symbols / visible, digits / visible,
            sum(bool(_TERMINAL.search(x)) for x in lines) / len(lines), share, min(60.0, unit_words / max(1, units)),
            weights["entry"] / total, weights["row"] / total, weights["noise"] / total, weights["sentence"] / total, repeated, disorder, float(-(probabilities * np.log2(probabilities)).sum()),
            sum(c for x, c in chars.items() if x.isupper()) / letters,
        ]
        return group, stats

    def _units(self, lines: list[str], rows: np.ndarray, cjk: bool) -> Iterator[tuple[str | None, str, bool]]:
        """(kind if known, unit, is a line by itself): wrapped lines joined and cut at sentence ends, rows as they are."""
        width = max(map(len, lines))
        labels = rows.any() and np.mean([bool(re.match(r"\s*[^:=\t|;]{1,40}[:=]\s*[\t|;]", x)) for x, r in zip(lines, rows, strict=True) if r]) > 0.6
        # without sentence ends there is nothing to wrap: each line stands by itself
        loose = sum(len(_ENDS.findall(x)) for x in lines) < 0.15 * len(lines) and np.mean([x.lstrip()[:1].isupper() for x in lines]) < 0.5
        held, count, ends_short, ends_open = "", 0, False, False

        def flush() -> Iterator[tuple[str | None, str, bool]]:
            cut = [u for u in _SPLIT.split(held) if u.strip()]
            yield from ((None, u, count == 1 and len(cut) == 1) for u in cut)

        for i, line in enumerate(lines):
            text = line.strip()
            if rows[i] and not self._sentences(text, cjk):
                if held:
                    yield from flush()
                    held, count = "", 0
                yield "noise" if _DUMP.search(text) else "entry" if labels else "row", text, True
                continue
            fresh = bool(_BULLET.match(line)) or bool(_LABEL.match(line) and len(text) < 60)
            if held and (fresh or loose or ends_short or not ends_open):
                yield from flush()
                held, count = "", 0
            held = f"{held} {text}" if held and not cjk else held + text
            count += 1
            ends_open = text[-1] not in ".!?…。！？"
            ends_short = len(text) < 32 or (len(text) < 0.6 * width)
        if held:
            yield from flush()

    def _sentences(self, text: str, cjk: bool) -> bool:
        """Full sentences by their ends, whatever delimiters are in them."""
        if cjk:
            return bool(re.search(r"[。！？]", text)) and "\t" not in text and "|" not in text
        return bool(re.search(r"[^\W\d_]{2,}[.!?][\"'”’»)]*$", text)) and "\t" not in text and "|" not in text and len(_WORD.findall(text)) >= 6 and text[:1] not in "-*•"

    def _kind(self, unit: str, group: str, cjk: bool, alone: bool) -> str:
        body = unit
        marked = _BULLET.match(unit)
        if marked:
            body = unit[marked.end() :]
        words = _WORD.findall(body)
        tokens = body.split()
        if cjk and _CJK.search(body):
            return "sentence" if len(body) >= 8 and (re.search(r"[。！？，、]", body) or len(body) >= 20) else "entry"
        visible = sum(map(len, tokens)) or 1
        letters = sum(map(len, words))
        plain = [w for w in words if _plausible_word(w)]
        sound = sum(len(t) for t in tokens if _sound(t))
        longest = max(map(len, tokens), default=0)
        label = _LABEL.match(unit)
        if label and len(unit) < 90 and len(_WORD.findall(label["value"])) <= 5:
            return "entry"
        if (marked or len(tokens) <= 3) and len(words) <= 4 and longest <= 30 and (letters >= 0.3 * visible or any(c.isdigit() for c in body)) and len(plain) >= 0.5 * len(words) and not re.fullmatch(r"[\W_]+", body):
            return "entry"
        if (longest >= 45 or _DIGIT.search(body)) and _DUMP.search(body):
            return "noise"
        if letters < 0.45 * visible or sound < 0.6 * visible or (longest > 60 and letters > 0):
            joined = longest > 60 and len(plain) < 3 and _joined_prose(body)
            return "sentence" if joined else "noise"
        lower = [w.lower() for w in words]
        common = self.common.get(group)
        frequent = sum(w in common for w in lower) / len(words) if common else 0.3
        ended = bool(re.search(r"[.!?…][\"'”’»)\]]*\s*$", body))
        upper = body.lstrip("\"'“‘«¿¡([–—- ")[:1].isupper()
        if not upper and body[:1].islower() and len(words) < (9 if ended and not marked else 14) and (marked or alone):
            return "entry"
        if len(words) >= 5 and frequent >= 0.12 and (upper or ended) and not body.rstrip().endswith((",", ";")):
            return "sentence"
        if len(words) >= 4 and ended and upper and frequent > 0:
            return "sentence"
        if len(words) >= 14 and not marked and frequent >= 0.12:
            return "sentence"
        return "entry"

    @staticmethod
    def repeats(text: str, lower: list[str], cjk: bool) -> float:
        """Share of places whose next four words (six characters without spaces) were there before, more than twice."""
        if cjk or len(lower) < 8:
            counts, n = Counter(text[i : i + 6] for i in range(len(text) - 5)), max(1, len(text) - 5)
        else:
            counts, n = Counter(zip(lower, lower[1:], lower[2:], lower[3:], strict=False)), len(lower) - 3
        often = max(3, 0.02 * n)
        return sum(c for c in counts.values() if c > often) / n

    def disorder(self, lower: list[str], group: str) -> float:
        """Share of neighbouring frequent words that stand together far less often than by chance."""
        own, lift = self.common.get(group), self.lift.get(group)
        if own is None or lift is None:
            return 0.0
        pairs = [p for p in zip(lower, lower[1:], strict=False) if p[0] in own and p[1] in own]
        return sum(lift.get(p, 0.0) < RARE_PAIR for p in pairs) / (len(pairs) + PAIRS_BEFORE)


def _joined_prose(body: str) -> bool:
    """Sentences whose spaces were lost, or turned into another sign."""
    spaced = re.sub(r"[_.·+%20]+", " ", body)
    if len(_WORD.findall(spaced)) >= 8 and sum(map(_plausible_word, _WORD.findall(spaced))) >= 0.8 * len(_WORD.findall(spaced)):
        return True
    letters = sum(c.isalpha() for c in body)
    vowels = len(_VOWEL.findall(body))
    return letters > 0.85 * len(body) and 0.3 < vowels / max(1, letters) < 0.5 and sum(c.isupper() for c in body) < 0.2 * letters and not _CLUSTER.search(body.replace("sch", ""))


Lift = dict[str, dict[tuple[str, str], float]]


def frequent_words(common_words: DataFrame) -> dict[str, set[str]]:
    common: dict[str, set[str]] = {}
    for row in common_words.select("lang", "word").collect():  # fixed table of some 280 rows
        if row["lang"] and row["word"]:
            common.setdefault(row["lang"].lower(), set()).add(row["word"].lower())
    return common


def pair_counts(text: str, common: dict[str, set[str]], into: Counter) -> None:
    """Adds the neighbouring frequent words of a text under its language; (word, '') counts the word itself."""
    lower = [w.lower() for w in _WORD.findall(text)]
    group, _ = Statistics(common).language(lower, text)
    own = common.get(group)
    if own is not None:
        into.update((group, a, b) for a, b in zip(lower, lower[1:], strict=False) if a in own and b in own)
        into.update((group, w, "") for w in lower if w in own)
        into[group, "", ""] += len(lower)


def lift_of(counts: dict[tuple[str, str, str], float]) -> Lift:
    """How many times as often as by chance two frequent words stand together, by language."""
    out: Lift = {}
    for (group, a, b), n in counts.items():
        if a and b:
            out.setdefault(group, {})[a, b] = n * counts[group, "", ""] / (counts[group, a, ""] * counts[group, b, ""])
    return out


def neighbour_lift(documents: DataFrame, common: dict[str, set[str]]) -> Lift:
    """Counts over all documents; at most 50 x 50 pairs a language of common_words come to the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for part in batches:
            for text in part["text"]:
                pair_counts(text, common, counts)
        yield pd.DataFrame([(*k, float(n)) for k, n in counts.items()], columns=["lang_group", "a", "b", "n"])

    rows = documents.select("text").filter(F.col("text").isNotNull()).mapInPandas(partial, "lang_group string, a string, b string, n double").groupBy("lang_group", "a", "b").agg(F.sum("n").alias("n")).collect()
    return lift_of({(r["lang_group"], r["a"], r["b"]): r["n"] for r in rows})


def _statistics_schema() -> str:
    return "doc_id long, lang_group string, " + ", ".join(f"{s} double" for s in STATISTICS)


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, lang_group and the statistics, for every document with text."""
    common = frequent_words(common_words)
    lift = neighbour_lift(documents, common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        statistics = Statistics(common, lift)
        for part in batches:
            out = [(i, found[0], *found[1]) for i, t in zip(part["doc_id"], part["text"], strict=True) if (found := statistics.of(t)) is not None]
            yield pd.DataFrame(out, columns=["doc_id", "lang_group", *STATISTICS])

    return documents.select("doc_id", "text").filter(F.col("text").isNotNull()).mapInPandas(run, _statistics_schema())


Model = dict[str, tuple[np.ndarray, np.ndarray]]
Moments = dict[str, tuple[float, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Fitted:
    """(mean, inverse covariance) by language group, the cut of the squared distance, and the profiles of `PROFILES`."""

    model: Model
    cut: float
    profiles: np.ndarray


def _packed(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), (x.T @ x)[np.triu_indices(x.shape[1])]])


def _unpacked(row: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    k = len(STATISTICS)
    products = np.zeros((k, k))
    products[np.triu_indices(k)] = row[1 + k :]
    return row[0], row[1 : 1 + k], products + np.triu(products, 1).T


def _medians(stats: DataFrame) -> Model:
    """Medians and absolute deviations from them of all documents, where no label says which are prose."""
    middle = np.array(stats.agg(*[F.coalesce(F.percentile_approx(s, 0.5), F.lit(0.0)).alias(s) for s in STATISTICS]).first())
    spread = np.array(stats.agg(*[F.coalesce(F.percentile_approx(F.abs(F.col(s) - float(m)), 0.5), F.lit(0.0)).alias(s) for s, m in zip(STATISTICS, middle, strict=True)]).first())
    return {"*": (middle, np.diag(1 / (np.square(1.4826 * spread) + np.square(FLOORS))))}


def _moments(stats: DataFrame, model: Model, within: float) -> Moments:
    """Count, sums and products by language group of the documents within a squared distance of a model."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in batches:
            x, groups = part[list(STATISTICS)].to_numpy(), part["lang_group"].to_numpy()
            keep = distances(x, groups.tolist(), model)[0] <= within
            for group in set(groups):
                sums[group] = sums.get(group, 0) + _packed(x[keep & (groups == group)])
        for group, row in sums.items():
            yield pd.DataFrame({"lang_group": group, "at": np.arange(len(row)), "value": row})

    rows = stats.mapInPandas(partial, "lang_group string, at int, value double").groupBy("lang_group", "at").agg(F.sum("value").alias("value")).collect()
    k = len(STATISTICS)
    out: dict[str, np.ndarray] = {}
    for r in rows:  # language groups x 136 numbers
        out.setdefault(r["lang_group"], np.zeros(1 + k + k * (k + 1) // 2))[r["at"]] = r["value"]
    return {group: _unpacked(row) for group, row in out.items()}


def estimate(moments: Moments) -> Model:
    """The model of all groups ('*'), and each group's own mixed with `PRIOR_ROWS` rows of it."""
    floors = np.diag(np.square(FLOORS))
    n, s, p = (sum(m[i] for m in moments.values()) for i in range(3)) if moments else (0, 0, 0)
    mean = s / n if n else np.zeros(len(FLOORS))
    second = p / n if n else np.outer(mean, mean)
    model = {"*": (mean, np.linalg.inv(second - np.outer(mean, mean) + floors))}
    for group, (n1, s1, p1) in moments.items():
        own = (s1 + PRIOR_ROWS * mean) / (n1 + PRIOR_ROWS)
        model[group] = own, np.linalg.inv((p1 + PRIOR_ROWS * second) / (n1 + PRIOR_ROWS) - np.outer(own, own) + floors)
    return model


def distances(x: np.ndarray, groups: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Squared Mahalanobis distances, and the contribution of each statistic; contributions sum to the distance."""
    parts = np.zeros_like(x)
    names = np.array(groups, dtype=object)
    for group in set(groups):
        at = names == group
        mean, inverse = model.get(group, model["*"])
        d = x[at] - mean
        parts[at] = d * (d @ inverse)
    return parts.sum(1), parts


def profile(parts: np.ndarray) -> np.ndarray:
    """Contributions as directions: roots of their shares of the distance."""
    positive = np.maximum(parts, 0)
    return np.sqrt(positive / np.maximum(positive.sum(1, keepdims=True), 1e-9))


def dividing_cut(squared: np.ndarray, strange: np.ndarray) -> float:
    """The cut with the fewest labelled documents on the wrong side; of several the middle of the widest gap."""
    if not strange.any() or strange.all():
        return CUT
    at = np.sort(squared)
    order = np.argsort(squared)
    # documents up to place i are within: strange ones there and others beyond are wrong
    wrong = np.cumsum(strange[order]) + (~strange).sum() - np.cumsum(~strange[order])
    gap = np.log(np.append(at[1:], at[-1]) + 1e-9) - np.log(at + 1e-9)
    i = max(np.flatnonzero(wrong == wrong.min()), key=lambda j: gap[j])
    return float(at[i] * np.exp(gap[i] / 2))


def labelled_sample(stats: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> pd.DataFrame:
    """The statistics of at most `rows` labelled documents, lowest hashes first; of several labels of one document the most frequent."""
    named = labels.select("doc_id", F.lower(F.trim("label")).alias("label")).filter(F.col("label").isin("prose", *CLASSES) & F.col("doc_id").isNotNull())
    voted = named.groupBy("doc_id", "label").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    sample = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return stats.join(F.broadcast(sample), "doc_id").toPandas()  # both bounded by rows


def fit(stats: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Fitted:
    sample = labelled_sample(stats, labels, rows)
    x, groups, label = sample[list(STATISTICS)].to_numpy(float), sample["lang_group"].to_numpy(), sample["label"].to_numpy()
    prose = label == "prose"
    if prose.any():
        model = estimate({g: _unpacked(_packed(x[prose & (groups == g)])) for g in set(groups[prose])})
    else:
        model = _medians(stats)
    for _ in range(ROUNDS):
        within = np.quantile(distances(x[prose], groups[prose].tolist(), model)[0], BULK) if prose.any() else 2.0 * len(STATISTICS)
        model = estimate(_moments(stats, model, float(within)))
    squared, parts = distances(x, groups.tolist(), model)
    cut = dividing_cut(squared, ~prose)
    return Fitted(model, cut, profiles_of(profile(parts)[squared > cut], label[squared > cut]))


def nearest(found: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    return np.square(found[:, None] - profiles).sum(2).argmin(1)


def profiles_of(found: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The median profile of each kind: labelled documents of its class that are nearest to what it is expected to be."""
    expected = np.array([[(s in members) * len(members) ** -0.5 for s in STATISTICS] for _, members in PROFILES])
    out = expected.copy()
    for name in set(CLASSES):
        kinds, own = np.flatnonzero(name == CLASSES), found[label == name]
        kind = kinds[nearest(own, expected[kinds])]
        for k in kinds:
            out[k] = np.median(np.vstack([own[kind == k], np.repeat(expected[k : k + 1], PROFILE_ROWS, 0)]), axis=0)
    return out


def classify(stats: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, lang_group, statistics, distance, contributions (a map), text_class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            squared, parts = distances(part[list(STATISTICS)].to_numpy(), part["lang_group"].tolist(), fitted.model)
            picked = CLASSES[nearest(profile(parts), fitted.profiles)]
            yield part.assign(distance=np.sqrt(np.maximum(0, squared)), contributions=[dict(zip(STATISTICS, row, strict=True)) for row in parts.tolist()], text_class=np.where(squared > fitted.cut, picked, "prose"))

    return stats.mapInPandas(run, _statistics_schema() + ", distance double, contributions map<string,double>, text_class string")


def judged(documents: DataFrame, common_words: DataFrame, labels: DataFrame) -> DataFrame:
    stats = checkpointed(document_statistics(documents, common_words))
    return classify(stats, fit(stats, labels))
