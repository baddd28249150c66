"""Personal data in free text: a linear-chain conditional random field over word shapes (problem 5).

Tokens are words, numbers with their separators, mail addresses in any spelling, and marks. The
score of a label at a token is the sum over a window of per-token features (word, shape, ending,
digit groups, small word lists), so a token's part is computed once and kept; batches of tokens
then sum table rows in numpy and Viterbi runs over all sequences of a batch together. The field
is trained on the driver from `pii_examples`, in a few seconds, and broadcast; its size is that
of the example table.

Decoded spans pass an exact check of their form (digits of a number, parts of an address, words
of a name) before they count. Null and empty texts have no spans. Rows of employee_rows that are
delivered twice count once. Texts are judged whole and by themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.pii_examples import labelled_table

TYPES = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{b}-{t}" for t in TYPES for b in "BI"))
WINDOW = range(-5, 4)
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}

# A sign for "at" as it is written, and as wrong decodings leave the full-width one.
_AT_WRITTEN = r"@|＠|\s?[(\[{]\s?(?:at|AT|@)\s?[)\]}]\s?|\s(?:AT|at)\s(?=\w+(?:\s(?:DOT|dot)\s|\.|\s?[(\[]))"
_AT_GARBLED = r"ï¼\xa0|ï¼ |Ôº†|∩╝á|´╝á|пј\xa0|´╝\xa0"
_GARBLED_SIGN = re.compile("ï¼|Ôº|∩╝|´╝|пј")
_DOT = r"(?:\.|．|\s?[(\[{]\s?(?:dot|DOT|\.)\s?[)\]}]\s?|\s(?:DOT|dot)\s)"
_HOST = rf"\s?[^\W_][\w-]*(?:{_DOT}[^\W\d_][\w-]+)+"
_EMAIL = rf"[^\W_](?:[\w+%-]|\.(?=[\w+%-]))*\s?(?:{_AT_WRITTEN}|{_AT_GARBLED}){_HOST}"
#: The same for texts without a garbled sign: what stands before a written one is never given back.
_EMAIL_WRITTEN = rf"[^\W_](?:[\w+%-]|\.(?=[\w+%-]))*+\s?(?:{_AT_WRITTEN}){_HOST}"
_WORDCHAR = r"[^\s\x00-\x2f0-9\x3a-\x40\x5b-\x60\x7b-\x7f“”«»¿¡…–—•]"
_OTHER_TOKENS = (
    r"|(?P<N>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,8}(?: ?[A-Z0-9]{1,3})?\b|\b[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b|\b[A-Z]{1,3}\d+(?: \d{4})?[A-Z]?\b"
    r"|(?:\+ ?\d+|\(\d{1,5}\)|\d+)(?:[ \-–./\xa0]?(?:\(\d+\)|\d+))*[A-Za-z]?(?![\w]))"
    rf"|(?P<I>\b[^\W\d_a-zà-ÿ]\.(?=[\s]|[^\W\d_]))|(?P<W>(?:{_WORDCHAR})+(?:['’.\-¡¿«»„“”…–—‹›](?:{_WORDCHAR})+)*)|(?P<L>\n)|(?P<P>\S)"
)
_TOKEN, _TOKEN_WRITTEN = (re.compile(rf"(?P<E>{e}){_OTHER_TOKENS}") for e in (_EMAIL, _EMAIL_WRITTEN))

# Small word lists; each is a feature, none decides by itself.
_LISTS = {
    "title": "mr mrs ms miss dr prof herr herrn frau m mme mlle madame monsieur sr sra srta señor señora dott ing sir",
    "first": "anna maria sofia leon samuel agnès nadia philip elena søren łucja felix vera oscar joana inés peter marta lena laura robert helen thomas andrew adrian victor zoë judith martin clara simon daniel jürgen karin björn paul marco tomáš andré josé renée nora ruth emma lucas david michael sarah james john william louise pierre jean marie hans eva ivan olga pedro ana luis carlos carmen giulia luca paolo katarzyna piotr jan ines inés hannah sophie julia max niels erik ingrid sven mette émile tomás philippa ricardo isabel",
    "street": "street st road rd lane ln avenue ave drive dr close way terrace court crescent square blvd boulevard place hill walk row parkway straße strasse str gasse weg allee platz ring rue bd avenue impasse place chemin quai allée calle c avda avenida plaza paseo camino via viale piazza rua travessa ulica ul",
    "unit": "apt suite floor unit box bis ter no nr flat",
    "company": "ltd gmbh s.a sa ag inc llc holdings partners logistics instruments foods packaging textiles group media office supply sons trust plc co company bank agency",
    "job": "officer manager director notary witness agent lead chief financial procurement authorised signatory registrar secretary clerk sales plant president head accountant owner",
    "lab_name": "dear contact signed witness attn ansprechpartner firmado unterzeichnet signé prepared handed according remis name sincerely estimado geehrte geehrter entregue gez",
    "lab_phone": "tel tél phone mobile mob telefon teléfono fax call ring reach erreichen joignable llame fax/phone",
    "lab_id": "ssn social security soc sec taxpayer id nino ni insurance passport travel document iban bank account payable card credit national holder holder's paid",
    "lab_mail": "email e-mail mail correo courriel mailto cc reply-to to escriba écrire questions rückfragen",
    "lab_addr": "deliver lives moved home address lieferadresse wohnt adresse habite domicilio vive p.o po",
    "lab_other": "order tracking firmware price container isbn coupon lot part invoice period file clause roughly batch meeting follow account class model code folder serial page seite página cost centre annex table",
}
_FLAGS: dict[str, list[str]] = {}
for _list, _words in _LISTS.items():
    for _word in _words.split():
        _FLAGS.setdefault(_word, []).append(_list)


def tokenize(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of tokens."""
    return [(m.start(), m.end(), m.lastgroup) for m in (_TOKEN if _GARBLED_SIGN.search(text) else _TOKEN_WRITTEN).finditer(text)]


def _shape(word: str) -> str:
    letters = [c for c in word if c.isalpha()]
    if not letters:
        return "sign"
    if len(letters) == 1:
        return "X" if letters[0].isupper() else "x"
    if all(c.isupper() for c in letters):
        return "XX"
    if word[0].isupper() or not (word[0].isalpha() and word[0].isascii() or word[0].islower()):
        return "Xx" if all(c.islower() or not c.isalpha() for c in word[1:]) else "XxX"
    return "x" if all(c.islower() or not c.isalpha() for c in word) else "xX"


@lru_cache(100_000)
def features(kind: str, word: str, centre: bool) -> tuple[str, ...]:
    """Feature names of a token; those of a neighbour are the coarser ones."""
    if not kind:
        return ()
    out = [f"k={kind}"]
    if kind == "N":
        bare = word.strip()
        groups = "-".join(str(len(g)) if g.isdigit() else re.sub(r"\d+", lambda m: str(len(m[0])), re.sub("[A-Za-z]", "A", g)) for g in re.split(r"[ \-–./()\xa0]+", bare.strip("+()")) if g)
        digits = sum(c.isdigit() for c in bare)
        out += [f"g={groups[:24]}", f"d={min(digits, 20)}", f"b={bare[0] if not bare[0].isalnum() else 'A' if bare[0].isalpha() else '0' if bare[0] == '0' else '9'}", f"sep={''.join(sorted(set(re.findall(r'[ –./()-]', bare))))}", f"alpha={any(c.isalpha() for c in bare)}"]
        if centre:
            out += [f"555={'555' in bare}", f"long={digits > 6}", f"short={digits < 5}", f"end={bare[-1].isalpha()}", f"head={re.sub('[0-9]', '9', bare[:2])}"]
    elif kind in "WI":
        lower = word.lower().strip("'’")
        out += [f"w={lower[:20]}", f"s={_shape(word)}"]
        out += [f"l={x}" for x in _FLAGS.get(lower.rstrip("."), ())]
        if lower.endswith(("straße", "strasse", "str", "gasse", "weg", "allee", "platz", "markt")) and len(lower) > 5:
            out.append("l=street")
        if centre:
            out += [f"e={lower[-3:]}", f"n={min(len(word), 8)}"]
    elif kind in "PF":
        out.append(f"w={word}")
    elif kind == "E":
        out += ["w=mail", "s=mail", "l=mail"]
    return tuple(out)


class Field:
    """Weights of the conditional random field, and its decoder."""

    def __init__(self, weights: dict[tuple[int, str], np.ndarray], transitions: np.ndarray, start: np.ndarray) -> None:
        self.weights, self.transitions, self.start = weights, transitions, start
        self.known: dict[tuple[str, str], int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, len(WINDOW), len(LABELS)), np.float32)
        self.size = 0

    def _row(self, kind: str, word: str) -> int:
        key = (kind, word)
        at = self.known.get(key)
        if at is None:
            row = np.zeros((len(WINDOW), len(LABELS)), np.float32)
            for i, offset in enumerate(WINDOW):
                for f in features(kind, word, offset == 0):
                    w = self.weights.get((offset, f))
                    if w is not None:
                        row[i] += w
            if self.size == len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(1024, self.size), *self.table.shape[1:]), np.float32)])
            self.table[self.size] = row
            at = self.known[key] = self.size
            self.size += 1
        return at

    def bounded(self) -> None:
        """Forgets the tokens seen so far once there are many: bounds the memory of a worker. Their numbers end with it."""
        if len(self.known) > 60_000:
            self.known, self.size = {}, 0
            self.table = self.table[:1024]

    def number(self, kind: str, word: str) -> int:
        """The table row of a token, its digits made plain."""
        word = _plain(kind, word) if kind in "NE" else word
        at = self.known.get((kind, word))
        return self._row(kind, word) if at is None else at

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), len(LABELS)), np.float32)
        for i, offset in enumerate(WINDOW):
            # place `offset` of the window looks at the token at t + offset
            part = self.table[ids, i]
            if offset < 0:
                out[-offset:] += part[:offset]
            elif offset:
                out[:-offset] += part[offset:]
            else:
                out += part
        return out

    def viterbi(self, emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Labels of the concatenated sequences, decoded side by side in order of length."""
        labels = np.zeros(len(emissions), np.int8)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        n = len(lengths)
        if not n or not lengths[0]:
            return labels
        score = emissions[starts[lengths > 0]] + self.start
        back: list[np.ndarray] = []
        for t in range(1, int(lengths[0])):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # sequences longer than t
            paths = score[:live, :, None] + self.transitions
            back.append(paths.argmax(1).astype(np.int8))
            done = paths.max(1) + emissions[starts[:live] + t]
            score = np.concatenate([done, score[live:]])
        now = np.zeros(len(score), np.int8)
        last = score.argmax(1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            ending = lengths[:live] == t + 1
            now[:live] = np.where(ending, last[:live], now[:live])
            labels[starts[:live] + t] = now[:live]
            if t:
                now[:live] = back[t - 1][np.arange(live), now[:live]]
        return labels


def _encode(rows: list[tuple[str, list[tuple[int, int, str]], str]]) -> tuple[list[list[tuple[str, str]]], list[list[int]]]:
    sequences, targets = [], []
    for text, spans, context in rows:
        tokens = tokenize(text)
        labels = []
        for start, end, _ in tokens:
            hit = next(((s, k) for s, e, k in spans if s <= start and end <= e), None)
            labels.append(0 if hit is None else LABELS.index(("B-" if start == hit[0] else "I-") + hit[1]))
        begin = 0
        for j in range(len(tokens) + 1):  # lines are decoded by themselves, so they are learned so
            if j == len(tokens) or tokens[j][2] == "L":
                if j > begin:
                    sequences.append([("F", context), *((k, text[s:e]) for s, e, k in tokens[begin:j])])
                    targets.append([0, *labels[begin:j]])
                begin = j + 1
    return sequences, targets


def _by_row(values: np.ndarray, order: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of rows that share a key: `order` sorts them by key, `cuts` are the keys' first places."""
    return np.add.reduceat(values[order], cuts, axis=0)


def train(rows: list[tuple[str, list[tuple[int, int, str]], str]] | None = None, epochs: int = 60, rate: float = 0.12, decay: float = 0.02) -> Field:
    """Maximum likelihood by scaled forward-backward, all sequences side by side, with Adam.

    Emissions go through a table of distinct tokens by window place, so an epoch costs a few
    gathers over the tokens however many features a token has."""
    sequences, targets = _encode(rows or labelled_table())
    by_length = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sequences, targets = [sequences[i] for i in by_length], [targets[i] for i in by_length]
    lengths = np.array([len(s) for s in sequences])
    n_labels, n_places = len(LABELS), len(WINDOW)
    known: dict[tuple[str, str], int] = {}
    ids = np.array([known.setdefault((k, _plain(k, w)), len(known)) for s in sequences for k, w in s])
    firsts = np.cumsum(lengths) - lengths
    names: dict[tuple[int, str], int] = {}
    links = [(t * n_places + i, names.setdefault((offset, f), len(names))) for (k, w), t in known.items() for i, offset in enumerate(WINDOW) for f in features(k, w, offset == 0)]
    cell, feature = np.array(links, np.int64).T
    cells, cell_cuts = np.unique(cell, return_index=True)
    to_feature = np.argsort(feature, kind="stable")
    feature_cuts = np.searchsorted(feature[to_feature], np.arange(len(names)))
    # window place i of position p looks at the token at p + offset, within the sequence
    ends, begins = np.repeat(firsts + lengths, lengths), np.repeat(firsts, lengths)
    position = np.arange(len(ids))
    views = []
    for i, offset in enumerate(WINDOW):
        ok = np.flatnonzero((position + offset >= begins) & (position + offset < ends))
        key = ids[ok + offset] * n_places + i
        order = np.argsort(key, kind="stable")
        found, cuts = np.unique(key[order], return_index=True)
        views.append((ok, key, order, found, cuts))
    gold = np.concatenate([np.array(t, np.int64) for t in targets])
    banned = np.array([[0.0 if y[0] != "I" or x[2:] == y[2:] and x != "O" else -30.0 for y in LABELS] for x in LABELS])
    no_start = np.array([-30.0 if x[0] == "I" else 0.0 for x in LABELS])
    w, trans, start = np.zeros((len(names), n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    inner = np.ones(len(ids), bool)
    inner[firsts] = False
    gold_trans = np.zeros_like(trans)
    np.add.at(gold_trans, (gold[position[inner] - 1], gold[inner]), 1)
    gold_start = np.bincount(gold[firsts], minlength=n_labels).astype(float)
    live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]  # sequences longer than t
    params = [w, trans, start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for epoch in range(1, epochs + 1):
        table = np.zeros((len(known) * n_places, n_labels))
        table[cells] = np.add.reduceat(w[feature], cell_cuts, axis=0)
        emit = np.zeros((len(ids), n_labels))
        for ok, key, *_ in views:
            emit[ok] += table[key]
        e = np.exp(emit - emit.max(1, keepdims=True))
        step = np.exp(trans + banned)
        alpha, scale, beta = np.zeros_like(e), np.ones(len(ids)), np.ones_like(e)
        for t, n in enumerate(live):
            at = firsts[:n] + t
            alpha[at] = e[at] * (np.exp(start + no_start) if t == 0 else alpha[at - 1] @ step)
            scale[at] = alpha[at].sum(1)
            alpha[at] /= scale[at, None]
        pairs = np.zeros_like(trans)
        for t in range(len(live) - 1, 0, -1):
            at = firsts[: live[t]] + t
            into = e[at] * beta[at] / scale[at, None]
            beta[at - 1] = into @ step.T
            pairs += (alpha[at - 1].T @ into) * step
        delta = alpha * beta
        grad_start = delta[firsts].sum(0) - gold_start
        delta[position, gold] -= 1
        grad_table = np.zeros_like(table)
        for ok, _, order, found, cuts in views:
            grad_table[found] += _by_row(delta[ok], order, cuts)
        grads = [_by_row(grad_table[cell], to_feature, feature_cuts) + decay * w, pairs - gold_trans, grad_start]
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            p -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-6)
    return Field({k: w[i].astype(np.float32) for k, i in names.items()}, (trans + banned).astype(np.float32), (start + no_start).astype(np.float32))


@lru_cache(1)
def trained() -> Field:
    """The field fitted once a process to the example table."""
    return train()


#: What a person's name has at most, and how far before a span its title, given name or label may begin.
NAME_WORDS, NAME_LETTERS, LOOK_BACK = 8, 30, 64


# ---- exact checks of a span's form --------------------------------------------------------
_NOT_NAMES = frozenset((*_LISTS["company"].split(), *_LISTS["job"].split(), *_LISTS["street"].split(), "people", "legal", "sales", "operations", "finance", "logistics", "engineering", "marketing", "research", "support", "office", "customer", "sir", "madam", "the", "desk", "department")) - {"dr", "place", "hill", "way", "court", "close", "st", "ring", "row", "walk", "c", "via", "rua"}
_STREET_WORD = re.compile(r"(?i)(?:\b(?:street|st|road|rd|lane|ln|avenue|ave|drive|close|way|terrace|court|crescent|square|blvd|boulevard|place|hill|walk|row|dr|rue|bd|impasse|chemin|quai|allée|calle|avda|avenida|plaza|paseo|camino|rua|via|piazza)\b|\bC/|(?:straße|strasse|str\.|gasse|weg|allee|platz|markt)\b|\bbox\b)")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def sound(kind: str, datum: str) -> bool:
    if kind == "email":
        return bool(re.fullmatch(_EMAIL, datum))
    if kind == "phone":
        return 7 <= _digits(datum) <= 15 and not re.search(r"[A-Za-z]", datum)
    if kind == "id_number":
        return 6 <= _digits(datum) <= 32 and len(re.findall(r"[a-z]", datum)) == 0
    if kind == "address":
        return _digits(datum) > 0 and bool(_STREET_WORD.search(datum)) and not re.search(r"\d{6,}", datum)
    if not datum[0].isalpha() and datum[0] < "\xa0" or datum[0] == "�":
        return False
    words = re.findall(r"[^\W\d_][^\s,.]*", datum)
    if len(re.findall("[A-Za-z]", datum)) < 0.5 * len(datum) or any(len(w) > NAME_LETTERS for w in words):
        return False
    return bool(words) and len(words) <= NAME_WORDS and any(len(w) > 1 for w in words) and not any(c.isdigit() for c in datum) and not any(w.lower() in _NOT_NAMES for w in words) and not all(w.islower() for w in words)


_TITLE = re.compile(rf"(?i)(?:(?:{'|'.join(t for t in _LISTS['title'].split() if t != 'm')})\b\.?|[^\w�]|_)+\s*")
_GARBLED_GIVEN = re.compile(r"(?:^|(?<=\s))[^\W\d_a-zà-ÿ][^\s,.;:()]*[ÃÂƒ�├┼√≈ÔГвЂ║╝╜][^\s,.;:()]*[ \xa0]$")
_COMPANY_NEXT = re.compile(rf"(?i)[ ,\n]+(?:&|(?:{'|'.join(re.escape(w) for w in _LISTS['company'].split() if w not in ('co', 'group', 'media', 'office', 'company', 'bank', 'agency', 'sa', 'sons', 'ag'))})\b|media group|office supply)")
_SENTENCE_BEFORE = re.compile(r"(?<!\bMr)(?<!\bMs)(?<!\bDr)(?<!\bMrs)(?<!\bProf)(?<!\bSr)(?<!\bSra)[.!?…]\s+$")
_GIVEN = re.compile(r"(?:\b[^\W\d_a-z]\.|\b([^\W\d_a-z][^\W\d_]+))[ \xa0]$")
_SURNAME = re.compile(r"[ \xa0]([^\W\d_a-zà-ÿ][^\s,.;:()/<>\[\]]+)")
_NOT_PERSONAL = re.compile(r"(?i)\b(?:order|tracking|container|lot|part|firmware|invoice|isbn|coupon|code|class|model|serial|folder|batch|clause|item|sku|table|centre)(?: (?:no|nr|number|to|with code)\b\.?)?[ :#-]*[A-Z]{0,4}[ -]?$")
_FIRST = frozenset(_LISTS["first"].split())
_UNIT = re.compile(r"(?i)\b(?:apt|suite|floor|unit|#|bis|ter|p\.?\s?o)\b|\d")


def trimmed(kind: str, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The datum itself within a decoded span: without titles, marks at the ends and the town."""
    datum = text[start:end]
    if kind == "name":
        lead = _TITLE.match(datum)
        start += lead.end() if lead else 0
        while m := _GIVEN.search(text, max(0, start - LOOK_BACK), start):  # an initial or a given name that belongs to it
            if m[1] and m[1].lower() not in _FIRST:
                break
            start = m.start()
        if m := _GARBLED_GIVEN.search(text[max(0, start - LOOK_BACK) : start]):
            start = max(0, start - LOOK_BACK) + m.start()
        if text[end - 1] == "." and (m := _SURNAME.match(text, end)):
            end = m.end()
        parts = text[start:end].split(", ")
        if len(parts) == 2 and all(len(x.split()) >= 2 for x in parts):
            return [t for x in ((start, start + len(parts[0])), (end - len(parts[1]), end)) for t in trimmed(kind, text, *x)]
        while end > start and not (text[end - 1].isalpha() or text[end - 1] in "�" or (text[end - 1] == "." and end - start > 2 and text[end - 2].isupper() and not text[end - 3].isalpha())):
            end -= 1
    elif kind == "address":
        start += len(datum) - len(datum.lstrip(" ,;:.-(\n"))
        datum = text[start:end]
        head, comma, tail = datum.rpartition(",")
        if comma and (not tail.strip() or (not _UNIT.search(tail) and _STREET_WORD.search(head) and _digits(head))):
            end = start + len(head)
    elif kind in ("phone", "id_number"):
        end -= len(text[start:end]) - len(text[start:end].rstrip(" ,;:.-\n"))
        if text[start] == "(" and ")" not in text[start:end]:
            start += 1
    return [(start, end)] if end > start else []


def find(texts: Sequence[str | None], field: Field, context: str = "text_extractions", batch_tokens: int = 200_000) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of the sound spans of each text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    held: list[tuple[int, str, list[tuple[int, int, str]]]] = []
    count = 0

    def decode() -> None:
        field.bounded()
        ids: list[int] = []
        number, first, gap = field.number, field.number("F", context), [field.number("", "")] * 5
        starts, lengths, owner = [], [], []
        for i, text, tokens in held:
            # a sequence is a line: blank lines and line ends separate data, so long texts decode in parallel
            begin = 0
            for j in range(len(tokens) + 1):
                if j == len(tokens) or tokens[j][2] == "L" and j - begin > 0:
                    if j > begin:
                        starts.append(len(ids))
                        lengths.append(j - begin + 1)
                        owner.append((i, text, tokens[begin:j]))
                        ids.append(first)
                        ids += [number(k, text[s:e]) for s, e, k in tokens[begin:j]]
                        ids += gap  # keeps the windows of neighbouring lines apart
                if j < len(tokens) and tokens[j][2] == "L":
                    begin = j + 1
        if not ids:
            return
        emissions = field.emissions(np.array(ids))
        labels = field.viterbi(emissions, np.array(starts), np.array(lengths))
        for at, size, (i, text, tokens) in zip(starts, lengths, owner, strict=True):
            own, size = labels[at + 1 : at + size], size - 1
            if not own.any():
                continue
            j = 0
            while j < size:
                label = LABELS[own[j]]
                if label[0] == "B":
                    k = j + 1
                    while k < size and LABELS[own[k]] == "I-" + label[2:]:
                        k += 1
                    out[i] += [(s, e, label[2:]) for s, e in trimmed(label[2:], text, tokens[j][0], tokens[k - 1][1]) if sound(label[2:], text[s:e]) and not (label == "B-name" and (_place_like(text, s, e) if context == "text_extractions" else _COMPANY_NEXT.match(text, e))) and not (label in ("B-phone", "B-id_number") and _NOT_PERSONAL.search(text, max(0, s - LOOK_BACK), s))]
                    j = k
                else:
                    j += 1

    for i, text in enumerate(texts):
        if not text:
            continue
        tokens = tokenize(text)
        held.append((i, text, tokens))
        count += len(tokens)
        if count > batch_tokens:
            decode()
            held, count = [], 0
    decode()
    return [_joined(text, spans) for text, spans in zip(texts, out, strict=True)]


def _place_like(text: str, start: int, end: int) -> bool:
    """One word alone at a line's start, or behind a capital À (garbled or not), is a place or an ordinary word."""
    datum = text[start:end]
    if re.match(r"(?:À|Ã€|ГЂ|├Ç|√Ä|Ç|Ã)[ \xa0]", datum) or re.search(r"(?:À|Ã€|ГЂ|├Ç|├|√Ä|Ã|�)[ \xa0]?$", text[max(0, start - 3) : start]):
        return True
    if _COMPANY_NEXT.match(text, end) or text[end : end + 1].isdigit():
        return True
    if " " not in datum and _SENTENCE_BEFORE.search(text[max(0, start - 12) : start]) and not text.startswith(" signed", end):
        return True
    line = text[text.rfind("\n", 0, start) + 1 : start]
    return " " not in datum and not line.strip() and not text.startswith(" signed", end)


def _joined(text: str | None, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The halves of one name as one span: `LAST, First` and a given name or initial with its surname."""
    out: list[tuple[int, int, str]] = []
    for span in spans:
        if out and span[0] < out[-1][1]:  # a span that was widened over the one before
            out[-1] = (min(out[-1][0], span[0]), max(out[-1][1], span[1]), span[2])
            continue
        if out and out[-1][2] == span[2] == "name":
            gap, first = text[out[-1][1] : span[0]], text[out[-1][0] : out[-1][1]]
            last = text[span[0] : span[1]]
            if (gap == ", " and " " not in first and " " not in last) or (gap in (" ", ". ") and " " not in last and "," not in first and (" " not in first or (text[span[1] : span[1] + 1] != "," and (first[-1] == "." or first[-2] == " ")))):
                out[-1] = (out[-1][0], span[1], "name")
                continue
        out.append(span)
    return out


def _plain(kind: str, word: str) -> str:
    """Digits as nines and mail addresses as one, so that tokens repeat."""
    if kind == "E":
        return "e"
    return re.sub(r"[1-46-9]", "9", word) if kind == "N" else word


_SPANS = "array<struct<start_pos:int,end_pos:int,pii_type:string>>"


def spans_of(df: DataFrame, record_table: str, id_column: str, text: str, weights) -> DataFrame:  # noqa: ANN001
    """record_table, record_id, text, spans. `weights` is the broadcast field."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = weights.value
        for part in batches:
            found = find(part["text"].tolist(), field, record_table)
            yield part.assign(spans=[[{"start_pos": s, "end_pos": e, "pii_type": k} for s, e, k in row] for row in found])

    chosen = df.select(F.lit(record_table).alias("record_table"), F.col(id_column).alias("record_id"), F.col(text).alias("text"))
    return chosen.mapInPandas(run, f"record_table string, record_id long, text string, spans {_SPANS}")


def occurrences(spans: DataFrame) -> DataFrame:
    return spans.select("record_table", "record_id", F.inline("spans")).select("record_table", "record_id", "pii_type", F.col("start_pos"))


def masked(spans: DataFrame) -> DataFrame:
    """record_table, record_id, masked_text: placeholders in the spans' places, everything else unchanged."""
    names = F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv])
    gaps = F.transform(
        F.col("spans"),
        lambda s, i: F.concat(F.substring(F.col("text"), F.when(i == 0, F.lit(1)).otherwise(F.element_at("spans", i)["end_pos"] + 1), s["start_pos"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at("spans", i)["end_pos"])), F.element_at(names, s["pii_type"])),
    )
    tail = F.expr("substring(text, element_at(spans, -1).end_pos + 1)")
    return spans.select("record_table", "record_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(F.array_join(gaps, ""), tail)).alias("masked_text"))
