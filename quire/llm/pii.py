"""Personal data, also in disguise, with spans in the source's own code points.

Base patterns run on the text as it is. Then transducers rewrite a copy - look-alike and full-width characters to ASCII,
invisible characters to nothing, digits spelled in four languages and letters that stand in for digits to digits, "at"
and "dot" in words or brackets, each on its own, to @ and . - and each rewriting keeps the ranges that it changed. Identifiers found in the copy whose range was
rewritten are mapped back and added, unless a base span of their kind covers them whole. Base spans stay as they are; an
added span may overlap one, as where the pattern sees only the plain end of a disguised address.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, reach, texts

# The kinds in order and their base patterns. An email's is in two parts around its sign, an address's begins
# where a run of digits does; both find what the plain patterns find, in linear time on runs of any length.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones, and characters that show nothing.
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονѵ", "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXovv", strict=True))
INVISIBLE = set("­​‌‍⁠﻿")
# Hyphens and a full stop of other blocks.
LOOKALIKES |= dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-") | {"\u3002": "."}
# Spelled digits in English, French, German and Spanish.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SPELLED |= {"zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
SPELLED |= {"null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
SPELLED |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
# Letters that stand in for digits within a number, words for repeats of a digit and for a leading plus.
STAND_INS = {"l": "1", "I": "1", "O": "0", "o": "0"}
REPEATS = {"double": 2, "triple": 3, "doble": 2}
PLUS = ("plus", "más")
# The words for the two signs.
AT, DOT = ("at", "arroba", "chez"), ("dot", "punto", "punkt", "point")
# Last labels of three letters or more that hold after words for a dot which are common words too.
LAST = ("com", "org", "net", "edu", "gov", "info", "test", "example")
POINTS = ("punto", "punkt", "point")
# Context that makes "at" and "dot" ordinary words. Words that are no last label, determiners that are no
# first label after a bare "at", and words before a bare "at" whose object is a site.
NO_LAST = frozenset("the and or of on if we he she you they this that these those with from for not but then than when where while which who what was were are has have had will would can could should did does our your his her their its all only".split())
NO_FIRST = frozenset("the this that these those some any each every no which what another his her their its our your my www".split())
NO_LOCAL = frozenset("look looking looked available found us them him it is are was were be hosted live page site website online visit visited posted published see seen only here more and or read click order buy".split())

_ODD = re.compile("[^\x00-\x9f\xa1-\xac\xae-\u024f]")
_DIGIT = re.compile("[0-9]")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_STOPS = "|".join(DOT)
_TERM = rf"(?:(?:{'|'.join(REPEATS)}) )?(?:{_WORD})|[0-9]+"
_GAP = r"(?:[ .-]|, )"
_NO_BEFORE, _NO_AFTER = r"(?<![^\W_])", r"(?![^\W_])"
_RUN = re.compile(rf"{_NO_BEFORE}(?:(?:{'|'.join(PLUS)}|\+)[ -]*)?(?:{_TERM})(?:{_GAP}(?:{_TERM}|{_STOPS}))+{_NO_AFTER}", re.I)
_PART = re.compile(rf"{'|'.join(PLUS)}|\+|(?:({'|'.join(REPEATS)}) )?({_WORD})|[0-9]+|{_STOPS}", re.I)
#: Every run with spelled digits has one of them before another part, in lower case.
_SPELLED = re.compile(rf"(?:{_WORD}){_GAP}(?:{_TERM}|{_STOPS})")
_MIXED = re.compile(rf"{_NO_BEFORE}[0-9lIOo]*[0-9][0-9lIOo]*(?:[ .()-]{{1,2}}[0-9lIOo]*[0-9][0-9lIOo]*)*{_NO_AFTER}")
_BESIDE = re.compile("[0-9][lIOo]|[lIOo][0-9]")
_STAND_IN = re.compile("[lIOo]")
_OPEN, _SHUT = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_BRACKETS = [(re.compile(rf"\s{{0,3}}(?:{_OPEN}(?:{'|'.join(words)}|{re.escape(sign)}){_SHUT}|(?<=[A-Za-z0-9])([_-])(?:{'|'.join(words)})\1(?=[A-Za-z0-9]))\s{{0,3}}", re.I), sign) for words, sign in ((AT, "@"), (DOT, "."))]
_AT = re.compile(rf" (?:{'|'.join(AT)}|@) |@", re.I)
_STOP = rf" (?P<word>{'|'.join(DOT)}) |\."
_LABEL = re.compile("[A-Za-z0-9-]+")
_NEXT = re.compile(rf"(?:{_STOP})(?P<label>[A-Za-z0-9-]+)", re.I)
_BEFORE = re.compile(rf" (?:{'|'.join(w[::-1] for w in DOT)}) (?=[A-Za-z0-9._%+-])", re.I)
_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
_ALPHA = re.compile(r"[A-Za-z]{2,}")
_SPEECH = re.compile(rf"{_OPEN}(?:{'|'.join(AT)}|@|\.){_SHUT}|[_-](?:{'|'.join(AT)})[_-]| (?:{'|'.join(AT)}|@) [A-Za-z0-9-]+\.[A-Za-z0-9]", re.I)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", at + 1)


def base(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind."""
    found: list[Span] = []
    found += [("email", *span) for span in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split(".")))]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Tape:
    """A text after some rewritings, with the source range behind any span of it. A rewriting keeps its edits alone, as
    ranges before and after, so memory goes with them and the text."""

    def __init__(self, text: str):
        self.text = text
        self.layers: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts each (start, end, new) in place; edits are in order and don't overlap. Each new character stands for the
        whole old range."""
        if not edits:
            return
        text, at, moved = [], 0, 0
        begin, end = [], []
        for a, b, new in edits:
            text += [self.text[at:a], new]
            begin.append(a + moved)
            end.append(a + moved + len(new))
            moved += len(new) - (b - a)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.layers.append((begin, end, [a for a, _, _ in edits], [b for _, b, _ in edits]))

    def source(self, a: int, b: int) -> tuple[int, int, bool]:
        """Where the span a:b comes from, and whether anything in it was rewritten."""
        size, changed = b - a, False
        for begin, end, old_begin, old_end in reversed(self.layers):
            low, high = bisect_right(begin, a) - 1, bisect_right(begin, b - 1) - 1
            # an edit that left something lies in the span, or the span begins in one
            changed = changed or any(end[k] > begin[k] and end[k] > a for k in range(max(low, 0), high + 1))
            a = a if low < 0 else old_begin[low] if a < end[low] else a - end[low] + old_end[low]
            b = b if high < 0 else old_end[high] if b - 1 < end[high] else b - end[high] + old_end[high]
        return a, b, changed or b - a != size


def _fold(c: str) -> str:
    """The ASCII character that c looks like or the digit it stands for, nothing for an invisible one, else c itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and " " <= plain <= "~" and unicodedata.category(c) != "Lm" else c


def _spelled(tape: Tape, least: int = 3) -> list[tuple[int, int, str]]:
    """Edits for runs of spelled and plain digits, each part on its own; a run needs `least` spelled ones."""
    edits, signs = [], dict.fromkeys(PLUS, "+") | dict.fromkeys(DOT, ".")
    for m in _RUN.finditer(tape.text):
        parts = list(_PART.finditer(tape.text, *m.span()))
        if sum(p[2] is not None for p in parts) < least:
            continue
        for i, p in enumerate(parts):
            if p[2]:
                new = SPELLED[p[2].lower()] * REPEATS.get((p[1] or "").lower(), 1)
            else:
                new = signs.get(p[0].lower(), p[0])
            stop = parts[i + 1].start() if i + 1 < len(parts) else p.end()
            edits += [(p.start(), p.end(), new)] if new != p[0] else []
            edits += [(p.end(), stop, "")] if stop > p.end() else []
    return edits


def _mixed(text: str) -> list[tuple[int, int, str]]:
    """Edits for letters that stand in for digits, in numbers each of whose groups has a digit, and which have twice as
    many digits as letters."""
    edits = []
    for m in _MIXED.finditer(text):
        found = list(_STAND_IN.finditer(text, *m.span()))
        if found and 2 * len(found) <= len(_digits(m[0])):
            edits += [(x.start(), x.end(), STAND_INS[x[0]]) for x in found]
    return edits


def _speech(text: str) -> bool:
    """Whether the text may have a sign of an address in words, brackets or spaces."""
    low = text.lower()
    return any(w in low for w in DOT) or _SPEECH.search(text) is not None


def _domain(text: str, at: int, bare: bool) -> tuple[list[tuple[int, int, str]], int, bool]:
    """Edits for the words for dots in the domain at `at`, its end (0: there is none) and whether it has such words. The
    domain ends after the last label that can be a last one."""
    first = _LABEL.match(text, at)
    if not first:
        return [], 0, False
    edits: list[tuple[int, int, str]] = []
    good, top, known, n, stop = 0, "", False, 0, first.end()
    while m := _NEXT.match(text, stop):
        label, word = m["label"], (m["word"] or "").lower()
        low = label.lower()
        if word and known and len(low) != 2 and low not in LAST:
            break
        if word:
            edits.append((m.start(), m.start("label"), "."))
        stop = m.end()
        known = low in LAST[:5]
        fits = not word or low in LAST or low not in NO_LAST and low not in NO_FIRST and (len(low) == 2 or word not in POINTS)
        if _ALPHA.fullmatch(label) and fits and not (bare and not word and label.istitle()):
            good, n, top = stop, len(edits), low
    if bare and first[0].lower() in NO_FIRST and not (n and top in LAST):
        return [], 0, False
    return edits[:n], good, n > 0


def _spoken(tape: Tape) -> list[tuple[int, int, str]]:
    """Edits for addresses with "at" or "dot" as bare words, each of the two on its own: the other one may be a word or
    the sign itself. Dots in words count before the sign too."""
    text, edits, done = tape.text, [], 0
    turned = text[::-1] if any(w in text.lower() for w in DOT) else ""
    for m in _AT.finditer(text):
        a, b = m.span()
        bare = b - a > 1
        if a < done:
            continue
        dots, end, worded = _domain(text, b, bare)
        if not end:
            continue
        start, before = a, []
        while start > done and _NAME.match(text, start - 1):
            start -= 1
        local = text[start:a]
        if not local or bare and not worded and (local.lower() in NO_LOCAL or text.startswith("/", end)):
            continue
        while turned and start > done and (w := _BEFORE.match(turned, len(text) - start)):
            new = len(text) - w.end()
            begin = new
            while begin > done and _NAME.match(text, begin - 1):
                begin -= 1
            word = text[begin:new].lower()
            if begin == new or word in NO_LAST or word in NO_FIRST:
                break
            before.append((new, start, "."))
            start = begin
        new = [*before[::-1], *([(a, b, "@")] if bare else []), *dots]
        edits += new
        done = end if new else done
    return edits


def _signs(text: str) -> tuple[bool, bool, bool]:
    """Whether the text may have digits in words, digits beside letters that stand in for them, and signs of an address
    in disguise. None of these is narrower than the patterns that it stands before."""
    return _SPELLED.search(text.lower()) is not None, _BESIDE.search(text) is not None, _speech(text)


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Spans that only show once the text is rewritten."""
    odd = not text.isascii() and _ODD.search(text) is not None
    edits = [(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _fold(m[0])) != m[0]] if odd else []
    signs = _signs(text)
    if not edits and not any(signs):
        return []
    tape = Tape(text)
    if edits:
        tape.rewrite(edits)
        signs = tuple(x or y for x, y in zip(signs, _signs(tape.text), strict=True))
    spelled, mixed, spoken = signs
    if mixed:
        tape.rewrite(_mixed(tape.text))
    if spelled:
        tape.rewrite(_spelled(tape))
    if spoken:
        for pattern, sign in _BRACKETS:
            tape.rewrite([(*m.span(), sign) for m in pattern.finditer(tape.text)])
        tape.rewrite(_spoken(tape))
    if not tape.layers:
        return []
    out: list[Span] = []
    known = {kind: _Cover([(a, b) for k, a, b in plain if k == kind]) for kind in KINDS}
    for kind, a, b in base(tape.text):
        low, high, changed = tape.source(a, b)
        if changed and not known[kind].covers(low, high):
            out.append((kind, low, high))
            known[kind].last = max(known[kind].last, high)
    return out


class _Cover:
    """Whether a span lies in one of some others: those given, and those before it, whose starts don't come after its."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends, self.last = [a for a, _ in spans], [], -1
        for _, b in spans:
            self.ends.append(max(b, self.ends[-1] if self.ends else b))

    def covers(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a)
        return self.last >= b or k > 0 and self.ends[k - 1] >= b


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kinds in brackets."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda s: (s[1], s[2]))
    while i < len(spans):
        kinds, a, b = [spans[i][0]], spans[i][1], spans[i][2]
        while i + 1 < len(spans) and spans[i + 1][1] < b:
            i += 1
            kinds += [spans[i][0]] * (spans[i][0] not in kinds)
            b = max(b, spans[i][2])
        out += [text[at:a], "<" + "|".join(kinds).upper() + ">"]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by start and kind."""
    plain = base(text)
    return plain, sorted(plain + disguised(text, plain), key=lambda s: (s[1], KINDS.index(s[0])))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256, spans (all, kind:start:end joined
    by commas) and n_added of every text; a null text counts as empty, an empty table gives no rows. Each row is judged by
    its own text, repeated rows alike; spans that begin together are in the order of KINDS; other columns are not looked
    at. Time and memory go with a text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                found = [find(x) for x in b.column("text").to_pylist()]
                counts = [pa.array([sum(k == kind for k, _, _ in plain) for plain, _ in found], pa.int64()) for kind in KINDS]
                digest = pa.array([hashlib.sha256(joined(plain).encode()).hexdigest() for plain, _ in found], pa.string())
                spans = pa.array([joined(every) for _, every in found], pa.string())
                added = pa.array([len(every) - len(plain) for plain, every in found], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digest, spans, added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(docs: DataFrame) -> DataFrame:
    """docs with the personal data in `text` replaced; every other column as it is. A null text stays null. The column
    n_chars, where there is one of type long, is set to the new text's length. Rows stay one for one, repeated ones too,
    and an empty table stays empty; spans that overlap are replaced as one."""
    reach(docs.sparkSession)
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                new = [None if x is None else redact(x, find(x)[1]) for x in b.column(at).to_pylist()]
                yield b.set_column(at, "text", pa.array(new, b.column(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if dict(docs.dtypes).get("n_chars") == "bigint":
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns)
