"""Personal data with offsets that survive deobfuscation (operator 6).

Base spans are matches in the text as it stands. A chain of transducers then rewrites
disguises (look-alike letters and digits, invisible characters, spelled digits, "at" and
"dot" written out or in brackets, character references), each keeping for every character
it emits the source span that it came from. Identifiers found in the rewritten text map
back to source characters; those that lie within no base span of their kind are added, so
an address of which the patterns only see a part is reported whole too.

Defined cases: null and empty texts have no spans; offsets are code points, end exclusive;
repeated rows each give a row; an empty table gives an empty result; other columns are
ignored. Whole texts are read, however long, in time proportional to their length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

#: Look-alikes of ASCII letters in other scripts (fixed values).
LOOK_ALIKES = dict(zip(
    "абвгдеѕіјкӏмнорстуԛԝхһԁѵүғѡьАВСЕНІЈКМОРЅТХУѴԚԜҮΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορτυχϲωηοօոսցհɑɡıȷ",
    "a6brgesijklmhopctyqwxhdvyfwbABCEHIJKMOPSTXYVQWYABEZHIKMNOPTYXayikvoptuxcwnoonughagij",
    strict=True,
))
#: Characters that show nothing.
INVISIBLE = frozenset("­͏​‌‍‎‏⁠⁡⁢⁣⁤﻿")
#: Digit words in English, German, French and Spanish (fixed values).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

#: Those of them that prose has as articles and the like (fixed values).
PROSE = frozenset("un uno null oh dos sept".split())

_DW = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOTS = "dot|punkt|punto|point"
#: What may stand between two digits of a run.
_RUN_SEP = rf"(?:[\s,-]{{1,3}}|\.|[ \t]+(?:{_DOTS})[ \t]+)"
#: Part of every run with a digit word: the word beside a digit or another one.
_SPELLED_DIGIT = re.compile(rf"\b(?:{_DW}){_RUN_SEP}(?:{_DW}|[0-9])|[0-9]{_RUN_SEP}(?:{_DW})\b", re.I)
_DIGIT_RUN = re.compile(rf"(?:\bplus[\s-]+)?\b(?:{_DW}|[0-9]+)(?:{_RUN_SEP}(?:{_DW}|[0-9]+)\b)+", re.I)
#: Letters that stand for digits inside a number (fixed values).
DIGIT_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1"}
_MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl]{2,}(?![A-Za-z0-9])")
_LETTER = re.compile(r"[OoIl]")
_IN_RUN = re.compile(rf"plus|{_DW}|[0-9]", re.I)
_DOT_HINT = re.compile(r"dot|punkt|punto|point|[\[({<]\s*[.@]|[\[({<]\s*(?:at|arobase)\b|&#|&(?:commat|period);|%40|@[ \t]|[ \t]@", re.I)
_AT_BRACKET = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:at|arobase|@)[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
_DOT_BRACKET = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|punkt|punto|point|\.)[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
_AT_CODE = re.compile(r"&#0*64;|&#x0*40;|&commat;|%40", re.I)
_DOT_CODE = re.compile(r"&#0*46;|&#x0*2e;|&period;", re.I)
_PART = r"[A-Za-z0-9][A-Za-z0-9%+-]*"
_SEP = r"[ \t_-]{1,3}"
_DOTW = rf"(?:{_SEP}(?:dot|punkt|punto|point){_SEP}|[ \t]{{1,3}}\.[ \t]{{1,3}}|\.)"
#: What parts a mailbox from its domain; the domain after it; the mailbox before it, read backwards.
_AT = re.compile(rf"{_SEP}(?:at|arobase){_SEP}|[ \t]{{0,3}}@[ \t]{{0,3}}", re.I)
_DOMAIN = re.compile(rf"{_PART}(?:{_DOTW}{_PART})+", re.I)
_TRAP = r"[A-Za-z0-9%+-]*[A-Za-z0-9]"
_MAILBOX = re.compile(rf"{_TRAP}(?:(?:{_SEP}(?:tod|tknup|otnup|tniop){_SEP}|\.){_TRAP})*", re.I)
_DOT_WORD = re.compile(rf"{_SEP}(?:dot|punkt|punto|point){_SEP}|[ \t]{{1,3}}\.[ \t]{{1,3}}", re.I)
_AT_HINT = re.compile(rf"(?<=[A-Za-z0-9%+-]){_SEP}(?:at|arobase){_SEP}{_PART}\.[A-Za-z0-9]", re.I)
#: Endings of files, and words that start a sentence after a missing space (fixed values).
NOT_DOMAINS = frozenset(
    "py sh rs js ts jsx tsx md txt rst htm html php asp aspx jsp css scss json xml yml yaml toml ini cfg conf log csv tsv sql pdf doc docx xls xlsx ppt pptx jpg jpeg png gif svg "
    "mp mp3 mp4 wav zip tar gz tgz exe dll bin jar java class cpp hpp cc hs rb go kt swift lua ipynb parquet "
    "the then and but or so he she we they you this that these those there here when while if as at by for from on of with was were is it his her our your their not no yes an".split()
)
#: Words before a spelled at that name no mailbox (fixed values).
BEFORE_AT = frozenset(
    "us me you him her them it we they is are was were be been available found find look looks looking looked see seen visit visited online hosted host read more here there "
    "live lives lived work works worked working arrive arrived meet met stay stayed posted published site website page blog shop order buy download downloads downloaded "
    "browse details out up over and or to only start starts started sold learn register registered sign join located listed aimed hints pointed directed "
    "now today also best good not all one once even that this".split()
)
_DIGIT_DOT = re.compile(r"(?<=[0-9])[ \t]{1,3}(?:dot|punkt|punto|point|\.)[ \t]{1,3}(?=[0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in match.split("."))
    digits = _NOT_DIGIT.sub("", match)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the pattern, from one @ to the next, as the pattern itself rescans long runs from each of their characters."""
    end, before, at = 0, 0, text.find("@")
    while at >= 0:
        if at >= end:
            low = max(end, before)
            start = low + len(text[low:at].rstrip(_LOCAL))
            host = _HOST.match(text, at + 1) if start < at else None
            if host:
                end = host.end()
                yield start, end
        before, at = at + 1, text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the pattern: of each chain of numbers, every four from the left."""
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") >= 3:
            ends, at = [], m.start()
            for number in m[0].split("."):
                ends.append((at, at + len(number)))
                at += len(number) + 1
            for k in range(0, len(ends) - 3, 4):
                yield ends[k][0], ends[k + 3][1]


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if _DIGIT.search(text):
        out["ip"] = [x for x in _ips(text) if valid("ip", text[x[0] : x[1]])]
        for kind in ("card", "phone") if "+" in text else ("card",):
            out[kind] = [m.span() for m in PATTERNS[kind].finditer(text) if valid(kind, m[0])]
    return out


class Tape:
    """A rewritten text and, for each of its characters, the source span behind it."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, np.arange(len(text)), np.arange(1, len(text) + 1), False

    @property
    def start(self) -> list[int]:
        return self.starts.tolist()

    @property
    def end(self) -> list[int]:
        return self.ends.tolist()

    def replace(self, pieces: list[tuple[int, int, str]]) -> None:
        """pieces: (start, end, replacement) in order; what lies between stays."""
        if not pieces:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in pieces:
            text += (self.text[at:a], new)
            start += (self.starts[at:a], np.full(len(new), self.starts[a]))
            end += (self.ends[at:a], np.full(len(new), self.ends[b - 1]))
            at = b
        self.text = "".join(text) + self.text[at:]
        self.starts, self.ends, self.changed = np.concatenate([*start, self.starts[at:]]), np.concatenate([*end, self.ends[at:]]), True

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], list[tuple[int, int, str]]]) -> None:
        """by: the pieces in a match."""
        self.replace([p for m in pattern.finditer(self.text) for p in by(m)])

    def letters(self, new: dict[str, str]) -> None:
        """Every character by what stands for it."""
        if not new:
            return
        moved = {c: x for c, x in new.items() if len(x) != 1}
        self.text = self.text.translate({ord(c): x for c, x in new.items() if len(x) == 1})
        self.changed = True
        if moved:
            self.rewrite(re.compile("[" + re.escape("".join(moved)) + "]"), lambda m: [(m.start(), m.end(), moved[m[0]])])


@lru_cache(1 << 16)
def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    n = unicodedata.normalize("NFKC", c)
    if n.isascii() and len(n) <= 3:
        return n.strip() or (c if n else "")
    d = unicodedata.digit(c, None)
    return c if d is None else str(d)


def _digits(m: re.Match) -> list[tuple[int, int, str]]:
    """One piece for each digit or digit word of a run; the separators between two of which one is spelled go, and dot words become dots.

    A word that prose has anyway is no digit at an end of the run beside a written digit."""
    found = [(m.start() + x.start(), m.start() + x.end(), x[0].lower()) for x in _IN_RUN.finditer(m[0])]
    while len(found) > 1 and found[-1][2] in PROSE and found[-2][2].isdigit():
        found.pop()
    while len(found) > 1 and found[0][2] in PROSE and found[1][2].isdigit():
        found.pop(0)
    pieces, at = [], None
    for a, b, w in found:
        new = "+" if w == "plus" else DIGIT_WORDS.get(w, w)
        spelled = new != w
        if at is not None and a > at[0]:
            between = m.string[at[0] : a]
            if between == ".":
                pass
            elif not between.isascii() or any(c.isalpha() for c in between):
                pieces.append((at[0], a, "."))
            elif spelled or at[1]:
                pieces.append((at[0], a, ""))
        if spelled:
            pieces.append((a, b, new))
        at = (b, spelled)
    return pieces


def _whole_domain(text: str, end: int, domain: str) -> bool:
    """Whether a plain ``domain`` that ends at ``end`` is one by its form and by what follows, and not a missing space, a file or the start of a link."""
    after = text[end : end + 2]
    last = domain.rsplit(".", 1)[-1]
    return domain in (domain.lower(), domain.upper()) and 2 <= len(last) <= 12 and last.isalpha() and last.lower() not in NOT_DOMAINS and after[:1] not in tuple("@/:\\_") and not (after[:1] == "." and after[1:].isalnum())


def _addresses(t: Tape) -> list[tuple[int, int, str]]:
    """The at and dot words of addresses, from one at to the next.

    After a spelled or spaced at, plain dots that didn't stand in disguise count if they make a whole domain
    and no word before at is one that prose has there."""
    text, out, low = t.text, [], 0
    for at in _AT.finditer(text):
        before, low = low, max(low, at.end())
        a, b = at.span()
        domain = _DOMAIN.match(text, b) if a >= before else None
        if not domain or _AT.match(text, domain.end()):
            continue
        box = _MAILBOX.match(text[before:a][::-1])
        if not box:
            continue
        left, right = a - box.end(), domain.end()
        if at[0] != "@":
            plain = any(c == "." and t.ends[i] - t.starts[i] == 1 for i, c in enumerate(domain[0], b))
            if plain and (text[left:a].lower() in BEFORE_AT or not _whole_domain(text, right, _DOT_WORD.sub(".", domain[0]))):
                continue
        dots = [(x.start(), x.end(), ".") for lo, hi in ((left, a), (b, right)) for x in _DOT_WORD.finditer(text, lo, hi)]
        ats = [(a, b, "@")] if at[0] != "@" else []
        out += sorted(dots + ats)
        low = right
    return out


def deobfuscated(text: str) -> Tape | None:
    """None if nothing in the text looks disguised."""
    odd = {} if text.isascii() else {c: p for c in set(text) if (ord(c) >= 0x2B0 or c in "\xad²³¹ɑɡıȷ") and (p := _plain(c)) != c}
    words, dots, mixed, at = (p.search(text) for p in (_SPELLED_DIGIT, _DOT_HINT, _MIXED, _AT_HINT))
    if not (odd or words or dots or mixed or at or _DIGIT_DOT.search(text)):
        return None
    t = Tape(text)
    whole = lambda new: lambda m: [(m.start(), m.end(), new)]
    t.letters(odd)
    t.rewrite(_MIXED, lambda m: [] if m[0].isdigit() or m[0].isalpha() else [(m.start() + x.start(), m.start() + x.end(), DIGIT_LETTERS[x[0]]) for x in _LETTER.finditer(m[0])])
    for p, new in ((_AT_CODE, "@"), (_DOT_CODE, "."), (_AT_BRACKET, "@"), (_DOT_BRACKET, ".")) if _DOT_HINT.search(t.text) else ():
        t.rewrite(p, whole(new))
    if words or t.changed and _SPELLED_DIGIT.search(t.text):
        t.rewrite(_DIGIT_RUN, _digits)
    t.rewrite(_DIGIT_DOT, whole("."))
    if _DOT_HINT.search(t.text) or _AT_HINT.search(t.text) or t.changed and "@" in t.text:
        t.replace(_addresses(t))
    return t if t.changed else None


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and all spans, by kind, each in order of start."""
    text = text or ""
    base = spans(text)
    every = {k: list(v) for k, v in base.items()}
    if text and (t := deobfuscated(text)):
        for kind, found in spans(t.text).items():
            own, k = base[kind], 0
            for a, b in found:
                s, e = int(t.starts[a]), int(t.ends[b - 1])
                while k < len(own) and own[k][1] < e:
                    k += 1
                if k == len(own) or own[k][0] > s:  # within no base span
                    every[kind].append((s, e))
            every[kind].sort()
    return base, every


def joined(by: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in by[k])


def _each(batches):
    for b in batches:
        found = [find(t) for t in b.column("text").to_pylist()]
        n = [pa.array([len(every[k]) for _, every in found], pa.int64()) for k in KINDS]
        sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *n, sha, pa.array([joined(every) for _, every in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans."""
    slim = docs.select("doc_id", "text")
    return arrow_map(slim, _each, f"doc_id {dict(slim.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
