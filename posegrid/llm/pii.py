"""Personal data in disguise: offset-preserving transducers, detectors, spans mapped back.

Base detectors run on the text as it is. The disguised forms are found on a normalised copy that
a chain of rewrites makes (homoglyphs, spelled digits, at/dot words); each rewrite keeps, for every
character it writes, the source span it came from, so a match maps back to source characters.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base forms of the contract. A run of digits is read once: an address starts at its head or not at all.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT_RUN = re.compile(r"[0-9]")

# fixed values: letters of other scripts that look like Latin ones, and other forms of signs
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "．": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "​": "", "‌": "", "‍": "", "⁠": "", "­": "",
}
HOMOGLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms follow ASCII
HOMOGLYPHS |= {chr(base + i): str(i) for base in (0x0660, 0x06F0, 0x0966) for i in range(10)}  # Arabic-Indic and Devanagari digits
GLYPH = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + "]")
# fixed values: digit names
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
NAME = "(?:" + "|".join(DIGITS) + ")"
#: At least four digit names or digits one after the other, two of them names at least.
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\s-]+)?(?:{NAME}|[0-9])(?:[\s,.-]+(?:{NAME}|[0-9]+))+(?![A-Za-z0-9])", re.I)
NAMED = re.compile(rf"(?<![A-Za-z])({NAME}|plus)(?![A-Za-z])", re.I)
BLANKS = r"(?:(?<!\s)\s+)"  # from the head of a run of blanks, so that each run is read once
AT_CORE, DOT_CORE = r"[\[({<]\s*(?:at|@)\s*[\])}>]", r"[\[({<]\s*(?:dot|point|\.)\s*[\])}>]"
DOT_SIGN = rf"{BLANKS}?{DOT_CORE}\s*"
DOT_WORD = rf"(?:{DOT_SIGN}|{BLANKS}dot\s+|{BLANKS}\.\s+)"
AT = re.compile(rf"{BLANKS}?{AT_CORE}\s*|{BLANKS}at\s+|{BLANKS}@\s+", re.I)
DOT = re.compile(DOT_WORD, re.I)
#: What may be an at sign, disguised or not.
SIGN = re.compile(rf"{AT_CORE}|(?<=\s)(?:at|@)(?=\s)|@", re.I)
LABEL, HOST, ENDS = r"[A-Za-z0-9_%+-]+", r"[A-Za-z0-9-]+", r"(?![A-Za-z0-9])"
ANY_DOT = rf"(?:\.|{DOT_WORD})"


def _domain(last: str) -> str:
    """A domain behind a sign. A spaced full stop after a domain with plain dots is rather the end of a sentence: then only a short word counts."""
    more = rf"\.{HOST}(?:{ANY_DOT}{HOST})*(?:(?:\.|{DOT_SIGN}|{BLANKS}dot\s+){last}|{BLANKS}\.\s+[A-Za-z]{{2,6}}{ENDS})"
    return rf"{HOST}(?:{DOT_WORD}(?:{HOST}{ANY_DOT})*{last}|{more}|\.{last})"


#: Prices have a spaced "@" as well: behind it the last label starts with a letter, unless its dot is in brackets.
SPACED_DOMAIN = rf"(?:{HOST}(?:{ANY_DOT}{HOST})*{DOT_SIGN}{HOST}|{_domain('[A-Za-z][A-Za-z0-9-]*')})"
#: A domain behind a plain word "at": all dots are disguised.
WORD_DOMAIN = rf"{HOST}(?:{DOT_WORD}{HOST})*(?:{DOT_SIGN}{HOST}|{BLANKS}dot\s+[A-Za-z]{{2,63}}{ENDS}|{BLANKS}\.\s+[A-Za-z]{{2,6}}{ENDS})"
#: What may stand behind each kind of sign. A plain word "at" counts only if all dots after it are disguised too.
AFTER_SIGN = {"plain": re.compile(_domain(HOST), re.I), "bracket": re.compile(rf"\s*{_domain(HOST)}", re.I), "@": re.compile(rf"\s+{SPACED_DOMAIN}", re.I), "at": re.compile(rf"\s+{WORD_DOMAIN}", re.I)}
#: What may stand before a sign, read backwards: labels with dots of any form between them.
BACK_DOT = r"(?:\.|\s*[\])}>]\s*(?:tod|tniop|\.)\s*[\[({<]\s*|\s+tod\s+|\s+\.\s+)"
BEFORE_SIGN = re.compile(rf"{LABEL}(?:{BACK_DOT}{LABEL})*", re.I)
#: An address of four numbers, each in digits or digit names, with disguised dots.
NUMBER = rf"(?:[0-9]{{1,3}}|{NAME}(?:[\s-]+{NAME}){{0,2}})"
DISGUISED_IP = re.compile(rf"(?<![A-Za-z0-9.]){NUMBER}(?:(?:\.|{DOT_WORD}){NUMBER}){{3}}(?![A-Za-z0-9])", re.I)
# fixed values: escaped signs
ESCAPES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&#x2e;": ".", "&period;": ".", "%2e": "."}
ESCAPE = re.compile("|".join(map(re.escape, ESCAPES)), re.I)
HINT = re.compile(r"[\[({<]\s*(?:at|@|dot|point|\.)\s*[\])}>]|\sdot\s|\s@\s|&(?:#|commat|period)|%(?:40|2e)", re.I)
HINT_DIGIT = re.compile(rf"(?<![A-Za-z]){NAME}[\s,.-]+(?:{NAME}|[0-9])(?![A-Za-z])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the contract's four forms, by start, then kind as listed."""
    out: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        # leftmost start: all of the local-part run before the sign, back to the last match at most
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT_RUN.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


class Mapped:
    """A text with, for each character, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def rewrite(self, spans: Iterable[tuple[int, int]], to: Callable[[str], str]) -> None:
        """Replace each span by to(its text); all characters written stand for the whole span."""
        text, starts, ends, at = [], [], [], 0
        for s, e in spans:
            new = to(self.text[s:e])
            text += [self.text[at:s], new]
            starts += [self.start[at:s], np.full(len(new), self.start[s])]
            ends += [self.end[at:s], np.full(len(new), self.end[e - 1])]
            at = e
        if at:
            self.text = "".join([*text, self.text[at:]])
            self.start, self.end = np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.start[start]), int(self.end[end - 1])


def _matches(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in pattern.finditer(text) if m.end() > m.start())


def _disguised(text: str) -> Iterator[tuple[int, int]]:
    """Addresses whose at sign or dots are disguised: from each sign a domain ahead, then the labels behind, so that no label is read from each of its characters."""
    backward, n, at, last = text[::-1], len(text), 0, 0
    while m := SIGN.search(text, at):
        at, (s, e) = m.end(), m.span()
        spaced = e < n and text[e].isspace() and s > 0 and text[s - 1].isspace()
        kind = "bracket" if e - s > 2 or text[s] in "[({<" else (m.group().lower() if spaced else "plain")
        domain = AFTER_SIGN[kind].match(text, e)
        if not domain:
            continue
        while kind != "plain" and s > last and text[s - 1].isspace():
            s -= 1
        labels = BEFORE_SIGN.match(backward, n - s, n - last)
        if labels:
            yield n - labels.end(), domain.end()
            at = last = domain.end()


def _spell(text: str) -> str:
    if len(NAMED.findall(text)) < 2:
        return text
    done = NAMED.sub(lambda x: "+" if x.group().lower() == "plus" else DIGITS[x.group().lower()], text)
    return re.sub(r"(?<=[+0-9])[\s,.-]+(?=[0-9])", "", done)


def _dotted(text: str) -> str:
    return ".".join(re.sub(r"[\s-]+", "", NAMED.sub(lambda x: DIGITS.get(x.group().lower(), x.group()), part)) for part in DOT.sub(".", text).split("."))


def _plain(text: str) -> str:
    return AT.sub("@", DOT.sub(".", text))


def hidden_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that only show after normalisation, as source offsets."""
    odd = not text.isascii() and GLYPH.search(text)
    if not (odd or HINT.search(text) or HINT_DIGIT.search(text)):
        return []
    m = Mapped(text)
    if odd:
        m.rewrite(_matches(GLYPH, m.text), HOMOGLYPHS.__getitem__)
    m.rewrite(_matches(ESCAPE, m.text), lambda x: ESCAPES[x.lower()])
    m.rewrite(_matches(DISGUISED_IP, m.text), _dotted)
    m.rewrite(_matches(SPELLED, m.text), _spell)
    m.rewrite(_disguised(m.text), _plain)
    return [(k, *m.source(s, e)) for k, s, e in base_spans(m.text)]


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base plus disguised ones; a disguised one that lies within another span is left out."""
    base = base_spans(text)
    found, starts = list(base), [s for _, s, _ in base]
    reach = list(itertools.accumulate((e for *_, e in base), max))
    furthest = 0
    for k, s, e in hidden_spans(text):
        before = bisect.bisect_right(starts, s)
        # the furthest end of all spans that start no later
        if e > max(furthest, reach[before - 1] if before else 0):
            found.append((k, s, e))
            furthest = e
    return base, sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are one, named after the longest."""
    joint: list[list] = []
    for k, s, e in spans:
        if joint and s < joint[-1][2]:
            if e - s > joint[-1][3]:
                joint[-1][0], joint[-1][3] = k, e - s
            joint[-1][2] = max(joint[-1][2], e)
        else:
            joint.append([k, s, e, e - s])
    out, at = [], 0
    for k, s, e, _ in joint:
        out += [text[at:s], f"<{k}>"]
        at = e
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add base_spans, spans (kind:start:end, comma-joined, code points) and masked to every row.

    No shuffle. Null text counts as empty and stays null in ``masked``; other columns pass through.
    Columns that carry one of the three names already are replaced.
    """
    small_batches(docs)
    docs = docs.drop("base_spans", "spans", "masked")

    @F.pandas_udf("base_spans string, spans string, masked string")
    def detect(text: pd.Series) -> pd.DataFrame:
        found = [all_spans(t or "") for t in text]
        masked = [None if t is None else mask(t, a) for t, (_, a) in zip(text, found, strict=True)]
        return pd.DataFrame({"base_spans": [joined(b) for b, _ in found], "spans": [joined(a) for _, a in found], "masked": masked})

    return docs.withColumn("_pii", detect(F.col(text_col))).select(*docs.columns, "_pii.base_spans", "_pii.spans", "_pii.masked")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_<kind>, base_sha256, spans."""
    found = find_pii(docs.select("doc_id", "text")).drop("text", "masked")
    kinds = F.transform(F.split("base_spans", ","), lambda x: F.split(x, ":")[0])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")
