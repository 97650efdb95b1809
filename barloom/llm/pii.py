"""Personal data in whole texts, plain or disguised, at exact source offsets.

Plain identifiers are found on the text as it is. Disguised ones are found on a normalised copy: transducers rewrite
homoglyphs, spelled digits and written-out at and dot signs, and each keeps the segments it changed, so that a span found on the copy
is carried back through them to the code points it came from. What the copy adds never replaces a plain finding.
All scans are linear in the text, also over long runs of digits or letters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import id_and_text, schema, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place in KINDS, end; sorts as required

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the run before the sign, down to the end of the match before."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def plain_spans(text: str) -> list[Span]:
    """The four kinds as they stand in a text, each leftmost and non-overlapping, sorted."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


# Letters of other scripts that look like an ASCII letter, and invisible characters.
LOOK_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеѕіјорсухԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιοντυ" "ɡıʟ",
        "ABESIJKMHOPCTXYaesijopcyxdqw" "ABEZHIKMNOPTYXaiovtu" "gil",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

#: Characters the first transducer may change: look-alikes, invisible ones, and compatibility forms of ASCII.
FOREIGN = re.compile(f"[{''.join(LOOK_ALIKE)}{INVISIBLE}\\u00b2\\u00b3\\u00b9\\u0660-\\u0669\\u06f0-\\u06f9\\u0966-\\u096f\\u2010-\\u2015\\u2024\\u2070-\\u209c\\u2212\\u2460-\\u2468\\ufe52\\ufe6b\\uff01-\\uff5e\\U0001d400-\\U0001d7ff]")
WORD = f"(?:{'|'.join(DIGITS)}|oh)"
SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:{WORD}|[0-9])(?:(?:[ ,]{{0,2}}| ?- ?)(?:{WORD}|[0-9]))*(?![^\W_])")
SPELLED_PART = re.compile(rf"(?i)(zero|oh)|{'|'.join(f'({w})' for w in DIGITS[1:])}|[0-9]")  # the group says which digit
PLUS = re.compile(rf"(?i)(?<![^\W_])plus +(?={WORD}\b|[0-9])")
OPEN, CLOSE = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
DOT = re.compile(rf"(?i)(?<=[^\W_])(?:{OPEN}(?:dot|punkt|point|punto|\.){CLOSE}|[ \t]+dot[ \t]+)(?=[^\W_])")
AT = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+.-])(?:{OPEN}(?:at|@){CLOSE}|[ \t]+@[ \t]*|[ \t]*@[ \t]+)(?=[A-Za-z0-9])")
BARE_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])[ \t]+at[ \t]+(?=[A-Za-z0-9-]+(?:{OPEN}(?:dot|punkt|point|punto|\.){CLOSE}|[ \t]+dot[ \t]+)[A-Za-z0-9])")

AT_DOMAIN = re.compile(r"(?i)[ \t]+at[ \t]+(?=(?:[a-z0-9-]+\.)+[a-z]{2,})")


def _addressee(text: str, end: int) -> bool:
    """Whether what stands before a bare "at" can only be the local part of an address: letters with a digit, dot or underscore inside."""
    start = end
    while start > max(0, end - 64) and text[start - 1] in LOCAL:
        start -= 1
    name = text[start:end]
    return any(c.isalpha() for c in name) and name[-1:] != "." and any(c in "._0123456789" for c in name[1:])


class Trace:
    """A rewritten text and the segments that lead back: (start in the copy, start in the source, source length if changed)."""

    def __init__(self, text: str, parts: list[tuple[int, int, str]]) -> None:
        """parts: replaced source ranges and what stands for them, in order."""
        out, at, length = [], 0, 0
        self.starts, self.sources = [0], [(0, None)]
        for start, end, new in parts:
            out += [text[at:start], new]
            length += start - at
            if new:
                self._cut(length, start, end - start)
            length += len(new)
            self._cut(length, end, None)
            at = end
        self.text = "".join([*out, text[at:]])

    def _cut(self, start: int, source: int, size: int | None) -> None:
        if self.starts[-1] == start:
            self.sources[-1] = (source, size)
        else:
            self.starts.append(start)
            self.sources.append((source, size))

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (a, size), (b, last) = self.sources[i], self.sources[j]
        return a if size is not None else a + start - self.starts[i], b + last if last is not None else b + end - self.starts[j]


def _foreign(text: str) -> list[tuple[int, int, str]]:
    parts = []
    for m in FOREIGN.finditer(text) if not text.isascii() else ():
        new = "" if m[0] in INVISIBLE else LOOK_ALIKE.get(m[0]) or ("-" if "‐" <= m[0] <= "―" or m[0] == "−" else unicodedata.normalize("NFKC", m[0]))
        if not new.isascii() and len(new) == 1 and new.isdecimal():
            new = str(unicodedata.decimal(new))
        new = LOOK_ALIKE.get(new, new)
        if new.isascii():
            parts.append((m.start(), m.end(), new))
    return parts


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Digit words to digits; what separates neighbouring ones goes. A sequence without a word stays."""
    low = text.casefold()
    if "oh" not in low and not any(w in low for w in DIGITS):
        return []
    parts = []
    for m in SPELLED.finditer(text):
        if not any(map(str.isalpha, m[0])):
            continue
        at = m.start()
        for p in SPELLED_PART.finditer(text, m.start(), m.end()):
            if p.start() > at:
                parts.append((at, p.start(), ""))
            if p.lastindex:
                parts.append((p.start(), p.end(), str(p.lastindex - 1)))
            at = p.end()
    return parts


def _plus(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "+") for m in PLUS.finditer(text)] if "plus" in text.lower() else []


def _signs(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    parts = []
    if "at" in low and re.search(r"[\[({<][ \t]*at|[ \t]at[ \t]", low) or " @" in low or "@ " in low or re.search(r"[\[({<][ \t]*@", low):
        parts += [(m.start(), m.end(), "@") for m in AT.finditer(text)] + [(m.start(), m.end(), "@") for m in BARE_AT.finditer(text)]
        parts += [(m.start(), m.end(), "@") for m in AT_DOMAIN.finditer(text) if _addressee(text, m.start())]
    if "dot" in low or "pun" in low or "point" in low or re.search(r"[\[({<][ \t]*\.", low):
        parts += [(m.start(), m.end(), ".") for m in DOT.finditer(text)]
    return sorted(set(parts))


#: In this order; each works on the copy that the one before has made.
TRANSDUCERS: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (_foreign, _plus, _spelled, _signs)


def _spans_of_copy(text: str, transducers: tuple[Callable[[str], list[tuple[int, int, str]]], ...]) -> list[Span]:
    """Identifiers of the copy that the transducers make, where they touch a rewritten place, at their source offsets."""
    traces: list[Trace] = []
    copy = text
    for transducer in transducers:
        if parts := transducer(copy):
            traces.append(Trace(copy, parts))
            copy = traces[-1].text
    found = []
    for start, kind, end in plain_spans(copy) if traces else ():
        a, b = start, end
        for trace in reversed(traces):
            a, b = trace.back(a, b)
        if text[a:b] != copy[start:end]:
            found.append((a, kind, b))
    return found


def disguised_spans(text: str) -> list[Span]:
    """Identifiers of the normalised copy that touch a rewritten place, at their source offsets.

    A digit word can also be part of a name ("one.one at ..."), so a second copy leaves the words; it adds what overlaps nothing of its kind.
    """
    found = _spans_of_copy(text, TRANSDUCERS)
    if _spelled(text):
        words = _spans_of_copy(text, tuple(t for t in TRANSDUCERS if t is not _spelled))
        found += [(a, k, b) for a, k, b in words if not any(k == kind and a < end and start < b for start, kind, end in found)]
    return found


def _goes_on(text: str, start: int, end: int) -> bool:
    """Whether digit words right after the plain phone number [start, end) are its rest: numbers of country 1 have eleven digits, no more."""
    digits = NOT_DIGIT.sub("", text[start:end])
    return not (digits.startswith("1") and len(digits) >= 11)


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans): a disguised one is added where no plain one of its kind overlaps it.

    A phone number whose last digits are words is plain up to there; then the whole number is a span besides the plain one.
    """
    plain, added = plain_spans(text), []
    for a, k, b in disguised_spans(text):
        over = [(start, end) for start, kind, end in plain if k == kind and a < end and start < b]
        if not over or k == 3 and len(over) == 1 and over[0][0] == a and over[0][1] < b and "," not in text[over[0][1] : b] and _goes_on(text, *over[0]):
            added.append((a, k, b))
    return plain, sorted(plain + added)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, n_email, n_ip, n_card, n_phone, base, spans): counts and spans of the plain findings, and all spans.

    Spans are kind:start:end in code points, comma-joined, by start and then kind. A null text is empty and has none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                plain, spans = find_spans(text)
                kinds = [k for _, k, _ in plain]
                rows.append((*(kinds.count(k) for k in range(4)), written(plain), written(spans)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out

    return docs.mapInPandas(run, schema(doc_id="bigint", n_email="bigint", n_ip="bigint", n_card="bigint", n_phone="bigint", base="string", spans="string"))


def masked(text: Column) -> Column:
    """The text with every span, plain or disguised, replaced by its kind in angle brackets; overlapping ones by the first's. Null stays null."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(mask_text, na_action="ignore")

    return mask(text)


def mask_text(text: str) -> str:
    out, at = [], 0
    for start, kind, end in find_spans(text)[1]:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(id_and_text(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
