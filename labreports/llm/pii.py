"""Personal data: candidate spans, boosted trees on format and context, calibrated thresholds.

The agreed base spans are always found. High-recall generators propose further, overlapping spans
(numbers in any grouping, addresses with the signs written out); boosted trees rate them by their
format and the words around them, and a threshold for each kind, set on labelled examples that the
trees haven't seen, selects those that are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labreports.llm.boosting import Boosted, fit_boosted
from labreports.llm.common import add_columns

KINDS = ("email", "ip", "card", "phone")

# The agreed base patterns. Starts inside a run of digits are left out, as the run's
# own start decides; so long runs take linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, sign and domain, found from the sign outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base spans, the kind as its place in KINDS."""
    spans = [(0, *span) for span in _emails(text)] if "@" in text else []
    if not _ANY_DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                spans.append((3, *m.span()))
    return spans


_ANY_DIGIT = re.compile("[0-9]")
_AT = r"(?:@|[\[({]\x20?at\x20?[\])}]|(?<=\x20)at(?=\x20))"
_DOT = r"(?:[\[({]\x20?(?:dot|\.)\x20?[\])}]|(?<=\x20)dot(?=\x20)|\.)"
_SPELLED = re.compile(
    rf"(?<![\w.%+-])[\w.%+-]{{1,64}}\x20?{_AT}\x20?"
    rf"(?:[A-Za-z0-9-]{{1,63}}\x20?{_DOT}\x20?){{1,4}}[A-Za-z]{{2,12}}\b"
)
_NUMBER = re.compile(r"(?<![\w.])[+(]{0,2}[0-9](?:[\x20().:/-]{0,2}[0-9]){5,20}(?![\w])")
# A card number may also begin inside what the pattern above takes, as after a telephone number.
_GROUPED = re.compile(
    r"(?<![0-9])(?=([3-6][0-9]{3}(?:[\x20./-]?[0-9]{4}){2}[\x20./-]?[0-9]{3,4})(?![0-9]))"
)
# Words that tell what a number or address is.
CUES = (
    ("mail", "email", "e-mail", "contact", "write", "reach"),
    ("ip", "host", "server", "address", "from", "login"),
    ("card", "visa", "credit", "payment", "debit", "mastercard"),
    ("phone", "call", "tel", "mobile", "cell", "fax", "telefon"),
    ("order", "invoice", "version", "isbn", "id", "page", "ref", "build", "date", "number"),
)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` proposed for a text; a number is proposed for every kind it may be."""
    found = []
    if any(sign in text for sign in ("dot", "at]", "at)", "at}")):
        for m in _SPELLED.finditer(text):
            found.append((0, *m.span()))
    if _ANY_DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            size = len(_digits(m[0]))
            if m[0].count(".") >= 3 or m[0].count(":") >= 3:
                found.append((1, *m.span()))
            if size >= 13:
                found.append((2, *m.span()))
            if 7 <= size <= 15:
                found.append((3, *m.span()))
        found += [(2, *m.span(1)) for m in _GROUPED.finditer(text)]
    return list(dict.fromkeys(found))


FEATURES = (
    "kind digits groups separators letters length plus bracket dots hyphens blanks slashes luhn "
    "first_group last_group longest_group same_groups octets cue_mail cue_ip cue_card cue_phone "
    "cue_other marks_at marks_dot known_end capital"
).split()
_ENDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info")
_WORD = re.compile(r"[a-z-]+")


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and words of the 48 characters around it."""
    span = text[start:end]
    digits = _digits(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    near = set(_WORD.findall(text[max(0, start - 32) : start].lower()))
    near |= set(_WORD.findall(text[end : end + 16].lower()))
    parts = [int(g[:9]) for g in re.findall("[0-9]+", span)]
    tail = re.search(r"([A-Za-z]+)$", span)
    return [
        kind,
        len(digits),
        len(groups),
        sum(c in " ().:/-" for c in span),
        sum(c.isalpha() for c in span),
        len(span),
        "+" in span,
        "(" in span,
        span.count("."),
        span.count("-"),
        span.count(" "),
        span.count("/") + span.count(":"),
        len(digits) >= 12 and luhn(digits),
        groups[0],
        groups[-1],
        max(groups),
        len(set(groups)) == 1,
        len(parts) == 4 and max(parts) <= 255,
        *(any(cue in near for cue in cues) for cues in CUES),
        bool(re.search(r"[\[({]\x20?at|@|\x20at\x20", span)),
        bool(re.search(r"[\[({]\x20?(?:dot|\.)|\x20dot\x20", span)),
        bool(tail) and tail[1].lower() in _ENDS,
        span[:1].isupper(),
    ]


@dataclass(frozen=True)
class PiiModel:
    trees: Boosted
    thresholds: tuple[float, ...]


def _examples(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in made-up sentences whose personal data is known."""
    random = np.random.default_rng(seed)
    pick = lambda items: items[int(random.integers(len(items)))]
    number = lambda n: "".join(map(str, random.integers(0, 10, n)))
    word = lambda: "".join(pick("abcdefghijklmnoprstuvw") for _ in range(int(random.integers(2, 9))))

    def card() -> str:
        body = pick("456") + number(14)
        full = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        sign = pick(["", " ", "-", ".", "/"])
        return sign.join(full[k : k + 4] for k in range(0, 16, 4))

    def serial() -> str:
        """Sixteen digits that are no card number."""
        body = number(15)
        return body + next(str(d) for d in range(10) if not luhn(body + str(d)))

    def spaced(digits: str) -> str:
        return " ".join(digits[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{number(2)} {a} {b} {c}", f"00{number(2)} {a} {b}{c}"])

    def address() -> str:
        at, dot = pick([" [at] ", "(at)", " at ", "[at]", " (at) ", "{at}"]), pick([" [dot] ", "(dot)", " dot ", "[dot]", "."])
        if at == " at ":
            dot = " dot "
        return f"{word()}{pick(['.', '', '_'])}{word()}{at}{word()}{dot}{pick(_ENDS)}"

    def octets() -> str:
        return ".".join(str(x) for x in random.integers(0, 256, 4))

    def other() -> str:
        return pick([
            f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)}/{number(4)}", number(8), number(12), serial(),
            f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(2)}:{number(2)}:{number(2)}", f"{number(1)}.{number(2)}.{number(1)}.{number(5)}",
            f"{number(4)}.{number(2)}.{number(3)}.{number(4)}", f"{number(6)}-{number(4)}", spaced(serial()), f"{number(3)} {number(4)}",
            f"{number(2)}.{number(2)}.{number(4)} {number(2)}:{number(2)}", f"{word()} at {word()}.{word()}", f"{word()} at the {word()} dot {word()}", f"dot {word()} at {word()} dot. {word()}",
        ])

    makers = (address, octets, card, phone)
    rows, labels = [], []
    for _ in range(count):
        kind = int(random.integers(0, 8))
        real = kind < 4
        inner = makers[kind]() if real else other()
        cues = CUES[kind] if real and random.random() < 0.6 else CUES[4] if random.random() < 0.5 else (word(),)
        before = f"{' '.join(word() for _ in range(5))} {pick(cues)}{pick([' ', ': ', ' - ', ' '])}"
        text = f"{before}{inner}{pick([' ', '. ', ', '])}{word()} {word()}"
        for k, start, end in candidates(text):
            covered = start < len(before) + len(inner) and end > len(before)
            exact = start == len(before) and end == len(before) + len(inner)
            if covered:
                rows.append(features(text, k, start, end))
                labels.append(real and exact and k == kind)
    return np.array(rows, float), np.array(labels, float)


@lru_cache(maxsize=4)
def fit_pii(examples: int = 4_000, precision: float = 0.995, seed: int = 5) -> PiiModel:
    """Boosted trees and a threshold for each kind: the lowest at which the wanted share of the
    selected held-out examples is personal data. Both sets are bounded by ``examples``. A session fits
    once for each set of arguments."""
    x, y = _examples(examples, seed)
    trees = fit_boosted(x, y)
    held, truth = _examples(examples // 2, seed + 1)
    odds, thresholds = trees.predict(held), []
    for kind in range(len(KINDS)):
        own = np.flatnonzero(held[:, 0] == kind)
        order = own[np.argsort(-odds[own], kind="stable")]
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        thresholds.append(float(odds[order[good[-1]]]) if len(good) else np.inf)
    return PiiModel(trees, tuple(thresholds))


def added_spans(text: str, base: list[tuple[int, int, int]], model: PiiModel) -> list[tuple[int, int, int]]:
    """Candidates that the thresholds select: the likeliest first, none that overlaps another."""
    proposed = candidates(text)
    if not proposed:
        return []
    odds = model.trees.predict(np.array([features(text, *span) for span in proposed], float))
    over = odds - np.array([model.thresholds[kind] for kind, _, _ in proposed])
    # One byte for each place of the text says whether a span covers it.
    covered, added = bytearray(len(text)), []
    for _, start, end in base:
        covered[start:end] = b"\1" * (end - start)
    for at in np.argsort(-over, kind="stable"):
        kind, start, end = proposed[at]
        if over[at] >= 0 and covered.find(1, start, end) < 0:
            covered[start:end] = b"\1" * (end - start)
            added.append((kind, start, end))
    return added


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def personal_data(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """Add ``spans`` to every row: kind, start, end (code points, exclusive) and whether it is a base
    span, by kind in the order of KINDS and then by start.

    Null text counts as empty and has none. Long texts are taken whole, in time that grows with the
    text and its candidates. Rows are handled by themselves without a shuffle, so repeated rows get
    equal spans and an empty table gives no rows. A column ``spans`` is replaced.
    """
    model = model or fit_pii()

    def find(texts: list[str]) -> list[list]:
        found = []
        for text in texts:
            base = base_spans(text)
            spans = [(*span, True) for span in base]
            spans += [(*span, False) for span in added_spans(text, base, model)]
            found.append(
                [
                    {"kind": KINDS[kind], "start": start, "end": end, "base": is_base}
                    for kind, start, end, is_base in sorted(spans)
                ]
            )
        return [found]

    return add_columns(docs, "text", f"spans {_SPANS}", lambda: find)


def redacted(found: DataFrame) -> DataFrame:
    """The rows of ``personal_data`` with each span of the text replaced by its kind in brackets;
    spans that overlap are replaced together, under the kind of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            place = batch.schema.get_field_index("text")
            for text, spans in zip(batch.column(place).to_pylist(), batch.column("spans").to_pylist()):
                out, at = [], 0
                for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if span["start"] >= at:
                        out += [text[at : span["start"]], f"[{span['kind'].upper()}]"]
                    at = max(at, span["end"])
                texts.append(None if text is None else "".join([*out, text[at:]]))
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, separated by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
