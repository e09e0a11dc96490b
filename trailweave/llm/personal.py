"""Personal data in texts: plain identifiers, and disguised ones mapped back to the source.

Plain ones are e-mail addresses, IPv4 addresses, card numbers and telephone numbers by fixed
patterns. For disguised ones a transducer rewrites the text in steps: look-alike letters and
wide or foreign digits become ASCII and invisible characters vanish; "(at)" and "[dot]" become
"@" and "."; spelled digits become digits, also among written ones; bare "dot" between digits or
in an address, and bare "at" in an address with a disguised dot, become "." and "@". It keeps for
every character written the source characters it stands for, so that what the same patterns
find in the rewritten text is reported as spans of the source. A disguised span that touches a
plain one of its kind is left to that one, unless it is an address that holds the plain one
whole and more.

Secrets, values of 16 characters and more with a digit that a name such as "token" or "api key"
is set to, are told apart from personal data: they are counted and redacted with it, but are
no spans of the four kinds.

Offsets count code points, ends exclusive. Ties cannot be: of equal spans of a kind one stays. Null texts count as empty and have no spans;
repeated rows give repeated results; very long texts take linear time; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
_NAMES = (*KINDS, "secret")

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never begins inside a run of digits: the run's first digit would begin it, too.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SET = re.compile(r"[:=]\s{0,3}[\"']?([A-Za-z0-9_/+=.-]{16,})")
_SECRET_NAME = re.compile(r"(?ai:\b(?:[a-z0-9]+[_-])*(?:token|secret|passw(?:or)?d|passphrase|pwd|credentials?|auth|(?:api|access|private|secret)[\s_-]?key))[\"']?\s{0,3}\Z")

# Look-alikes of ASCII letters, and spelled digits.
LOOK_ALIKES = dict(
    zip(
        "абвгдезикмнорсстухіјѕһԁԛѡАВЕЗКМНОРСТУХІЈЅοαερνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "a6brdeziKMHopccTyxijshdqwABE3KMHOPCTYXIJSoaepviktuABEZHIKMNOPTYX",
        strict=True,
    )
)
SPELLED = {
    "zero": "0",
    "oh": "0",
    "one": "1",
    "two": "2",
    "three": "3",
    "four": "4",
    "five": "5",
    "six": "6",
    "seven": "7",
    "eight": "8",
    "nine": "9",
}
_WORD = r"(?<![^\W\d])(?ai:" + "|".join(SPELLED) + r")(?![^\W\d])"
_SPELLED = re.compile(_WORD, re.I)
_NUMBER = re.compile(rf"(\bplus[\s,-]+(?=[0-9]|{_WORD}))|({_WORD})|[0-9]+", re.I)
_BETWEEN = re.compile(r"[\s,.-]+")
_NEAR = re.compile(r"[\s,.()-]+(?:dot\s+)?", re.I)
_BRACKETED = re.compile(r"[(\[{<]\s*(?:(at|@)|dot|punto|point|punkt|\.)\s*[)\]}>]", re.I)
_NUMBER_DOT = re.compile(r"(?<=[0-9])\s+dot\s+(?=[0-9])", re.I)
_BARE_DOT = re.compile(r"\s+dot\s+", re.I)
_BARE_AT = re.compile(r"\s+at\s+", re.I)
_CHAIN = re.compile(r"at(?=\s)|[A-Za-z0-9._%+-]+(?:\s+dot\s+(?!at\s)[A-Za-z0-9._%+-]+)*", re.I)
_BARE_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)+", re.I)
_ODD = re.compile(r"[­Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९​-‏⁠‐-―﻿！-～]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, start)
        at = text.find("@", max(at + 1, last))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain identifiers, in order; kinds by place in ``KINDS``."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _with_blanks(text: str, a: int, b: int, last: int) -> tuple[int, int]:
    """The piece from ``a`` to ``b`` with the blanks around it, none before ``last``."""
    while a > last and text[a - 1].isspace():
        a -= 1
    while b < len(text) and text[b].isspace():
        b += 1
    return a, b


class _Written:
    """A text with pieces ``(start, end, new)`` rewritten, and the way back to the text before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.edits, self.places, out, last, size = edits, [], [], 0, 0
        for a, b, new in edits:
            out += [text[last:a], new]
            size += a - last
            self.places.append(size)
            size += len(new)
            last = b
        self.text = "".join([*out, text[last:]])
        self.starts = [a for a, _, _ in edits]

    def back(self, a: int, b: int) -> tuple[int, int, bool]:
        """The span before, and whether something in it was rewritten."""
        a, b = self._char(a)[0], self._char(b - 1)[1]
        k = bisect.bisect_left(self.starts, a)
        return a, b, k < len(self.starts) and self.starts[k] < b

    def on(self, at: int) -> int | None:
        """The place of a character of the text before, if it was not rewritten."""
        k = bisect.bisect_right(self.starts, at) - 1
        if k < 0:
            return at
        _, b, new = self.edits[k]
        return at - b + self.places[k] + len(new) if at >= b else None

    def _char(self, at: int) -> tuple[int, int]:
        k = bisect.bisect_right(self.places, at) - 1
        if k < 0:
            return at, at + 1
        a, b, new = self.edits[k]
        if at < self.places[k] + len(new):
            return a, b
        return b + at - self.places[k] - len(new), b + at - self.places[k] - len(new) + 1


def _letters(text: str) -> list[tuple[int, int, str]]:
    """Look-alikes, wide letters, foreign digits, dashes and invisible characters."""
    found: list[tuple[int, int, str]] = []
    if not text.isascii():
        for m in _ODD.finditer(text):
            c = m[0]
            if c in LOOK_ALIKES:
                found.append((m.start(), m.end(), LOOK_ALIKES[c]))
            elif "！" <= c <= "～":
                found.append((m.start(), m.end(), chr(ord(c) - 0xFEE0)))
            elif "‐" <= c <= "―":
                found.append((m.start(), m.end(), "-"))
            elif unicodedata.category(c) == "Nd":
                found.append((m.start(), m.end(), str(unicodedata.digit(c))))
            elif unicodedata.category(c) == "Cf":
                found.append((m.start(), m.end(), ""))
    return found


def _brackets(text: str) -> list[tuple[int, int, str]]:
    found, last = [], 0
    for m in _BRACKETED.finditer(text):
        a, last = _with_blanks(text, m.start(), m.end(), last)
        found.append((a, last, "@" if m[1] else "."))
    return found


def _digits(text: str) -> list[list[tuple[int, int, str]]]:
    """Spelled digits as digits, in up to three readings of what stands between them: dropped
    between two spelled ones; dropped all along a number that holds a spelled one; as the first,
    but single dots stay. Numbers of fewer than four digits are part of no identifier."""
    if not _SPELLED.search(text):
        return []
    groups: list[list[re.Match]] = []
    for m in _NUMBER.finditer(text):
        if groups and (m.start() == groups[-1][-1].end() or _NEAR.fullmatch(text, groups[-1][-1].end(), m.start())):
            groups[-1].append(m)
        else:
            groups.append([m])
    readings: list[list[tuple[int, int, str]]] = [[], [], []]
    for group in groups:
        if not any(m[1] or m[2] for m in group) or sum(0 if m[1] else 1 if m[2] else len(m[0]) for m in group) < 4:
            continue
        for k, found in enumerate(readings):
            before = None
            for m in group:
                if before is not None and before.end() < m.start() and not before[1] and _BETWEEN.fullmatch(text, before.end(), m.start()):
                    both = before[2] and m[2]
                    if k == 1 or (both and (k == 0 or text[before.end() : m.start()] != ".")):
                        found.append((before.end(), m.start(), ""))
                if m[1] or m[2]:
                    found.append((m.start(), m.end(), "+" if m[1] else SPELLED[m[2].lower()]))
                before = m
    return [r for k, r in enumerate(readings) if r and r not in readings[:k]]


def _bare(text: str, dots: set[int]) -> list[tuple[int, int, str]]:
    """Bare "dot" between digits and in addresses, bare "at" before a host, where one of the dots
    of the address was disguised; ``dots``: places of those that were bracketed."""
    low = "dot" in text.lower()
    if not low and not dots:
        return []
    found = {(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(text)} if low else set()
    before = None
    for m in _CHAIN.finditer(text):
        if m[0].lower() == "at":
            continue
        if before is not None:
            a, b = before.end(), m.start()
            firm = text[a:b] == "@"
            host = _BARE_HOST.match(text, b) if firm or _BARE_AT.fullmatch(text, a, b) else None
            if host:
                bare = [(d.start(), d.end(), ".") for c in (before, host) for d in _BARE_DOT.finditer(text, c.start(), c.end())]
                if firm or bare or any(text[k] == "." and k in dots for c in (before, host) for k in range(c.start(), c.end())):
                    found.update(bare)
                    if not firm:
                        found.add((a, b, "@"))
        before = m
    return sorted(found)


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the source that hold an identifier once the text is rewritten.

    The text is read without spelled digits first. Of overlapping spans of a kind the first found
    stays, but an address that another holds whole gives way to it (a plain one: is joined by it).
    """
    letters = _Written(text, _letters(text))
    brackets = _Written(letters.text, _brackets(letters.text))
    own = [sorted((a, b) for a, t, b in plain if t == kind) for kind in range(len(KINDS))]
    out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    for k, edits in enumerate([[], *_digits(brackets.text)]):
        digits = _Written(brackets.text, edits)
        dots = {digits.on(p) for p, (_, _, new) in zip(brackets.places, brackets.edits, strict=True) if new == "."} - {None}
        bare = _Written(digits.text, _bare(digits.text, dots))
        steps = [bare, digits, brackets, letters]
        if not any(step.edits for step in steps):
            continue
        for a, kind, b in plain_spans(bare.text):
            changed = False
            for step in steps:
                a, b, here = step.back(a, b)
                changed |= here
            if not changed:
                continue
            met = _meeting(own[kind], a, b)
            if met and (kind or k or not all(a <= x and y <= b and (a, b) != (x, y) for x, y in met)):
                continue
            met = _meeting(out[kind], a, b)
            if met and (kind or not all(a <= x and y <= b for x, y in met)):
                continue
            at = bisect.bisect_left(out[kind], (a,))
            out[kind][at : at + len(met)] = [(a, b)]
    return [(a, kind, b) for kind, spans in enumerate(out) for a, b in spans]


def _meeting(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Those of ordered, separate spans that share a character with ``a`` to ``b``."""
    k = bisect.bisect_left(spans, (a,))
    k -= k > 0 and spans[k - 1][1] > a
    return spans[k : bisect.bisect_left(spans, (b,))]


def spans_of(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The plain spans of a text, and plain and disguised ones together, both in order."""
    if not text:
        return [], []
    plain = plain_spans(text)
    return plain, sorted(plain + disguised_spans(text, plain))


def secret_spans(text: str | None) -> list[tuple[int, int]]:
    """Places of values that stand after the name of a secret and a colon or equals sign."""
    out = []
    for m in _SET.finditer(text or ""):
        if _DIGIT.search(m[1]) and _SECRET_NAME.search(text[max(0, m.start() - 40) : m.start()]):
            out.append((m.start(1), m.end(1)))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None) -> str | None:
    """The text with each span or secret, or run of overlapping ones, replaced by ``[KIND]`` of its first."""
    spans = sorted(spans_of(text)[1] + [(a, len(KINDS), b) for a, b in secret_spans(text)])
    if not spans:
        return text
    out, last = [], 0
    for a, k, b in spans:
        if a >= last:
            out += [text[last:a], f"[{_NAMES[k].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_found`` of each row; the
    numbers by kind and the checksum are of the plain spans, ``n_found`` counts all spans and secrets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1024):
                texts = part.column(1).to_pylist()
                found, secrets = [spans_of(t) for t in texts], [len(secret_spans(t)) for t in texts]
                counts = [[sum(k == kind for _, k, _ in plain) for plain, _ in found] for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(_listed(plain).encode()).hexdigest() for plain, _ in found]),
                        pa.array([_listed(both) for _, both in found], pa.string()),
                        pa.array(secrets, pa.int64()),
                        pa.array([len(both) + n for (_, both), n in zip(found, secrets, strict=True)], pa.int64()),
                    ],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_found"],
                )

    kind = df.schema[doc_id].dataType.simpleString()
    fields = ", ".join(f"n_{k} long" for k in KINDS)
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, {fields}, base_sha256 string, spans string, n_secret long, n_found long"
    )


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with personal data in ``text`` replaced by placeholders, other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1024):
                k = part.schema.get_field_index(text)
                yield part.set_column(k, part.schema.field(k), pa.array([redact(t) for t in part.column(k).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)
