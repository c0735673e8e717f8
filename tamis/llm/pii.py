"""Personal data in texts, also where it is disguised, at its place in the source.

Plain identifiers are found in the text itself. Then a cascade of transducers rewrites
disguises (look-alike characters, spelled digits, at/dot words); each keeps the list of
rewritten segments, so that a span found in the rewritten text is mapped back, transducer by
transducer, to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tamis.llm.batches import chosen, steps, strings

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, index of the kind, end

# Plain identifiers. Possessive parts keep every search linear in the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if at % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            last = match.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def plain_spans(text: str) -> list[Span]:
    """Leftmost, per kind non-overlapping identifiers, by start and then kind."""
    found: list[Span] = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _DIGITS.finditer(text):
            # at most three digits can be below 256 unless zeros lead
            if m[1] and all(len(p) <= 3 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


class Rewrite:
    """A transducer's output with the segments it rewrote: (start, end, source start, source end)."""

    def __init__(self, source: str, changes: list[tuple[int, int, str]]) -> None:
        pieces, self.starts, self.segments, last, at = [], [], [], 0, 0
        for low, high, new in changes:
            pieces += [source[last:low], new]
            at += low - last
            self.starts.append(at)
            self.segments.append((at, at + len(new), low, high))
            at, last = at + len(new), high
        pieces.append(source[last:])
        self.text = "".join(pieces)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of an output span, and whether it holds anything rewritten.

        A boundary inside a rewritten segment moves to that segment's outer side.
        """
        first, low = self._at(start)
        last, high = self._at(end - 1)
        low = first[2] if first and start < first[1] else low
        high = last[3] if last and end - 1 < last[1] else high + 1
        around = self.segments[max(0, bisect_right(self.starts, start) - 1) : bisect_right(self.starts, end - 1)]
        # a deleted character counts where the span goes on at both its sides
        touched = any(a < end and b > start if a < b else start < a < end for a, b, _, _ in around)
        return low, high, touched

    def _at(self, position: int) -> tuple[tuple | None, int]:
        i = bisect_right(self.starts, position) - 1
        if i < 0:
            return None, position
        segment = self.segments[i]
        return segment, position - segment[1] + segment[3]


# Look-alikes of ASCII characters in other scripts, and characters without width.
LOOKALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іɩι", "j": "јϳ", "k": "κ", "l": "ӏⅼ",
    "m": "ⅿ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хⅹ",
    "y": "уү", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "Υ", "Z": "Ζ", "0": "߀", ".": "․。｡", "-": "‐‑‒–−", "@": "﹫", "+": "﬩",
}
NO_WIDTH = "​‌‍⁠﻿­"


def _lookalike_table() -> dict[str, str]:
    table = {c: plain for plain, many in LOOKALIKES.items() for c in many}
    table |= {chr(code): chr(code - 0xFEE0) for code in range(0xFF01, 0xFF5F)}  # full-width ASCII
    for low, count in ((0x1D400, 52), (0x1D7CE, 10)):  # bold mathematical letters and digits
        table |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(low, low + count)}
    return table | {c: "" for c in NO_WIDTH}


_TABLE = _lookalike_table()
_LOOKALIKE = re.compile("[" + "".join(map(re.escape, _TABLE)) + "]")


def lookalikes(text: str) -> list[tuple[int, int, str]]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        pass
    else:
        # of the characters of Latin-1 only the soft hyphen is in the table
        if "\xad" not in text:
            return []
    return [(m.start(), m.end(), _TABLE[m[0]]) for m in _LOOKALIKE.finditer(text)]


# Names of digits and of signs between them.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGN_WORDS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "minus": "-"}
# Digit names in a row that are read as a number; fewer are prose.
MIN_DIGIT_WORDS = 4

_BETWEEN = re.compile(r"[ ,.-]{1,2}|[ -]?[0-9][ -]?|")


def _name_finder() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name in DIGIT_WORDS | SIGN_WORDS:
        found.add_word(name, name)
    found.make_automaton()
    return found


_NAMES = _name_finder()


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of digit names become digits; signs named between them become signs."""
    low = lowered(text)
    names: list[tuple[int, int, str]] = []
    for last, name in _NAMES.iter(low):
        start, end = last + 1 - len(name), last + 1
        if not (start and low[start - 1].isalnum()) and not (end < len(low) and low[end].isalnum()):
            names.append((start, end, name))
    if len(names) < MIN_DIGIT_WORDS:
        return []
    changes: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []

    def close() -> None:
        while run and run[-1][2] in SIGN_WORDS:
            run.pop()
        while run and SIGN_WORDS.get(run[0][2], "+") != "+":
            run.pop(0)
        if sum(name in DIGIT_WORDS for _, _, name in run) >= MIN_DIGIT_WORDS:
            for at, (start, end, name) in enumerate(run):
                high = run[at + 1][0] if at + 1 < len(run) else end
                # written digits between names stay
                kept = "".join(_DIGIT.findall(text[end:high]))
                changes.append((start, high, (DIGIT_WORDS.get(name) or SIGN_WORDS[name]) + kept))
        run.clear()

    for start, end, name in names:
        if run and (start - run[-1][1] > 3 or not _BETWEEN.fullmatch(text, run[-1][1], start)):
            close()
        run.append((start, end, name))
    close()
    return changes


# Last parts of domains that a sentence with bare "at" and "dot" must end in.
TOP_DOMAINS = "com org net edu gov mil int info biz io co me app dev ai de fr es it nl be ch at eu uk us ca au jp in br mx ru pl se"

_OPEN, _CLOSE = r"[\x20]?[\[({<][\x20]?", r"[\x20]?[\])}>][\x20]?"
_AT = re.compile(rf"{_OPEN}(?:at|@|arroba){_CLOSE}|\x20(?:at|arroba|@)\x20", re.IGNORECASE)
_DOT = re.compile(rf"{_OPEN}(?:dot|\.|punkt|punto|point){_CLOSE}|\x20(?:dot|punkt|punto|point)\x20|\.", re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_LOCAL_DOT = re.compile(rf"[A-Za-z0-9_%+-]{{1,64}}({_DOT.pattern})[A-Za-z0-9_%+-]{{1,64}}\Z", re.IGNORECASE)
_BRACKETED = re.compile(r"[\[({<][\x20]?(?:at|@|arroba|dot|\.|punkt|punto|point)[\x20]?[\])}>]", re.IGNORECASE)
_BARE = (" dot ", " punkt ", " punto ", " point ", " @ ")
_TOP = frozenset(TOP_DOMAINS.split())


def at_dot(text: str) -> list[tuple[int, int, str]]:
    """Words and brackets that stand for ``@`` and ``.`` in an address become those.

    Bare words count only where the address ends in a known top domain and at least one dot
    is disguised; anything in brackets counts before letters of any top domain.
    """
    if not _BRACKETED.search(text):
        low = lowered(text)
        if not any(sign in low for sign in _BARE) or not any(sign in low for sign in (" at ", "@", " arroba ")):
            return []
    changes: list[tuple[int, int, str]] = []
    last = 0
    for at in re.finditer(f"{_AT.pattern}|@", text, re.IGNORECASE):
        if at.start() < max(1, last) or text[at.start() - 1] not in _LOCAL:
            continue
        dots, ends, bare_dot, position = [], [], False, at.end()
        label = _LABEL.match(text, position)
        while label:
            ends.append((label.end(), label[0]))
            dot = _DOT.match(text, label.end())
            if not dot:
                break
            dots.append(dot)
            label = _LABEL.match(text, dot.end())
        dots = dots[: max(0, len(ends) - 1)]

        def bare(sign: str) -> bool:
            return sign.strip().isalpha()

        bracketed = any(s.strip()[0] in "[({<" for s in [at[0], *(d[0] for d in dots)])
        # a sentence may go on after the address: end at the last label that can be a top domain
        while dots and not (ends[len(dots)][1].lower() in _TOP or (not bare(dots[-1][0]) and bracketed and len(ends[len(dots)][1]) > 1 and ends[len(dots)][1].isalpha())):
            dots.pop()
        bare_dot = any(bare(d[0]) for d in dots)
        plain = at[0] == "@" and all(d[0] == "." for d in dots)
        if not dots or plain or (bare(at[0]) and not (bare_dot or bracketed)):
            continue
        local_dots, end = [], at.start()
        while local := _LOCAL_DOT.search(text, max(last, end - 140), end):
            end = local.start(1)
            if local[1] != ".":
                local_dots.append((end, local.end(1), "."))
        changes += reversed(local_dots)
        changes.append((at.start(), at.end(), "@"))
        changes += [(d.start(), d.end(), ".") for d in dots if d[0] != "."]
        last = ends[len(dots)][0]
    return changes


TRANSDUCERS: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (lookalikes, spelled_digits, at_dot)


def disguised_spans(text: str) -> list[Span]:
    """Identifiers of the rewritten text that hold something rewritten, as source spans."""
    stages: list[Rewrite] = []
    for transducer in TRANSDUCERS:
        changes = transducer(stages[-1].text if stages else text)
        if changes:
            stages.append(Rewrite(stages[-1].text if stages else text, changes))
    if not stages:
        return []
    found = []
    for start, kind, end in plain_spans(stages[-1].text):
        rewritten = False
        for stage in reversed(stages):
            start, end, touched = stage.back(start, end)
            rewritten = rewritten or touched
        if rewritten:
            found.append((start, kind, end))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("plain", pa.bool_())]))


def _dicts(base: list[Span], every: list[Span]) -> list[dict]:
    plain = set(base)
    return [{"start": s, "kind": KINDS[k], "end": e, "plain": (s, k, e) in plain} for s, k, e in every]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, plain and disguised spans) by start, kind and end."""
    base = plain_spans(text)
    extra = disguised_spans(text)
    return base, sorted({*base, *extra}) if extra else base


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``spans`` (start, kind, end in code points, plain or not).

    Null and empty texts have no spans; repeated rows give repeated rows; columns other than
    the two named are not read. A disguised identifier may contain a plain one; both are listed.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            rows = [_dicts(*all_spans(text)) for text in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SPANS)], ["id", "spans"])

    schema = f"id {kind}, spans array<struct<start:bigint,kind:string,end:bigint,plain:boolean>>"
    return chosen(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def masked_text(text: str) -> str:
    """The text with every identifier replaced by its kind; overlapping ones by the first's."""
    _, spans = all_spans(text)
    pieces, at = [], 0
    for start, kind, end in spans:
        if start < at:
            # overlaps what is replaced already: cover its rest too
            at = max(at, end)
            continue
        pieces += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*pieces, text[at:]]) if spans else text


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with identifiers in ``text_col`` replaced; all rows and columns stay, null too."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at):
            texts = [t if t is None else masked_text(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
