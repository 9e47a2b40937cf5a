"""Personal data in text: an automaton finds anchors, small parsers expand each anchor to the span around it."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm import segments as seg

# The kinds in their order: the four fixed shapes, then those that the anchors add.
BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["intl_email", "address", "account"]
KINDS = BASE_KINDS + ADDED_KINDS
#: Words that announce an identifier, with the check that its value must pass.
CUES = {
    "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "digits", "acct": "digits", "konto": "digits", "kontonummer": "digits",
    "compte": "digits", "cuenta": "digits", "passport": "document", "passeport": "document", "pasaporte": "document", "reisepass": "document",
}
#: Schemes whose target is a person's address.
SCHEMES = ["tel:", "sip:", "sips:", "xmpp:", "mailto:"]
# Bytes of text worked on at a time; a longer text is worked on alone.
BATCH = 8 << 20

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE_RUN = re.compile(r"[\x20().0-9-]+")
_FILLER = re.compile(r"(?:[\x20\x09.:#=-]|(?i:number|num|no|nr|is|id)(?![A-Za-z0-9])){0,12}+")
_VALUE = re.compile(r"[A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){0,41}")
_SSN = re.compile(r"([0-9]{3})([\x20-]?)([0-9]{2})\2([0-9]{4})(?![0-9A-Za-z])")
_ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,17}(?![0-9A-Za-z])")
_DOCUMENT = re.compile(r"(?=[A-Za-z]{0,8}[0-9])[A-Z0-9]{6,9}(?![0-9A-Za-z])")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>@]+@[^\s/?#\"'<>@]+")
_TARGET = re.compile(r"[^\s\"'<>;?,]+")
_SCHEME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")

_automaton = None


def _anchors() -> ahocorasick.Automaton:
    """One automaton over at-signs, digits, plus signs, schemes and cues in three letterings; built once a worker."""
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, ("digit", 1, None))
        a.add_word("@", ("at", 1, None))
        a.add_word("+", ("plus", 1, None))
        a.add_word("://", ("url", 3, None))
        for s in SCHEMES:
            for form in {s, s.upper(), s.title()}:
                a.add_word(form, ("target", len(s), s))
        for word, check in CUES.items():
            for form in {word, word.upper(), word.capitalize(), word.title()}:
                a.add_word(form, ("cue", len(word), check))
        a.make_automaton()
        _automaton = a
    return _automaton


def _run_end(text: str, at: int) -> int:
    m = _DIGITS.match(text, at)
    return m.end() if m else at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around an at-sign, not reaching before ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    m = _LABEL.match(text, at + 1)
    if start == at or not m:
        return None
    end, dots = m.end(), 0
    while end < len(text) and text[end] == "." and (m := _LABEL.match(text, end + 1)):
        end, dots = m.end(), dots + 1
    return (start, end) if dots else None


def _ip(text: str, at: int) -> tuple[int, bool] | None:
    """End of four runs of digits joined by dots from ``at``, and whether each is at most 255."""
    parts, end = [], at
    for i in range(4):
        if i:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        upto = _run_end(text, end)
        if upto == end:
            return None
        parts.append(text[end:upto].lstrip("0"))
        end = upto
    return end, all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _digit_chain(text: str, at: int) -> int:
    """End of the digits from ``at`` with at most one space or dash between two."""
    end = _run_end(text, at)
    while end + 1 < len(text) and text[end] in " -" and text[end + 1] in "0123456789":
        end = _run_end(text, end + 1)
    return end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _is_card(chain: str) -> bool:
    if len(chain) > 40:  # 19 digits with 18 separators are 37 characters
        return False
    digits = chain.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int) -> tuple[int, bool] | None:
    """End of the number that a plus sign begins, and whether it has 9 to 15 digits."""
    if at + 2 >= len(text) or text[at + 1] not in "0123456789":
        return None
    m = _PHONE_RUN.match(text, at + 2)
    body = m.group(0).rstrip(" ().-") if m else ""
    if len(body) < 2:
        return None
    n = 1 + sum(c in "0123456789" for c in body)
    return at + 2 + len(body), 9 <= n <= 15


def _is_word(c: str) -> bool:
    return c in _LOCAL or (c > "\x7f" and c.isalnum())


def _intl_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """An address with letters beyond ASCII: labels of letters, digits and dashes, the last of two letters or more."""
    start = at
    while start > floor and _is_word(text[start - 1]):
        start -= 1
    end = at + 1
    while end < len(text) and (_is_word(text[end]) and text[end] not in "_%+"):
        end += 1
    while end > at + 1 and text[end - 1] in ".-":
        end -= 1
    labels = text[at + 1 : end].split(".")
    if start == at or len(labels) < 2 or not all(labels) or len(labels[-1]) < 2 or not labels[-1].isalpha() or text[start:end].isascii():
        return None
    return start, end


def _iban(text: str, at: int) -> int | None:
    """End of an account number of 15 to 34 characters whose remainder by 97 is one."""
    m = _VALUE.match(text, at)
    if not m:
        return None
    chars, best = "", None
    for i in range(m.start(), m.end()):
        c = text[i]
        if c in " -":
            continue
        chars += c.upper()
        if len(chars) > 34:
            break
        whole_word = i + 1 == len(text) or not (text[i + 1].isascii() and text[i + 1].isalnum())
        if len(chars) >= 15 and whole_word and re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", chars):
            if int("".join(str(int(x, 36)) for x in chars[4:] + chars[:4])) % 97 == 1:
                best = i + 1
    return best


def _account(text: str, at: int, check: str) -> tuple[int, int] | None:
    """The identifier after a cue that ends at ``at``: filler words, then a value that passes the cue's check."""
    if at < len(text) and text[at].isalnum():
        return None
    start = _FILLER.match(text, at).end()
    if start == at:
        return None
    if check == "iban":
        end = _iban(text, start)
        return (start, end) if end else None
    m = {"ssn": _SSN, "digits": _ACCOUNT, "document": _DOCUMENT}[check].match(text, start)
    if not m:
        return None
    if check == "ssn" and (m[1] in ("000", "666") or m[1] > "899" or m[3] == "00" or m[4] == "0000"):
        return None
    return m.span()


def _url(text: str, colon: int, floor: int) -> tuple[int, int] | None:
    """A web address that names a user: scheme, ``://``, user, at-sign, host."""
    start = colon
    while start > floor and text[start - 1] in _SCHEME_CHARS:
        start -= 1
    m = _AUTHORITY.match(text, colon + 3)
    if start == colon or not text[start].isalpha() or not m:
        return None
    return start, m.end()


def _target(text: str, start: int, at: int, scheme: str) -> tuple[int, int] | None:
    """The target of a scheme such as ``tel:``: seven digits or more, or a user at a host."""
    if start and text[start - 1].isalnum():
        return None
    m = _TARGET.match(text, at)
    if not m:
        return None
    body = m.group(0).rstrip(".)")
    good = sum(c in "0123456789" for c in body) >= 7 if scheme == "tel:" else 0 < body.find("@") < len(body) - 1
    return (start, at + len(body)) if good else None


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``kind, start, end`` of the base spans and of all spans, by kind, then start; ends exclusive.

    Every anchor looks at the characters next to it only, up to the first one
    that cannot belong, and never back before the last span of its kind, so the
    work is in proportion to the text.
    """
    base: list[tuple[int, int, int]] = []
    added: list[tuple[int, int, int]] = []
    end_of = dict.fromkeys(KINDS, 0)
    run = 0  # end of the digits that an ip attempt has looked at
    for last, (what, length, detail) in _anchors().iter(text):
        at = last + 1 - length
        if what == "digit":
            if at >= end_of["card"]:
                end = end_of["card"] = _digit_chain(text, at)
                if _is_card(text[at : min(end, at + 41)]):
                    base.append((2, at, end))
            if at >= run and at >= end_of["ip"]:
                found = _ip(text, at)
                if found:
                    run = end_of["ip"] = found[0]
                    if found[1]:
                        base.append((1, at, found[0]))
                else:
                    run = _run_end(text, at)
        elif what == "at":
            span = _email(text, at, end_of["email"])
            if span:
                base.append((0, *span))
                end_of["email"] = span[1]
            wide = _intl_email(text, at, end_of["intl_email"])
            if wide:
                added.append((4, *wide))
                end_of["intl_email"] = wide[1]
        elif what == "plus":
            if at >= end_of["phone"]:
                found = _phone(text, at)
                if found:
                    end_of["phone"] = found[0]
                    if found[1]:
                        base.append((3, at, found[0]))
        else:
            if what == "cue":
                kind, name = 6, "account"
                span = None if at and text[at - 1].isalnum() else _account(text, last + 1, detail)
            else:
                kind, name = 5, "address"
                span = _url(text, at, end_of[name]) if what == "url" else _target(text, at, last + 1, detail)
            if span and span[0] >= end_of[name]:
                added.append((kind, *span))
                end_of[name] = span[1]
    base.sort()
    return base, base + sorted(a for a in added if not any(b <= a[1] and a[2] <= e for b, e in _near(base, a)))


def _near(base: list[tuple[int, int, int]], span: tuple[int, int, int]) -> Iterator[tuple[int, int]]:
    """The base spans that may cover ``span``: per kind, the last one that starts no later."""
    for kind in range(len(BASE_KINDS)):
        i = bisect_right(base, (kind, span[1], 1 << 62)) - 1
        if i >= 0 and base[i][0] == kind:
            yield base[i][1:]


_SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _spans_array(lists: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [s for spans in lists for s in spans]
    cols = list(zip(*flat, strict=True)) or [(), (), ()]
    values = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in cols], fields=list(_ARROW_SPAN.value_type))
    offsets = [0]
    for spans in lists:
        offsets.append(offsets[-1] + len(spans))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=_ARROW_SPAN)


def find_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of ``kind, start, end`` by kind, then start.

    ``kind`` is a place in ``KINDS``; places are code points, ends exclusive.
    ``spans`` holds the base spans and what the other anchors add and no base
    span covers: addresses with letters beyond ASCII, web addresses that name a
    user, targets of ``tel:`` and its like, and identifiers after a cue. Null
    or empty text has no spans; each row stands for itself, so repeated rows
    repeat their spans; the whole text is read however long it is. Columns of
    ``docs`` named ``base_spans`` or ``spans`` are replaced, all others kept.
    """
    kept = [c for c in docs.columns if c not in ("base_spans", "spans")]
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept])
    for name in ("base_spans", "spans"):
        schema.add(name, _SPAN)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in seg.batches_of(batches, text_col, BATCH):
            found = [scan(t) if t else ([], []) for t in b.column(text_col).to_pylist()]
            arrays = [b.column(c) for c in kept] + [_spans_array([f[i] for f in found]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "base_spans", "spans"])

    return docs.select(*kept).mapInArrow(work, schema)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
