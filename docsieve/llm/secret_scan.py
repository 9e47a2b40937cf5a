"""Secrets in text: fixed shapes, and windows of high entropy inside candidate strings. Column expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, their patterns, the group whose length counts and the least length.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}+", 0, 16),
]
# Character classes with the entropy in bits that a window must reach.
CLASSES = [
    ("entropy_hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}+(?![0-9A-Za-z])", 3.0),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", 3.9),
]
WINDOW = 20
# No secrets: windows that meet placeholders, runs of one character or alphabets; whole candidates (patterns from ^ to $)
# that are words without digits, numbers or UUIDs.
ALLOW = [
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx",
    r"(.)\1{7,}",
    r"(?i)abcdefghij|0123456789",
    r"^[A-Za-z/_+-]*$",
    r"^[0-9]*$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
]
KINDS = [b[0] for b in BASE] + [c[0] for c in CLASSES]
_SPAN = "array<struct<start:int,kind:int,end:int>>"
# Codes of the candidate characters: from "+" to "z".
_LOW, _CODES = 43, 80
_STEP = 256


def _let(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(c), then), 1)


def _running(items: Column, start: str, length: str) -> Column:
    """Spans from gaps and lengths in turn; in two levels, so that no list grows item by item over the whole text."""
    n = F.size(items)
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _STEP).cast("int")), lambda k: F.slice(items, k * _STEP + 1, _STEP))
    none = F.array().cast("array<int>")

    def base(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.lit(0), lambda s, x: s + x[start] + x[length])
        return F.struct((acc["at"] + own).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def inside(acc: Column, x: Column) -> Column:
        a = acc["at"] + x[start]
        span = F.struct(a.alias("start"), (a + x[length]).alias("end"), x["value"].alias("value"))
        return F.struct((a + x[length]).alias("at"), F.array_append(acc["out"], span).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return _let(parts, lambda ps: _let(
        F.aggregate(ps, F.struct(F.lit(0).alias("at"), none.alias("out")), base)["out"],
        lambda bs: F.flatten(F.zip_with(ps, bs, lambda p, b: F.aggregate(p, F.struct(b.alias("at"), empty.alias("out")), inside)["out"])),
    ))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """``start, end, value`` of every match, leftmost and non-overlapping, in code points; ``value`` is the group.

    The pieces between matches and the matches take turns, so their lengths give the places.
    """
    def spans(pieces: Column, matches: Column, values: Column) -> Column:
        items = F.transform(matches, lambda m, i: F.struct(
            F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"), F.get(values, i).alias("value")
        ))
        return _let(items, lambda x: _running(x, "gap", "len"))

    found = _let(F.split(text, pattern, -1), lambda p: _let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: (
            _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: spans(p, m, v)) if group else spans(p, m, m)
        )
    ))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _share(c: Column) -> Column:
    """c * log2(c), 0 for 0."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def hot_windows(candidate: Column, bits: float, window: int = WINDOW, cut: Column | None = None) -> Column:
    """Spans of a candidate covered by windows of at least ``bits`` of Shannon entropy that hold a letter and a digit.

    Windows that overlap one of the spans in ``cut`` do not count.

    The counts per character follow the window: one character leaves, one
    comes, and the entropy changes by their two terms only. Every 256 windows
    start anew, so a long candidate costs in proportion to its length.
    """
    def scan(codes: Column, at: Column) -> Column:
        n_windows = F.least(F.lit(_STEP), F.size(codes) - window + 1 - at)
        first = F.slice(codes, at + 1, window)
        counts = F.transform(F.sequence(F.lit(0), F.lit(_CODES - 1)), lambda k: F.size(F.filter(first, lambda c: c == k)))

        def flagged(state: Column, i: Column) -> Column:
            ok = (F.lit(math.log2(window)) - state["sum"] / window >= bits - 1e-9) & (state["digits"] > 0) & (state["digits"] < window)
            return F.when(ok, F.array_append(state["out"], i)).otherwise(state["out"])

        def step(state: Column, i: Column) -> Column:
            out, new = F.get(codes, i - 1), F.get(codes, i + window - 1)
            c_out = F.get(state["counts"], out)
            c_new = F.get(state["counts"], new) - F.when(out == new, 1).otherwise(0)
            moved = F.struct(
                F.transform(state["counts"], lambda c, k: c - F.when(k == out, 1).otherwise(0) + F.when(k == new, 1).otherwise(0)).alias("counts"),
                (state["sum"] - _share(c_out) + _share(c_out - 1) - _share(c_new) + _share(c_new + 1)).alias("sum"),
                (state["digits"] - _is_digit(out) + _is_digit(new)).alias("digits"),
                state["out"].alias("out"),
            )
            return _let(moved, lambda s: F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), s["digits"].alias("digits"), flagged(s, i).alias("out")))

        def begin(cs: Column) -> Column:
            state = F.struct(
                cs.alias("counts"), F.aggregate(cs, F.lit(0.0), lambda s, c: s + _share(c)).alias("sum"),
                F.aggregate(F.slice(cs, 48 - _LOW + 1, 10), F.lit(0), lambda s, c: s + c).alias("digits"), F.array().cast("array<int>").alias("out"),
            )
            return _let(state, lambda s: F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), s["digits"].alias("digits"), flagged(s, at).alias("out")))

        later = F.when(n_windows > 1, F.sequence(at + 1, at + n_windows - 1)).otherwise(F.array().cast("array<int>"))
        return _let(counts, lambda cs: F.aggregate(later, begin(cs), step)["out"])

    no_span = F.array().cast("array<struct<start:int,end:int>>")

    def kept(starts: Column) -> Column:
        return starts if cut is None else F.filter(starts, lambda i: ~F.exists(cut, lambda x: (x["start"] < i + window) & (i < x["end"])))

    def spans(codes: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.size(codes) - window, F.lit(_STEP)), lambda at: kept(scan(codes, at)))
        # Segment by segment first; then the segments' few spans.
        return _let(starts, lambda ss: _let(
            F.flatten(F.transform(ss, lambda s: F.aggregate(s, no_span, _merge_starts(window)))), lambda all_: F.aggregate(all_, no_span, _merge_spans)
        ))

    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - _LOW)
    return F.when(F.length(candidate) >= window, _let(F.filter(codes, lambda c: c >= 0), spans)).otherwise(no_span)


def _merge_starts(window: int):
    return lambda acc, i: _merge_spans(acc, F.struct(i.alias("start"), (i + window).alias("end")))


def _merge_spans(acc: Column, x: Column) -> Column:
    """Spans in order, joined where they meet."""
    last = F.try_element_at(acc, F.lit(-1))
    joined = F.struct(last["start"].alias("start"), x["end"].alias("end"))
    return F.when(x["start"] <= F.coalesce(last["end"], F.lit(-1)), F.array_append(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(F.array_append(acc, x))


def _is_digit(code: Column) -> Column:
    return F.when(code.between(48 - _LOW, 57 - _LOW), 1).otherwise(0)


def _is_whole(pattern: str) -> bool:
    return pattern.removeprefix("(?i)").startswith("^") and pattern.endswith("$")


def _allowed(c: Column, allow: list[str]) -> Column:
    """Whether a pattern from ^ to $ takes the candidate as a whole."""
    hit = F.lit(False)
    for p in filter(_is_whole, allow):
        hit = hit | c.rlike(p)
    return hit


def _allowed_spans(c: Column, allow: list[str]) -> Column:
    """Where the other patterns match inside the candidate."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.concat(none, *[located(c, p) for p in allow if not _is_whole(p)])


def _at_least(n: int):
    return lambda s: F.length(s["value"]) >= n


def _span(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _hot_spans(bits: float, kind: int, allow: list[str]):
    return lambda s: F.transform(
        _let(_allowed_spans(s["value"], allow), lambda cut: hot_windows(s["value"], bits, cut=cut)),
        lambda w: F.struct((s["start"] + w["start"]).alias("start"), F.lit(kind).alias("kind"), (s["start"] + w["end"]).alias("end")),
    )


def _base_spans(text: Column) -> Column:
    """Spans of the fixed shapes."""
    found = []
    for no, (_, pattern, group, least) in enumerate(BASE):
        found.append(F.transform(F.filter(located(text, pattern, group), _at_least(least)), _span(no)))
    return F.array_sort(F.concat(*found)).cast(_SPAN)


def _added_spans(text: Column, base: Column, allow: list[str]) -> Column:
    """Spans of high entropy that no base span covers."""
    found = []
    for no, (_, pattern, bits) in enumerate(CLASSES, len(BASE)):
        candidates = F.filter(located(text, pattern), lambda s: ~_allowed(s["value"], allow))
        spans = F.flatten(F.transform(candidates, _hot_spans(bits, no, allow)))
        found.append(F.filter(spans, lambda x: ~F.exists(base, lambda o: (o["start"] <= x["start"]) & (x["end"] <= o["end"]))))
    return F.concat(*found).cast(_SPAN)


def find_secrets(docs: DataFrame, text_col: str = "text", allow: list[str] | None = None) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of ``start, kind, end`` by start, then kind.

    ``kind`` is a place in ``KINDS``; places are code points, ends exclusive.
    ``spans`` holds the base spans and the windows of high entropy that they
    do not cover. Patterns of ``allow`` from ^ to $ suppress whole candidates,
    the others only the windows that overlap a match. Null text has no spans. Each row stands for itself: repeated rows repeat their spans.
    Columns of ``docs`` named ``base_spans`` or ``spans`` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("base_spans", _base_spans(text))
    added = _added_spans(text, F.col("base_spans"), ALLOW if allow is None else allow)
    return out.withColumn("spans", F.array_sort(F.concat("base_spans", added)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
