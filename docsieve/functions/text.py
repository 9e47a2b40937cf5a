"""String expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

import html.entities
import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the standard string strip understands it: the Unicode class
# plus the four ASCII separators.
_WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove whitespace of every kind on both ends (``trim`` drops spaces only).

    Each end is looked at on its own and the end as a beginning, so the text between is not searched.
    """
    for _ in range(2):
        c = F.reverse(F.regexp_replace(c, rf"(?U)^{_WS}++", ""))
    return c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once a row however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def contains_any(c: Column, words: list[str]) -> Column:
    """True where any of the literal words occurs."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def first_match(c: Column, patterns: list[str]) -> Column:
    """The first pattern in list order that matches, else null.

    A pattern is searched only where the literal characters that it starts with occur.
    """

    def hit(text: Column, p: str) -> Column:
        start, found = literal_start(p), text.rlike("(?U)" + p)
        return F.contains(text, F.lit(start)) & found if start else found

    return once(c, lambda text: F.coalesce(*[F.when(hit(text, p), F.lit(p)) for p in patterns]))


def literal_start(pattern: str) -> str:
    """Characters that every match of ``pattern`` starts with; a pattern with alternatives outside brackets has none."""
    outside, depth = "", 0
    for ch in re.sub(r"\\.|\[[^\]]*\]", "", pattern):
        depth += (ch == "(") - (ch == ")")
        outside += ch if not depth else ""
    start = re.match(r"[a-z0-9 ]*", pattern)[0]
    if "|" in outside:
        return ""
    # A repeated character belongs to what follows it.
    return start[:-1] if pattern[len(start) : len(start) + 1] in ("?", "*", "+", "{") else start


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits (no lambda, so equal scans stay equal and shuffles are reused)."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


# ---------------------------------------------------------------- HTML

# Elements dropped with their content.
DROPPED_ELEMENTS = ["script", "style", "nav", "footer", "header"]

# script and style run to the end of the page when they are never closed.
_RAW = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in DROPPED_ELEMENTS[:2])
_BLOCK = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in DROPPED_ELEMENTS[2:])
# Possessive, so that a run of any length takes no stack; a quoted value may hold ">".
_TAG = r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[A-Za-z][^>]*+>"""
_TAG_RUN = rf"(?:{_TAG}|<![^>]*+>|<\?[^>]*+>)++"


def _named_entities() -> dict[str, str]:
    """Entity names with their characters, from the standard library's HTML 4 table."""
    names = {n: chr(cp) for n, cp in html.entities.name2codepoint.items()}
    names["apos"] = "'"
    return names


def decode_entities(c: Column) -> Column:
    """Decode ``&name;``, ``&#n;`` and ``&#xh;`` in one pass, so ``&amp;lt;`` stays ``&lt;``.

    The text is cut at each ``&``; every later part starts with a candidate
    name. The steps are separate so that no lambda repeats another's work.
    """
    table = F.from_json(F.lit(json.dumps(_named_entities())), "map<string,string>")

    def name(part: Column, i: Column) -> Column:
        found = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        return F.struct(part.alias("part"), F.when(i > 0, found).alias("name"))

    def number(p: Column) -> Column:
        digits = (
            F.when(p["name"].rlike("^#[xX]"), F.conv(F.substring(p["name"], 3, 7), 16, 10))
            .when(F.startswith(p["name"], F.lit("#")), F.substring(p["name"], 2, 8))
        )
        return F.struct(p["part"].alias("part"), p["name"].alias("name"), digits.cast("bigint").alias("n"))

    def char(p: Column) -> Column:
        valid = p["n"].between(1, 0xD7FF) | p["n"].between(0xE000, 0x10FFFF)
        decoded = (
            F.when(p["name"] == "", F.lit(None).cast("string"))
            .when(p["name"] == "amp", "&")
            .when(valid, F.decode(F.unhex(F.lpad(F.hex(p["n"]), 8, "0")), "UTF-32"))
            .when(p["n"].isNotNull(), "\ufffd")
            .when(p["name"].isNotNull(), F.element_at(table, p["name"]))
        )
        return F.struct(p["part"].alias("part"), p["name"].alias("name"), decoded.alias("char"))

    def text(p: Column) -> Column:
        rest = F.substring(p["part"], F.length(p["name"]) + 2, F.length(p["part"]))
        return (
            F.when(p["name"].isNull(), p["part"])
            .when(p["char"].isNull(), F.concat(F.lit("&"), p["part"]))
            .otherwise(F.concat(p["char"], rest))
        )

    parts = F.transform(F.split(c, "&"), name)
    return F.array_join(F.transform(F.transform(F.transform(parts, number), char), text), "")


def let(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(c), then), 1)


# Put behind the "<" of an opener that nothing closes, so that no pattern runs to the end of the page for it in vain.
_ASIDE = "\x01"


def _aside(c: Column, head: Callable[[Column], Column], opener: str) -> Column:
    """``c`` with every ``opener`` behind its ``head`` put aside."""
    def mark(t: Column) -> Column:
        return let(head(t), lambda h: F.concat(h, F.regexp_replace(F.substring(t, F.length(h) + 1, F.length(t)), rf"(?i)<(?={opener})", f"<{_ASIDE}")))

    return let(c, mark)


def _upto_last(text: Column, end: str) -> Column:
    return F.left(text, F.length(text) - F.length(F.substring_index(text, end, -1)))


def drop_raw(c: Column, instead: str) -> Column:
    """Comments, scripts and styles replaced; work in proportion to the text, whatever is left open.

    An opener can only be closed before the last end of a comment, or the last
    ``>``; later ones are put aside first, so every search succeeds.
    """
    c = _aside(c, lambda t: _upto_last(t, "-->"), "!--")
    c = _aside(c, lambda t: _upto_last(t, ">"), rf"(?:{'|'.join(DROPPED_ELEMENTS[:2])})\b")
    return F.replace(F.regexp_replace(c, rf"(?is)<!--.*?-->|{_RAW}", instead), F.lit(f"<{_ASIDE}"), F.lit("<"))


def _drop_blocks(c: Column, instead: str) -> Column:
    """Elements of the other dropped kinds, closed ones only; as linear as ``drop_raw``."""
    for t in DROPPED_ELEMENTS[2:]:
        # Up to the last ">" that a closing tag follows.
        c = _aside(c, lambda x, t=t: F.regexp_extract(x, rf"(?is)\A(.*>)[^>]*</{t}\s*>", 1), rf"{t}\b")
    return F.replace(F.regexp_replace(c, rf"(?is){_BLOCK}", instead), F.lit(f"<{_ASIDE}"), F.lit("<"))


def _drop_tags(c: Column, instead: str) -> Column:
    """Runs of tags replaced; no tag ends behind the last ``>``."""
    return let(c, lambda t: let(_upto_last(t, ">"), lambda h: F.concat(
        F.regexp_replace(h, rf"(?s){_TAG_RUN}", instead), F.substring(t, F.length(h) + 1, F.length(t))
    )))


def clean_html(c: Column) -> Column:
    """Visible text of a page.

    A run of adjacent tags (dropped elements and comments count as tags)
    becomes one line break; long breaks and runs of spaces shrink.
    """
    body = _drop_blocks(drop_raw(F.coalesce(c, F.lit("")), "<br>"), "<br>")
    body = decode_entities(_drop_tags(body, "\n"))
    body = F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r" {2,}", " ")
    return strip(body)


# ---------------------------------------------------------------- chunks


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    if overlap >= size:
        raise ValueError("overlap must be smaller than size, or the windows never advance")


def _whole_or(c: Column, size: int, split: Column) -> Column:
    """Short text is one chunk as it stands, empty text none."""
    empty = F.array().cast("array<string>")
    return F.when(c.isNull() | (c == ""), empty).when(F.length(c) <= size, F.array(c)).otherwise(split)


def fixed_chunks(c: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, one every ``size - overlap``."""
    check_sizes(size, overlap)
    starts = F.sequence(F.lit(0), F.length(c) - 1, F.lit(size - overlap))
    return _whole_or(c, size, F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(size))))


def _pack(parts: Column, size: int, overlap: int, glue: str) -> Column:
    """Greedy packing of parts into chunks as a left fold."""

    def step(acc: Column, part: Column) -> Column:
        cur = acc["cur"]
        fits = F.length(cur) + F.length(part) + len(glue) <= size
        grown = F.when(cur == "", part).otherwise(F.concat(cur, F.lit(glue), part))
        tail = F.concat(_right(cur, overlap), F.lit(glue), part)
        fresh = F.when((cur != "") & F.lit(overlap > 0), tail).otherwise(part)
        flushed = F.when(cur != "", F.array_append(acc["out"], strip(cur))).otherwise(acc["out"])
        return F.struct(
            F.when(fits, grown).otherwise(fresh).alias("cur"),
            F.when(fits, acc["out"]).otherwise(flushed).alias("out"),
        )

    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(parts, start, step, lambda acc: _close(acc))


def _right(c: Column, n: int) -> Column:
    return F.substring(c, F.greatest(F.length(c) - n + 1, F.lit(1)), F.lit(n))


def _close(acc: Column) -> Column:
    last = strip(acc["cur"])
    return F.when(last != "", F.array_append(acc["out"], last)).otherwise(acc["out"])


def sentence_chunks(c: Column, size: int, overlap: int) -> Column:
    """Sentences packed up to ``size``; the next chunk repeats the last ``overlap`` characters."""
    check_sizes(size, overlap)
    return _whole_or(c, size, _pack(F.split(c, r"(?U)(?<=[.!?])\s+"), size, overlap, " "))


def semantic_chunks(c: Column, size: int, overlap: int) -> Column:
    """Paragraphs packed up to ``size``; a longer paragraph is cut into sentence chunks.

    A long paragraph also closes the chunk before it without overlap, so the
    text falls apart into independent runs: stretches of short paragraphs,
    packed, and single long ones.
    """
    check_sizes(size, overlap)
    paras = F.filter(F.transform(F.split(c, r"\n\n+"), strip), lambda p: p != "")
    no_run = F.array().cast("array<string>")

    def gather(acc: Column, p: Column) -> Column:
        long = F.length(p) > size
        closed = F.when(F.size(acc["run"]) > 0, F.array_append(acc["runs"], acc["run"])).otherwise(acc["runs"])
        return F.struct(
            F.when(long, no_run).otherwise(F.array_append(acc["run"], p)).alias("run"),
            F.when(long, F.array_append(closed, F.array(p))).otherwise(acc["runs"]).alias("runs"),
        )

    start = F.struct(no_run.alias("run"), F.array().cast("array<array<string>>").alias("runs"))
    runs = F.aggregate(
        paras, start, gather,
        lambda acc: F.when(F.size(acc["run"]) > 0, F.array_append(acc["runs"], acc["run"])).otherwise(acc["runs"]),
    )

    def one_run(run: Column) -> Column:
        head = F.element_at(run, 1)
        cut = _pack(F.split(head, r"(?U)(?<=[.!?])\s+"), size, overlap, " ")
        return F.when(F.length(head) > size, cut).otherwise(_pack(run, size, overlap, "\n\n"))

    return _whole_or(c, size, F.flatten(F.transform(runs, one_run)))
