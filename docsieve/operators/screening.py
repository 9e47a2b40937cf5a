"""Screening of questions and answers.

Every check is one column: a struct ``(blocked, flagged, reason, message)``
with ``blocked`` false where the check passes. A screening run puts the checks
side by side in one scan and takes the first block in the configured order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import contains_any, first_match, once, strip

# ---------------------------------------------------------------- fixed values
# Patterns, word lists and texts that results depend on.

PII_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
}

INJECTION_PATTERNS = [
    r"ignore (?:all )?(?:previous |above )?instructions",
    r"you are now",
    r"pretend (?:you are|to be)",
    r"forget (?:all |everything )",
    r"disregard (?:all |previous )",
    r"override (?:your |the )?(?:system|instructions)",
    r"new (?:system )?prompt",
    r"act as (?:a |an )?(?:different|new)",
    r"jailbreak",
    r"do anything now",
]

TOXIC_WORDS = ["kill", "murder", "attack", "bomb", "weapon", "hack", "steal", "fraud", "illegal", "drug", "abuse"]

# Tested on lower-cased text; the first one is written in lower case so that it can match.
TOXIC_ANSWER_PATTERNS = [
    r"i hate",
    r"you('re| are) (stupid|dumb|idiot)",
    r"(racial|ethnic) (slur|epithet)",
    r"shut up",
]

COMPLIANCE_PHRASES = [
    "guaranteed return", "guaranteed profit", "you will make money", "risk-free investment", "insider information",
]

LEAK_TYPES = ["ssn", "credit_card", "email"]
LEAK_WHITELIST = ["user@example.com", "example@databricks.com", "your_email@company.com"]
SAFE_EMAIL_DOMAINS = [
    "example.com", "example.org", "example.net", "databricks.com", "company.com",
    "domain.com", "mycompany.com", "test.com", "localhost",
]
DOC_URL_PATTERN = r"https?://docs\.databricks\.com/[^\s\)]+"

INPUT_ORDER = ["input_length_min", "input_length_max", "pii", "injection", "toxicity", "intent"]
OUTPUT_ORDER = ["toxicity", "compliance", "pii_leakage", "hallucination", "quality"]

MESSAGES = {
    "input_length_min": "Your question is too short. Please provide more detail so I can help you.",
    "input_length_max": "Your message is too long. Please keep it under {} characters.",
    "pii": "Your message contains personal information. Please remove sensitive data and try again.",
    "injection": "Your request could not be processed. Please ask a genuine question.",
    "toxicity": "Your message contains content that doesn't align with our usage policies.",
    "intent": "I couldn't understand your message. Please ask a question in plain language.",
    "answer_toxicity": "I apologize, but I'm unable to provide that response. Let me help you differently.",
    "compliance": "I need to rephrase my response to comply with communication guidelines.",
    "pii_leakage": "I detected potentially sensitive information in my response."
                   " Let me provide the information without personal data.",
}

# ---------------------------------------------------------------- check structs

def _null() -> Column:
    return F.lit(None).cast("string")


def _result(found: Column, reason: Callable[[Column], Column], message: str, blocks: bool = True) -> Column:
    """The struct of a check; ``found`` is null where it passes and is worked out once."""

    def made(x: Column) -> Column:
        hit = x.isNotNull()
        return F.struct(
            (hit if blocks else F.lit(False)).alias("blocked"),
            (F.lit(False) if blocks else hit).alias("flagged"),
            F.when(hit, reason(x)).alias("reason"),
            (F.when(hit, F.lit(message)) if blocks else _null()).alias("message"),
        )

    return once(found, made)


def _only_if(value: Column, hit: Callable[[Column], Column]) -> Column:
    """``value`` where it is a hit, else null."""
    return once(value, lambda x: F.when(hit(x), x))


def chk_length_min(c: Column, minimum: int = 10) -> Column:
    found = _only_if(F.length(strip(c)), lambda n: n < minimum)
    return _result(found, lambda n: F.concat(F.lit("Input too short ("), n.cast("string"), F.lit(f" < {minimum})")), MESSAGES["input_length_min"])


def chk_length_max(c: Column, maximum: int = 4000) -> Column:
    found = _only_if(F.length(c), lambda n: n > maximum)
    reason = lambda n: F.concat(F.lit("Input too long ("), n.cast("string"), F.lit(f" > {maximum})"))
    return _result(found, reason, MESSAGES["input_length_max"].format(maximum))


def pii_type(c: Column, types: list[str] | None = None) -> Column:
    """The first kind of personal data found, else null."""
    found = []
    for name in types or list(PII_PATTERNS):
        hit = c.rlike("(?U)" + PII_PATTERNS[name])
        found.append(F.when((F.contains(c, F.lit("@")) & hit) if name == "email" else hit, F.lit(name)))
    # Text without digits and without an @ cannot hold any of them.
    return F.when(c.rlike(r"(?U)\d|@"), F.coalesce(*found))


def chk_pii(c: Column) -> Column:
    return _result(pii_type(c), lambda kind: F.concat(F.lit("PII detected: "), kind), MESSAGES["pii"])


def chk_injection(c: Column) -> Column:
    return _result(first_match(F.lower(c), INJECTION_PATTERNS), lambda hit: F.concat(F.lit("Prompt injection detected: "), hit), MESSAGES["injection"])


def toxic_words(c: Column) -> Column:
    return once(F.lower(c), lambda low: F.filter(F.array(*[F.lit(w) for w in TOXIC_WORDS]), lambda w: F.contains(low, w)))


def chk_toxicity(c: Column, domain_words: list[str] | None = None) -> Column:
    """Toxic words block unless the text also holds a word of the domain."""

    def hit(low: Column) -> Column:
        toxic = contains_any(low, TOXIC_WORDS)
        return toxic & ~contains_any(low, domain_words) if domain_words else toxic

    def reason(words: Column) -> Column:
        listed = F.array_join(F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")
        return F.concat(F.lit("Toxic content: ["), listed, F.lit("]"))

    return _result(F.when(once(F.lower(c), hit), toxic_words(c)), reason, MESSAGES["toxicity"])


# Two words or numbers: a search that ends at the second, instead of counts.
_WORD = r"(?>(?<![a-zA-Z])[a-zA-Z]{2,}+|(?<!\d)\d++\.?+\d*+)"
_TWO_WORDS = rf"(?U){_WORD}[\s\S]*?{_WORD}"


def intent_of(c: Column) -> Column:
    """``gibberish``, ``non_text`` or ``accepted``."""

    def kind(text: Column) -> Column:
        letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
        return (
            F.when((F.length(text) > 20) & ~text.rlike(_TWO_WORDS), "gibberish")
            .when((F.length(text) > 10) & (letters / F.length(text) < 0.3), "non_text")
            .otherwise("accepted")
        )

    return once(strip(c), kind)


def chk_intent(c: Column) -> Column:
    text = strip(c)
    gibberish = F.concat(
        F.lit("Message appears to be gibberish ("), F.regexp_count(text, F.lit("[a-zA-Z]{2,}")).cast("string"),
        F.lit(" words in "), F.length(text).cast("string"), F.lit(" chars)"),
    )
    share = F.bround(100.0 * F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.length(text), 0).cast("int")
    symbols = F.concat(F.lit("Message is mostly non-alphabetic ("), share.cast("string"), F.lit("% alpha)"))
    found = _only_if(intent_of(c), lambda kind: kind != "accepted")
    return _result(found, lambda kind: F.when(kind == "gibberish", gibberish).otherwise(symbols), MESSAGES["intent"])


def group_index(c: Column, groups: dict[str, list[str]]) -> Column:
    """Position of the first keyword group found in the text, else null."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(contains_any(low, words), F.lit(i)) for i, words in enumerate(groups.values())], F.lit(None).cast("int"))


def intent_from(here: Column, before: Column, groups: dict[str, list[str]], allowed: list[str] | None = None) -> Column:
    """``(blocked, intent)`` from the group found in the message and the one found in its context."""
    if not groups:
        return F.struct(F.lit(False).alias("blocked"), F.lit("unconfigured").alias("intent"))
    names = F.array(*[F.lit(g) for g in groups])
    found = F.coalesce(here, before)
    name = F.get(names, found)
    outside = ~name.isin(allowed) if allowed else F.lit(False)
    intent = (
        F.when(found.isNull(), F.lit("off_topic" if allowed else "unknown"))
        .when(here.isNotNull() | outside, name).otherwise(F.concat(name, F.lit("_from_context")))
    )
    return F.struct(F.when(found.isNull(), F.lit(bool(allowed))).otherwise(outside).alias("blocked"), intent.alias("intent"))


def chk_intent_keywords(
    c: Column, context: Column, groups: dict[str, list[str]], allowed: list[str] | None = None
) -> Column:
    """Older intent check: the first keyword group found in the message, else in the context.

    Returns ``(blocked, intent)``. With an allow-list, other intents and no
    intent at all are blocked.
    """
    return intent_from(group_index(c, groups), group_index(context, groups), groups, allowed)


# ---------------------------------------------------------------- answers


def chk_out_toxicity(c: Column) -> Column:
    found = first_match(F.lower(c), TOXIC_ANSWER_PATTERNS)
    return _result(found, lambda hit: F.concat(F.lit("Toxic content in response: "), hit), MESSAGES["answer_toxicity"])


def chk_compliance(c: Column, phrases: list[str] | None = None) -> Column:
    listed = F.array(*[F.lit(p) for p in (COMPLIANCE_PHRASES if phrases is None else phrases)]).cast("array<string>")
    found = once(F.lower(c), lambda low: F.get(F.filter(listed, lambda p: F.contains(low, p)), 0))
    return _result(found, lambda hit: F.concat(F.lit("Compliance violation: '"), hit, F.lit("'")), MESSAGES["compliance"])


def leaked(c: Column, kind: str, user: Column, retrieved: Column) -> Column:
    """Matches of one kind in an answer that neither the whitelist nor the sources explain."""
    pattern = F.lit("(?U)" + PII_PATTERNS[kind])
    from_sources = F.flatten(F.transform(
        F.coalesce(retrieved, F.array().cast(_RETRIEVED)),
        lambda d: F.regexp_extract_all(F.coalesce(d["chunk_text"], F.lit("")), F.lit("(?U)" + PII_PATTERNS["email"]), F.lit(0)),
    ))
    known = F.concat(F.array(*[F.lit(w) for w in LEAK_WHITELIST], F.coalesce(user, F.lit(""))), from_sources)
    # Sources are read only where the answer has something to explain.
    found = F.when(c.rlike("(?U)" + PII_PATTERNS[kind]), F.array_except(F.regexp_extract_all(c, pattern, F.lit(0)), known))
    if kind == "email":
        safe = "(?i)@(?:" + "|".join(d.replace(".", r"\.") for d in SAFE_EMAIL_DOMAINS) + ")$"
        found = F.when(F.contains(c, F.lit("@")), F.filter(found, lambda m: ~m.rlike(safe)))
    return found


_RETRIEVED = "array<struct<url:string,chunk_text:string>>"


def chk_pii_leak(c: Column, user: Column, retrieved: Column) -> Column:
    """``retrieved`` is the answer's own ``array<struct<url, chunk_text>>``: no join."""
    kind = F.coalesce(*[F.when(F.size(leaked(c, k, user, retrieved)) > 0, F.lit(k)) for k in LEAK_TYPES])
    kind = F.when(c.rlike(r"(?U)\d|@"), kind)
    return _result(kind, lambda k: F.concat(F.lit("PII leakage in response: "), k), MESSAGES["pii_leakage"])


def ungrounded_urls(c: Column, retrieved: Column, url_pattern: str = DOC_URL_PATTERN) -> Column:
    """Documentation links of the answer that were not retrieved; empty without any retrieval."""
    known = F.transform(retrieved, lambda d: d["url"])
    urls = F.regexp_extract_all(c, F.lit(url_pattern), F.lit(0))
    missing = F.filter(urls, lambda u: ~F.coalesce(F.array_contains(known, u), F.lit(False)))
    return F.when(F.size(retrieved) > 0, missing).otherwise(F.array().cast("array<string>"))


def chk_grounding(c: Column, retrieved: Column, url_pattern: str = DOC_URL_PATTERN) -> Column:
    """Flags, never blocks; passes with a note where nothing was retrieved."""

    def reason(urls: Column) -> Column:
        listed = F.array_join(F.transform(urls, lambda u: F.concat(F.lit("'"), u, F.lit("'"))), ", ")
        return F.concat(F.lit("Potentially ungrounded URLs: ["), listed, F.lit("]"))

    found = _only_if(ungrounded_urls(c, retrieved, url_pattern), lambda urls: F.size(urls) > 0)
    res = _result(found, reason, "", blocks=False)
    nothing = F.coalesce(F.size(retrieved) <= 0, F.lit(True))
    return res.withField("note", F.when(nothing, F.lit("No context to check against")))


def chk_quality(c: Column, minimum: int = 20) -> Column:
    found = _only_if(F.length(strip(c)), lambda n: n < minimum)
    return _result(found, lambda n: F.concat(F.lit("Response too short ("), n.cast("string"), F.lit(" chars)")), "", blocks=False)


# ---------------------------------------------------------------- runs


def _resolve(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """First block in order wins; the checks after it did not run, so they are null."""
    names = list(checks)
    if not names:
        return df.withColumns({
            "blocked": F.lit(False), "blocked_by": _null(), "reason": _null(), "message": _null(),
            "flags": F.array().cast("array<string>"),
        })
    out = df
    stopped: Column = F.lit(False)
    for n in names:
        # One projection per check: each refers to the columns before it, so a
        # row blocked early skips the costly patterns that follow.
        out = out.withColumn(f"chk_{n}", F.when(~stopped, checks[n]))
        stopped = stopped | F.coalesce(F.col(f"chk_{n}.blocked"), F.lit(False))
    hits = {n: F.coalesce(F.col(f"chk_{n}.blocked"), F.lit(False)) for n in names}

    def first(value: Callable[[str], Column]) -> Column:
        return F.coalesce(*[F.when(hits[n], value(n)) for n in names])

    flags = F.filter(
        F.array(*[F.when(F.coalesce(F.col(f"chk_{n}.flagged"), F.lit(False)), F.lit(n)) for n in names]),
        lambda x: x.isNotNull(),
    )
    return out.withColumns({
        "blocked": stopped,
        "blocked_by": first(F.lit),
        "reason": first(lambda n: F.col(f"chk_{n}.reason")),
        "message": first(lambda n: F.col(f"chk_{n}.message")),
        "flags": flags,
    })


def input_checks(c: Column, config: dict | None = None) -> dict[str, Column]:
    cfg = config or {}
    made: dict[str, Callable[[], Column]] = {
        "input_length_min": lambda: chk_length_min(c, cfg.get("min_input_length", 10)),
        "input_length_max": lambda: chk_length_max(c, cfg.get("max_input_length", 4000)),
        "pii": lambda: chk_pii(c),
        "injection": lambda: chk_injection(c),
        "toxicity": lambda: chk_toxicity(c, cfg.get("domain_context_keywords")),
        "intent": lambda: chk_intent(c),
    }
    return {n: made[n]() for n in cfg.get("enabled_checks", INPUT_ORDER) if n in made}


def screen_input(df: DataFrame, text: str, config: dict | None = None) -> DataFrame:
    """``df`` with one ``chk_*`` struct per check and the verdict; unknown check names are skipped."""
    return _resolve(df, input_checks(F.col(text), config))


def screen_question(df: DataFrame, question: str, context: str, config: dict | None = None) -> DataFrame:
    """As :func:`screen_input`; a question off topic passes the intent check if what was asked before in its thread does."""
    checks = input_checks(F.col(question), config)
    if "intent" in checks:
        here, before = checks["intent"], chk_intent(F.col(context))
        saved = lambda h: h["blocked"] & ~before["blocked"] & (F.col(context) != "")
        checks["intent"] = once(here, lambda h: F.when(F.coalesce(saved(h), F.lit(False)), before).otherwise(h))
    return _resolve(df, checks)


def screen_output(df: DataFrame, answer: str, user: str, retrieved: str, config: dict | None = None) -> DataFrame:
    """As :func:`screen_input` for answers; ``flags`` lists checks that flagged without blocking."""
    cfg = config or {}
    c, u, r = F.col(answer), F.col(user), F.col(retrieved)
    made: dict[str, Callable[[], Column]] = {
        "toxicity": lambda: chk_out_toxicity(c),
        "compliance": lambda: chk_compliance(c, cfg.get("compliance_blocked_phrases")),
        "pii_leakage": lambda: chk_pii_leak(c, u, r),
        "hallucination": lambda: chk_grounding(c, r, cfg.get("url_pattern", DOC_URL_PATTERN)),
        "quality": lambda: chk_quality(c, cfg.get("min_response_length", 20)),
    }
    return _resolve(df, {n: made[n]() for n in cfg.get("enabled_checks", OUTPUT_ORDER) if n in made})


# ---------------------------------------------------------------- accuracy


def screening_accuracy(df: DataFrame, by: str = "attack_type") -> DataFrame:
    """Confusion counts and rates per class of request, and for all (null class)."""
    want, got = F.col("should_block"), F.col("blocked")

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    counts = df.rollup(by).agg(
        F.count("*").alias("total"),
        n(want & got).alias("correct_blocks"),
        n(~want & ~got).alias("correct_passes"),
        n(~want & got).alias("false_positives"),
        n(want & ~got).alias("false_negatives"),
        F.grouping(by).cast("int").alias("is_total"),
    )
    blockable = F.greatest(F.col("correct_blocks") + F.col("false_negatives"), F.lit(1))
    passable = F.greatest(F.col("correct_passes") + F.col("false_positives"), F.lit(1))
    return counts.select(
        "*",
        (F.col("correct_blocks") / blockable).alias("block_accuracy"),
        (F.col("correct_passes") / passable).alias("pass_accuracy"),
        (F.col("false_positives") / passable).alias("false_positive_rate"),
        (F.col("false_negatives") / blockable).alias("false_negative_rate"),
        ((F.col("correct_blocks") + F.col("correct_passes")) / F.col("total")).alias("overall_accuracy"),
    )


def screening_errors(df: DataFrame, text: str) -> DataFrame:
    """The wrong rows, with the first 100 characters of the request for display."""
    return df.where(F.col("should_block") != F.col("blocked")).withColumn("request", F.left(F.col(text), F.lit(100)))


# ---------------------------------------------------------------- masking


def mask_pii(c: Column, types: list[str] | None = None, mask: str = "[MASKED]") -> Column:
    """Replace every match of the chosen kinds of personal data."""
    for name in types or list(PII_PATTERNS):
        c = F.regexp_replace(c, "(?U)" + PII_PATTERNS[name], mask)
    return c
