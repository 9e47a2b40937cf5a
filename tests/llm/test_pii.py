"""Personal data against plain patterns and hand-made cases."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from docsieve.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_base(text):
    return [(no, m.start(), m.end()) for no, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(k, m.group(0))]


TEXTS = [
    None, "", "no data", "a@b@c.com, .x%+-@a-b.c.d. z@", "a@b.com@d.org x@.y.z w@q..r", "aé@b.c@d.e 1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.0 1.2.3 4.5.6.7",
    "4111 1111-1111 1111 then 4111111111111112 and 4111  1111 4222222222222", "+1 (017) 555-7713. +4930123456 +12 +1(2 +1 ))) 5 ++1 234 567 890+1 234 567 891",
    "+1 2345678901234567 0 9", "9" * 5000 + " " + "1-" * 3000 + "@" * 500, "x" * 20000 + "@" + "y." * 9000 + "z" + "+1" + " (" * 4000,
    "1.1.1.1" * 300 + "." + ".".join("7" * 50), "é😀4111111111111111😀b@c.de",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "mine", [1]) for i, t in enumerate(TEXTS)] + [(None, "b@c.de", None, None), (3, TEXTS[3], "mine", [2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, spans array<int>")
    out = pii.find_personal(df)
    assert out.columns == ["doc_id", "text", "kind", "base_spans", "spans"]
    return [(r.text, [tuple(x) for x in r.base_spans], [tuple(x) for x in r.spans]) for r in out.collect()]


def test_cases(found):
    assert len(found) == len(TEXTS) + 2
    for text, base, spans in found:
        assert base == brute_base(text or ""), text[:80]
        assert spans[: len(base)] == base and spans == sorted(spans)


def test_random_texts():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("aZ9 01.-+@()é://") for _ in range(rng.randrange(60)))
        assert pii.scan(text)[0] == brute_base(text), repr(text)


@pytest.mark.parametrize(("text", "value", "kind"), [
    ("write to jörg.müller@bücher.example now", "jörg.müller@bücher.example", "intl_email"),
    ("see https://anna:pw@host.example/x and http://plain.example/y", "https://anna:pw@host.example", "address"),
    ("call tel:0301234567. or sip:bob@pbx", "tel:0301234567", "address"),
    ("IBAN: DE89 3704 0044 0532 0130 00 please", "DE89 3704 0044 0532 0130 00", "account"),
    ("SSN is 123-45-6789", "123-45-6789", "account"),
    ("Account no. 12345678, thanks", "12345678", "account"),
    ("Passport C01X00T47 seen", "C01X00T47", "account"),
])
def test_added(text, value, kind):
    assert (pii.KINDS.index(kind), text.index(value), text.index(value) + len(value)) in pii.scan(text)[1]


@pytest.mark.parametrize("text", [
    "accounts 12345678", "on account of the weather", "IBAN DE89 3704 0044 0532 0130 01", "SSN 666-45-6789", "account 12345", "http://plain.example/a", "a:// b", "tel: none",
    "passport control", "discount 12345678901",
])
def test_not_added(text):
    assert all(k < 4 for k, _, _ in pii.scan(text)[1])


def test_covered_is_not_added():
    base, spans = pii.scan("mailto:ann@example.com account 4111111111111111")
    assert (2, 31, 47) in base and all(k != 6 for k, _, _ in spans)


def test_empty_table(spark):
    assert pii.find_personal(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query(spark, sf):
    docs = {d["doc_id"]: d["text"] or "" for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = queries.op13_personal_data(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        base = brute_base(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in base) for n in range(4))
