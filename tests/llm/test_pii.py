import random
import re

import pytest

from lectern.llm import pii

DIGITS = lambda m: re.sub("[^0-9]", "", m)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(DIGITS(m)) <= 19 and luhn(DIGITS(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(DIGITS(m)) <= 15),
]


def brute(text):
    return [(k, m.start(), m.end()) for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m.group(0))]


def texts():
    r = random.Random(5)
    out = [
        "a@b.c%d@e.f", "a@@b@c.d", "x@y@z.w", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1.2.3.4.5", "001.02.3.255 256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111",
        "12  4111111111111111", "+49 (30) 123-4567", "+1-1", "+1 10.0.0.1 234 5", "é😀a@b.co 😀4111111111111111", "1" * 3000, "a" * 20000 + "@" + "b" * 5000, "+1" + "(" * 5000, "1.2.3." * 2000,
        "12-" * 3000, "a@b.c " * 1500, ". @a.b@c..d", None, "",
    ]
    parts = [*"0123456789 -.+@ab(", "4111 1111 1111 1111", "1.2.3.4", "é"]
    return out + ["".join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(1500)]


def test_base_spans_equal_plain_search(spark):
    rows = pii.with_spans(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(4)).collect()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind != "iban"] == brute(r.text), r.text


@pytest.mark.parametrize(
    "text, spans",
    [("IBAN DE89 3704 0044 0532 0130 00!", [("iban", 5, 32, 1.0)]), ("GB82WEST12345698765432", [("iban", 0, 22, 0.85)]), ("GB82WEST12345698765431", []), ("xGB82WEST12345698765432", [])],
)
def test_iban(spark, text, spans):
    row = pii.with_spans(spark.createDataFrame([(text,)], "text string")).first()
    assert [tuple(s) for s in row.spans] == spans


@pytest.mark.parametrize(
    "text, found",
    [
        ("AT61 1904 3002 3457 3201 BIC BKAUATWW", ["AT61 1904 3002 3457 3201"]),
        ("AT611904300234573201 IBAN", ["AT611904300234573201"]),
        ("to ES91 2100 0418 4502 0005 1332 BANK", ["ES91 2100 0418 4502 0005 1332"]),
        ("ES9121000418450200051332 A", ["ES9121000418450200051332"]),
        ("AT61 1904 3002 3457 3201 GB82 WEST 1234 5698 7654 32", ["AT61 1904 3002 3457 3201", "GB82 WEST 1234 5698 7654 32"]),
        ("NO 12 AB12 ABCD EFGH DE89 3704 0044 0532 0130 00 BIC", ["DE89 3704 0044 0532 0130 00"]),
        ("😀 PL61 1090 1014 0000 0712 1981 2874 X, DE89370400440532013000 DE89370400440532013000", ["PL61 1090 1014 0000 0712 1981 2874", *["DE89370400440532013000"] * 2]),
        ("AT61 1904 3002 3457 3202 BIC", []),
    ],
)
def test_iban_before_a_capital_word(spark, text, found):
    df = spark.createDataFrame([(text,)], "text string")
    spans = pii.with_spans(df).first().spans
    assert [text[s.start : s.end] for s in spans if s.kind == "iban"] == found
    if not any(s.kind != "iban" for s in spans):
        masked = text
        for iban in found:
            masked = masked.replace(iban, "<IBAN>", 1)
        assert pii.redact(df).first().text == masked


def test_context_raises_the_score(spark):
    rows = pii.with_spans(spark.createDataFrame([("call +49 30 1234567",), ("no. +49 30 1234567",)], "text string")).collect()
    assert [r.spans[0].score for r in rows] == [0.75, 0.6]


def test_redact(spark, odd_docs, no_docs):
    df = spark.createDataFrame([("a+123456789012@x.yz, +1 10.0.0.1 234",), ("😀 4111 1111 1111 1111 é",), (None,), ("",)], "text string")
    assert [r.text for r in pii.redact(df).collect()] == ["<EMAIL>, <PHONE>", "😀 <CARD> é", None, ""]
    docs = odd_docs.withColumnRenamed("source", "spans").withColumnRenamed("lang", "pii_text")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()}[14] == "é😀 mail <EMAIL> or <PHONE>"
    assert pii.redact(no_docs).count() == 0


def test_query(spark):
    import hashlib

    from lectern.llm.registry import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op10_pii"](spark, "/root/testdata/sf0.001").collect():
        want = brute(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
