"""Personal data by regular expressions, checksum validators and context words, in Spark SQL functions alone.

Each kind has an expression that proposes leftmost non-overlapping spans, a validator that
confirms them, and words that raise the score when they stand just before a span. Emails, ip
addresses, card numbers (Luhn) and phone numbers are the base kinds; IBANs (mod 97) are added.

The expressions are written so that Java's matcher needs linear time on any text: runs are
possessive and start only where a run can start. Where a match of a base kind was dropped by a
validator the text is not tried again from within it. An IBAN's expression matches its first four
characters and only looks ahead to the longest run that may follow, so that a capital word behind
does no harm: the run may also end before any blank in it, and what lies behind is tried again. Spans come from the pieces between matches, whose
lengths are summed in blocks, so that a text with very many matches is no problem either.

Context is what stands before a span, CONTEXT code points of it and no farther back than the end of the kind's match
before: of two addresses behind one "contact:" the first has the bonus. What stands behind a span adds nothing.

Edge cases: null reads as empty text, which has no span; spans are in code points, end exclusive;
spans of different kinds may overlap, those of one kind do not; repeated rows get equal results; nothing is shuffled and
other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import fresh_name

#: Code points before a span in which context words count, and what they add to a score.
CONTEXT, CONTEXT_BONUS = 40, 0.15
_SUM_BLOCK = 256

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's checksum: every second digit from the right is doubled, digit sums add up to 0 mod 10."""
    doubled = F.translate(digits, "0123456789", "0246813579")
    n = F.length(digits)
    take = lambda s, i: F.substring(s, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, take(doubled, i)).otherwise(take(digits, i)))
    return (n > 0) & (F.when(n > 0, total) % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN, blanks aside, leaves 1: first four characters to the end, letters as 10 to 35, remainder by 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    step = lambda acc, i: F.when(code(i) >= 65, (acc * 100 + code(i) - 55) % 97).otherwise((acc * 10 + code(i) - 48) % 97)
    return _between(F.length(plain), 15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def iban_in(head: Column, run: Column) -> Column:
    """The IBAN that head and run begin with, or null.

    It ends with the run or before a blank in it and passes mod 97. The end that gives the country's length comes first,
    then the run's; other ends are for countries of unknown length, the longest first.
    """
    parts = F.split(F.concat(head, run), " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))
    right = F.filter(ends, mod97)
    length = F.try_element_at(F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair]), F.substring(head, 1, 2))
    last = F.get(right, F.size(right) - 1)
    exact = F.get(F.filter(right, lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))) == length), F.lit(0))
    return F.coalesce(exact, F.when(length.isNull() | (last == F.concat(head, run)), last))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: object
    maybe: object  # a cheap test that any match implies
    score: float
    context: str
    #: For an expression that matches a span's head and looks ahead to the run behind it (group 1): the span, or null.
    span_in: object = None


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
        lambda text: F.contains(text, F.lit("@")),
        0.8,
        "mail|contact|kontakt|contacto|write to|reach",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
        lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        lambda text: text.rlike(r"[0-9]\.[0-9]"),
        0.6,
        r"\bip\b|address|adresse|host|server|client",
    ),
    Kind(
        # A run of digits with single blanks or dashes between; only whole runs of 13 to 19 digits.
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
        lambda m: luhn(_digits(m)),
        lambda text: text.rlike(r"[0-9][ -]?[0-9]"),
        0.8,
        "card|karte|carte|tarjeta|visa|credit|master|amex",
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda m: _between(F.length(_digits(m)), 9, 15),
        lambda text: text.rlike(r"\+[0-9]"),
        0.6,
        r"phone|call|tel\b|tel[.:ée]|mobile|mobil|fax",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9_]))",
        None,
        lambda text: text.rlike("[A-Z]{2}[0-9]{2}"),
        0.85,
        "iban|account|konto|compte|cuenta|bank",
        iban_in,
    ),
)
BASE = KINDS[:4]

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def running_sums(lengths: Column) -> Column:
    """Of each element, the sum of those before it. Sums go in blocks, as growing an array copies it."""
    grown = lambda xs, start: F.aggregate(
        xs, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"],
    )
    blocks = F.transform(F.sequence(F.lit(0), (F.size(lengths) - 1).cast("int"), F.lit(_SUM_BLOCK)), lambda k: F.slice(lengths, k + 1, _SUM_BLOCK))
    zero = F.lit(0).cast("bigint")
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
    return F.flatten(F.zip_with(blocks, grown(totals, zero), lambda b, start: grown(b, start)))


def _span_of(kind: Kind):
    """From a match m, the piece p before it and the sum s of all before both, the span with its score."""

    def span(r: Column) -> Column:
        start = r["s"] + F.length(r["p"])
        near = F.lower(F.when(F.length(r["p"]) > CONTEXT, F.substring(r["p"], -CONTEXT, CONTEXT)).otherwise(r["p"])).rlike(kind.context)
        score = F.round(F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0), 2)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(r["m"])).alias("end"), score.alias("score"))

    return span


def _spans_from_heads(kind: Kind, rows: Column) -> Column:
    """Spans of a kind with span_in, leftmost first, none within another; context reaches back to the span before."""
    known = F.filter(F.transform(rows, lambda r: F.struct(kind.span_in(r["m"], r["t"]).alias("m"), r["p"].alias("p"), r["s"].alias("s"))), lambda r: r["m"].isNotNull())
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        start = r["s"] + F.length(r["p"])
        free = F.least(start - acc["at"], F.length(r["p"]).cast("bigint")).cast("int")
        behind = F.struct(r["m"].alias("m"), F.substring(r["p"], F.length(r["p"]) - free + 1, free).alias("p"), (start - free).alias("s"))
        span = _span_of(kind)(behind)
        return F.when(start >= acc["at"], F.struct(span["end"].alias("at"), F.concat(acc["out"], F.array(span).cast(_SPAN)).alias("out"))).otherwise(acc)

    return F.aggregate(known, first, step, lambda acc: acc["out"])


def with_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """docs with a column of spans, array<struct<kind, start, end, score>>, by kind as listed, then by start."""
    kept, out = docs.columns, docs
    plain = fresh_name(out, "pii_text")
    out = out.withColumn(plain, F.coalesce(F.col(text), F.lit("")))
    spans = []
    for kind in KINDS:
        found, pieces, starts, valid = (fresh_name(out, f"pii_{kind.name}_{x}") for x in ("found", "pieces", "starts", "spans"))
        none = F.array().cast("array<string>")
        out = out.withColumn(found, F.when(kind.maybe(F.col(plain)), F.regexp_extract_all(plain, F.lit(kind.pattern), F.lit(0))).otherwise(none))
        any_ = F.size(found) > 0
        out = out.withColumn(pieces, F.when(any_, F.slice(F.split(plain, kind.pattern, -1), F.lit(1), F.size(found))).otherwise(none))
        steps = F.zip_with(pieces, found, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
        out = out.withColumn(starts, F.when(any_, running_sums(steps)).otherwise(F.array().cast("array<bigint>")))
        rows = [F.col(found).alias("m"), F.col(pieces).alias("p"), F.col(starts).alias("s")]

        if kind.span_in:
            runs = F.regexp_extract_all(plain, F.lit(kind.pattern), F.lit(1))
            confirmed = _spans_from_heads(kind, F.arrays_zip(*rows, runs.alias("t")))
        else:
            confirmed = F.transform(F.filter(F.arrays_zip(*rows), lambda r: kind.valid(r["m"])), _span_of(kind))  # noqa: B023
        out = out.withColumn(valid, F.when(any_, confirmed).otherwise(F.array()).cast(_SPAN))
        spans.append(valid)
    return out.select(*kept, F.concat(*spans).alias(name))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", least_score: float = 0.0) -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans by that of the first. A null text stays null."""
    spans = fresh_name(docs, "pii_spans")
    out = with_spans(docs, text, spans)
    order = lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"])).otherwise(b["end"] - a["end"]).cast("int")
    chosen = F.array_sort(F.filter(spans, lambda s: s["score"] >= least_score), order)
    whole = F.col(text)
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda start, end: F.substring(whole, (start + 1).cast("int"), (end - start).cast("int"))
    step = lambda acc, s: (
        F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], s["start"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    )
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole)))
    masked = F.when(F.size(chosen) > 0, F.aggregate(chosen, first, step, rest)).otherwise(whole)
    return out.select(*[masked.alias(c) if c == text else F.col(c) for c in docs.columns])
