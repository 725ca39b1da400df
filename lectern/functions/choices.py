"""Answer choices are JSON of changing kind: object, list, string, or nothing.

They are read once, into `items`: what a learner may be shown, as text in the form of the course back end's language (`True`, `None`, `1e-07`).
Plain JSON (lists and objects of strings without escapes, whole numbers, short fractions and literals) is told by one expression and cut by
another, in the JVM. Anything else (nested values, escapes, exponents, long numbers) goes through Python's own reader, in
Arrow batches; `with_items` leaves that step out where a table has no such row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import ANSWER_LABELS, bound, strip

#: kind: map, list or none. shown: the texts that a learner sees, of a map those of labels whose value counts as true. low: the texts
#: that an answer may equal, stripped and in lower case; a map has one for each answer label.
ITEMS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("shown", T.ArrayType(T.StringType())), T.StructField("low", T.ArrayType(T.StringType()))])

_BLANK = r"[ \t\n\r]*+"
_TEXT = r'"[^"\\\x00-\x1f]*+"'
#: Whole numbers and fractions that print as they are written.
_NUMBER = r"(?:-?[1-9][0-9]{0,17}+|0|-?(?:0|[1-9][0-9]{0,8}+)\.(?:0|[0-9]{0,3}[1-9]))(?![0-9.eE])"
_VALUE = rf"(?:{_TEXT}|{_NUMBER}|true|false|null)"
_LIST = rf"\[{_BLANK}(?:{_VALUE}{_BLANK}(?:,{_BLANK}{_VALUE}{_BLANK})*+)?\]"
_MAP = rf"\{{{_BLANK}(?:{_TEXT}{_BLANK}:{_BLANK}{_VALUE}{_BLANK}(?:,{_BLANK}{_TEXT}{_BLANK}:{_BLANK}{_VALUE}{_BLANK})*+)?\}}"
_PLAIN = rf"\A{_BLANK}(?:{_LIST}|{_MAP}|{_VALUE}){_BLANK}\z"
#: Longer texts are left to Python, as the expression needs stack for each element.
_LONG = 4000


def is_plain(choices: Column) -> Column:
    """Whether the items of choices need no Python; nulls don't."""
    return F.coalesce((F.length(choices) <= _LONG) & choices.rlike(_PLAIN), choices.isNull())


def _shown(token: Column) -> Column:
    """The text of one token."""
    quoted = token.startswith('"')
    literal = F.when(token.isin("true", "false"), F.initcap(token)).when(token == "null", "None").otherwise(token)
    return F.when(quoted, token.substr(F.lit(2), F.length(token) - 2)).otherwise(literal)


def _filled(token: Column) -> Column:
    return ~token.isin('""', "0", "0.0", "-0.0", "false", "null")


def _struct(kind: Column, shown: Column, low: Column) -> Column:
    return F.struct(kind.alias("kind"), shown.alias("shown"), low.alias("low"))


def plain_items(choices: Column) -> Column:
    """ITEMS of plain choices; of nulls and of anything else that is no container, no item."""
    return bound(F.regexp_extract_all(choices, F.lit(rf"{_TEXT}|[^ \t\n\r,:\[\]{{}}]++"), F.lit(0)), lambda tokens: _items_of(choices, tokens))


def _items_of(choices: Column, tokens: Column) -> Column:
    first = F.regexp_extract(choices, r"\A[ \t\n\r]*+(.)", 1)
    low = lambda texts: F.transform(texts, lambda t: F.lower(strip(t)))

    names, values = (F.reverse(F.filter(tokens, lambda t, i: i % 2 == k)) for k in (0, 1))  # so that the last of repeated names comes first
    of_label = lambda names, values: F.array(*[F.get(values, F.array_position(names, f'"{label}"').cast("int") - 1) for label in ANSWER_LABELS])
    of = bound(names, lambda n: bound(values, lambda v: of_label(n, v)))  # null where a label is missing
    filled = lambda of: F.transform(F.filter(of, lambda t: t.isNotNull() & _filled(t)), _shown)
    labelled = lambda of: low(F.transform(of, lambda t: F.coalesce(_shown(t), F.lit(""))))

    listed = F.transform(F.slice(tokens, 1, 4), _shown)
    body = F.trim(F.translate(choices, "\t\n\r", "   "))
    letters = F.slice(F.regexp_extract_all(_shown(body), F.lit("(?s)."), F.lit(0)), 1, 4)
    row = lambda texts: _struct(F.lit("list"), texts, low(texts))
    none = F.array().cast("array<string>")
    return bound(
        first,
        lambda first: F.when((first == "{") & (F.size(tokens) > 0), bound(of, lambda x: _struct(F.lit("map"), filled(x), labelled(x))))
        .when(first == '"', bound(letters, row))
        .when(first.isin("[", "{"), bound(listed, row))
        .otherwise(_struct(F.lit("none"), none, none)),
    )


def read_items(text: str | None) -> tuple[str, list[str], list[str]]:
    """ITEMS of any JSON text, by Python's reader; what is no JSON has no item."""
    try:
        value = json.loads(text or "null")
        if isinstance(value, dict) and value:
            kind, shown, every = "map", [str(value[x]) for x in ANSWER_LABELS if value.get(x)], [str(value.get(x, "")) for x in ANSWER_LABELS]
        elif isinstance(value, (dict, list, str)):
            shown = every = [str(x) for x in list(value)[:4]]
            kind = "list"
        else:
            return "none", [], []
    except (ValueError, RecursionError):
        return "none", [], []
    whole = lambda s: s.encode("utf-8", "replace").decode()  # noqa: E731  (half a surrogate pair is no character)
    return kind, list(map(whole, shown)), [whole(s.strip().lower()) for s in every]


def _odd_items(choices: Column) -> Column:
    """ITEMS by `read_items`, in Arrow batches."""
    import pandas as pd  # asked for only where choices are not plain

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([read_items(t) for t in texts], columns=ITEMS.names)

    read.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(read, ITEMS)(choices)


def parse(choices: Column) -> Column:
    """ITEMS of any choices. Python has a part in its plan; `with_items` looks first whether there is need."""
    plain = is_plain(choices)
    return F.when(plain, plain_items(choices)).otherwise(_odd_items(F.when(~plain, choices)))


def with_items(questions: DataFrame, name: str = "_parsed") -> DataFrame:
    """questions with a column of their choices' ITEMS; Python has a part in it only if some choices are not plain."""
    choices = F.col("choices")
    odd = questions.where(~is_plain(choices)).select(F.lit(1))
    return questions.withColumn(name, plain_items(choices) if odd.isEmpty() else parse(choices))


def choice_texts(choices: Column, question_format: Column, parsed: Column | None = None) -> Column:
    """What a learner is shown: the filled labels of an object, else up to four list elements. `parsed`: a column of `with_items`."""
    parsed = parse(choices) if parsed is None else parsed
    true_false = (question_format == "TF") & (parsed["kind"] != "map") & (F.size(parsed["shown"]) == 0)
    return F.when(true_false, F.array(F.lit("True"), F.lit("False"))).otherwise(parsed["shown"])


def answer_label(correct_answer: Column, choices: Column, question_format: Column, parsed: Column | None = None) -> Column:
    """The letter of the right choice, or the stripped answer itself if no choice equals it.

    A letter as answer wins over an equal text; `TF` questions ignore the order of
    their choices; a label that an object lacks reads as empty text.
    """
    parsed = parse(choices) if parsed is None else parsed
    answer = strip(F.coalesce(correct_answer, F.lit("")))
    low = F.lower(answer)
    at = F.array_position(parsed["low"], low)
    return (
        F.when(F.upper(answer).isin(*ANSWER_LABELS), F.upper(answer))
        .when((question_format == "TF") & (low == "true"), "A")
        .when((question_format == "TF") & (low == "false"), "B")
        .when(at > 0, F.element_at(F.array(*map(F.lit, ANSWER_LABELS)), at.cast("int")))
        .otherwise(answer)
    )
