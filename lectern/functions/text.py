"""String expressions with the semantics of the course back end's language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The buckets, variants and answer labels of a package, in their order.
BLOOM_BUCKETS = ("remember", "understand", "analyze")
VARIANT_KEYS = ("normal", "elaborated", "simplified")
ANSWER_LABELS = ("A", "B", "C", "D")

#: All white space of Unicode and the four ASCII separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(x: Column) -> Column:
    """Without white space at both ends, Unicode white space included. Only the ends are looked at, whatever lies between."""
    return F.trim(x, F.lit(WHITE))


def bloom_bucket(level: Column) -> Column:
    """One of three buckets; null, unknown or padded levels count as `analyze`."""
    level = F.lower(F.coalesce(level, F.lit("")))
    return F.when(level.isin("remember", "understand"), level).otherwise("analyze")


def text_piece(title: Column, content: Column) -> Column:
    """Title, line break, content, stripped; a null prints as `None`."""
    return strip(F.concat(F.coalesce(title, F.lit("None")), F.lit("\n"), F.coalesce(content, F.lit("None"))))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the last."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns[:-1]), columns[-1])


def node_order(order: Column, lesson_id: Column) -> Column:
    """The source's order; a null or zero order gives way to the lesson's id."""
    order = order.cast("bigint")
    return F.when(F.coalesce(order, F.lit(0)) != 0, order).otherwise(lesson_id)
