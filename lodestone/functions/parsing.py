"""Parsers of generated text, as Column expressions.

A line has the form ``<bullet> field | field``. The bullet is any text of at
least one character, so a line without one loses its first character to it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One bullet and one, two or three fields (fixed values).
TWO_FIELDS = r"(.+?)\s*(.+?)\s*\|\s*(.+?)$"
THREE_FIELDS = r"(.+?)\s*(.+?)\s*\|\s*(.+?)\s*\|\s*(.+?)$"
SCORE = r"Score:\s*([\d.]+)%?"


def lines(text: Column) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def two_fields(line: Column) -> Column:
    """(name, value) of a line, null where it has not that form."""
    return F.when(F.regexp_like(line, F.lit(TWO_FIELDS)), F.struct(F.regexp_extract(line, TWO_FIELDS, 2).alias("name"), F.regexp_extract(line, TWO_FIELDS, 3).alias("value")))


def three_fields(line: Column) -> Column:
    """(head, relation, tail) of a line, null where it has not that form."""
    return F.when(
        F.regexp_like(line, F.lit(THREE_FIELDS)),
        F.struct(*(F.regexp_extract(line, THREE_FIELDS, i).alias(n) for i, n in ((2, "head"), (3, "relation"), (4, "tail")))),
    )


def score(text: Column) -> Column:
    """The number after ``Score:``, a percentage as a share; 0 where there is none."""
    number = F.regexp_extract(text, SCORE, 1)
    value = number.try_cast("double")
    percent = F.contains(text, F.concat(number, F.lit("%")))
    return F.coalesce(F.when(value.isNotNull() & percent, value / 100).otherwise(value), F.lit(0.0))


def answer_parts(text: Column) -> Column:
    """(answer, rationale, score): the last line of each kind counts; without an answer line the whole text answers."""
    raw = F.split(text, "\n")

    def last(mark: str) -> Column:
        return F.try_element_at(F.filter(raw, lambda x: F.startswith(x, F.lit(mark))), F.lit(-1))

    def rest(mark: str) -> Column:
        return F.trim(F.substring(last(mark), F.lit(len(mark) + 1), F.length(text)))

    return F.struct(
        F.coalesce(rest("Answer:"), text).alias("answer"),
        F.coalesce(rest("Rationale:"), F.lit("")).alias("rationale"),
        F.coalesce(score(last("Score:")), F.lit(0.0)).alias("score"),
    )
