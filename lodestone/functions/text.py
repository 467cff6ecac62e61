"""Text functions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence: up to and including its closing marks, never across a line break.
SENTENCE = r"[^.!?\n]+[.!?]*"
#: A token: a run of letters, digits and underscores, or one other visible character.
TOKEN = r"\w+|[^\w\s]"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sentences(text: Column) -> Column:
    """Sentences of a text, blank ones left out. A null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.filter(found, lambda s: F.trim(s) != "")


def paragraphs(text: Column) -> Column:
    """Lines with their line break, each blank line joined to the line before it."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\n)(?=[^\n]*\S)", "$1\u0001"), "\u0001")
    return F.filter(parts, lambda p: p != "")


def paragraph_sentences(text: Column) -> Column:
    """Sentences paragraph by paragraph, for texts too long to be split at once."""
    return F.flatten(F.transform(paragraphs(text), sentences))


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def tokenized_sentences(text: Column, pattern: str = TOKEN) -> Column:
    """Each sentence as its tokens joined by single spaces."""
    return F.transform(sentences(text), lambda s: F.array_join(tokens(s, pattern), " "))


def collapse_spaces(text: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Words between white space (the six ASCII characters); one-character split patterns need no regex engine."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


def spaced_length(text: Column) -> Column:
    """Pieces between single spaces, empty ones counted."""
    return F.size(F.split(text, " "))


def passage_text(title: Column, text: Column, sep: str) -> Column:
    """Title and text as one: the text alone without a title, the title alone for a blank text."""
    return F.when(title.isNull(), text).when(F.trim(text) == "", title).otherwise(F.concat(title, F.lit(sep), text))


def pack_chunks(units: Column, window: int) -> Column:
    """Consecutive sentences packed greedily: a chunk closes once it has ``window`` spaced words or more."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n"))

    def add(a: Column, s: Column) -> Column:
        held = F.when(a["held"].isNull(), s).otherwise(F.concat(a["held"], F.lit(" "), s))
        n = a["n"] + spaced_length(s)
        full = n >= window
        return F.struct(
            F.when(full, F.array_append(a["out"], held)).otherwise(a["out"]).alias("out"),
            F.when(~full, held).alias("held"),
            F.when(full, F.lit(0)).otherwise(n).alias("n"),
        )

    return F.aggregate(units, start, add, lambda a: F.when(a["held"].isNull(), a["out"]).otherwise(F.array_append(a["out"], a["held"])))


def sanitize(value: Column) -> Column:
    """A value fit for a `` | ``-separated line."""
    return F.trim(F.translate(value, "|\n", "  "))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 / (Levenshtein distance + 1)."""
    return F.lit(1.0) / (F.levenshtein(a, b) + 1)


def numbered(items: Column) -> Column:
    """A block of contexts: one stands alone, several are numbered from [1] with a blank line between."""
    lines = F.transform(items, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.trim(t), F.lit(" ")))
    return F.when(F.size(items) == 0, F.lit("")).when(F.size(items) == 1, F.trim(F.get(items, F.lit(0)))).otherwise(F.rtrim(F.array_join(lines, "\n\n")))


def json_part(text: Column, schema: str, a_list: bool = False) -> Column:
    """The object (or list) from the first opening to the last closing bracket; null where it doesn't parse."""
    opening, closing = ("[", "]") if a_list else ("{", "}")
    begin = F.locate(opening, text)
    end = F.length(text) - F.locate(closing, F.reverse(text)) + 1
    body = F.when((begin > 0) & (end <= F.length(text)) & (end >= begin), F.substring(text, begin, end - begin + 1))
    parsed = F.try_parse_json(body)
    kind = F.schema_of_variant(parsed)
    right = kind.startswith("ARRAY" if a_list else "OBJECT")
    return F.when(right, F.from_json(body, schema))
