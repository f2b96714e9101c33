"""Text expressions that stay inside the JVM.

Patterns are written for java.util.regex but keep to what means the same everywhere:
word characters are spelled out as Unicode classes, boundaries as lookarounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
WORD_START = rf"(?<!{WORD})"
WORD_END = rf"(?!{WORD})"
BLANKS = " \t\n\r\x0b\x0c"
# Private-use character that marks where a match starts.
MARK = "\ue000"


def whole(body: str) -> str:
    """``body`` between word boundaries."""
    return f"{WORD_START}(?:{body}){WORD_END}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    The optimizer copies a column used once into the place of its use; inside a lambda
    that would compute it again for every element.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``, NULL when there is none (or the group is empty)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def number(text: Column, pattern: str, group: int = 1) -> Column:
    return first(text, pattern, group).try_cast("double")


def whole_number(text: Column, pattern: str, group: int = 1) -> Column:
    return first(text, pattern, group).try_cast("bigint")


def hits(text: Column, pattern: str | Column) -> Column:
    """How often ``pattern`` matches."""
    return F.regexp_count(text, pattern if isinstance(pattern, Column) else F.lit(pattern)).cast("bigint")


def guarded_hits(text: Column, word: str, pattern: str) -> Column:
    """``hits``; ``word`` is a literal part of every match, tried first."""
    return F.when(~text.contains(word), F.lit(0).cast("bigint")).otherwise(hits(text, pattern))


def has(text: Column, *words: str) -> Column:
    """Whether any of the literal ``words`` occurs."""
    test = text.contains(words[0])
    for word in words[1:]:
        test = test | text.contains(word)
    return test


def found(text: Column, word: str, pattern: str) -> Column:
    """Whether the pattern matches; ``word`` is a literal part of every match, tried first."""
    return text.contains(word) & text.rlike(pattern)


def literal_count(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gap = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return (gap / len(word)).cast("bigint")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    return F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(group))


def vocabulary(text: Column, shortest: int) -> Column:
    """Distinct lower-case words of at least ``shortest`` characters."""
    return F.array_distinct(matches(F.lower(text), rf"{WORD}{{{shortest},}}"))


def located(text: Column, pattern: str | Column) -> Column:
    """Every match with the 1-based line it starts on: ARRAY<STRUCT<line, match>>.

    A mark in front of each match survives the split into lines, so the line numbers
    come out in match order after one pass over the text.
    """
    clean = F.replace(text, F.lit(MARK), F.lit(""))
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    grouped = F.concat(F.lit("("), pattern, F.lit(")"))
    marked = lines(F.regexp_replace(clean, grouped, F.lit(MARK + "$1")))
    numbers = F.flatten(
        F.transform(
            marked,
            lambda line, i: F.array_repeat(
                (i + 1).cast("bigint"), literal_count(line, MARK).cast("int")
            ),
        )
    )
    return F.arrays_zip(numbers.alias("line"), matches(clean, pattern).alias("match"))


def present(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the values whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*[F.when(cond, value if isinstance(value, Column) else F.lit(value)) for cond, value in pairs])
    )


def joined(array: Column, separator: str = "|") -> Column:
    return F.array_join(array, separator)
