"""Fragments of the ANSI SQL the queries are checked against."""

from __future__ import annotations

from ..functions import text as T

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
# A separator on both sides of every character that is not part of a word, so that
# whole words can be counted without lookaround.
NOT_WORD = r"[^\p{L}\p{N}_]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain(pattern: str) -> str:
    """The pattern with boundaries the checking engine knows."""
    plain = pattern.replace(T.WORD_START, r"\b").replace(T.WORD_END, r"\b")
    return plain.replace("(?id)", "(?i)").replace("(?d)", "").replace("(?ds)", "(?s)")


def rx(col: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({col}, {lit(plain(pattern))}, {group}), '')"


def rnum(col: str, pattern: str, group: int = 1, kind: str = "double") -> str:
    return f"try_cast({rx(col, pattern, group)} as {kind})"


def rl(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit(plain(pattern))})"


def rc(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {lit(plain(pattern))}))"


def rall(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({col}, {lit(plain(pattern))}, {group})"


def lc(col: str, word: str) -> str:
    return f"((length({col}) - length(replace({col}, {lit(word)}, ''))) // {len(word)})"


def strip(col: str) -> str:
    return f"trim({col}, {BLANKS})"


def has(col: str, *words: str) -> str:
    return "(" + " or ".join(f"contains({col}, {lit(word)})" for word in words) + ")"


def spaced(col: str) -> str:
    """``col`` with every non-word character doubled (see ``wc``)."""
    return rf"regexp_replace({col}, '({NOT_WORD})', '\1\1', 'g')"


def wc(spaced_col: str, body: str) -> str:
    """Whole-word count of ``body`` on a ``spaced`` column."""
    return f"len(regexp_extract_all({spaced_col}, {lit(f'(?:^|{NOT_WORD})(?:{body})(?:$|{NOT_WORD})')}))"


def ordered_case(rules, test, default: str = "null") -> str:
    """CASE over (value, pattern) rules, first match wins."""
    arms = " ".join(f"when {test(pattern)} then {lit(value)}" for value, pattern in rules)
    return f"case {arms} else {default} end"
