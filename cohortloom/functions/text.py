"""Text predicates and tokens, as plain columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number keeps its inner dots and a unit glued to it (1.6cm); every other run of letters and digits is a token,
# in any script. The second spelling is for Python, whose patterns have no letter classes.
TOKEN_PATTERN = r"[0-9]+(?:\.[0-9]+)*[\p{L}\p{N}]*|[\p{L}\p{N}]+"
_PYTHON_TOKEN = r"[0-9]+(?:\.[0-9]+)*[^\W_]*|[^\W_]+"

# Characters a regular expression gives a meaning to, in both the Java and the RE2 dialect.
_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}])")


def alternation(keywords: Iterable[str], literal: bool = True) -> str:
    """One regular expression matching any keyword; surrounding blanks of a keyword are dropped."""
    words = [word.strip() for word in keywords]
    words = [word for word in words if word]
    if not words:
        raise ValueError("at least one keyword is needed")
    return "|".join(_SPECIAL.sub(r"\\\1", word) if literal else word for word in words)


def contains_keyword(text: Column, keywords: Iterable[str], literal: bool = True) -> Column:
    """Ignore-case keyword test; a NULL text is no match."""
    return F.coalesce(text.rlike("(?i)" + alternation(keywords, literal)), F.lit(False))


def contains_ignore_case(text: Column, word: str) -> Column:
    """Ignore-case substring test without a regular expression."""
    return F.lower(text).contains(word.lower())


def occurs(text: Column, pattern: str) -> Column:
    """True where the pattern occurs; a dot also matches a line break."""
    return text.rlike("(?s)" + pattern)


def tokens_of(text: Column) -> Column:
    """The array of lower-case tokens of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def phrase_tokens(phrase: str) -> list[str]:
    """The same analysis for a phrase given in the program."""
    return re.findall(_PYTHON_TOKEN, phrase.lower())


def labelled(first: Column, second: Column) -> Column:
    """'first second': a NULL first part is written as None, a NULL second part makes the label NULL."""
    return F.concat(F.coalesce(first, F.lit("None")), F.lit(" "), second)


def seeded_order(key: Column, seed: int | Column) -> Column:
    """A fixed pseudo-random order for keys: the MD5 of 'key:seed'.

    It depends on the value alone, so the pick is the same for any partitioning, after a lost executor and in any
    engine that has MD5.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(key.cast("string"), F.lit(":"), seed.cast("string")))
