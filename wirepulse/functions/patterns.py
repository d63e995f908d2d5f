r"""Keyword patterns as regular expressions with one meaning everywhere.

Patterns are written in the common dialect where ``\b`` is an ASCII word
boundary and ``\s`` includes the no-break space. Java disagrees on both, so the
two escapes are spelled out before a pattern reaches ``rlike``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

WORD = "A-Za-z0-9_"
SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def java_pattern(source: str) -> str:
    """Spell out word boundaries and white space for Java's engine."""
    def boundary(m: re.Match) -> str:
        opens_word = re.match(r"[A-Za-z0-9(]|\\d", source[m.end():])
        return f"(?<![{WORD}])" if opens_word else f"(?![{WORD}])"

    return re.sub(r"\\b", boundary, source).replace(r"\s", f"[{SPACE}]")


def any_pattern(sources: Sequence[str]) -> str:
    """One case-insensitive alternation: does any of the patterns occur?

    For ``padded`` text. The word boundary most patterns open with is factored
    out and matched as one non-word character: testing it once per position
    instead of once per pattern makes the search several times cheaper.
    """
    opened = [java_pattern(s[2:]) for s in sources if s.startswith(r"\b")]
    others = [java_pattern(s) for s in sources if not s.startswith(r"\b")]
    arms = ([rf"\W(?:{'|'.join(opened)})"] if opened else []) + others
    return "(?i)(?:" + "|".join(arms) + ")"


def padded(text: Column) -> Column:
    """Text after a line break, so that its first word has a character before it."""
    return F.concat(F.lit("\n"), text)


def contains_any(text: Column, sources: Sequence[str]) -> Column:
    """Does any pattern occur in ``padded`` text?"""
    return text.rlike(any_pattern(sources)) if sources else F.lit(False)


def first_pattern(text: Column, sources: Sequence[str]) -> Column:
    """The first pattern *in list order* that occurs in ``padded`` text, as its
    source; null when none does. Meant for rows ``contains_any`` accepted."""
    found = F.lit(None).cast("string")
    for source in reversed(sources):
        found = F.when(contains_any(text, (source,)), source).otherwise(found)
    return found
