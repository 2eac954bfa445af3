"""Text predicates and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that hide in malformed identifiers (braille blanks, zero-width, marks, no-break space).
INVISIBLE = "[⠀-⣿​-‏﻿ ]"
#: White space as Unicode has it, with the four information separators.
SPACES = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Characters beyond which a text gets no name detection.
SIZE_GUARD = 500_000


def visible(text: Column) -> Column:
    """Each invisible character becomes one space, so offsets stay."""
    return F.regexp_replace(text, INVISIBLE, " ")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"\\A{SPACES}+|{SPACES}+\\z", "")


def not_blank(text: Column) -> Column:
    return F.length(strip(text)) > 0


def rejoined_literals(text: Column) -> Column:
    """SQL string literals that a block comment splits are one again."""
    return F.regexp_replace(text, r"(?s)'\s*/\*.*?\*/\s*'", "")


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def has_devanagari(text: Column) -> Column:
    return text.rlike("[ऀ-ॿ]")


def within_guard(text: Column) -> Column:
    return F.length(text) <= SIZE_GUARD


def stripped_end(text: Column) -> Column:
    """Without closing punctuation."""
    return F.regexp_replace(text, r"[.,;)(]+\z", "")


def quoted(text: str) -> str:
    """A literal as a pattern."""
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|&#~" else c for c in text)
