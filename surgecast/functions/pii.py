"""PII patterns and match expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of personal data, by kind.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[ -]){3}\d{4}\b",
    "phone": r"\b(?:\+?\d{1,2}[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b",
}


# A character every match of the pattern must contain. Checking it first with a
# plain substring search skips the (backtracking) regex on most values and
# cannot change the result.
REQUIRED_CHAR = {"email": "@", "ssn": "-"}


# Java regex classes are ASCII by default; (?U) makes \d, \s, \w and \b
# Unicode-aware, as they are in Python's re for str patterns.
UNICODE = "(?U)"


def matches(col: Column, pattern_name: str) -> Column:
    """True where the (non-null) value contains the pattern."""
    text = col.cast("string")
    hit = text.rlike(UNICODE + PII_PATTERNS[pattern_name])
    need = REQUIRED_CHAR.get(pattern_name)
    if need is None:
        return hit
    return F.when(F.instr(text, need) > 0, hit).otherwise(F.lit(False))
