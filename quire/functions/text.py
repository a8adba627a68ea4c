"""Text functions as Column expressions; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements of the project's ASCII form.
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„‟"
DASHES = "‐‑‒–—−\u00ad"
NO_BREAK_SPACE = "\u00a0"
WIDE_REPLACEMENTS = (("…", "..."), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
# End of fixed values.

#: Every character that Python's str.strip removes, as a Java class with (?U).
BLANK = r"[\s\x1c-\x1f]"


def strip_blanks(text: Column) -> Column:
    """Drop blanks of any kind at both ends; null stays null."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and all-blank texts."""
    return F.coalesce(F.length(strip_blanks(text)) == 0, F.lit(True))


def ascii_form(text: Column) -> Column:
    """Typographic characters as ASCII; characters without a replacement stay."""
    narrow = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + NO_BREAK_SPACE
    plain = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " "
    out = F.translate(text, narrow, plain)
    for wide, letters in WIDE_REPLACEMENTS:
        out = F.replace(out, F.lit(wide), F.lit(letters))
    return out


def one_line(text: Column) -> Column:
    """ASCII form with runs of blanks as one space and no outer blanks."""
    return strip_blanks(F.regexp_replace(ascii_form(text), rf"(?U){BLANK}+", " "))


def printable_ascii(text: Column) -> Column:
    """Nonempty and every code point in 32..126; null gives false."""
    return F.coalesce(text.rlike(r"\A[\x20-\x7E]+\z"), F.lit(False))


def ctc_steps(text: Column) -> Column:
    """Frames a recognizer needs: characters plus pairs of equal neighbours; null gives 0."""
    pairs = F.regexp_count(text, F.lit(r"(?s)(.)(?=\1)"))
    return F.coalesce(F.length(text) + pairs, F.lit(0)).cast("bigint")
