"""Text helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
#: The characters that Python's strip() and split() take for white space, for use inside a class of a pattern.
SPACES = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE, NO_SPACE = f"[{SPACES}]", f"[^{SPACES}]"
#: The same characters one by one, and the class without the newline, for use inside a line.
WHITE = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
INLINE = f"[{SPACES}&&[^\n]]"
#: A bullet where a line begins, of a text with a newline before it; possessive, so that no character is read twice.
BULLET = f"\n{INLINE}*+[-*•]"


def strip(c: Column | str) -> Column:
    """Without white space at both ends. Only the ends are looked at: a pattern would be tried at each blank of the text."""
    return F.btrim(c, F.lit(WHITE))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(c, F.lit(f"{NO_SPACE}+"))


def lines(c: Column | str) -> Column:
    return F.split(strip(c), "\n")


def filled_lines(c: Column | str) -> Column:
    return F.filter(lines(c), lambda x: strip(x) != "")


def bullets(c: Column | str) -> Column:
    """Lines that begin with a bullet after white space."""
    return F.filter(lines(c), lambda x: strip(x).rlike(r"\A[-*•]"))


def bullet_count(c: Column) -> Column:
    """How many bullets() has; one pass over the text, lines aren't cut out."""
    return F.regexp_count(F.concat(F.lit("\n"), c), F.lit(BULLET))


def bullets_of(c: Column, words: Column) -> Column:
    """How many of these lines have so many words behind their bullets and blanks."""
    rest = F.concat(F.lit(f"{BULLET}[-*• ]*+(?:{INLINE}*+{NO_SPACE}++){{"), F.greatest(words, F.lit(0)).cast("string"), F.lit(f"}}{INLINE}*+(?=\n|\\z)"))
    return F.when(words >= 0, F.regexp_count(F.concat(F.lit("\n"), c), rest)).otherwise(0)


def holds(text: Column, part: Column) -> Column:
    """Substring, whatever the case."""
    return F.contains(F.lower(text), F.lower(part))


def tokens(*texts: Column) -> Column:
    """A quarter of the characters of all texts, at least 1 if there are any."""
    n = sum((F.length(F.coalesce(t, F.lit(""))) for t in texts[1:]), F.length(F.coalesce(texts[0], F.lit(""))))
    return F.when(n > 0, F.greatest(F.floor(n / CHARS_PER_TOKEN), F.lit(1))).otherwise(0).cast("int")


def rate(count: Column, seconds: Column) -> Column:
    """count / seconds with seconds of a nanosecond at least, 0 for a count of 0."""
    return F.when(count > 0, count / F.greatest(seconds, F.lit(1e-9))).otherwise(F.lit(0.0))
