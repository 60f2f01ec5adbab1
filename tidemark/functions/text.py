"""Column expressions for text: blank tests, trimming, lines, completions.

All of these are built-in Spark expressions (JVM side, whole-stage codegen).
Whitespace follows the Unicode definition (``(?U)``), so a no-break space
counts as blank, as it does for ``IsNullOrWhiteSpace`` in the source tool.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regular expressions whose behaviour must match the source tool.
NON_BLANK_RE = r"(?U)\S"
COMMENT_LINE_RE = r"(?U)^\s*//"
# Unicode White_Space (what ``(?U)\s`` matches), used as a trim set: btrim
# is linear, while a ``\s+$`` regex rescans every run of blanks.
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                     0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
THINK_RE = r"(?s)<think>.*?</think>"
FIRST_FENCE_RE = r"(?sU)^.*?```(?:\w+)?\s*(.*?)```.*$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    """null, empty or only whitespace."""
    c = col(c)
    return c.isNull() | ~c.rlike(NON_BLANK_RE)


def not_blank(c) -> Column:
    c = col(c)
    return c.isNotNull() & c.rlike(NON_BLANK_RE)


def blank_coalesce(a, b) -> Column:
    """``a`` when it holds a non-blank character, else ``b``."""
    return F.when(not_blank(a), col(a)).otherwise(col(b))


def unicode_trim(c) -> Column:
    """Trim every Unicode whitespace character at both ends (Spark ``trim``
    strips only the space character)."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def split_lines(c) -> Column:
    """Split on LF keeping trailing empty lines; ``\\r`` stays on its line."""
    return F.split(F.coalesce(col(c), F.lit("")), "\n", -1)


def effective_loc(c) -> Column:
    """A1: lines that are non-blank and do not start with ``//`` after
    leading whitespace.  Block comments count."""
    return F.size(F.filter(split_lines(c), lambda l: l.rlike(NON_BLANK_RE) & ~l.rlike(COMMENT_LINE_RE)))


def changed_line_numbers(old, new) -> Column:
    """1-based numbers of new lines that have no old line at the same
    position or differ from it.  Positional, so an insertion flags every
    later line and a trailing deletion flags nothing."""
    # both texts are cut once: a lambda's body is worked out per element, so it
    # must not hold the split itself.  Places past the shorter text are null.
    differs = F.zip_with(split_lines(old), split_lines(new), lambda o, n: n.isNotNull() & ~o.eqNullSafe(n))
    numbered = F.transform(differs, lambda d, i: F.when(d, i + 1))
    return F.filter(numbered, lambda i: i.isNotNull())


def strip_think(c) -> Column:
    """Drop every closed ``<think>...</think>`` span, then trim."""
    return unicode_trim(F.regexp_replace(col(c), THINK_RE, ""))


def extract_code_block(c) -> Column:
    """Blank -> ''; else after X1 the body of the first fenced block,
    trimmed; with no closed fence the whole (stripped) text."""
    # one replace: with a fence the whole text becomes the first block's
    # body, without one the text is left as it is (no separate match test)
    body = F.regexp_replace(strip_think(c), FIRST_FENCE_RE, "$1")
    return F.when(is_blank(c), F.lit("")).otherwise(unicode_trim(body))


def basename(c) -> Column:
    """File name after the last ``/`` or ``\\`` (both separators accepted)."""
    # no pattern: it would be tried from every character of the path
    return F.substring_index(F.substring_index(col(c), "/", -1), "\\", -1)


def stem(c) -> Column:
    """File name without its last extension (``a.b.cs`` -> ``a.b``,
    ``.gitignore`` -> ``''``)."""
    return F.regexp_extract(basename(c), r"^(.*?)(\.[^.]*)?$", 1)


def extension(c) -> Column:
    """Last extension including the dot; '' when there is none or the name
    ends with a dot."""
    return F.regexp_extract(basename(c), r"(\.[^.]+)$", 1)
