"""String rules with explicit Unicode classes, as Column expressions.

Two notions of white space occur. ``JS_SPACE`` is what ECMAScript trims and what
its ``\\s`` matches; ``BLANK`` is what makes a value blank in the tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _escaped(points) -> str:
    return "".join(f"\\u{point:04X}" for point in points)


#: Unicode space separators.
SPACES = (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: The white space of ECMAScript as the inside of a regex class: with the byte order mark, without U+0085.
JS_SPACE = _escaped((*range(0x09, 0x0E), *SPACES, 0xFEFF))
#: Unicode white space and the separators U+001C to U+001F.
BLANK = _escaped((*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, *SPACES))


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit("".join(map(chr, (*range(0x09, 0x0E), *SPACES, 0xFEFF)))))


def js_words(c: Column) -> Column:
    """The words between runs of ECMAScript white space, empty ones left out."""
    return F.filter(F.split(c, f"[{JS_SPACE}]+"), lambda w: w != "")


def has_text(c: Column) -> Column:
    """False for null and for blank."""
    return F.coalesce(c.rlike(f"[^{BLANK}]"), F.lit(False))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, as ECMAScript counts."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def humanize(c: Column) -> Column:
    """A relation type as words."""
    return F.replace(c, F.lit("_"), F.lit(" "))


def optional_text(c: Column) -> Column:
    """The trimmed string, or null where nothing is left."""
    return F.nullif(js_trim(c), F.lit(""))
