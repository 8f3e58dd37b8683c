"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank in text.
BLANK_CLASS = (
    r"\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def is_blank(text: Column) -> Column:
    """True when text is null or holds nothing but blanks."""
    return ~F.coalesce(text.rlike(f"[^{BLANK_CLASS}]"), F.lit(False))


def strip(text: Column) -> Column:
    """Text without leading and trailing blanks, Unicode ones included."""
    return F.regexp_replace(text, rf"^[{BLANK_CLASS}]+|[{BLANK_CLASS}]+\z", "")


def _escaped_char(char: Column) -> Column:
    code = F.ascii(char)
    digits = F.lower(F.hex(code))
    return (
        F.when(code < 256, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code < 65536, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )


def quoted(text: Column) -> Column:
    """Text as a quoted literal: single quotes unless only those occur inside."""
    has_single, has_double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    unprintable = r"[\p{C}\p{Z}&&[^ ]]"
    body = F.when(
        body.rlike(unprintable),
        F.array_join(F.transform(
            F.regexp_extract_all(body, F.lit("(?s)."), F.lit(0)),
            lambda c: F.when(c.rlike(unprintable), _escaped_char(c)).otherwise(c),
        ), ""),
    ).otherwise(body)
    return (
        F.when(has_single & ~has_double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def list_literal(items: Column) -> Column:
    """An array of strings as ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))
