"""Reading the JSON array out of a model's text answer.

The answer is parsed as a variant and read as objects of three variants, so an
element or attribute of another type shows as such instead of being converted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answer verdicts.
OK, API_ERROR, NO_ARRAY, PARSE_ERROR = "ok", "api_error", "no_array", "parse_error"

# The keys of a match and what an absent key stands for.
MATCH_DEFAULTS = {"field_name": "", "field_type": "text", "matched_value": ""}

_JSON_SEGMENT = r'"(?:[^"\\]|\\.)*"|[^"]+|"'
_NOT_A_NUMBER = r"(?<![\w.+-])(?:NaN|-?Infinity)(?![\w.+-])"


def array_slice(text: Column) -> Column:
    """From the first ``[`` to the last ``]``; null when either is missing, '' when crossed."""
    start = F.instr(text, F.lit("["))
    end = F.length(text) - F.instr(F.reverse(text), F.lit("]")) + 1
    return (
        F.when((start > 0) & F.contains(text, F.lit("]")),
               F.substring(text, start, F.greatest(end - start + 1, F.lit(0))))
    )


def _without_nan(json_text: Column) -> Column:
    """Bare NaN and Infinity become 0: numbers like them, but plain JSON."""
    cleaned = F.array_join(F.transform(
        F.regexp_extract_all(json_text, F.lit(_JSON_SEGMENT), F.lit(0)),
        lambda s: F.when(s.startswith('"'), s).otherwise(F.regexp_replace(s, _NOT_A_NUMBER, "0")),
    ), "")
    return F.when(json_text.rlike("NaN|Infinity"), cleaned).otherwise(json_text)


_ELEMENT = f"struct<{', '.join(f'{key}: variant' for key in MATCH_DEFAULTS)}>"


def parse_elements(json_text: Column) -> Column:
    """Exactly one JSON array as an array of objects; null for anything else.

    The text is wrapped in one more array: trailing text or a second array
    then shows as a parse failure or as a second outer element. An element
    that is not an object is null; so is an attribute that is absent.
    """
    wrapped = F.concat(F.lit("["), _without_nan(json_text), F.lit("]"))
    outer = F.try_variant_get(F.try_parse_json(wrapped), "$", f"array<array<{_ELEMENT}>>")
    # a transform over one element, so that the parse is written and run once
    return F.transform(F.array(outer), lambda arrays: F.when(F.size(arrays) == 1, arrays[0]))[0]


def answer_verdict(status_code: Column, text: Column, elements: Column) -> Column:
    return (
        F.when(status_code.isNull() | (status_code != 200) | text.isNull(), API_ERROR)
        .when(array_slice(text).isNull(), NO_ARRAY)
        .when(elements.isNull(), PARSE_ERROR)
        .otherwise(OK)
    )


def valid_matches(elements: Column) -> Column:
    """Elements that are objects whose attributes, where present, are strings; in order.

    A JSON null is present and not a string.
    """
    def valid(element: Column) -> Column:
        good = element.isNotNull()
        for key in MATCH_DEFAULTS:
            good = good & (element[key].isNull() | (F.schema_of_variant(element[key]) == "STRING"))
        return good

    return F.transform(F.filter(elements, valid), lambda element: F.struct(*[
        F.coalesce(element[key].cast("string"), F.lit(default)).alias(key)
        for key, default in MATCH_DEFAULTS.items()]))
