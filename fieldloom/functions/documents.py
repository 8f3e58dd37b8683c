"""Expressions over resume documents held as ``map<string,string>``.

All keep the order of the document's keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.text import is_blank

DOCUMENT = "map<string,string>"


def no_fields() -> Column:
    return F.create_map().cast(DOCUMENT)


def parse_document(json_text: Column) -> Column:
    """JSON object text to a map; null and JSON null read as no fields.

    A repeated key keeps its first place and its last value.
    """
    def last_values(parsed: Column) -> Column:
        entries = F.map_entries(parsed)
        keys = F.array_distinct(F.map_keys(parsed))
        kept = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(
            F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
        return F.when(F.size(keys) == F.size(entries), parsed).otherwise(kept)

    # one evaluation of the parser for all uses
    parsed = F.transform(F.array(F.from_json(json_text, DOCUMENT)), last_values)
    return F.coalesce(F.get(parsed, F.lit(0)), no_fields())


def is_broken(json_text: Column) -> Column:
    """Whether text is there that is not a JSON object; JSON null is no document, not a broken one."""
    return F.from_json(json_text, DOCUMENT).isNull() & json_text.isNotNull() & (F.trim(json_text) != "null")


def document_text(fields: Column) -> Column:
    """The map as a JSON object, null values included."""
    return F.to_json(fields, {"ignoreNullFields": "false"})


def field_count(fields: Column) -> Column:
    return F.coalesce(F.size(F.map_keys(fields)), F.lit(0))


def resume_text(fields: Column) -> Column:
    """``key: value`` lines in document order, blank values left out."""
    kept = F.filter(F.map_entries(fields), lambda e: ~is_blank(e["value"]))
    lines = F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def field_contains(fields: Column, key: str, needle: str) -> Column:
    """Case-insensitive substring test on one key; a missing key never matches."""
    return F.coalesce(F.contains(F.lower(fields[key]), F.lower(F.lit(needle))), F.lit(False))


def merged(fields: Column, patch: Column) -> Column:
    """Shallow merge where patch wins; known keys keep their place, new ones follow."""
    current, change = F.coalesce(fields, no_fields()), F.coalesce(patch, no_fields())
    kept = F.transform_values(
        current, lambda k, v: F.when(F.map_contains_key(change, k), change[k]).otherwise(v))
    added = F.map_filter(change, lambda k, v: ~F.map_contains_key(current, k))
    return F.map_concat(kept, added)


def without_any(fields: Column, keys: Column) -> Column:
    return F.map_filter(F.coalesce(fields, no_fields()), lambda k, v: ~F.array_contains(keys, k))
