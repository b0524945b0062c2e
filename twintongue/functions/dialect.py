"""Column expressions with the dialect's meaning; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column, whole: bool) -> Column:
    """Whole numbers truncate; division by zero gives NULL."""
    return F.when(b != 0, F.call_function("div", a, b)) if whole else F.try_divide(a, b)


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def concat(*parts: Column) -> Column:
    """Skips NULLs and turns numbers and booleans into text."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def substr(text: Column, start: int, length: int | None = None) -> Column:
    """From 1; 0 means 1, and nothing begins before the text."""
    if start < 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.substring(text, F.lit(max(start, 1)), F.lit(length if length is not None else (1 << 31) - 1))


def trim(text: Column, left: bool = True, right: bool = True) -> Column:
    """All Unicode white space, not blanks alone."""
    space = "[\\s\\u0085\\p{Z}]"
    if left:
        text = F.regexp_replace(text, f"^{space}+", "")
    return F.regexp_replace(text, f"{space}+$", "") if right else text


def _path(path: str | None) -> str:
    path = path or "$"
    return path if path.startswith("$") else "$." + path


def json_extract(text: Column, path: str) -> Column:
    return F.get_json_object(text, _path(path))


def json_array_length(text: Column, path: str | None = None) -> Column:
    return F.json_array_length(text if path is None else F.get_json_object(text, _path(path)))


def json_valid(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def json_type(text: Column, path: str | None = None) -> Column:
    """null, boolean, number, string, array or object; NULL for what is no JSON or not there."""
    parsed = F.try_parse_json(text)
    found = parsed if path is None else F.try_variant_get(parsed, _path(path), "variant")
    kind = F.schema_of_variant(found)
    named = F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    return F.when(found.isNotNull(), named)
