"""Strict JSON on top of ``try_parse_json``, which by itself accepts text after the first value."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def is_json_object_text(text: Column) -> Column:
    """Whether the first character after JSON white space opens an object. Cheap; decides before parsing."""
    return text.rlike(r"^[ \t\r\n]*\{")


def has_lone_surrogate(text: Column) -> Column:
    """Whether an escape names half of a surrogate pair, which is no character. Most texts end at the first test.

    Escaped backslashes become blanks first, so that what remains of a backslash starts an escape and escapes on both
    sides of one do not become neighbours; then whole pairs are taken out.
    """
    unescaped = F.regexp_replace(text, r"\\\\", " ")
    single = F.regexp_replace(
        unescaped, r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", ""
    )
    return (text.contains("\\ud") | text.contains("\\uD")) & single.rlike(r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}")


def has_infinite_number(text: Column) -> Column:
    """Whether a number of a JSON text is beyond the range of a double. Most texts end at the first test.

    Escapes go first, so that what remains of strings holds no quotes, then strings; the numbers left are read as doubles.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', '""')
    numbers = F.regexp_extract_all(bare, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"))
    infinite = F.exists(numbers, lambda x: F.abs(x.try_cast("double")) == float("inf"))
    return text.rlike(r"[eE]\+?[0-9]{3}|[0-9]{309}") & infinite


def strict_json(text: Column) -> tuple[Column, Callable]:
    """One-parse strict check.

    The text is parsed as the first element of ``[text,"token"]``. If it is one complete value, the array has the
    token as its second element. Text that closes the array early leaves no token behind, text with a second value
    moves it to a later place, and anything else is a syntax error. The token is random per plan, so no stored text
    can contain it.

    Returns the column to materialise, and a function that takes the materialised column and gives
    ``(is_valid, document)``.
    """
    token = uuid.uuid4().hex
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{token}"]')))

    def read(parsed: Column) -> tuple[Column, Column]:
        valid = F.coalesce(F.try_variant_get(parsed, "$[1]", "string") == F.lit(token), F.lit(False))
        return valid, F.when(valid, F.try_variant_get(parsed, "$[0]", "variant"))

    return wrapped, read
