"""Checks of parameters that come as text: type, bounds, choices and patterns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string", "date": "date"}


def checked(value: Column, kind: str, least: float | None = None, most: float | None = None, choices: list[str] | None = None, pattern: str | None = None, default: str | None = None, required: bool = False) -> Column:
    """Struct (value, error) of a parameter given as text: the trimmed text if it passes, else null and what is wrong.

    Null and blank values take the default; without one they are missing where
    the parameter is required, and null without an error elsewhere.
    """
    text = F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))
    typed = text.try_cast(KINDS[kind])
    size = F.length(text) if kind == "string" else typed
    rules = [(text.isNull(), "missing" if required else None), (typed.isNull(), f"not a {kind}")]
    if least is not None:
        rules.append((size < least, "too small"))
    if most is not None:
        rules.append((size > most, "too large"))
    if choices is not None:
        rules.append((~text.isin(choices), "not a choice"))
    if pattern is not None:
        rules.append((~text.rlike(f"^(?:{pattern})$"), "wrong form"))
    error = F.lit(None).cast("string")
    for wrong, message in reversed(rules):
        error = F.when(wrong, F.lit(message)).otherwise(error)
    return F.struct(F.when(error.isNull(), text).alias("value"), error.alias("error"))
