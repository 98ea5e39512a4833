"""Text and path functions as columns."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """The part after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix with its dot, or empty."""
    return F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1)


def without_literal(text: Column, literal: str = ".mp4") -> Column:
    """Every occurrence of a literal removed."""
    return F.replace(text, F.lit(literal), F.lit(""))


def replace_component(path: Column, component: str, replacement: str) -> Column:
    """Path components equal to ``component`` replaced, doubled slashes collapsed."""
    parts = F.transform(F.split(path, "/"), lambda x: F.when(x == component, F.lit(replacement)).otherwise(x))
    return F.replace(F.array_join(parts, "/"), F.lit("//"), F.lit("/"))


def replace_component_text(path: str, component: str, replacement: str) -> str:
    """As ``replace_component``, for one string; the replacement is made absolute."""
    return "/".join(os.path.abspath(replacement) if x == component else x for x in path.split("/")).replace("//", "/")


def minutes_to_ms(minutes: Column) -> Column:
    """Whole milliseconds, cut toward zero."""
    return (minutes * 60000).cast("long")


def split_name(name: Column, number: Column) -> Column:
    """name-split-NN."""
    return F.concat(name, F.format_string("-split-%02d", number.cast("int")))


def range_name(name: Column, start: Column, end: Column) -> Column:
    """name-start_S_end_E."""
    return F.format_string("%s-start_%d_end_%d", name, start, end)


def key_value_line(key: Column, value: Column) -> Column:
    """'key: value' with three decimals."""
    return F.format_string("%s: %.3f", key.cast("string"), value.cast("double"))
