"""String helpers as Column functions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = r"^[+-]?(?:0[xX][0-9a-fA-F]+|[0-9]+)$"
FLOAT = r"^[+-]?(?:0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def is_int(s: Column, non_negative: bool = False) -> Column:
    """Whether the whole string is a whole number, decimal or hexadecimal."""
    return s.rlike(INT) & (~F.startswith(s, F.lit("-")) if non_negative else F.lit(True))


def is_float(s: Column, non_negative: bool = False) -> Column:
    """Whether the whole string is a number, also hexadecimal, inf or nan."""
    return s.rlike(FLOAT) & (~F.startswith(s, F.lit("-")) if non_negative else F.lit(True))


def remove_prefix(s: Column, prefix: str) -> Column:
    return F.when(F.startswith(s, F.lit(prefix)), F.substring(s, len(prefix) + 1, F.length(s))).otherwise(s)


def remove_suffix(s: Column, suffix: str) -> Column:
    return F.when(F.endswith(s, F.lit(suffix)), F.substring(s, 1, F.length(s) - len(suffix))).otherwise(s)


def split(s: Column, by: str, skip_empty: bool = False) -> Column:
    """Parts between a delimiter; an empty last part is none."""
    import re

    parts = F.split(s, re.escape(by))
    if skip_empty:
        return F.filter(parts, lambda x: x != "")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def labelled(name: str, value: Column, width: int = 33) -> Column:
    """A line of a report: the name padded, then the value."""
    return F.concat(F.rpad(F.lit(f"{name}:"), width, " "), value.cast("string"))


def resolve(path: str, base: str) -> str:
    """A path with ~ expanded; a relative one is taken from the folder of base."""
    p = Path(os.path.expanduser(path))
    return str(p if p.is_absolute() else Path(base).parent / p)
