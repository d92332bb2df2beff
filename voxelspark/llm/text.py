"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ends a word: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(text: Column) -> Column:
    """A text, with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def free_name(taken: list[str], name: str) -> str:
    """name, or name with underscores in front until no column (in any case) has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
