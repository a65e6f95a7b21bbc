"""Column expressions on texts, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six white-space characters that separate words: 20 and 09 to 0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def count_without(text: Column, characters: str) -> Column:
    """Code points of ``text`` that are not among ``characters``."""
    return F.length(F.translate(text, characters, "")).cast("long")
