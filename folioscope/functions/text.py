"""Text expressions (Column to Column) that stay inside generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and the plain letter each stands for.
_MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def unaccent(col: Column | str) -> Column:
    """Letters without accents; other characters stay. Null stays null."""
    return F.translate(F.col(col) if isinstance(col, str) else col, _MARKED, _PLAIN)


def squeeze(col: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def fold(col: Column | str) -> Column:
    """Lower case, no accents, single blanks."""
    c = F.col(col) if isinstance(col, str) else col
    return squeeze(unaccent(F.lower(c)))


def py_fold(text: str | None) -> str:
    """The Python twin of `fold`, for code inside Arrow functions and on small lists."""
    if not text:
        return ""
    marks_off = "".join(ch for ch in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(ch))
    return " ".join(marks_off.split())
