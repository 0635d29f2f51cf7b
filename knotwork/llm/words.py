"""Word definitions shared by the corpus operators (native expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts as 0.

    Each word becomes one mark, then white space is dropped: two strings per row, never an array of words.
    """
    marks = F.translate(F.regexp_replace(text, WORD, "\x01"), SPACES, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")
