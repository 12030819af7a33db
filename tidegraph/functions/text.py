"""Column helpers on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any Unicode white space, no-break spaces included.
_OUTER = r"(?U)^[\s  ﻿]+|[\s  ﻿]+$"
_SOLID = r"(?U)[^\s  ﻿]"


def strip(text: Column) -> Column:
    """``text`` without outer white space of any kind."""
    return F.regexp_replace(text, _OUTER, "")


def has_text(text: Column) -> Column:
    """True where ``text`` is neither null nor blank."""
    return F.coalesce(text.rlike(_SOLID), F.lit(False))


def words_joined(text: Column) -> Column:
    """Lower case; words parted by blanks, hyphens or underscores, joined by one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s _\-]+", " "))
