"""Dates in free text notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by their first letters, in English, Spanish and French.
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fev": 2, "fév": 2, "mar": 3, "apr": 4, "abr": 4, "avr": 4, "may": 5, "mai": 5, "jun": 6, "juin": 6,
    "jul": 7, "juil": 7, "aug": 8, "ago": 8, "aou": 8, "aoû": 8, "sep": 9, "set": 9, "oct": 10, "nov": 11, "dec": 12, "dic": 12, "déc": 12,
}
_DATE = r"(\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{8}|\d{1,2}\.? (?:de |of )?\p{L}{3,10}\.?,? (?:de |of )?\d{4})"
_RANGE = _DATE + r"\s*(?:to|until|till|through|-|–|/|al?|au|hasta|y|et|and)\s*(?:el |le |the )?\s*" + _DATE
_HALT = r"(?i)suspen|halt|no trading|sin cotizar|not traded"
_NOT = r"(?i)predecessor|lifted|no suspension|sin suspensi|not suspended|line only"


def parsed_date(text: Column) -> Column:
    """A date written as 2022-10-04, 2022.10.04, 20221004, 4 Oct 2022 or 4 de octubre de 2022; null if none."""
    numbers = F.regexp_replace(text, r"[./]", "-")
    month = F.lower(F.regexp_extract(text, r"(\p{L}{3,})\.?,? (?:de |of )?\d{4}", 1))
    names = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    number = F.coalesce(F.try_element_at(names, F.substring(month, 1, 4)), F.try_element_at(names, F.substring(month, 1, 3)))
    spelled = F.format_string("%s-%02d-%02d", F.regexp_extract(text, r"(\d{4})$", 1), number, F.regexp_extract(text, r"^(\d{1,2})", 1).try_cast("int"))
    packed = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.when(text.rlike(r"^\d{4}\D"), numbers).when(text.rlike(r"^\d{8}$"), packed).otherwise(spelled).try_cast("date")


def suspensions(provenance: DataFrame) -> DataFrame:
    """``run_id, ticker, from_day, to_day``: spans of days on which, by a note, trading was suspended; repeated notes count once.

    A note is read clause by clause (parted by ``;`` or a stop and a blank); a clause counts if it speaks of a halt, doesn't deny it,
    and holds two dates joined as a range. Null and blank notes give no rows.
    """
    clauses = provenance.where(F.col("note").isNotNull()).select("run_id", "ticker", F.explode(F.split("note", r";|\. ")).alias("clause"))
    told = clauses.where(F.col("clause").rlike(_HALT) & ~F.col("clause").rlike(_NOT)).where(F.col("clause").rlike(_RANGE))
    days = [parsed_date(F.regexp_extract("clause", _RANGE, k)) for k in (1, 2)]
    spans = told.select("run_id", "ticker", days[0].alias("from_day"), days[1].alias("to_day"))
    return spans.where("from_day <= to_day").distinct()
