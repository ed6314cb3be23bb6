"""Years in catalogue records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guess_year(*fields: Column) -> Column:
    """Earliest year from 1000 to 2099 that no digit adjoins, in any of the fields; null if there is none."""
    text = F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9])(1[0-9]{3}|20[0-9]{2})(?![0-9])"), F.lit(1))
    return F.array_min(F.transform(found, lambda y: y.cast("int")))


def document_year(date: Column, designation: Column) -> Column:
    """Year of the first dd.mm.yyyy in date, else the number behind the designation's last dash: two digits over 25 are
    of the 20th century, up to 25 of the 21st."""
    date, tail = F.coalesce(date, F.lit("")), F.coalesce(designation, F.lit(""))
    dated = F.regexp_extract(date, r"\b[0-9]{2}\.[0-9]{2}\.([0-9]{4})\b", 1).try_cast("int")
    n = F.regexp_extract(tail, r"[-–]([0-9]{2}|[0-9]{4})\s*\z", 1).try_cast("int")
    short = F.when(n > 25, n + 1900).otherwise(n + 2000)
    return F.coalesce(dated, F.when(n >= 100, n).when(n.isNotNull(), short))
