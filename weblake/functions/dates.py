"""Dates written in running text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weblake.config import LISTING_MONTHS
from weblake.functions.text import let

_MONTH = "(?:" + "|".join(LISTING_MONTHS) + ")"
_MENTION = (r"(?i)\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{4}/\d{1,2}/\d{1,2}\b"
            rf"|\b\d{{1,2}} {_MONTH} \d{{4}}\b|\b{_MONTH} \d{{1,2}}, \d{{4}}\b")
_MONTHS = "array(" + ", ".join(f"'{m}'" for m in LISTING_MONTHS) + ")"
_ISO = f"""p -> cast(try_cast(case
  when p[0] rlike '^[0-9]{{4}}' then concat_ws('-', p[0], lpad(p[1], 2, '0'), lpad(p[2], 2, '0'))
  when p[0] rlike '^[0-9]' then concat_ws('-', p[2], lpad(array_position({_MONTHS}, lower(p[1])), 2, '0'), lpad(p[0], 2, '0'))
  when p[0] <> '' then concat_ws('-', p[2], lpad(array_position({_MONTHS}, lower(p[0])), 2, '0'), lpad(p[1], 2, '0'))
  end as date) as string)"""


def first_date(text: Column) -> Column:
    """ISO date of the first date mention, or null when there is none or it is no real day.

    Forms: 2012-03-07, 2012/3/7, 7 March 2012, March 7, 2012 (month names in any case).
    """
    found = F.regexp_extract(text, _MENTION, 0)
    return let(F.split(F.regexp_replace(found, "[-/, ]+", " "), " "), _ISO)
