"""Which tasks describe the same upstream record: keys shared by problems 3 and 4."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that stand for no record id.
STAND_INS = ["", "unknown", "none", "n/a", "null", "tbd", "-", "0"]
OUTER_BLANKS = r"^[\s  -​　﻿]+|[\s  -​　﻿]+$"


def source_key(column: str = "source_record_id") -> Column:
    """The record id without case, outer blanks and the difference of - and _; null if it names none."""
    plain = F.translate(F.lower(F.regexp_replace(F.col(column), OUTER_BLANKS, "")), "_", "-")
    return F.when(~plain.isin(STAND_INS), plain)


def id_number(column: str = "id") -> Column:
    """The number after the last _ of an id, without leading zeros; null if there is none."""
    digits = F.regexp_extract(F.col(column), r"_(\d+)[\s ​　﻿]*$", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", ""))
