"""Durations as job reports write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"hrs": 3600, "min": 60, "sec": 1}


def duration_seconds(text: Column) -> Column:
    """Seconds of texts such as "1hrs, 2mins, 3sec"; parts may be missing, and null stays null."""
    found = [F.coalesce(F.regexp_extract(text, rf"(\d+)\s*{unit}", 1).try_cast("long"), F.lit(0)) * n for unit, n in SECONDS.items()]
    return F.when(text.isNotNull(), found[0] + found[1] + found[2])
