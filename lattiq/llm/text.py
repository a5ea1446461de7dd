"""Text helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(column: Column) -> Column:
    """column without blanks of any kind at either end."""
    return F.regexp_replace(column.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
