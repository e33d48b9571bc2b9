"""Names: the comparison keys under which two spellings count as one name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_name(name: Column) -> Column:
    """Key of a name: outer spaces trimmed, inner runs of spaces made one, case ignored. Null stays null."""
    return F.lower(F.regexp_replace(F.trim(name), " +", " "))


def node_id(name: Column) -> Column:
    """Node identity: the name with double quotes turned into spaces."""
    return F.replace(name, F.lit('"'), F.lit(" "))
