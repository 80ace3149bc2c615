"""Names that extractors make up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def auto_named(name: Column) -> Column:
    """Whether an extractor made the name up: a literal prefix, no pattern with a wildcard; a null name is one."""
    return F.coalesce(name.startswith("FUN_"), F.lit(True))
