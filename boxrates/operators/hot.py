"""Finding the few heaviest groups of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def heaviest(groups: DataFrame, keys: Sequence[str], size: str, above: int) -> DataFrame:
    """Groups with ``size > above``, however many; their list is broadcast only if Spark
    measures it as small.

    Callers must be exact for any choice of groups; being listed only changes how work is
    split.
    """
    return groups.filter(F.col(size) > above).select(*keys, size)
