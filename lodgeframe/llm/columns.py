"""Names for added columns that no column of the input has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def free_prefix(df: DataFrame, *names: str) -> str:
    """The shortest run of underscores that, before any of ``names``, makes a name that ``df`` has not (in any case)."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any(prefix + name.lower() in taken for name in names):
        prefix += "_"
    return prefix


def widened(df: DataFrame, *added: StructField, without: tuple[str, ...] = ()) -> StructType:
    """The columns of ``df`` but for ``without``, then ``added``."""
    return StructType([f for f in df.schema.fields if f.name not in without] + list(added))
