"""Tables between steps, and columns that results replace."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftbase.sources.scratch import keep, scratch_dir

__all__ = ["keep", "scratch_dir", "without"]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in either case: results take the place of such columns."""
    gone = {x.lower() for x in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in gone])
