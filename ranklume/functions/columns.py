"""Names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(name: str, *frames: DataFrame) -> str:
    """The name, or a longer one that no column of the frames has in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
