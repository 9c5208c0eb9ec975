"""Writers of stored tables: whole, by key, or by partition; each write is a new folder or a whole partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ledgerloom.operators.monitor import upsert


def replace_by_key(stored: DataFrame | None, fresh: DataFrame, keys: Sequence[str], path: str) -> None:
    """Write the stored rows with the fresh ones in place of those with the same key, to a path that isn't read here."""
    merged = upsert(stored if stored is not None else fresh.limit(0), fresh, keys)
    merged.write.mode("errorifexists").parquet(path)


def append_new(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], path: str) -> None:
    """Append the fresh rows whose key isn't stored yet."""
    fresh.join(stored.select(*keys).distinct(), list(keys), "left_anti").select(*fresh.columns).write.mode("append").parquet(path)


def replace_partitions(fresh: DataFrame, by: Sequence[str], path: str) -> None:
    """Replace the partitions that ``fresh`` has rows of, and leave the others."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
