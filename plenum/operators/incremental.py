"""Re-import by meeting: what changed, replacing it, and dimensions that only grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(incoming: DataFrame, stored: DataFrame, keys: list[str], token: str = "scraped_at", rebuild: bool = False) -> DataFrame:
    """Incoming rows whose key is new or whose token differs as text; all of them on a rebuild."""
    if rebuild:
        return incoming
    old = stored.select(*keys, F.col(token).alias("_old"), F.lit(True).alias("_known"))
    return incoming.join(old, keys, "left").where(F.col("_known").isNull() | ~F.col(token).eqNullSafe(F.col("_old"))).drop("_old", "_known")


def replace(rows: DataFrame, path: str, partition: list[str]) -> None:
    """Writes whole meetings; only the partitions in `rows` are replaced."""
    rows.repartition(*partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def first_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: the first by `order`."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")


def new_keys(incoming: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Keys not yet in a dimension, with default attributes; rows that are there keep their edited values."""
    fresh = incoming.select(key).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")
    for name, value in (defaults or {}).items():
        fresh = fresh.withColumn(name, value)
    return fresh


def with_defaults(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds the columns an older table lacks."""
    for name, value in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def undo_fills(rows: DataFrame, value: str, source: str, base: str) -> DataFrame:
    """Values that came from elsewhere than `base` taken back, so that fills can be derived afresh."""
    own = F.col(source).eqNullSafe(base)
    return rows.withColumn(value, F.when(own, F.col(value))).withColumn(source, F.when(own, F.col(source)))
