"""Settings of the session that steps need."""

from __future__ import annotations

from pyspark.sql import DataFrame


def task_count(df: DataFrame) -> int:
    """Number of shuffle partitions of the session, for steps that generate rows from few inputs."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rows_in(df: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``keys`` occur in ``cells``. The optimizer picks the join by size."""
    return df.join(cells.select(*keys).distinct(), keys, "left_semi")
