"""First rows per group, safe for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group, optionally with their 1-based ``rank``.

    Spark keeps only ``n`` rows per group and task before the shuffle. Above its
    threshold for that it would sort a hot group whole in one task, so a salted pass
    first takes the first ``n`` of each of many slices, which contain the answer.
    """
    if n <= 0:
        return df.withColumn(rank, F.lit(0)).limit(0) if rank else df.limit(0)
    spark = df.sparkSession
    if n > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        slices = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        hashable = [name for name, kind in df.dtypes if "map<" not in kind]
        salt = F.pmod(F.xxhash64(*hashable), F.lit(slices))
        spread = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_n", F.row_number().over(spread))
            .where(F.col("_n") <= n)
            .drop("_salt", "_n")
        )
    ranked = df.withColumn(
        rank or "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).where(F.col(rank or "_n") <= n)
    return ranked if rank else ranked.drop("_n")
