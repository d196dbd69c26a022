"""Per-key aggregates where a few keys hold most rows: multi-level tree aggregation.

Level 0 combines each fixed-size input chunk (a scan task of ``spark.sql.files.maxPartitionBytes``) locally: one state
per key and chunk. Further rounds merge the states of ``fan_in`` neighbouring chunks at a time, so the number of rounds is the logarithm of
the number of chunks, and no reducer receives more than ``fan_in`` states of a key in any round, however many chunks there are.

Defined cases: rows with a null key part are left out; null values count as rows but not as distinct values; repeated
rows count each time; empty input gives no rows; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounds(states: int, fan_in: int) -> list[int]:
    """States left per key after each merge round, down to one."""
    if fan_in < 2:
        raise ValueError("fan_in is at least 2")
    out = []
    while states > 1:
        states = -(-states // fan_in)
        out.append(states)
    return out


def _merge_rounds(part: DataFrame, keys: list[str], sums: list[str], states: int, fan_in: int) -> DataFrame:
    """``part``: keys, lane in [0, states), sums. The lane of a round is the one before, divided by ``fan_in``."""
    for left in rounds(states, fan_in):
        lane = [F.expr(f"lane div {fan_in}").alias("lane")] if left > 1 else []
        part = part.groupBy(*keys, *lane).agg(*[F.sum(s).alias(s) for s in sums])
    return part.drop("lane")


def chunks(df: DataFrame) -> int:
    """Input chunks of a scan, or of the shuffle that ``df`` is read from; planning only, nothing runs."""
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, df.rdd.getNumPartitions())


def tree_count(df: DataFrame, keys: list[str], count_as: str = "n_rows", fan_in: int = 16) -> DataFrame:
    """Rows per key. Any assignment of rows to chunks gives the same result."""
    src = df.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys)
    n = chunks(src)
    if n == 1:
        return src.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_as))
    part = src.groupBy(*keys, F.pmod(F.spark_partition_id(), F.lit(n)).alias("lane")).agg(F.count(F.lit(1)).alias(count_as))
    return _merge_rounds(part, keys, [count_as], n, fan_in)


def tree_count_distinct(df: DataFrame, keys: list[str], value: str, count_as: str = "n_rows", distinct_as: str = "n_distinct", fan_in: int = 16) -> DataFrame:
    """Rows and exact distinct values per key.

    A chunk first combines its equal (key, value) rows. Distinct values then meet by (key, value), which no hot key can
    overload; as each value lives in one of those partitions, the partitions' distinct counts add up, and they are
    merged like chunks."""
    src = df.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, F.col(value).alias("__v"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = src.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias(count_as))
    lane = F.pmod(F.spark_partition_id(), F.lit(n)).alias("lane")
    part = once.groupBy(*keys, lane).agg(F.sum(count_as).alias(count_as), F.count("__v").alias(distinct_as))
    return _merge_rounds(part, keys, [count_as, distinct_as], n, fan_in)


def heavy_keys(counted: DataFrame, count_col: str, share: float) -> DataFrame:
    """Keys holding at least ``share`` of all counted rows; the total is one scalar, not a join."""
    per_cent = round(share * 10_000)
    total = counted.agg(F.sum(count_col)).scalar()
    return counted.where(F.col(count_col) * 10_000 >= total * per_cent)
