"""Train/test split and class balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_SHARE = 0.7
# A failed row stands for itself and ten more copies.
MINORITY_WEIGHT = 11


def train_flag(keys: list[str], seed: str = "split-1", share: float = TRAIN_SHARE) -> Column:
    """True for about ``share`` of all keys, always the same ones.

    The split hangs on the row's key, not on partitions or row order, so a lost and
    recomputed partition lands on the same side.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    return F.substring(digest, 1, 8) < format(round(share * 16**8), "08x")


def split_train_test(df: DataFrame, keys: list[str], **options) -> tuple[DataFrame, DataFrame]:
    flag = train_flag(keys, **options)
    return df.where(flag), df.where(~flag)


def minority_weight() -> Column:
    return F.when(F.col("label") == 1.0, F.lit(MINORITY_WEIGHT)).otherwise(F.lit(1))


def oversample_minority(train: DataFrame) -> DataFrame:
    """Every failed row eleven times, every other row once; no shuffle, no union."""
    copies = F.explode(F.sequence(F.lit(1), minority_weight()))
    return train.withColumn("copy", copies).drop("copy")


def weigh_minority(train: DataFrame) -> DataFrame:
    """Same balance as ``oversample_minority`` as a weight column, without copies."""
    return train.withColumn("weight", minority_weight().cast("double"))
