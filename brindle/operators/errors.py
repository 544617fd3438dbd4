"""Chains of causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def root_codes(errors: DataFrame, found: Column, hops: int = 8, key: str = "id", cause: str = "cause") -> DataFrame:
    """(key, code): of each error the first code along its chain of causes, itself first, at most `hops` errors.

    found: an error's own code, or null if it is none of the looked for.  Pointer chasing: every round knows the first code among
    twice as many errors and the error after them, so 8 hops are 3 joins, whatever the length of the chains; a cycle just
    ends with its hops.  An error that is in the table twice, or a cause that is not in it, ends a chain only where no
    row has its key: of rows with one key the smallest (code, cause) counts.
    """
    if hops < 1 or hops & (hops - 1):
        raise ValueError("hops is a power of two")
    now = errors.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.struct(found.alias("code"), F.col(cause).alias("next"))).alias("s")).select("id", "s.*")
    while hops > 1:
        then = now.select(F.col("id").alias("next"), F.col("code").alias("_code"), F.col("next").alias("_next"))
        # chains that have their code go no further, so a cause shared by many errors is asked for by those without one alone
        asks = F.when(F.col("code").isNull(), F.col("next"))
        now = now.withColumn("next", asks).join(then, "next", "left").select("id", F.coalesce("code", "_code").alias("code"), F.col("_next").alias("next"))
        hops //= 2
    return now.select(F.col("id").alias(key), "code")
