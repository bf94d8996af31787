"""Eviction policies as filters over (key, time, excluded) columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..sources.store import scratch


@dataclass(frozen=True)
class LeastRecentlyUsed:
    """When the evictable rows reach ``limit``, the ones used longest ago go: down to ``limit - remove``."""

    limit: int
    remove: int = 100

    def survivors(self, rows: DataFrame, used: str, key: str, excluded: str | None = None) -> DataFrame:
        """The rows that stay; ``used`` is the time of last use, ties go by key.

        The cut is found in a range partitioning by (time, key): the counts of its parts, which are as many as shuffle partitions, say
        in which one the last row to stay lies, and only that part is sorted on.
        """
        stays = F.coalesce(F.col(excluded), F.lit(False)) if excluded else F.lit(False)
        open_rows = rows.filter(~stays)
        count = open_rows.count()
        if count < self.limit:
            return rows
        keep = max(0, self.limit - self.remove)
        if keep == 0:
            return rows.filter(stays)
        path = scratch(rows.sparkSession)
        parts = open_rows.select(F.col(used).alias("u"), F.col(key).alias("k")).repartitionByRange(F.col("u").desc_nulls_last(), F.col("k").desc_nulls_last())
        parts.withColumn("p", F.spark_partition_id()).write.parquet(path)
        parts, before = rows.sparkSession.read.parquet(path), 0
        for p, n in sorted(parts.groupBy("p").count().collect()):
            if before + n >= keep:
                break
            before += n
        last = parts.filter(F.col("p") == p).orderBy(F.col("u").desc_nulls_last(), F.col("k").desc_nulls_last()).offset(keep - 1 - before).limit(1).select("u", "k").first()
        newer = (F.col(used) > F.lit(last[0])) | ((F.col(used) == F.lit(last[0])) & (F.col(key) >= F.lit(last[1])))
        if last[0] is None:
            newer = F.col(used).isNotNull() | (F.col(key) >= F.lit(last[1]))
        return rows.filter(stays | F.coalesce(newer, F.lit(False)))


@dataclass(frozen=True)
class TimeToLive:
    """Rows go once they were inserted longer than ``seconds`` ago; use doesn't renew them."""

    seconds: float

    def survivors(self, rows: DataFrame, inserted: str, now: dt.datetime, excluded: str | None = None) -> DataFrame:
        stays = F.coalesce(F.col(excluded), F.lit(False)) if excluded else F.lit(False)
        edge = F.lit(now - dt.timedelta(seconds=self.seconds)).cast("timestamp")
        return rows.filter(stays | (F.col(inserted) > edge))


def check_exclusive(policy, domain, fully_loaded: bool) -> None:
    """Evicting rows and vouching for their completeness don't go together."""
    if policy is not None and (domain is not None or fully_loaded):
        raise EngineError("a collection with an eviction policy cannot declare its data complete")
