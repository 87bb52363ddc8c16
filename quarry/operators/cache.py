"""A table of answers by hash of namespace, query, parameters and index snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import cache_key


def lookup(queries: DataFrame, cache: DataFrame, namespace: str, params: dict, snapshot: str = "") -> DataFrame:
    """queries (query, ...) with cache_key, hit, sources; a stored empty list is a hit."""
    keyed = queries.withColumn("cache_key", cache_key(namespace, F.col("query"), params, snapshot))
    return keyed.join(cache.select("cache_key", "sources", F.lit(True).alias("hit")), "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(looked_up: DataFrame) -> DataFrame:
    return looked_up.filter(~F.col("hit")).drop("sources", "hit")
