"""Where callers bring their own tokenizer, client or transport.

What is brought runs in the executors, in Arrow batches.  A factory is called
once a task, so connections and models are opened where they are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(c: Column, tokenizer: Callable[[str], list]) -> Column:
    """The number of tokens that ``tokenizer`` makes of each text; null for null."""

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else len(tokenizer(x)) for x in texts], dtype="Int64")

    return F.pandas_udf(count, "long")(c)


def with_client(df: DataFrame, factory: Callable[[], object], call: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``call`` makes of each batch with the client that ``factory`` gives to the task; clients that can be closed are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        try:
            for batch in batches:
                yield call(client, batch)
        finally:
            getattr(client, "close", lambda: None)()

    return df.mapInPandas(run, schema)


def resolved(requests: DataFrame, cache: DataFrame, key: str, value: str, factory: Callable[[], object], call: Callable[[object, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """key, value, origin of all requests: from the cache where it has the key, else by one call for each distinct key."""
    hits = requests.join(cache.select(key, value), key).withColumn("origin", F.lit("cache"))
    misses = requests.join(cache.select(key), key, "left_anti")
    kinds = {f.name: f.dataType.simpleString() for f in (*requests.schema.fields, *cache.schema.fields)}
    called = with_client(misses.select(key).distinct(), factory, call, f"`{key}` {kinds[key]}, `{value}` {kinds[value]}")
    return hits.select(key, value, "origin").unionByName(misses.join(called, key).select(key, value, F.lit("called").alias("origin")))
