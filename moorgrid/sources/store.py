"""Key-value store of JSON texts as a table (key, value)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(store: DataFrame, key: str, default=None):
    """The stored value; a missing or empty one gives the default."""
    row = store.where(F.col("key") == key).select("value").first()
    return (json.loads(row[0]) if row and row[0] else None) or default


def put(store: DataFrame, key: str, value) -> DataFrame:
    """The next version of the store."""
    new = store.sparkSession.createDataFrame([(key, json.dumps(value))], "key STRING, value STRING")
    return store.where(F.col("key") != key).select("key", "value").unionByName(new)


def get_user(store: DataFrame, identity: str, default=None):
    """What a user has stored."""
    return get(store, f"user:{identity}", default)


def put_user(store: DataFrame, identity: str, value) -> DataFrame:
    """The next version of the store with the user's value."""
    return put(store, f"user:{identity}", value)
