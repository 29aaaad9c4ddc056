"""Joins by a key that a few values may dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that go by broadcast: a fixed number of rows, whatever the input.
FREQUENT = 1000


def frequent_join(big: DataFrame, small: DataFrame, on: list[str], weight: str) -> DataFrame:
    """big JOIN small, small unique on the keys `on`; weight: about how many rows of big have the key.

    The FREQUENT keys of most weight go by broadcast, the rest by a shuffle in which no key is frequent."""
    hot = small.orderBy(F.desc(weight), *on).limit(FREQUENT)
    keys = hot.select(*on)
    rest = big.join(F.broadcast(keys), on, "left_anti").join(small.join(F.broadcast(keys), on, "left_anti"), on)
    return big.join(F.broadcast(hot), on).unionByName(rest)
