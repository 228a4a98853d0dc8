"""Constant lookups as literal maps (folded at planning time, no join)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """``mapping[key]``, or ``default`` when the key is NULL or unknown."""
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = literal[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def first_match(conditions: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first condition that is true."""
    head, *tail = conditions
    chain = reduce(lambda acc, pair: acc.when(*pair), tail, F.when(*head))
    return chain.otherwise(default)
