"""Joins that survive keys which hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this part of a task's even share of the rows on.
HOT_PART = 4


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], times: str, total: int, tasks: int) -> DataFrame:
    """``rows`` inner-joined with ``facts`` on ``keys``.

    ``facts`` (written, as it is read more than once) says in ``times`` how many of
    the ``total`` rows bear each of its keys; no key is null. A key with more than ``total / (HOT_PART * tasks)``
    rows stays out of the exchange: its facts, of which there are fewer than
    ``HOT_PART * tasks`` whatever the input, go to every task instead and its rows
    stay where they are. All other keys meet by an ordinary join."""
    share = total / (HOT_PART * tasks)
    hot = facts.filter(F.col(times) > share)
    cold = facts.filter(F.col(times) <= share)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rest.join(cold, keys).unionByName(rows.join(F.broadcast(hot), keys))
