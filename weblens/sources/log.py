"""Interaction log derived from the driver's ``events`` table.

Mapping (fixed for this repo): ``tab = user_id``; the element is ``k`` from
``props`` (``{"k": n}``), the n-th element (0-based, document order) of page
``page_id = tab``; ``click`` toggles a selection, ``error`` clears all
selections, ``signup`` toggles the inspector, ``purchase`` sets ``format`` to
``FORMATS[k mod 6]``, ``view`` sets the option number ``k mod 7`` of ``OPTION_VALUES`` to
its value number ``k div 7``, counted round. Events are ordered by ``(ts, event_id)``. The replay also understands ``remove`` (drop one
selection) and ``close`` (tab closed: state dropped) rows; the driver's
events have no source for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions import lists as L

EVENT_TYPES = {"click": "toggle", "error": "clear", "signup": "inspector", "purchase": "set",
               "view": "set"}

#: Options that the log's settings events set, and the values they take in turn.
OPTION_VALUES = {
    "depth": ["0", "1", "2", "Infinity"],
    "includeContext": ["false", "true"],
    "includeCSS": ["false", "true"],
    "stripNoise": ["false", "true"],
    "keepTestIds": ["false", "true"],
    "truncationThreshold": ["4", "12", "240"],
    "includeHidden": ["true", "false"],
}


def log_from_events(events: DataFrame) -> DataFrame:
    """``(tab, ts, event_id, type, element, key, value)``; key and value of settings."""
    t = F.col("event_type")
    typ = F.lit("ignore")
    for src, dst in reversed(list(EVENT_TYPES.items())):
        typ = F.when(t == src, F.lit(dst)).otherwise(typ)
    k = F.get_json_object("props", "$.k").cast("long")
    n = F.pmod(k, F.lit(len(OPTION_VALUES)))
    key, value = F.when(t == "purchase", F.lit("format")), F.when(t == "purchase", format_of(k))
    for i, (name, values) in enumerate(OPTION_VALUES.items()):
        mine = (t == "view") & (n == i)
        turn = F.pmod(F.floor(k / len(OPTION_VALUES)), F.lit(len(values))) + 1
        key, value = key.when(mine, name), value.when(mine, F.element_at(F.array(*[F.lit(v) for v in values]), turn.cast("int")))
    return events.select(
        F.col("user_id").alias("tab"), "ts", "event_id", typ.alias("type"), k.alias("element"), key.alias("key"), value.alias("value"))


def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def format_of(k) -> F.Column:
    k = F.col(k) if isinstance(k, str) else k
    arr = F.array(*[F.lit(f) for f in L.FORMATS])
    return F.element_at(arr, (F.pmod(k, F.lit(len(L.FORMATS))) + 1).cast("int"))
