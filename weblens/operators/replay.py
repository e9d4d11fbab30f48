"""Batch replay of the interaction log: surviving selections, settings
(last writer wins over defaults) and inspector state per tab.

Skew: a single tab may hold a large share of all events. Its events are spread
over ``SALTS`` tasks by their id; the tab's (and its elements') last resets, one
row each, are repeated for every salt. What is left after the resets is counted
per (tab, element, salt) before the salts meet, so no task sees all events of a
tab, and no window runs over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblens.functions import lists as L

ORDER = ["ts", "event_id"]
SALTS = 16


def _key():
    return F.struct(*[F.col(c) for c in ORDER])


def selection_replay(log: DataFrame) -> DataFrame:
    """Selections alive at the end of the log: an element is selected iff it
    was toggled an odd number of times after its last reset, where a reset is
    the tab's last ``clear`` or ``close`` (state dropped) or the element's last
    ``remove``; selection order is the order of those last toggles.
    ``(tab, element, toggles, last_ts, sel_order)``."""
    t = F.col("type")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    last_clear = log.filter(t.isin("clear", "close")).groupBy("tab").agg(F.max(_key()).alias("lc")).select("tab", "lc", salts)
    last_remove = log.filter((t == "remove") & F.col("element").isNotNull()).groupBy("tab", "element").agg(
        F.max(_key()).alias("lr")).select("tab", "element", "lr", salts)
    tg = log.filter((t == "toggle") & F.col("element").isNotNull()).withColumn(
        "salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int"))
    tg = tg.join(last_clear, ["tab", "salt"], "left").filter(F.col("lc").isNull() | (_key() > F.col("lc")))
    tg = tg.join(last_remove, ["tab", "element", "salt"], "left").filter(F.col("lr").isNull() | (_key() > F.col("lr")))
    part = tg.groupBy("tab", "element", "salt").agg(F.count("*").alias("n"), F.max(_key()).alias("last"))
    g = part.groupBy("tab", "element").agg(F.sum("n").alias("toggles"), F.max("last").alias("last"))
    g = g.filter(F.col("toggles") % 2 == 1)
    w = Window.partitionBy("tab").orderBy("last")
    return g.select("tab", "element", "toggles", F.col("last.ts").alias("last_ts"),
                    F.row_number().over(w).cast("long").alias("sel_order"))


def settings_replay(log: DataFrame) -> DataFrame:
    """Last value per (tab, key): ``(tab, key, value, ts)``."""
    s = log.filter(F.col("type") == "set")
    return s.groupBy("tab", "key").agg(F.max_by(F.struct("value", "ts"), _key()).alias("v")).select(
        "tab", "key", F.col("v.value").alias("value"), F.col("v.ts").alias("ts"))


def options(log: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The effective settings of each tab as typed columns, one row a tab: its own
    last values over per-site ``overrides`` (tab, key, value) over the defaults.
    ``opt_depth`` is null for the whole subtree."""
    s = settings_replay(log).select("tab", "key", "value", F.lit(1).alias("near"))
    if overrides is not None:
        s = s.unionByName(overrides.select("tab", "key", "value", F.lit(0).alias("near")))
    s = log.select("tab").distinct().join(s, "tab", "left")

    def value(key):
        mine = F.col("key") == key
        return F.coalesce(F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("near"))), F.lit(dict(DEFAULT_ROWS)[key]))

    cols = {"opt_format": value("format"), "opt_depth": F.try_to_number(F.nullif(value("depth"), F.lit("Infinity")), F.lit("999")).cast("int")}
    for key in ("includeContext", "includeCSS", "stripNoise", "keepTestIds", "includeHidden", "promptWrapper"):
        cols[OPTION_NAMES[key]] = value(key) == "true"
    for key in ("truncationThreshold", "maxTokenWarning"):
        cols[OPTION_NAMES[key]] = value(key).cast("int")
    return s.groupBy("tab").agg(*[c.alias(n) for n, c in cols.items()])


def _default_str(v) -> str:
    if v is None:
        return "Infinity"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


DEFAULT_ROWS = [(k, _default_str(v)) for k, v in L.DEFAULTS.items()]
OPTION_NAMES = {
    "includeContext": "opt_include_context", "includeCSS": "opt_include_css", "stripNoise": "opt_strip_noise", "keepTestIds": "opt_keep_test_ids",
    "includeHidden": "opt_include_hidden", "promptWrapper": "opt_prompt_wrapper", "truncationThreshold": "opt_truncation", "maxTokenWarning": "opt_max_tokens",
}


def effective_settings(log: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Defaults overlaid by each tab's replayed values (and optional per-site
    overrides, applied first): ``(tab, key, value, source)``."""
    tabs = log.select("tab").distinct()
    d = tabs.select("tab", F.inline(F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(v).alias("default")) for k, v in DEFAULT_ROWS])))
    s = settings_replay(log).select("tab", "key", F.col("value").alias("stored"))
    j = d.join(s, ["tab", "key"], "left")
    if overrides is not None:
        j = j.join(overrides.select("tab", "key", F.col("value").alias("site")), ["tab", "key"], "left")
    else:
        j = j.withColumn("site", F.lit(None).cast("string"))
    return j.select("tab", "key", F.coalesce("stored", "site", "default").alias("value"),
                    F.when(F.col("stored").isNotNull(), "stored").when(F.col("site").isNotNull(), "site")
                    .otherwise("default").alias("source"))


def inspector_state(log: DataFrame) -> DataFrame:
    """Inspector on/off per tab after replaying its toggles (starts off)."""
    return log.filter(F.col("type") == "inspector").groupBy("tab").agg(
        F.count("*").alias("toggles")).select("tab", "toggles", (F.col("toggles") % 2 == 1).alias("enabled"))
