"""Streaming selection replay with per-tab state (``applyInPandasWithState``).

Events may arrive out of order. Per tab the state keeps the latest clear key
and, per element, the toggles after it: toggles older than the watermark are
folded into a (count, max key) summary, and newer toggles stay as individual
keys. An event older than the watermark of its micro-batch is late: it is
dropped here, explicitly, and counted in the state (a clear that is taken is
then never older than a folded toggle, so it removes all folded toggles or
none). The selection list after every micro-batch equals the batch replay of
all events that were not late, whatever their order; ``late`` in the output is
the tab's number of dropped events. Keys are ``(ts in microseconds, event_id)``.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from weblens.session import ensure_checkpoint_dir, ship
from weblens.sources.log import log_from_events

OUT_SCHEMA = "tab long, element long, toggles long, sel_order long, late long"
STATE_SCHEMA = "state string"


def _apply(key, pdfs, state):
    (tab,) = key
    st = json.loads(state.get[0]) if state.exists else {"clear": None, "els": {}, "late": 0}
    wm, late = state.getCurrentWatermarkMs() * 1000, st["late"]
    clear = tuple(st["clear"]) if st["clear"] else None
    els = {int(k): v for k, v in st["els"].items()}  # element -> {"n": int, "max": [..]|None, "keys": [[..]]}
    evs = []
    for pdf in pdfs:
        fresh = pdf[pdf["tsu"] >= wm]
        late += len(pdf) - len(fresh)
        evs.extend(zip(fresh["type"], fresh["element"], fresh["tsu"], fresh["event_id"]))
    for typ, _el, tsu, eid in evs:
        if typ == "clear":
            k = (int(tsu), int(eid))
            if clear is None or k > clear:
                clear = k
    for typ, el, tsu, eid in evs:
        if typ == "toggle" and el is not None and not pd.isna(el):
            k = (int(tsu), int(eid))
            if clear is None or k > clear:
                e = els.setdefault(int(el), {"n": 0, "max": None, "keys": []})
                e["keys"].append(list(k))
    out_rows = []
    new_els = {}
    for el, e in els.items():
        # drop everything not newer than the latest clear
        if clear is not None and e["max"] is not None and tuple(e["max"]) <= clear:
            e["n"], e["max"] = 0, None
        keys = [tuple(k) for k in e["keys"] if clear is None or tuple(k) > clear]
        old = [k for k in keys if k[0] < wm]
        keep = [k for k in keys if k[0] >= wm]
        if old:
            e["n"] += len(old)
            m = max(old)
            e["max"] = list(m if e["max"] is None or m > tuple(e["max"]) else e["max"])
        e["keys"] = [list(k) for k in keep]
        total = e["n"] + len(keep)
        if total == 0:
            continue
        new_els[el] = e
        last = max(([tuple(e["max"])] if e["max"] else []) + keep)
        if total % 2 == 1:
            out_rows.append((el, total, last))
    state.update((json.dumps({"clear": list(clear) if clear else None,
                              "els": {str(k): v for k, v in new_els.items()}, "late": late}),))
    out_rows.sort(key=lambda r: r[2])
    if not out_rows:
        # marker row: the tab now has no selection (so an older list is not reused)
        yield pd.DataFrame({"tab": [int(tab)], "element": [None], "toggles": [None], "sel_order": [None], "late": [late]},
                           columns=["tab", "element", "toggles", "sel_order", "late"]).astype("Int64")
        return
    yield pd.DataFrame({
        "tab": [int(tab)] * len(out_rows),
        "element": [r[0] for r in out_rows],
        "toggles": [r[1] for r in out_rows],
        "sel_order": list(range(1, len(out_rows) + 1)),
        "late": [late] * len(out_rows),
    }, columns=["tab", "element", "toggles", "sel_order", "late"]).astype("int64")


def replay_stream(events_stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Streaming DataFrame of the current selections per tab (update mode:
    every micro-batch re-emits the full list of each touched tab)."""
    ev = events_stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    log = log_from_events(ev).filter(
        F.col("type").isin("toggle", "clear"))
    log = log.withColumn("tsu", F.unix_micros("ts"))
    ship(events_stream.sparkSession)
    return log.groupBy("tab").applyInPandasWithState(
        _apply, OUT_SCHEMA, STATE_SCHEMA, "Update", GroupStateTimeout.NoTimeout)


def run_selection_stream(spark: SparkSession, source_dir: str, glob: str = "events.parquet",
                         max_files: int = 1, watermark: str = "1 hour") -> DataFrame:
    """Replays ``events`` as a stream (availableNow) and returns, per tab, the
    selection list emitted by the last micro-batch that touched it."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex[:12]
    sink = f"{base}/selection_stream/{run}/out"
    schema = spark.read.option("pathGlobFilter", glob).parquet(source_dir).schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
           .parquet(source_dir))

    def write(batch: DataFrame, batch_id: int) -> None:
        # idempotent: a retried batch overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    # an empty first folder: a stream without any batch then reads as no rows
    spark.createDataFrame([], OUT_SCHEMA).write.parquet(f"{sink}/batch_id=-1")
    q = (replay_stream(src, watermark).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{base}/selection_stream/{run}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.schema(f"{OUT_SCHEMA}, batch_id long").parquet(sink)
    latest = out.groupBy("tab").agg(F.max("batch_id").alias("batch_id"))
    return out.join(latest, ["tab", "batch_id"]).filter(F.col("element").isNotNull()).select(
        "tab", "element", "toggles", "sel_order", "late")
