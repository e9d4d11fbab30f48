"""Streaming selection replay with state per element (``transformWithState``).

State of a tab, in RocksDB: a head (the last clear, the pending timer, whether anything
is folded), a folded summary of each element (number of toggles after that clear and the
last of them), and the toggles that are newer than the watermark, one entry each. A
micro-batch reads and writes only the elements that it toggles, so a tab with many
selections costs no more than its news, and reads no element of a tab without a head; a
clear alone walks over the tab's elements. One event-time timer a tab, for its oldest new
toggle, folds what the watermark has passed and sets itself for the next: no clear that is
still accepted can come before a folded toggle, since events behind the watermark are dropped.

A micro-batch emits the elements it changed; ``current`` puts the list of each tab
together from the last change of every element. It equals the batch replay of all
events that were not late, in any order of arrival. Keys are ``(ts in microseconds,
event_id)``.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weblens.session import ensure_checkpoint_dir
from weblens.sources.log import log_from_events

CHANGES = "tab long, element long, toggles long, last_ts long, last_id long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Selections(StatefulProcessor):
    """Toggles and clears of one tab."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "ts long, id long, timer long, folds boolean")
        self.folded = handle.getMapState("folded", "element long", "n long, ts long, id long")
        self.fresh = handle.getMapState("fresh", "element long", "keys string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        wm = timerValues.getCurrentWatermarkInMs() * 1000
        toggles: dict[int, set] = {}
        clear = None
        for typ, el, ts, eid in ((r["type"], r["element"], r["tsu"], r["event_id"]) for r in rows):
            k = (int(ts), int(eid))
            if k[0] < wm:
                continue
            if typ == "clear":
                clear = k if clear is None or k > clear else clear
            elif el is not None:
                toggles.setdefault(int(el), set()).add(k)
        if not toggles and clear is None:
            return
        head = self.head.get()
        before, timer, folds = self._head(head)
        news = clear is not None and (before is None or clear > before)
        clear = clear if news else before
        folded: dict[int, tuple] = {}
        fresh: dict[int, list] = {}
        if head is not None and news:
            folded, fresh = self._all_folded() if folds else {}, self._all_fresh()
        elif head is not None:
            folded = {el: v for el in toggles if (v := self._folded(el))} if folds else {}
            fresh = {el: v for el in toggles if (v := self._fresh(el))}
        changed = sorted({*toggles, *folded, *fresh})
        gone = [el for el in changed if el in folded and clear is not None and folded[el][1] <= clear]
        kept = {el: sorted(k for k in {*fresh.get(el, []), *toggles.get(el, [])} if clear is None or k > clear) for el in changed}
        if news and len(gone) == len(folded):
            if folds:
                self.folded.clear()
            folds = False
        else:
            for el in gone:
                self.folded.removeKey((el,))
        if news and fresh and not any(kept.values()):
            self.fresh.clear()
        else:
            for el in changed:
                self._set_fresh(el, kept[el], fresh.get(el, []))
        first = min((k[0] // 1000 + 1 for el in toggles for k in kept[el][:1]), default=None)
        if first is not None and (timer is None or first < timer):
            self.handle.registerTimer(first)
            timer = first
        self._set_head(head, clear, timer, folds)
        gone = set(gone)
        for el in changed:
            n, last = folded[el] if el in folded and el not in gone else (0, None)
            top = max([k for k in (last, kept[el][-1] if kept[el] else None) if k is not None], default=(None, None))
            yield Row(tab=int(key[0]), element=el, toggles=n + len(kept[el]), last_ts=top[0], last_id=top[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Fold the toggles that the watermark has passed."""
        ms = timerValues.getCurrentWatermarkInMs()
        head, fresh = self.head.get(), self._all_fresh()
        clear, timer, folds = self._head(head)
        kept = {el: [k for k in keys if k[0] >= ms * 1000] for el, keys in fresh.items()}
        known = folds
        for el, keys in fresh.items():
            old = keys[:len(keys) - len(kept[el])]
            if old:
                n, last = (known and self._folded(el)) or (0, None)
                self.folded.updateValue((el,), (n + len(old), *max([*old, *([last] if last else [])])))
                folds = True
        if fresh and not any(kept.values()):
            self.fresh.clear()
        else:
            for el, keys in kept.items():
                self._set_fresh(el, keys, fresh[el])
        timer = timer if timer is not None and timer > ms else None
        first = min((keys[0][0] // 1000 + 1 for keys in kept.values() if keys), default=None)
        if first is not None and (timer is None or first < timer):
            self.handle.registerTimer(first)
            timer = first
        self._set_head(head, clear, timer, folds)
        return iter(())

    @staticmethod
    def _head(v) -> tuple:
        """Last clear, pending timer and whether anything is folded."""
        return (None, None, False) if v is None else (None if v[0] is None else (int(v[0]), int(v[1])), v[2], bool(v[3]))

    def _set_head(self, old, clear, timer, folds: bool) -> None:
        new = (*(clear or (None, None)), timer, folds)
        if old is None or tuple(old) != new:
            self.head.update(new)

    @staticmethod
    def _summary(v) -> tuple[int, tuple[int, int]]:
        return int(v[0]), (int(v[1]), int(v[2]))

    @staticmethod
    def _keys(v) -> list[tuple[int, int]]:
        return [tuple(map(int, k.split(":"))) for k in v[0].split(" ")]

    def _folded(self, el: int) -> tuple[int, tuple[int, int]] | None:
        v = self.folded.getValue((el,))
        return None if v is None else self._summary(v)

    def _fresh(self, el: int) -> list[tuple[int, int]]:
        v = self.fresh.getValue((el,))
        return [] if v is None else self._keys(v)

    def _all_folded(self) -> dict[int, tuple]:
        return {int(k[0]): self._summary(v) for k, v in self.folded.iterator()}

    def _all_fresh(self) -> dict[int, list]:
        return {int(k[0]): self._keys(v) for k, v in self.fresh.iterator()}

    def _set_fresh(self, el: int, keys: list[tuple[int, int]], old: list[tuple[int, int]]) -> None:
        if keys == old:
            return
        if keys:
            self.fresh.updateValue((el,), (" ".join(f"{a}:{b}" for a, b in keys),))
        else:
            self.fresh.removeKey((el,))


def changes(events_stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Streaming DataFrame of the elements that each micro-batch changed."""
    spark = events_stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # the worker that sets the processor up runs beside the driver and does not see
    # shipped packages: the class travels with its code
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    log = log_from_events(events_stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark))
    log = log.filter(F.col("type").isin("toggle", "clear")).select("tab", "ts", "event_id", "type", "element", F.unix_micros("ts").alias("tsu"))
    return log.groupBy("tab").transformWithState(Selections(), CHANGES, "Update", "eventTime")


def current(changed: DataFrame) -> DataFrame:
    """``(tab, element, toggles, sel_order)`` from changes with their ``batch_id``."""
    last = changed.groupBy("tab", "element").agg(F.max_by(F.struct("toggles", "last_ts", "last_id"), "batch_id").alias("c"))
    alive = last.filter("c.toggles % 2 = 1").select("tab", "element", "c.*")
    order = F.row_number().over(Window.partitionBy("tab").orderBy("last_ts", "last_id"))
    return alive.select("tab", "element", "toggles", order.cast("long").alias("sel_order"))


def run_selection_state(spark: SparkSession, source_dir: str, glob: str = "events.parquet", max_files: int = 1, watermark: str = "1 hour") -> DataFrame:
    """Replays the events in ``source_dir`` as a stream (availableNow): the selection
    list of each tab after the last micro-batch."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/selection_state/{uuid.uuid4().hex[:12]}"
    schema = spark.read.option("pathGlobFilter", glob).parquet(source_dir).schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    # an empty first folder: a stream without any batch then reads as no rows
    spark.createDataFrame([], CHANGES).write.parquet(f"{base}/out/batch_id=-1")
    try:
        q = (changes(src, watermark).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return current(spark.read.schema(f"{CHANGES}, batch_id long").parquet(f"{base}/out"))
