"""Stream replay equals batch replay, for out-of-order and in-order arrival."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from weblens.operators.replay import selection_replay
from weblens.sources.log import log_from_events, read_log
from weblens.streaming.selection_stream import run_selection_stream


def _rows(df):
    return sorted(tuple(r) for r in df.select("tab", "element", "toggles", "sel_order").collect())


def _split(spark, parts_col, n):
    d = tempfile.mkdtemp(prefix="weblens-ev-")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for i in range(n):
        ev.filter(parts_col == i).coalesce(1).write.parquet(f"{d}/part{i}")
    # one directory per chunk -> move files into one flat directory in chunk order
    flat = tempfile.mkdtemp(prefix="weblens-evflat-")
    import glob
    import shutil
    import time
    for i in range(n):
        for f in glob.glob(f"{d}/part{i}/*.parquet"):
            shutil.copy(f, f"{flat}/chunk{i:03d}.parquet")
            time.sleep(0.05)
    return flat


def test_out_of_order(spark):
    batch = _rows(selection_replay(read_log(spark, SF_SMALL)))
    flat = _split(spark, F.col("event_id") % 3, 3)
    got = _rows(run_selection_stream(spark, flat, glob="*.parquet", watermark="36500 days"))
    assert got == batch


def test_in_order_with_compaction(spark):
    batch = _rows(selection_replay(read_log(spark, SF_SMALL)))
    q = F.ntile(4).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts", "event_id")) - 1
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("chunk", q)
    d = tempfile.mkdtemp(prefix="weblens-ev-")
    import glob
    import shutil
    import time
    flat = tempfile.mkdtemp(prefix="weblens-evflat-")
    for i in range(4):
        ev.filter(F.col("chunk") == i).drop("chunk").coalesce(1).write.parquet(f"{d}/part{i}")
        for f in glob.glob(f"{d}/part{i}/*.parquet"):
            shutil.copy(f, f"{flat}/chunk{i:03d}.parquet")
            time.sleep(0.05)
    got = _rows(run_selection_stream(spark, flat, glob="*.parquet", watermark="1 hour"))
    assert got == batch


def test_late_clear_is_dropped_and_counted(spark):
    """A clear that arrives behind the watermark, after the toggles around it
    were folded, changes nothing and is counted; the rest equals the batch."""
    import datetime as dt
    import os
    import time

    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    t0 = dt.datetime(2024, 1, 1)
    kinds = {"toggle": "click", "clear": "error"}

    def event(i, kind, hours):
        row = {"event_id": i, "ts": t0 + dt.timedelta(hours=hours), "user_id": 1, "event_type": kinds[kind], "props": '{"k": 5}'}
        return tuple(row.get(f.name) for f in schema.fields)

    files = [[event(1, "toggle", 0), event(2, "toggle", 2), event(3, "toggle", 2.1)], [event(4, "toggle", 9), event(5, "toggle", 9.1)], [event(6, "clear", 1)]]
    flat = tempfile.mkdtemp(prefix="weblens-late-")
    for i, rows in enumerate(files):
        out = tempfile.mkdtemp(prefix="weblens-ev-")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(out)
        part = next(f for f in os.listdir(out) if f.endswith(".parquet"))
        with open(f"{out}/{part}", "rb") as a, open(f"{flat}/chunk{i}.parquet", "wb") as b:
            b.write(a.read())
        time.sleep(0.05)
    got = run_selection_stream(spark, flat, glob="*.parquet", watermark="1 hour")
    on_time = spark.createDataFrame(files[0] + files[1], schema)
    assert _rows(got) == _rows(selection_replay(log_from_events(on_time))) == [(1, 5, 5, 1)]
    assert [r.late for r in got.collect()] == [1]


def test_settings_stream_in_any_order(spark):
    """Last writer by event order, whichever micro-batch brings it."""
    from weblens.operators.replay import settings_replay
    from weblens.streaming.settings_stream import run_settings_stream

    want = sorted(tuple(r) for r in settings_replay(read_log(spark, SF_SMALL)).select("tab", "key", "value").collect())
    flat = _split(spark, 2 - F.col("event_id") % 3, 3)
    assert sorted(tuple(r) for r in run_settings_stream(spark, flat, glob="*.parquet").collect()) == want and len({k for _, k, _ in want}) == 8


def test_state_per_element_in_any_order(spark):
    from weblens.streaming.selection_state import run_selection_state

    batch = _rows(selection_replay(read_log(spark, SF_SMALL)))
    flat = _split(spark, F.col("event_id") % 3, 3)
    assert _rows(run_selection_state(spark, flat, glob="*.parquet", watermark="36500 days")) == batch


def test_state_per_element_folds_behind_the_watermark(spark):
    """In order over several micro-batches: what the watermark has passed is folded by timers."""
    from pyspark.sql import Window

    from weblens.streaming.selection_state import run_selection_state

    batch = _rows(selection_replay(read_log(spark, SF_SMALL)))
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn("chunk", F.ntile(4).over(Window.orderBy("ts", "event_id")) - 1)
    d = tempfile.mkdtemp(prefix="weblens-state-")
    for i in range(4):
        out = tempfile.mkdtemp(prefix="weblens-ev-")
        ev.filter(F.col("chunk") == i).drop("chunk").coalesce(1).write.mode("overwrite").parquet(out)
        import glob
        import shutil
        import time
        shutil.copy(glob.glob(f"{out}/*.parquet")[0], f"{d}/chunk{i}.parquet")
        time.sleep(0.05)
    assert _rows(run_selection_state(spark, d, glob="*.parquet", watermark="1 hour")) == batch


class _Value:
    def __init__(self, calls):
        self.v, self.calls = None, calls

    def get(self):
        self.calls.append("get")
        return self.v

    def update(self, v):
        self.calls.append("update")
        self.v = v


class _Map(dict):
    def __init__(self, name, calls):
        super().__init__()
        self.name, self.calls = name, calls

    def getValue(self, k):
        self.calls.append(f"{self.name}.get")
        return self.get(k)

    def updateValue(self, k, v):
        self.calls.append(f"{self.name}.put")
        self[k] = v

    def removeKey(self, k):
        self.calls.append(f"{self.name}.remove")
        del self[k]

    def iterator(self):
        self.calls.append(f"{self.name}.all")
        return iter(list(self.items()))

    def clear(self):
        self.calls.append(f"{self.name}.clear")
        super().clear()


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, name, schema):
        return _Value(self.calls)

    def getMapState(self, name, key, value):
        return _Map(name, self.calls)

    def registerTimer(self, ms):
        self.timers.append(ms)


class _Time:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_state_calls_follow_the_news(spark):
    """A tab has one pending timer however many toggles it has, its elements are read only if it
    has a head, and a timer folds with one look at the new toggles."""
    from collections import Counter

    from pyspark.sql import Row

    from weblens.streaming.selection_state import Selections

    def row(typ, el, sec, eid):
        return Row(type=typ, element=el, tsu=sec * 1_000_000, event_id=eid)

    h = _Handle()
    p = Selections()
    p.init(h)
    out = list(p.handleInputRows((7,), iter([row("toggle", i % 20, 100 + i, i) for i in range(60)] + [row("toggle", None, 99, 99)]), _Time(0)))
    assert [(r.tab, r.element, r.toggles, r.last_id) for r in out] == [(7, i, 3, 40 + i) for i in range(20)]
    assert h.timers == [100_001] and Counter(h.calls) == {"get": 1, "update": 1, "fresh.put": 20}
    h.calls.clear()
    assert list(p.handleExpiredTimer((7,), _Time(150_000), None)) == []
    # toggles from second 150 on are still new: elements 10 to 19
    assert h.timers == [100_001, 150_001] and sorted(k for k, in p.fresh) == list(range(10, 20))
    assert Counter(h.calls) == {"get": 1, "update": 1, "fresh.all": 1, "folded.put": 20, "fresh.put": 10, "fresh.remove": 10}
    h.calls.clear()
    out = list(p.handleInputRows((7,), iter([row("toggle", 3, 200, 100), row("toggle", 3, 200, 100), row("toggle", 4, 10, 101)]), _Time(150_000)))
    assert [tuple(r) for r in out] == [(7, 3, 4, 200_000_000, 100)] and h.timers == [100_001, 150_001]
    assert Counter(h.calls) == {"get": 1, "folded.get": 1, "fresh.get": 1, "fresh.put": 1}
    h.calls.clear()
    out = list(p.handleInputRows((7,), iter([row("clear", 0, 199, 102), row("toggle", 19, 198, 103), row("toggle", 5, 201, 104)]), _Time(150_000)))
    assert {r.element: r.toggles for r in out} == {i: int(i in (3, 5)) for i in range(20)}
    assert len(p.folded) == 0 and sorted(p.fresh) == [(3,), (5,)]
    list(p.handleExpiredTimer((7,), _Time(300_000), None))
    assert len(p.fresh) == 0 and h.timers == [100_001, 150_001, 200_001][:len(h.timers)]
    out = list(p.handleInputRows((7,), iter([row("clear", 0, 400, 105)]), _Time(300_000)))
    assert {(r.element, r.toggles, r.last_ts) for r in out} == {(3, 0, None), (5, 0, None)} and len(p.folded) == 0
