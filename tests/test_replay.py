"""Replay semantics on a hand-written log (sequential walk as the reference)."""

from weblens.operators.replay import inspector_state, selection_replay


def _walk(events):
    sel = {}
    for tab, _ts, _eid, typ, el in sorted(events, key=lambda e: (e[1], e[2])):
        cur = sel.setdefault(tab, [])
        if typ in ("clear", "close"):
            cur.clear()
        elif typ == "remove":
            if el in cur:
                cur.remove(el)
        elif typ == "toggle":
            if el in cur:
                cur.remove(el)
            else:
                cur.append(el)
    return sorted((tab, el, i + 1) for tab, cur in sel.items() for i, el in enumerate(cur))


def test_selection_replay_matches_sequential_walk(spark):
    import datetime as dt
    import random

    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    events = []
    for i in range(400):
        typ = rnd.choices(["toggle", "clear", "remove", "close", "inspector"], [70, 4, 10, 2, 5])[0]
        events.append((rnd.randrange(4), base + dt.timedelta(seconds=rnd.randrange(3000)), i, typ,
                       rnd.randrange(6) if typ in ("toggle", "remove") else None))
    log = spark.createDataFrame(events, "tab long, ts timestamp, event_id long, type string, element long")
    got = sorted((r["tab"], r["element"], r["sel_order"]) for r in selection_replay(log).collect())
    assert got == _walk(events)
    st = {r["tab"]: r["enabled"] for r in inspector_state(log).collect()}
    for tab in st:
        n = sum(1 for e in events if e[0] == tab and e[3] == "inspector")
        assert st[tab] == (n % 2 == 1)
