"""State and windows on streams against brute force."""

import json
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskloom.sources import files
from riskloom.streaming import events as stream
from riskloom.streaming import keyed, monitors, state
from riskloom.streaming.state import Entity, Entries, Exact, LastSeen, Seconds


class Kept:
    """Map state that survives between calls."""

    def __init__(self):
        self.rows = {}

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        self.rows.pop(key, None)


def features_of(rows, calls):
    """Features of one entity's rows, the state stored and read between ``calls`` parts; also the state that is left."""
    seconds, seen, head, out = Kept(), Kept(), {}, []
    for part in calls(rows):
        window = Seconds(head, Entries(seconds), LastSeen(head, Entries(seen)))
        entity = Entity(head, window)
        out += [entity.add(*r) for r in part]
        window.write()
        head = json.loads(json.dumps(head))
    return out, seconds, head


ROWS = st.lists(st.tuples(st.one_of(st.integers(0, 400), st.integers(0, 200_000)), st.sampled_from([0.1, 3e-11, 1e19, -1e19, -0.7, 5e-324, 1e300]),
                          st.sampled_from(["a", "b", None]), st.sampled_from(["m1", "m2", "m3", None, ""])), max_size=40)


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(1, 7))
def test_features_equal_brute_force(rows, size):
    rows = [(float(t), *r) for t, *r in sorted(rows, key=lambda r: r[0])]
    found, _, _ = features_of(rows, lambda r: (r[k:k + size] for k in range(0, len(r), size)))
    for k, (t, *_) in enumerate(rows):
        before = rows[:k + 1]
        within = lambda w: [r for r in before if r[0] >= t - w]
        assert found[k][4:7] == (len(within(300)), len(within(3600)), len(within(86400)))
        assert found[k][7] == float(sum(Fraction(r[1]) for r in within(3600)))
        assert found[k][8] == max(1, len({r[3] for r in before if r[0] > t - 3600 and r[3]}))


def test_state_follows_the_window_not_the_events():
    rows = [(float(t), 1.0, "d", f"m{t % 5000}") for t in range(0, 1_200_000, 60)]
    found, seconds, head = features_of(rows, lambda r: (r[k:k + 700] for k in range(0, len(r), 700)))
    assert found[-1][6] == 1441 and found[-1][8] == 60
    assert len(seconds.rows) <= 1441 // 64 + 2 and head["merchants"] == 60


def test_an_event_reads_little_of_a_wide_window():
    seconds, seen, head, reads = Kept(), Kept(), {}, []
    window = Seconds(head, Entries(seconds), LastSeen(head, Entries(seen)))
    for t in range(20_000):
        window.add(float(t), 1.0, f"m{t}")
    window.write()
    for kept in (seconds, seen):
        kept.getValue = lambda key, kept=kept: reads.append(key) or kept.rows.get(key)
    window = Seconds(head, Entries(seconds), LastSeen(head, Entries(seen)))
    window.add(20_000.0, 1.0, "m20000")
    assert len(reads) <= 8 and max(len(json.loads(v[0])) for v in seen.rows.values()) < 200


def test_exact_sums():
    total = Exact()
    for x in (1e308, 1e308, -1e308, 3e-11, 5e-324, 1e19, -1e19):
        total.add(Exact.of(x))
    assert total.value() == 1e308
    total.add(Exact.of(1e308), -1)
    assert total.value() == 3e-11 and Exact(*json.loads(json.dumps(total.stored()))).value() == 3e-11
    total.add(Exact.of(float("inf")))
    assert total.value() == float("inf")
    total.add(Exact.of(float("nan")))
    assert total.value() != total.value()
    total.add(Exact.of(float("nan")), -1)
    total.add(Exact.of(float("inf")), -1)
    assert total.value() == 3e-11


def test_state_is_forgotten_after_thirty_days():
    (_, _, found), _, _ = features_of([(0.0, 5.0, "d", "m"), (1.0, 9.0, "d", "m"), (3_000_000.0, 7.0, "d", "m")], lambda r: [r])
    assert found[-1] == 0 and found[0] == 1


EVENTS = "entity_id string, transaction_id long, event_time_seconds double, amount double, device_id string, merchant_id string"


def sent(spark, *files_):
    """A stream of one file per trigger from rows (entity, id, seconds)."""
    path, schema = files.scratch(spark, "in"), None
    for rows in files_:
        batch = spark.createDataFrame([(e, i, None if t is None else float(t), 1.0, "d", "m") for e, i, t in rows], EVENTS).withColumn(
            "event_ts", F.timestamp_seconds(F.col("event_time_seconds") + 1_700_000_000)).coalesce(1)
        batch.write.mode("append").parquet(path)
        schema = batch.schema
    return stream.from_table(spark, path, schema)


def test_rows_out_of_order_count_as_in_order(spark):
    """After 1000 and 4000 comes 3000: it is counted at its own time; a row sent again counts once; one without an entity or a time not at all."""
    events = sent(spark, [("a", 1, 1000), ("a", 2, 4000)], [("a", 3, 3000), ("a", 2, 4000), ("b", 9, 3500)], [(None, 8, 3600), ("a", 7, None), ("x", 0, 90_000)])
    found = {r.transaction_id: r.tx_count_1h for r in stream.run(state.live_features(events)).collect()}
    assert found == {1: 1, 3: 2, 2: 3, 9: 1}


def test_opened_windows_expire(spark):
    events = sent(spark, [("a", 1, 0), ("a", 2, 599), ("b", 3, 10)], [("a", 5, 1300), ("a", 4, 650)], [("z", 6, 9000)], [("z", 7, 19_000)])
    path, checkpoint = files.scratch(spark, "out"), files.scratch(spark, "stream")
    stream.start(state.opened_windows(events, 600, 1, "15 minutes"), path, checkpoint=checkpoint).awaitTermination()
    found = {r.transaction_id: (r.window_start, r.window_count, r.over_limit) for r in spark.read.parquet(path).collect()}
    assert found == {1: (0.0, 1, False), 2: (0.0, 2, True), 3: (10.0, 1, False), 4: (650.0, 1, False), 5: (1300.0, 1, False), 6: (9000.0, 1, False)}
    heads = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "head").load()
    assert {r.key.entity_id for r in heads.collect()} == {"z"}


def test_alert_table_takes_an_id_once(spark):
    path = files.scratch(spark, "alerts")
    make = lambda rows: spark.createDataFrame(rows, "id string, v long")
    first = keyed.upsert(path, "id", buckets=4)
    with pytest.raises(ValueError):
        keyed.read(spark, path)
    first(make([("a", 1), ("b", 1), ("b", 1), (None, 5)]), 0)
    first(make([("a", 2), ("c", 2)]), 1)
    first(make([("c", 3), ("d", 3)]), 1)  # a retry of a trigger that is in the manifest
    first(make([]), 2)
    assert {(r.id, r.v) for r in keyed.read(spark, path).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    latest = keyed.upsert(path + "-latest", "id", ["v"], 4)
    latest(make([("a", 2), ("b", 7)]), 0)
    latest(make([("a", 1), ("b", 9)]), 1)
    assert {(r.id, r.v) for r in keyed.read(spark, path + "-latest").collect()} == {("a", 2), ("b", 9)}


def test_a_trigger_that_broke_off_is_not_seen(spark, monkeypatch):
    """Files without a manifest row are not read, and the retry takes their place."""
    path, put = files.scratch(spark, "alerts"), keyed._put
    make = lambda rows: spark.createDataFrame(rows, "id string, v long")
    write = keyed.upsert(path, "id", buckets=2)
    write(make([("a", 1)]), 0)
    monkeypatch.setattr(keyed, "_put", lambda rows, where, *folders: put(rows, where, *folders) if where.endswith("data") else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        write(make([("b", 1), ("c", 1)]), 1)
    assert {r.id for r in keyed.read(spark, path).collect()} == {"a"}
    monkeypatch.setattr(keyed, "_put", put)
    write(make([("b", 1), ("c", 1)]), 1)
    assert {r.id for r in keyed.read(spark, path).collect()} == {"a", "b", "c"}


def test_a_trigger_costs_its_rows_and_not_the_table(spark):
    """Triggers of the same size: what is written in all grows with a logarithm of the triggers, and the first row of an id stays."""
    path = files.scratch(spark, "alerts")
    write, n = keyed.upsert(path, "id", buckets=1), 12
    for k in range(n):
        write(spark.range(k * 100 - 10 * (k > 0), k * 100 + 100).select("id", F.lit(k).alias("v")), k)
    rows = keyed.read(spark, path)
    assert rows.columns == ["id", "v"] and {r.id: r.v for r in rows.collect()} == {i: i // 100 for i in range(100 * n)}
    assert spark.read.parquet(f"{path}/data").count() < 4 * 100 * n  # a rewrite in each trigger writes 6.5 times the table


def test_entities_share_a_few_calls_to_the_state():
    """300 entities of a bucket in one trigger: calls to the state store for the pages, not for each entity; and an entity is forgotten."""
    calls = []

    class Counted(Kept):
        def __getattribute__(self, name):
            if name.endswith(("Value", "Key")) or name in ("get", "update", "clear"):
                calls.append(name)
            return object.__getattribute__(self, name)

        def get(self):
            return self.rows.get("")

        def update(self, value):
            self.rows[""] = value

        def clear(self):
            self.rows.clear()

    class Handle:
        def __init__(self):
            self.state, self.timers = {}, set()

        def getValueState(self, name, *_):
            return self.state.setdefault(name, Counted())

        getMapState = getValueState

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

    class Watermark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    handle, bucket, n = Handle(), state.Features(), 300
    bucket.init(handle)
    row = lambda e, t, i: (0, f"e{e}", None, float(t), i, t * 1_000_000, 1.0, "d", f"m{i}")
    whole = []
    for k, rows in enumerate(([row(e, 10 + e % 7, e) for e in range(n)], [row(e, 3000 + j, 1000 + 100 * e + j) for e in range(n) for j in range(3)],
                              [row(0, 4000 + j, 100_000 + j) for j in range(200)])):
        calls.clear()
        list(bucket.handleInputRows((0,), iter(rows), Watermark(0)))
        at = handle.timers.pop()
        whole += [r for packed in bucket.handleExpiredTimer((0,), Watermark(1_000_000 * (k + 10)), None) for r in zip(*packed)]
        assert len(calls) < 100
    assert len(whole) == n + 3 * n + 200
    names = ["entity_id", "t", "id", "us", *bucket.given, *bucket.made]
    found = {r[2]: dict(zip(names, r)) for r in whole}
    assert found[1002]["tx_count_1h"] == 4 and found[1000 + 100 * 7 + 1]["unique_merchants_1h"] == 3 and found[100_199]["tx_count_24h"] == 204
    assert {k for k in handle.state["seconds"].rows} == {("0|e0",), ("1|e0",), ("2|e0",)}
    at = handle.timers.pop()
    assert not list(bucket.handleExpiredTimer((0,), Watermark(at + 2_000_000), None))
    assert not any(s.rows for s in handle.state.values()) and not handle.timers


def test_few_waiting_rows_stay_in_the_head():
    """Rows of a key in the head until there are more than an entry holds; both are released in order, each event once."""
    class Head(Kept):
        get, clear = (lambda self: self.rows.get("")), (lambda self: self.rows.clear())
        update = lambda self, value: self.rows.update({"": value})

    class Handle:
        def __init__(self):
            self.head, self.waiting, self.timers = Head(), Kept(), []

        getValueState, getMapState = (lambda self, *_: self.head), (lambda self, *_: self.waiting)
        registerTimer, deleteTimer = (lambda self, at: self.timers.append(at)), (lambda self, at: self.timers.remove(at))

    class Watermark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    handle, windows = Handle(), state.OpenedWindows(600, 1)
    windows.init(handle)
    row = Row("entity_id", "event_ts", "event_time_seconds", "transaction_id", "event_us")
    send = lambda *rows: list(windows.handleInputRows(("a",), iter([row("a", None, float(t), i, t * 1_000_000) for t, i in rows]), Watermark(0)))
    send((700, 3), (10, 1)), send((10, 1), (20, 2))
    assert not handle.waiting.rows and handle.timers == [10_000]
    handle.timers.clear()
    assert [(r.transaction_id, r.window_count) for r in windows.handleExpiredTimer(("a",), Watermark(30_000), None)] == [(1, 1), (2, 2)]
    assert handle.timers == [700_000]
    many = [(701 + k, 10 + k) for k in range(2 * state.WAITING)]
    send(*many)
    assert len(handle.waiting.rows) == 3
    handle.timers.clear()
    out = [r.transaction_id for r in windows.handleExpiredTimer(("a",), Watermark(2_000_000), None)]
    assert out == [3, *[i for _, i in many]] and not handle.head.rows and not handle.waiting.rows


def test_late_rows_are_dropped_and_counted(spark):
    schema = "id long, event_ts timestamp, risk_label string"
    path = files.scratch(spark, "in")
    for ids, seconds in (([1, 2], 0), ([3], 50_000), ([4], 60_000), ([5], 10)):
        batch = spark.createDataFrame([(i,) for i in ids], "id long").select(
            "id", F.timestamp_seconds(F.lit(1_700_000_000 + seconds)).alias("event_ts"), F.lit("FRAUD").alias("risk_label"))
        batch.coalesce(1).write.mode("append").parquet(path)
    from pyspark.sql.types import _parse_datatype_string
    windows = monitors.verdict_windows(stream.from_table(spark, path, _parse_datatype_string(schema)))
    out = files.scratch(spark, "out")
    query = stream.start(windows, out)
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1
    assert sorted(r.total for r in spark.read.parquet(out).collect()) == [1, 2]


def test_parse_reports_what_is_wrong(spark):
    lines = ['{"transaction_id":"1","entity_id":"e","amount":2.5,"timestamp":"2024-01-01T00:00:00Z"}', '{"transaction_id":', '{"entity_id":"","amount":1}',
             '{"entity_id":"e","amount":1,"timestamp":"never"}']
    raw = spark.createDataFrame([(x,) for x in lines], "value string").withColumn("arrived_at", F.timestamp_seconds(F.lit(7)))
    rows = stream.parse(raw).collect()
    assert [r.valid for r in rows] == [True, False, False, True]
    assert rows[0].event_ts.timestamp() == 1704067200 and rows[3].event_ts.timestamp() == 7


def test_latest_table_keeps_the_newest_row(spark):
    path, write = files.scratch(spark, "latest"), None
    write = stream.latest_table(path, "k", ["t"])
    make = lambda rows: spark.createDataFrame(rows, "k string, t long, v string")
    write(make([("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z")]), 0)
    write(make([("a", 2, "late")]), 1)
    write(make([("a", 2, "late")]), 1)
    assert {r.k: r.v for r in stream.read_latest(spark, path, "k", ["t"]).collect()} == {"a": "y", "b": "z"}
