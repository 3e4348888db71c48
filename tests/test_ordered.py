"""Streams that fold events in order: late rows, limits of time, states that end, on literal rows."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

from siftlake.streaming import ordered

T0 = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000
US0 = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1e6)


def played(spark, schema, batches, made):
    """What a stream puts out when the batches come one after another; it is stopped and started again between them."""
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    before = {k: spark.conf.get(k, None) for k in ordered.settings(2)}
    for k, v in ordered.settings(2).items():
        spark.conf.set(k, v)
    try:
        spark.createDataFrame([], schema).write.parquet(f"{at}/in")
        out = made(spark.readStream.schema(schema).parquet(f"{at}/in"))
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
            out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{at}/out").collect()), key=ordered.in_order_of)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_an_address_comes_again_exactly_after_its_ttl(spark):
    h = lambda x: T0 + dt.timedelta(hours=x)
    batches = [
        [("a", h(5)), ("a", h(1)), ("b", h(2)), (None, h(3)), ("old", h(10)), ("old", h(9))],  # the earlier one comes later in the batch
        [("a", h(25) - dt.timedelta(microseconds=1)), ("a", h(25)), ("c", None), ("b", h(20))],
        [("a", h(200)), ("late", h(2))],  # 25 h is known, so two hours are long past
        [("z", h(1000))],
    ]
    history = spark.createDataFrame([("old", US0 - 15 * HOUR), ("never", US0 - 100 * HOUR)], "url string, first_us long")
    got = played(spark, "url string, at timestamp", batches, lambda df: ordered.first_of_ttl(df, url="url", at="at", ttl_us=24 * HOUR, late="3 hours", history=history))
    want = [("a", 1), ("a", 25), ("a", 200), ("b", 2), ("old", 9)]
    assert [(u, (us - US0) / HOUR) for u, us in got if u is not None] == want
    assert [us for u, us in got if u is None] == [US0 + 3 * HOUR]  # a null address is one of its own


def played_out(log, timeout, most):
    """The machine row by row."""
    carry, out = None, []
    for us, event in [*log, (1 << 60, "end")]:
        carry, actions = ordered.queue_step(carry, us, event, timeout, most)
        out += [(a, t, n) for t, a, n in actions]
    return out


def test_queue_steps():
    assert played_out([(0, "queued"), (3600, "claimed"), (3700, "acked")], 300, 3) == []  # an hour in the queue is not stale
    assert played_out([(0, "claimed"), (300, "acked")], 300, 3) == [("requeue", 300, 1)]  # at that very moment it is too late
    assert played_out([(0, "claimed"), (299, "acked"), (5000, "claimed"), (5100, "acked")], 300, 3) == []
    stale = [(0, "claimed"), (9000, "claimed"), (20_000, "claimed"), (30_000, "claimed")]
    assert played_out(stale, 300, 3) == [("requeue", 300, 1), ("requeue", 9300, 2), ("requeue", 20_300, 3), ("dead_letter", 30_300, 3)]
    assert played_out([*stale, (40_000, "queued"), (50_000, "claimed")], 300, 3)[-1] == ("requeue", 50_300, 1)  # a dead letter begins anew
    assert played_out([(0, "claimed"), (400, "acked"), (500, "claimed")], 300, 3) == [("requeue", 300, 1), ("requeue", 800, 1)]
    assert played_out([(0, "claimed"), (200, "claimed"), (450, "acked")], 300, 3) == []  # a new claim, a new time
    assert played_out([(0, "acked"), (1, "acked")], 300, 3) == []


def test_queue_machine(spark):
    rng = random.Random(4)
    log = [(f"p{rng.randint(0, 5)}", T0 + dt.timedelta(minutes=rng.randint(0, 3000)), rng.choice(["claimed", "claimed", "acked", "queued"]), n) for n in range(150)]
    batches = [[], [], [("end", T0 + dt.timedelta(days=99), "acked", -1)]]
    for row in log:
        batches[row[1] > T0 + dt.timedelta(minutes=1500)].append(row)
    got = played(spark, "post_id string, at timestamp, event string, n int", batches, lambda df: ordered.queue_machine(df, tie="n", timeout_us=2 * HOUR, most=2, late="2 days"))
    want = []
    for p in {r[0] for r in log}:
        own = [(US0 + int((at - T0).total_seconds()) * 1_000_000, e) for q, at, e, n in sorted(log, key=lambda r: (r[1], r[3])) if q == p]
        want += [(p, us, action, tries) for action, us, tries in played_out(own, 2 * HOUR, 2)]
    assert got == sorted(want) and {r[2] for r in got} == {"requeue", "dead_letter"}


def test_spend_without_a_cap_and_null_costs(spark):
    d = dt.date(2024, 1, 1)
    batches = [[(d, T0, 1, 5), (d, T0, 2, None), (d, T0 + dt.timedelta(hours=1), 3, 7)], [(d + dt.timedelta(9), T0 + dt.timedelta(9), 9, 1)]]
    for cap, want in ((0, [(1, 0, True, None), (2, 5, True, None), (3, 5, True, None)]), (5, [(1, 0, True, None), (2, 5, False, US0), (3, 5, False, US0)])):
        made = lambda df, cap=cap: ordered.spend_cap(df, day="day", at="at", tie="n", micro="micro", cap=cap, late="1 hour")
        assert [(r[2], *r[3:]) for r in played(spark, "day date, at timestamp, n int, micro long", batches, made)] == want


def test_rows_wait_as_one_value_a_bucket():
    """A bucket's rows are bytes in the state, later ones put behind: Spark converts one value, not each row."""
    import pandas as pd

    stored = {}

    class State:
        def __init__(self, name):
            self.name = name

        def exists(self):
            return self.name in stored

        def get(self):
            return stored[self.name]

        def update(self, value):
            assert isinstance(value[0], (bytes, int))
            stored[self.name] = value

        def containsKey(self, key):
            return (self.name, key) in stored

        def getValue(self, key):
            return stored[self.name, key]

        def updateValue(self, key, value):
            assert isinstance(value[0], bytes)
            stored[self.name, key] = value

        def keys(self):
            return [k[1] for k in stored if isinstance(k, tuple)]

        def removeKey(self, key):
            del stored[self.name, key]

    class Handle:
        timers = set()

        def getMapState(self, name, *schemas):
            return State(name)

        getValueState = getMapState

        def registerTimer(self, ms):
            self.timers.add(ms)

    class Time:
        def getCurrentWatermarkInMs(self):
            return 3 * 3_600_000

    def fold(name, carry, rows, until):
        return (len(rows) + (carry or (0,))[0],), [(name[0], us, tie) for us, tie in rows], None

    machine = ordered.InOrder(fold, ["k"], ["k", "us", "tie"], ["k", "n"], ["k", "us", "tie"], 3_600_000)
    machine.init(Handle())
    for rows in ([("a", 5, None), ("b", 7, 1), ("a", HOUR, 2)], [("a", 5, 3), ("a", 2, 4), (None, 9, 5), ("a", 5 * HOUR, 6), ("a", None, 7)]):
        list(machine.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["k", "us", "tie"])]), None))
    (got,) = machine.handleExpiredTimer((1,), Time(), None)
    assert sorted(map(tuple, got.values.tolist()), key=ordered.in_order_of) == [(None, 9, 5), ("a", 2, 4), ("a", 5, None), ("a", 5, 3), ("a", HOUR, 2), ("b", 7, 1)]
    assert got[got.k == "a"].values.tolist() == [["a", 2, 4], ["a", 5, None], ["a", 5, 3], ["a", HOUR, 2]]  # in order, nulls first
    assert machine._carried() == {("a",): (None, (4,)), ("b",): (None, (1,)), (None,): (None, (1,))} and machine.waiting.keys() == [(5,)]
    assert {h * 3_600_000 for h in (1, 2, 6)} == Handle.timers
